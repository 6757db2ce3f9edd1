"""Entity resolution: names, slugs, boards, URL candidates."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.country import fold
from ..sources.work import work_dir

#: fixed values: words that name the legal form of a company
LEGAL_WORDS = ("inc", "incorporated", "llc", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "ag", "kg", "sa", "sas", "sarl", "srl", "spa", "bv", "nv", "ab", "as", "oy", "plc", "pty", "pte", "kk", "group", "holding", "holdings")
SHORT_NAME, FUZZY_FROM = 4, 0.92
SHARED_TOKEN, SHARED_PREFIX = 4, 5
SCORE_ENOUGH, SCORE_LEAD = 70, 20


def normalize_name(name: Column, legal: Sequence[str] = LEGAL_WORDS) -> Column:
    words = F.split(fold(F.replace(name, F.lit("&"), F.lit(" and "))), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & (w != "and") & ~w.isin(*legal)), " ")


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two names, 0 to 1, by matching blocks."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


def similar_names(ours: DataFrame, theirs: DataFrame, a: str, b: str, least: float) -> DataFrame:
    """(columns of both, r): pairs whose texts a and b are `least` (over 0) alike at least. No column name may be in both.

    Texts of together n characters that are so alike differ by (1 - least) * n inserted or left-out characters at most.
    So of b cut into one piece more than that, some piece stands in a as it is, and moved by no more than the characters
    that are in or out before it. Candidates share the length of b, a piece, its number and a place that such a move allows.
    """
    # floor, with room for what the similarity's own division rounds
    differing = lambda n: F.floor((1 - least) * n + 1e-6).cast("int")
    longest = lambda n: F.floor(n * (2 - least) / least + 1e-6).cast("int")
    pieces = lambda n: differing(n + longest(n)) + 1
    starts = lambda n, i: F.floor(i * n / pieces(n)).cast("int")
    piece = lambda text, n, i, moved: F.substr(text, starts(n, i) + moved + 1, starts(n, i + 1) - starts(n, i))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), pieces(n) - 1))

    x, y, n, i = F.col(a), F.col(b), F.col("__n"), F.col("__i")
    held = theirs.withColumn("__n", F.length(y)).withColumn("__i", numbers(n)).withColumn("__piece", piece(y, n, i, F.lit(0)))
    lengths = F.sequence(F.ceil(F.length(x) * least / (2 - least) - 1e-6).cast("int"), longest(F.length(x)))
    # names are short, but each is asked for by many pieces: the rows are dealt by number, since their size would put them in one task
    dealt = ours.repartition(int(ours.sparkSession.conf.get("spark.sql.shuffle.partitions")), a)
    asked = dealt.withColumn("__n", F.explode(lengths)).withColumn("__out", differing(F.length(x) + n)).withColumn("__i", numbers(n))
    # moved by m, a has |m| differing characters before the piece, and what is left of the lengths' difference after it
    more = F.length(x) - n
    moves = F.sequence(F.ceil((more - F.col("__out")) / 2).cast("int"), F.floor((more + F.col("__out")) / 2).cast("int"))
    inside = lambda m: (starts(n, i) + m >= 0) & (starts(n, i + 1) + m <= F.length(x))
    found = F.transform(F.filter(moves, inside), lambda m: piece(x, n, i, m))
    asked = asked.where(F.abs(more) <= F.col("__out")).withColumn("__piece", F.explode(F.array_distinct(found))).drop("__out")
    near = asked.join(held.hint("merge"), ["__n", "__i", "__piece"]).select(*ours.columns, *theirs.columns).distinct()
    return near.withColumn("r", ratio(x, y)).where(F.col("r") >= least)


def match_names(incoming: DataFrame, known: DataFrame, name: str = "name", known_name: str = "name", fuzzy: float = FUZZY_FROM) -> DataFrame:
    """(name, matched): the known name of each distinct incoming one, null if there is none.

    Equal names first, then token subsets, then a known one-word name that starts the incoming one, then similar ones,
    the best by rank, similarity and least name. Candidates come from equi-joins: on the rarest token of the inner name
    for subsets, on the first token, and for similar names on a piece of the known one at about its place.
    """
    given = incoming.select(F.col(name).alias("given")).distinct().select("given", normalize_name(F.col("given")).alias("n"))
    # tables, since every stage reads both: a plan that works them out for each is more than a small driver holds
    index = _stored(known.select(normalize_name(F.col(known_name)).alias("k"), F.col(known_name).alias("shown")).where("k <> ''").groupBy("k").agg(F.min("shown").alias("shown")))
    met = _stored(given.join(index.hint("merge"), F.col("n") == F.col("k"), "left").select("given", "n", "shown"))
    exact = met.select("given", "shown", F.when(F.col("shown").isNotNull(), 3).otherwise(-1).alias("rank"), F.lit(1.0).alias("r"))
    rest = met.where(F.col("shown").isNull() & (F.length("n") > SHORT_NAME)).select("given", "n")
    long = index.where(F.length("k") > SHORT_NAME).select("shown", "k")
    words = lambda text: F.array_distinct(F.split(text, " "))
    # of two names, one inside the other, the one inside has its rarest word in both: the index holds that word alone
    ours = rest.where(F.size(words("n")) >= 2).select("given", "n", F.explode(words("n")).alias("word"))
    theirs = long.where(F.size(words("k")) >= 2).select("shown", "k", F.explode(words("k")).alias("word"))
    often = theirs.groupBy("word").agg(F.count("*").alias("often"))

    def rarest(names: DataFrame, *columns: str) -> DataFrame:
        return names.join(often.hint("merge"), "word", "left").groupBy(*columns).agg(F.min_by("word", F.struct(F.coalesce("often", F.lit(0)), "word")).alias("word"))

    inside = lambda short, long: F.size(F.array_except(words(short), words(long))) == 0
    known_in_given = ours.join(rarest(theirs, "shown", "k").hint("merge"), "word").where(inside("k", "n"))
    given_in_known = theirs.join(rarest(ours, "given", "n").hint("merge"), "word").where(inside("n", "k"))
    subsets = known_in_given.select("given", "shown").union(given_in_known.select("given", "shown")).select("given", "shown", F.lit(2).alias("rank"), F.lit(1.0).alias("r"))
    leading = rest.join(long.where(F.size(words("k")) == 1).hint("merge"), F.substring_index("n", " ", 1) == F.col("k")).select("given", "shown", F.lit(1).alias("rank"), F.lit(1.0).alias("r"))

    similar = similar_names(rest, long, "n", "k", fuzzy).select("given", "shown", F.lit(0).alias("rank"), "r")
    best = exact.union(subsets).union(leading).union(similar).groupBy("given").agg(F.min(F.struct(-F.col("rank"), -F.col("r"), "shown")).alias("b"))
    return best.select(F.col("given").alias(name), F.col("b.shown").alias("matched"))


def related(tokens: Column, others: Column) -> Column:
    """Whether a token of one list equals, contains or shares a prefix with one of the other."""

    def pair(a: Column, b: Column) -> Column:
        short, long = F.least(F.length(a), F.length(b)), F.when(F.length(a) >= F.length(b), a).otherwise(b)
        inner = F.when(F.length(a) >= F.length(b), b).otherwise(a)
        return (a == b) | ((short >= SHARED_TOKEN) & F.contains(long, inner)) | ((short >= SHARED_PREFIX) & (F.left(a, F.lit(SHARED_PREFIX)) == F.left(b, F.lit(SHARED_PREFIX))))

    return F.exists(tokens, lambda a: F.exists(others, lambda b: pair(a, b)))


def related_companies(bindings: DataFrame, companies: DataFrame, key: str, owner: str, tokens: str, company: str, company_tokens: str) -> DataFrame:
    """(key, own_related, other): whether a binding is related to its owner, and the least other company that it is related to.

    bindings: key, owner, tokens; companies: company, company_tokens. Related is as `related` says. Tokens are matched as
    tokens, each once: equal ones and ones of an equal beginning by that, one inside another by the rarest run of
    SHARED_TOKEN characters of the shorter, so candidates follow the tokens, not the pairs of rows. Of the companies that
    have a token only the two least go on, which is all that the least other one needs.
    """
    ours = bindings.select(key, owner, F.explode(tokens).alias("t")).distinct()
    theirs = companies.select(F.col(company).alias("__c"), F.explode(company_tokens).alias("u")).distinct()
    # the two least companies of a token, and of a beginning
    one = theirs.groupBy("u").agg(F.min("__c").alias("low"))
    two = theirs.join(one, "u").where(F.col("__c") > F.col("low")).groupBy("u").agg(F.min("__c").alias("second"))
    known = one.join(two, "u", "left")
    t, u = ours.select("t").distinct(), known.select("u")
    equal = t.join(known, F.col("t") == F.col("u")).select("t", "low", "second")
    starts = known.where(F.length("u") >= SHARED_PREFIX).select(F.left("u", F.lit(SHARED_PREFIX)).alias("p"), F.explode(F.array_compact(F.array("low", "second"))).alias("c")).distinct()
    first = starts.groupBy("p").agg(F.min("c").alias("low"))
    after = starts.join(first, "p").where(F.col("c") > F.col("low")).groupBy("p").agg(F.min("c").alias("second"))
    prefixed = t.where(F.length("t") >= SHARED_PREFIX).withColumn("p", F.left("t", F.lit(SHARED_PREFIX))).join(first.join(after, "p", "left"), "p").select("t", "low", "second")

    def grams(frame: DataFrame, name: str) -> DataFrame:
        places = F.sequence(F.lit(1), F.length(name) - SHARED_TOKEN + 1)
        return frame.where(F.length(name) >= SHARED_TOKEN).select(name, F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(F.col(name), i, F.lit(SHARED_TOKEN))))).alias("g"))

    def inside(short: DataFrame, a: str, long: DataFrame, b: str) -> DataFrame:
        """(a, b): tokens of one side that stand inside longer ones of the other."""
        held = grams(long, b)
        often = held.groupBy("g").agg(F.count("*").alias("often"))
        rarest = grams(short, a).join(often, "g", "left").groupBy(a).agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g")).alias("x")).where("x.often > 0")
        return rarest.select(a, F.col("x.g").alias("g")).join(held, "g").where((F.length(a) < F.length(b)) & F.contains(F.col(b), F.col(a))).select("t", "u")

    nested = inside(t, "t", u, "u").unionByName(inside(u, "u", t, "t")).distinct().join(known, "u").select("t", "low", "second")
    met = equal.unionByName(prefixed).unionByName(nested).select("t", F.explode(F.array_compact(F.array("low", "second"))).alias("c")).distinct()
    least = met.groupBy("t").agg(F.min("c").alias("low"))
    next_ = met.join(least, "t").where(F.col("c") > F.col("low")).groupBy("t").agg(F.min("c").alias("second"))
    other = ours.join(least.join(next_, "t", "left"), "t").groupBy(key, owner).agg(F.min(F.when(~F.col("low").eqNullSafe(F.col(owner)), F.col("low")).otherwise(F.col("second"))).alias("other"))
    own = bindings.join(companies.select(F.col(company).alias(owner), F.col(company_tokens).alias("__own")), owner, "left")
    said = own.select(key, owner, F.coalesce(related(F.col(tokens), F.col("__own")), F.lit(False)).alias("own_related"))
    other = other.select(F.col(key).alias("__key"), F.col(owner).alias("__owner"), "other")
    return said.join(other, (F.col(key) == F.col("__key")) & F.col(owner).eqNullSafe(F.col("__owner")), "left").select(key, owner, "own_related", "other")


def candidate_score(status: Column, error: Column, guessed: Column, job_links: Column, board: Column, supported: Column, words: Column, named: Column, storefront: Column, login: Column) -> Column:
    """Additive score of a URL candidate, none below 0."""
    score = F.when(supported, 60).when(board, 25).otherwise(0) + F.least(job_links * 4, F.lit(40)) + F.when(words, 10).otherwise(0) + F.when(named, 15).otherwise(0)
    score = score - F.when(storefront, 30).otherwise(0) - F.when(login, 40).otherwise(0)
    return F.when(error.isNotNull() | status.isNull() | (status != 200) | (guessed & (job_links <= 0)), 0).otherwise(F.greatest(score, F.lit(0)))


def confidence(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 35, "medium").when(score > 0, "low").otherwise("none")


def best_candidates(rows: DataFrame, key: str, place: str, score: str, url: str) -> DataFrame:
    """Each key's best candidate: tried in order until one is good enough, the first of equals."""
    good = rows.groupBy(key).agg(F.min(F.when(F.col(score) >= SCORE_ENOUGH, F.col(place))).alias("__stop"))
    tried = rows.join(good, key).where(F.col("__stop").isNull() | (F.col(place) <= F.col("__stop")))
    return tried.groupBy(key).agg(F.min_by(F.struct(score, url), F.struct(-F.col(score), place)).alias("b"), F.count("*").alias("tried")).select(key, "tried", f"b.{score}", f"b.{url}")


def brand_representatives(rows: DataFrame, url: str, root: Column, name: str) -> DataFrame:
    """One row for each (url, root): the name without brackets, then the shortest, then the least."""
    order = F.struct(F.contains(F.col(name), F.lit("(")), F.length(normalize_name(F.col(name))), F.length(name), name)
    return rows.withColumn("__root", root).groupBy(url, "__root").agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def _stored(rows: DataFrame) -> DataFrame:
    """The rows as a table of the shared work folder, so that a round does not plan or run the ones before it again."""
    path = work_dir(rows.sparkSession, "claims")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def claim_boards(companies: DataFrame, order: str, url: str, board: str) -> DataFrame:
    """(order, claimed): in order, a company whose URL or board an earlier claimer holds is skipped and claims nothing.

    Equal to going through them one by one: in each round those that are first among the undecided for both their URL
    and their board claim, and whoever shares either with a claimer is skipped. A blank URL is one URL, a blank board
    none. Rounds follow the longest chain of dependent choices; each writes what is left as a table.
    """
    rows = companies.select(order, F.lower(F.trim(F.coalesce(F.col(url), F.lit("")))).alias("u"), F.nullif(F.lower(F.trim(F.col(board))), F.lit("")).alias("b"))
    undecided, claimed = rows, None
    while True:  # each round decides the first row that is left, at least
        first_u = undecided.groupBy("u").agg(F.min(order).alias("mu"))
        first_b = undecided.where("b is not null").groupBy("b").agg(F.min(order).alias("mb"))
        seen = undecided.join(first_u, "u").join(first_b, "b", "left")
        new = seen.where((F.col(order) == F.col("mu")) & (F.col("b").isNull() | (F.col(order) == F.col("mb")))).select(order, "u", "b")
        new = _stored(new)
        claimed = new if claimed is None else claimed.unionByName(new)
        undecided = undecided.join(new.select("u"), "u", "left_anti").join(new.where("b is not null").select("b").distinct(), "b", "left_anti")
        undecided = _stored(undecided)
        if undecided.isEmpty():
            return companies.select(order).join(claimed.select(order, F.lit(True).alias("claimed")), order, "left").fillna(False, ["claimed"])
