"""N-gram Jaccard join of word-shingle sets, with set relations to skip work.

Links are exact: two sets link if 100 * |A & B| >= percent * |A | B|. The join works on classes of equal sets.

1. Frequencies. Every task sends its distinct shingles, counted, in blocks of one hash range; the block's owner adds
   them up. There are as many ranges as keep an owner's share of the corpus at RANGE_BYTES of text or so. What goes to
   all tasks is of fixed size: a bitmap of the shingles met twice or more, and the counts of the MAX_FREQUENT most
   frequent. Both only order the shingles, so their limits cost speed, never links.
2. Index. Shingles are ordered: met once, then more often, then by count. A set's prefix in that order is as long as
   the threshold asks for, and its shingles that other sets may share become index entries (shingle, position, size).
   A text with a tenth of its own shingles or so has no entry at all.
3. Answers from similar sets. In each list (shingle and size class) the least set is the pivot; each set is compared
   with the pivots of its own and the neighbouring size classes. Sets found in one component this way need no further
   comparison with one another: their answer follows from the pivot's. Differences to the pivot are kept: Jaccard
   distance is a metric, so |d(x, p) - d(y, p)| over the limit rules out a link of x and y.
4. Skipping. Lists that still join different components are cut into blocks by size class and position. A pair of
   blocks is skipped as a whole if its positions leave too few shingles to share or it lies in one component; what is
   left of the others is compared, each pair at its first common shingle. A pair comes out of the join only if its
   sets' parity bits allow a link: each shingle flips one of PARITY_BITS bits, so sets differ in as many shingles as
   their bits do at least.
5. Components of all links, by alternating stars.

Defined cases: texts without words and null texts have the empty set and link with nothing. A text of fewer words than
a shingle is one shingle. Rows of the same doc_id are one document to the graph. Rows with a null doc_id get their set
size and a null component. Repeated rows share a class. Other columns stay out; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, saved, sent_to_tasks, shingle_sets, string_bytes, table, work_dir
from .graph import connected_components

WORDS, PERCENT = 3, 90
#: bits of the bitmap of repeated shingles, number of counts sent to all tasks, and the least count worth sending
BITMAP_BITS, MAX_FREQUENT, FREQUENT = 1 << 27, 1_000_000, 8
FLUSH = 1_000_000
#: bytes of text whose shingles fall into one hash range, all ranges being alike
RANGE_BYTES = 32 << 20
MAX_EARLIER = 256
POSITIONS = 8
#: bits of a set's parity vector, 64 to a long
PARITY_BITS = 512


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _key(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What a shingle is counted by: its hash range and 32 more bits."""
    return (_bucket(hashes, buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Frequencies:
    """The order of shingles: 0 if met once, 1 if more often, else the count of a frequent one."""

    def __init__(self, buckets: int, segment: int, bitmap: np.ndarray, keys: np.ndarray, counts: np.ndarray):
        self.buckets, self.segment, self.bitmap, self.keys, self.counts = buckets, segment, bitmap, keys, counts

    def level(self, hashes: np.ndarray) -> np.ndarray:
        key = _key(hashes, self.buckets)
        bit = (key >> np.uint64(32)) * np.uint64(self.segment) + (((key & np.uint64(0xFFFFFFFF)) * np.uint64(self.segment)) >> np.uint64(32))
        out = (self.bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1
        out = out.astype(np.int64)
        more = np.flatnonzero(out)
        if len(more) and len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key[more]), len(self.keys) - 1)
            known = self.keys[at] == key[more]
            out[more[known]] = self.counts[at[known]]
        return out


def count_shingles(docs: DataFrame, words: int, work: str) -> Frequencies:
    """Frequencies over all documents (column `text`)."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    segment = max(64, BITMAP_BITS // buckets // 8 * 8)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            keys, counts = np.unique(_key(np.concatenate(held), buckets), return_counts=True)
            edges = np.searchsorted(keys >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            rows = []
            for i in np.flatnonzero(np.diff(edges)):
                mine, n = keys[edges[i] : edges[i + 1]].astype(np.uint32), counts[edges[i] : edges[i + 1]]
                rows.append((int(i), mine[n == 1].tobytes(), mine[n > 1].tobytes(), n[n > 1].astype(np.uint32).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["bucket", "once", "more", "times"])

        held, total = [], 0
        for batch in batches:
            for one in shingle_sets(*string_bytes(batch.column(0)), words):
                held.append(one)
                total += len(one)
                if total > FLUSH:
                    yield flush(held)
                    held, total = [], 0
        if total:
            yield flush(held)

    def owner(rows: pa.Table) -> pa.Table:
        def joined(name: str) -> np.ndarray:
            return np.frombuffer(b"".join(rows[name].to_pylist()), np.uint32)

        once, more = joined("once"), joined("more")
        keys, counts = _add_up(np.concatenate([once, more]), np.concatenate([np.ones(len(once), np.int64), joined("times").astype(np.int64)]))
        bits = np.zeros(segment, bool)
        bits[((keys[counts > 1].astype(np.uint64) * np.uint64(segment)) >> np.uint64(32)).astype(np.int64)] = True
        often = counts >= FREQUENT
        bucket = rows["bucket"][0].as_py()
        row = [pa.array([bucket]), pa.array([np.packbits(bits, bitorder="little").tobytes()]), pa.array([keys[often].astype(np.int64)], pa.list_(pa.int64())), pa.array([counts[often]], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(row, ["bucket", "bits", "tokens", "counts"])

    sent = docs.select("text").mapInArrow(parts, "bucket long, once binary, more binary, times binary")
    owned = saved(sent.groupBy("bucket").applyInArrow(owner, "bucket long, bits binary, tokens array<long>, counts array<long>"), f"{work}/frequencies")
    often = owned.select("bucket", F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select((F.col("bucket") * 2**32 + F.col("x.tokens")).alias("key"), F.col("x.counts").alias("n"))
    # the least count that MAX_FREQUENT shingles reach at most, from an exact histogram by size class
    sizes = {r["size"]: r["n"] for r in often.groupBy(F.floor(F.log2("n") * 16).alias("size")).agg(F.count("*").alias("n")).collect()}  # 1,000 classes
    least, total = 0.0, 0
    for size in sorted(sizes, reverse=True):
        if (total := total + sizes[size]) > MAX_FREQUENT:
            least = size + 1
            break
    found = often.where(F.floor(F.log2("n") * 16) >= least).toArrow()  # MAX_FREQUENT rows at most
    keys = found["key"].to_numpy().astype(np.uint64)
    order = np.argsort(keys)
    bitmap = np.zeros(buckets * segment // 8, np.uint8)
    for row in owned.select("bucket", "bits").toLocalIterator():  # BITMAP_BITS in all
        bitmap[row["bucket"] * segment // 8 :][: segment // 8] = np.frombuffer(row["bits"], np.uint8)
    return Frequencies(buckets, segment, bitmap, keys[order], found["n"].to_numpy().astype(np.int64)[order])


def needed(n, percent: int):
    """The least |A & B| for sets whose sizes sum to n."""
    return -(-percent * n // (100 + percent))


SETS = "doc_id long, n long, set_1 long, set_2 long, tokens array<long>, places array<int>, shingles array<long>, parity array<long>"


def parity(one: np.ndarray) -> np.ndarray:
    """Which of PARITY_BITS bits an odd number of the set's shingles fall on."""
    odd = np.bincount((one % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def index_sets(docs: DataFrame, words: int, percent: int, shared: Broadcast) -> DataFrame:
    """Each document's set size, set hash and index entries; the whole set too if it has any entry. shared: the Frequencies."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequencies = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, one in zip(batch.column(0).to_pylist(), shingle_sets(*string_bytes(batch.column(1)), words), strict=True):
                n = len(one)
                low = int(np.bitwise_xor.reduce(mix(one))) if n else 0
                high = int(mix(one ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)) if n else 0
                level = frequencies.level(one)
                # partners have percent % of the size at least, so this many shingles may be missing
                prefix = n - -(-percent * n // 100) + 1 if n else 0
                single = int((level == 0).sum())
                entry: tuple = ([], [], None, None)
                if single < prefix:
                    several = np.flatnonzero(level > 0)
                    several = several[np.lexsort((one[several], level[several]))][: prefix - single]
                    entry = (one[several].view(np.int64), np.arange(single, single + len(several), dtype=np.int32), one.view(np.int64), parity(one))
                rows.append((doc, n, low - (1 << 64) if low >> 63 else low, high - (1 << 64) if high >> 63 else high, *entry))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n", "set_1", "set_2", "tokens", "places", "shingles", "parity"])

    return docs.select("doc_id", "text").mapInArrow(task, SETS)


def _compared(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, shared, n_a, n_b, linked): the pairs of classes with the size of their intersection."""
    one = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    two = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    found = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("shared"))
    return found.withColumn("linked", 100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))


def _may_link(n_a: Column, n_b: Column, left_a: Column, left_b: Column, percent: int) -> Column:
    """Whether sets of these sizes can share enough if no more than the given numbers are left to share."""
    least = F.ceil(percent * (n_a + n_b) / (100 + percent) - F.lit(1e-9))
    return F.least(left_a, left_b) >= least


def _near_parity(percent: int) -> Column:
    """Whether the parities leave room for a link: |A ^ B| = n_1 + n - 2 |A & B| is no less than the bits that differ."""
    differ = sum((F.bit_count(F.col("parity_1")[i].bitwiseXOR(F.col("parity")[i])) for i in range(PARITY_BITS // 64)), F.lit(0))
    least = F.ceil(percent * (F.col("n_1") + F.col("n")) / (100 + percent) - F.lit(1e-9))
    return differ <= F.col("n_1") + F.col("n") - 2 * least


def similar_components(docs: DataFrame, work: str, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    with sent_to_tasks(rows.sparkSession, count_shingles(rows, words, work)) as shared:  # of fixed size
        sets = saved(index_sets(rows, words, percent, shared), f"{work}/sets")
    named = sets.where("n > 0 and doc_id is not null")
    # a table, so that the joins below deal by all their keys and copies of one text do not meet in one task
    reps = saved(named.groupBy("set_1", "set_2", "n").agg(F.min("doc_id").alias("rep")), f"{work}/reps")
    first = reps.select("set_1", "set_2", "n", F.col("rep").alias("doc_id"), "rep")
    classes = saved(named.where("shingles is not null").join(first, ["set_1", "set_2", "n", "doc_id"]).select("rep", "n", "tokens", "places", "shingles", "parity"), f"{work}/classes")

    # a little wider than the ratio of linked sizes, so that rounding never puts a class between them
    size_class = F.floor(F.log(F.col("n")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    entries = classes.select("rep", "n", size_class.alias("size"), "tokens", F.posexplode(F.arrays_zip("tokens", "places")).alias("pos", "e"))
    # a long set's later entries go without the earlier ones: their pairs may be met more than once
    earlier = F.when(F.col("pos") <= MAX_EARLIER, F.slice("tokens", 1, F.col("pos")))
    entries = entries.select(F.col("e.tokens").alias("token"), F.col("e.places").alias("place"), "rep", "n", "size", earlier.alias("earlier"))

    # answers by pivots
    pivots = entries.groupBy("token", "size").agg(F.min("rep").alias("pivot"), F.count("*").alias("sets"))
    near = pivots.select("token", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "pivot")
    stars = entries.join(near, ["token", "size"]).where("rep <> pivot")
    stars = stars.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()
    answers = saved(_compared(stars, classes, percent), f"{work}/answers")
    components = connected_components(answers.where("linked").select("a", "b"), f"{work}/stars")
    components = saved(components, f"{work}/components")

    # lists that still join several components
    own = entries.join(components.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = own.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    open_lists = saved(own.join(mixed, "token").join(classes.select("rep", "parity"), "rep").withColumn("part", F.floor(F.col("place") * POSITIONS / F.greatest(F.col("n") * (100 - percent) / 100, F.lit(1.0))).cast("int")), f"{work}/open")
    final = components
    if not open_lists.isEmpty():
        more = saved(_links_across(open_lists, answers, classes, percent), f"{work}/more")
        if not more.isEmpty():
            final = connected_components(components.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more), f"{work}/final")
    labels = final.select(F.col("node").alias("rep"), "component")
    known = reps.join(labels, "rep", "left").select("set_1", "set_2", "n", F.coalesce("component", "rep").alias("component_id"))
    out = sets.select("doc_id", "n", "set_1", "set_2").join(known, ["set_1", "set_2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _links_across(open_lists: DataFrame, answers: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The links between sets of different components: blocks of the lists that cannot be skipped, then their pairs."""
    blocks = open_lists.groupBy("token", "size", "part").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min(F.col("n")).alias("n_low"), F.max(F.col("n") - F.col("place")).alias("left"))
    x, y = blocks.alias("x"), blocks.alias("y")
    ordered = (F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.part") <= F.col("y.part")))
    several = (F.col("x.low") != F.col("y.low")) | (F.col("x.high") != F.col("y.high")) | (F.col("x.low") != F.col("x.high"))
    kept = x.join(y, F.col("x.token") == F.col("y.token")).where(
        ordered & (F.col("y.size") - F.col("x.size") <= 1) & several & _may_link(F.col("x.n_low"), F.col("y.n_low"), F.col("x.left"), F.col("y.left"), percent)
    )
    kept = kept.select(F.col("x.token").alias("token"), F.col("x.size").alias("size"), F.col("x.part").alias("part"), F.col("y.size").alias("size_2"), F.col("y.part").alias("part_2"))
    left = kept.join(open_lists, ["token", "size", "part"]).select("token", F.col("size_2").alias("size"), F.col("part_2").alias("part"), F.col("rep").alias("rep_1"), F.col("n").alias("n_1"), F.col("place").alias("place_1"), F.col("component").alias("component_1"), F.col("earlier").alias("earlier_1"), F.col("parity").alias("parity_1"))
    # only at the first shingle of both: the bound on what is left to share holds there, and the pair is met once
    met = F.coalesce(F.arrays_overlap("earlier_1", "earlier"), F.lit(False))
    pairs = left.join(open_lists, ["token", "size", "part"]).where(
        (F.col("component_1") != F.col("component")) & _near_parity(percent) & ~met & _may_link(F.col("n_1"), F.col("n"), F.col("n_1") - F.col("place_1"), F.col("n") - F.col("place"), percent)
    )
    pairs = pairs.select(F.least("rep_1", "rep").alias("a"), F.greatest("rep_1", "rep").alias("b")).distinct()
    pairs = pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")
    return _compared(_not_apart(pairs, answers, percent), classes, percent).where("linked").select("a", "b")


def _not_apart(pairs: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Pairs that no common pivot rules out: the distances to a pivot differ by no more than the limit."""
    distance = 1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))
    known = answers.select(F.col("a").alias("pivot"), F.col("b").alias("rep"), distance.alias("d"))
    # one pivot for each set: the one that it was compared with first by number
    one = known.groupBy("rep").agg(F.min(F.struct("pivot", "d")).alias("p"))
    left = one.select(F.col("rep").alias("a"), F.col("p.pivot").alias("pivot_a"), F.col("p.d").alias("d_a"))
    right = one.select(F.col("rep").alias("b"), F.col("p.pivot").alias("pivot_b"), F.col("p.d").alias("d_b"))
    apart = (F.col("pivot_a") == F.col("pivot_b")) & (F.abs(F.col("d_a") - F.col("d_b")) > (1 - percent / 100) + 1e-9)
    return pairs.join(left, "a", "left").join(right, "b", "left").where(~F.coalesce(apart, F.lit(False))).select("a", "b")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), work_dir(spark, "jaccard-join"))


def stage_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five words, 80 %): the one with the least id, an id being less than none.

    Rows are told apart by their place in a written copy of the table, so no two can be taken for one; rows that share
    an id but no text are documents of their own, and of equal rows one stays. Rows without words are near nothing and
    all stay. Columns of the table may have any name.
    """
    work = work_dir(spark, "jaccard-stage")
    rows = saved(docs.select(F.struct("*").alias("row")).withColumn("own", F.monotonically_increasing_id()), f"{work}/rows")
    texts = rows.select("own", F.col("row.text").cast("string").alias("text"))
    found = similar_components(texts, f"{work}/join", words=5, percent=80, key="own").where("n_shingles > 0")
    found = saved(found.select(F.col("doc_id").alias("own"), "component_id"), f"{work}/found")
    ids = rows.select("own", F.col("row.doc_id").alias("doc_id"))
    first = found.join(ids, "own").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "own")).alias("first"))
    gone = found.join(saved(first, f"{work}/first"), "component_id").where(F.col("own") != F.col("first.own")).select("own")
    return rows.join(gone, "own", "left_anti").select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
