"""The keyword automaton and its rules against one pattern a category, case by case."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from listwright.operators import keywords as K

FOLDER = "/root/testdata/sf0.001"


def pattern(words):
    ordered = sorted(words, key=lambda w: (-len(w), w))
    return re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ordered)) + r")(?:s|es)?(?!\w)")


def by_patterns(taxonomy, text):
    """(category, tier): distinct matches of one pattern for each."""
    low, out = text.lower(), {}
    anchors = [m.span() for m in pattern(taxonomy.anchors).finditer(low)] if taxonomy.anchors else []
    for tier, by in (("strong", taxonomy.strong), ("weak", taxonomy.weak)):
        for category, words in by.items():
            found = [m for m in pattern(words).finditer(low)] if words else []
            if category in taxonomy.anchored:
                found = [m for m in found if any(a >= m.start() - K.WINDOW and b <= m.end() + K.WINDOW for a, b in anchors)]
            if found:
                out[category, tier] = {m[0] for m in found}
    return out


def random_taxonomy(rng, words):
    phrase = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([1, 1, 1, 2, 3])))
    names = [f"c{i}" for i in range(12)]
    return K.Taxonomy({n: tuple({phrase() for _ in range(4)}) for n in names}, {n: tuple({phrase() for _ in range(3)}) for n in names}, tuple({phrase() for _ in range(3)}), frozenset(names[:4]), frozenset(names[4:5]))


def test_evidence_of_all_tables(spark):
    """Every document and part, under taxonomies of words and phrases of their own."""
    rng = random.Random(1)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select(F.col("doc_id").alias("k"), "text")
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").select(F.col("p_partkey").alias("k"), F.concat_ws(" - ", "p_name", "p_type", "p_brand").alias("text"))
    for rows, least in ((docs, 400), (parts, 200)):
        texts = {r["k"]: r["text"] for r in rows.collect()}
        words = sorted({w for t in texts.values() for w in re.findall(r"\w+", t.lower())[:30]})
        common = sorted(words, key=lambda w: -sum(w in t for t in list(texts.values())[:50]))[:60]
        taxonomy = random_taxonomy(rng, common)
        got = {(r["k"], r["category"], r["tier"]): set(r["hits"]) for r in K.evidence(rows, taxonomy, ["k"], "text").collect()}
        wanted = {(k, *key): v for k, t in texts.items() for key, v in by_patterns(taxonomy, t).items()}
        assert got == wanted and len(got) >= least


def test_overlaps_plurals_and_edges():
    t = K.Taxonomy({"a": ("sound", "sound design", "design")}, {"a": ("mix",), "b": ("c++", "box")})
    m = K.machine(t)
    spans = lambda text: {k: [text[x:y] for x, y in v] for k, v in m.spans(text).items()}
    assert spans("sound designs") == {("a", "strong"): ["sound designs"]}
    assert spans("sounds, design") == {("a", "strong"): ["sounds", "design"]}
    assert spans("unsound mixes boxes soundé _mix") == {("a", "weak"): ["mixes"], ("b", "weak"): ["boxes"]}
    assert spans("c++ c++s c++x") == {("b", "weak"): ["c++", "c++s"]}
    assert K.machine(K.Taxonomy({})).spans("x") == {}


def brute(t, title, role, company):
    """Scores and rules as they are said, with patterns."""
    title, role = title or "", (role or "").lower()
    low = title.lower()
    scored, titled, strongly = {}, {}, set()
    anchor = bool(t.anchors and pattern(t.anchors).search(low))
    body = by_patterns(t, role)
    for c in t.categories:
        strong = bool(t.strong.get(c)) and bool(pattern(t.strong[c]).search(low))
        weak = bool(t.weak.get(c)) and bool(pattern(t.weak[c]).search(low))
        s = 6 * strong + (6 if c in t.anchored and anchor else 3) * weak
        if c not in t.title_only:
            n, m = len(body.get((c, "strong"), ())), len(body.get((c, "weak"), ()))
            s += (min(3 + n - 1, 5) if n else 0) + min(m, 2)
        if strong:
            strongly.add(c)
        if s >= 5:
            scored[c], titled[c] = s, strong or weak
    rules = {r.kind: r for r in t.rules}
    says = lambda k, f="title": bool(re.search(getattr(rules[k], f), title, re.IGNORECASE))
    if "replaces" in rules and says("replaces"):
        r = rules["replaces"]
        gone = [c for c in r.gone if c in scored]
        for c in gone:
            del scored[c]
        if gone or (not scored and anchor):
            scored[r.category], titled[r.category] = max(scored.get(r.category, 0), 6), True
    if "raises" in rules and scored and says("raises"):
        r = rules["raises"]
        scored[r.category], titled[r.category] = max(scored.get(r.category, 0), 6), True
    for c, below in t.dominance.items():
        if c in scored and titled[c]:
            scored = {k: v for k, v in scored.items() if k not in below or titled[k]}
    ranked = [c for _, _, c in sorted((-v, 0 if titled[k] else 1, k) for k, v in scored.items())]
    found = sorted(ranked[:3])
    if "joins" in rules and company in rules["joins"].companies and says("joins") and rules["joins"].category not in found:
        return sorted(ranked[:2] + [rules["joins"].category])
    r = rules.get("yields")
    if r and r.category in found and set(r.gone) & set(found) and r.category not in strongly:
        found = sorted([c for c in ranked if c != r.category][:3])
    r = rules.get("takes")
    if r and company in r.companies and r.spared not in found and ((says("takes") and not says("takes", "unless")) or (found and says("takes", "also"))):
        return sorted({*[c for c in found if c not in r.gone][:2], r.category})
    r = rules.get("last")
    if r and not found and says("last") and not says("last", "unless"):
        return [r.category]
    return found


RULES = (
    K.Rule("replaces", "c1", r"\bred\b", gone=("c2", "c3")), K.Rule("raises", "c4", K.words_near(("ring", "bolt"), ("small", "old"))), K.Rule("joins", "c5", r"\bgear", companies=("X",)),
    K.Rule("yields", "c6", gone=("c7", "c8")), K.Rule("takes", "c9", r"\bhot", gone=("c1",), companies=("Y",), unless="plate", also=r"\bblue", spared="c2"), K.Rule("last", "c10", r"\bwidget", unless="large"),
)


@pytest.mark.parametrize("seed", range(4))
def test_rules_against_brute_force(spark, seed):
    rng = random.Random(seed)
    parts = spark.read.parquet(f"{FOLDER}/part.parquet").collect()
    words = sorted({w for r in parts for w in r["p_name"].split()} | {"economy", "small", "promo"})
    plain = random_taxonomy(rng, words)
    taxonomy = K.Taxonomy(plain.strong, plain.weak, plain.anchors, plain.anchored, plain.title_only, {"c1": ("c0", "c6"), "c4": ("c5",)}, RULES)
    rows = [(r["p_partkey"], r["p_name"] if r["p_partkey"] % 17 else None, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) if r["p_partkey"] % 13 else None, rng.choice(["X", "Y", None])) for r in parts]
    frame = spark.createDataFrame(rows, "k long, title string, role_text string, company_category string")
    got = {r["k"]: r["categories"] for r in K.classify(frame, taxonomy).collect()}
    wanted = {k: brute(taxonomy, t, role, company) for k, t, role, company in rows}
    assert got == wanted and sum(map(bool, wanted.values())) > 20
    assert K.classify(frame.limit(0), taxonomy).count() == 0


def test_named_rules():
    """The rules of sound and audio, on titles."""
    t = K.Taxonomy({"audio_software": ("plugin",), "music_technology": ("synth",), "music_production_recording": ("studio",), "test_measurement_qa": (), "audio_systems": (), "live_sound_events": ("live sound",), "game_audio_interactive": (), "acoustics_consulting": (), "transducers": ("speaker",), "sound_design": (), "av_systems_integration": ()}, {"audio_systems": ("system",)}, rules=K.AUDIO_RULES)
    say = K.Classifier(t)
    assert say("Software Engineer, Synth", "", None) == ["audio_software"]
    assert say("Synth Tester", "", None) == ["music_technology"]
    assert say("Synth Quality Engineer", "", None) == ["music_technology", "test_measurement_qa"]
    assert say("Composer", "", "Gaming, VR & Immersive Audio") == ["game_audio_interactive"]
    assert say("Live sound and system tech", "live sound system", None) == ["live_sound_events"]
    assert say("Acoustician, speaker", "", "Acoustic Consulting & Engineering") == ["acoustics_consulting"]
    assert say("Acoustic speaker engineer", "", "Acoustic Consulting & Engineering") == ["transducers"]
    assert say(None, None, None) == []


def test_taxonomy_files(tmp_path):
    spec = {"categories": [{"id": "a", "strong": ["x"], "dominates": ["b"]}, {"id": "b", "weak": ["y"], "anchored": True, "title_only": True}], "anchors": ["z"], "rules": [{"kind": "raises", "category": "a", "title": "q", "gone": ["b"]}]}
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    t = K.load_taxonomy(str(path))
    assert t.categories == ["a", "b"] and t.anchored == {"b"} and t.rules[0].gone == ("b",) and t.dominance == {"a": ("b",)}
    spec["rules"][0]["category"] = "other"
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="other"):
        K.load_taxonomy(str(path))
    spec["categories"].append({"id": "a"})
    path.write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="twice"):
        K.load_taxonomy(str(path))


def test_work_does_not_grow_with_categories():
    """A hundred times the categories, of words that the text lacks, cost about nothing more."""
    import time

    text = " ".join(f"word{i % 97}" for i in range(200_000))

    def took(n):
        m = K.machine(K.Taxonomy({f"c{i}": (f"other{i}", f"words of {i}") for i in range(n)}))
        began = time.perf_counter()
        m.spans(text)
        return time.perf_counter() - began

    took(10)
    assert took(2000) < 5 * took(20) + 0.2
