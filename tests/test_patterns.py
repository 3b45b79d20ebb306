"""Patterns in one pass against each pattern on its own."""

import random
import re

from pyspark.sql import functions as F

from tallyframe.functions import patterns as P
from tallyframe.functions import text as T
from tallyframe.operators import rules


def test_literals():
    assert P.alternatives(r"a|b(c|d)|[|]e|\|f") == ["a", "b(c|d)", "[|]e", r"\|f"]
    assert P.literals(r"abc") == {"abc"} and P.literals(r"\bacl\b|lca") == {"acl", "lca"}
    assert P.literals(r"(ligamento )?cruzado anterior") == {"cruzado anterior"}
    assert P.literals(r"vordere[sn]? kreuzband") == {" kreuzband"}
    assert P.literals(r"(ic|medial) menisk?us") == {" menis"}
    assert P.literals(r"(chondral|chondro\w+)") == {"chondral", "chondro"}
    assert P.literals(r"a(?!bcdef)") == {"a"} and P.literals(r"\?") == {"?"} and P.literals(r"ab+c") == {"ab"}
    assert P.literals(r"\w+") is None and P.literals(r"x|\w") is None and P.literals(r"(ab)?") is None and P.literals(r"a{2}b") is None
    assert P.literals(r"no\s+(tear|sign)s?") == {"tear", "sign"} and P.literals("[^.;]{0,40}") is None


def sentences(rng, n):
    """Made of pieces of the lexicon, so that many patterns match, and of other letters."""
    pieces = [re.sub(r"\\.|[()?*+|\[\]{}^$]", " ", e[3])[: rng.randint(3, 40)] for e in T.lexicon()] + ["the knee", "?", "x", "  ", "ligament", "no ", "medial"]
    return [" ".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(n)]


def test_matcher_against_each_pattern():
    rng = random.Random(6)
    entries = T.lexicon()
    groups = dict(rules._groups(entries, T.LABELS))
    texts = sentences(rng, 400)
    hits = 0
    for lang, own in groups.items():
        matcher = P.matcher_of(own)
        for s in texts[:: 1 if lang in ("en", "unk", "") else 5]:
            want = {name for name, ps in own if any(re.search(p, s) for p in ps)}
            assert matcher.found(s) == want, (lang, s)
            hits += len(want)
    assert hits > 500


def test_cues_by_language(spark):
    """The Arrow function finds what Spark's own regular expressions find."""
    rng = random.Random(7)
    rows = [(i, s, rng.choice(["en", "es", "tr", "de", "bg", "unk", "th"])) for i, s in enumerate(sentences(rng, 150))] + [(900, None, "en"), (901, "", "unk")]
    df = spark.createDataFrame(rows, "id int, s string, lang string")
    got = {r.id: r.c for r in df.select("id", rules._cues(F.col("s"), F.col("lang"), T.lexicon(), T.LABELS).alias("c")).collect()}
    entries = T.lexicon()
    langs = {e[2] for e in entries}
    for kind in ("uncertainty", "negation", "pathology"):
        want = {}
        for lang in ("en", "es", "tr", "de", "bg", "unk", "th"):
            own = [e[3] for e in entries if e[0] == kind and (e[2] == lang or lang == "unk")]
            for r in df.where(F.col("lang") == lang).select("id", F.coalesce(T.any_match(F.col("s"), own), F.lit(False)).alias("x")).collect():
                want[r.id] = r.x
        assert {i: c[kind] for i, c in got.items()} == want and "th" not in langs
    acl = {lang: [e[3] for e in entries if e[0] == "term" and e[1] == "ACL" and (e[2] in ("*", lang) or lang == "unk")] for lang in ("en", "unk", "th")}
    for lang, own in acl.items():
        for r in df.where(F.col("lang") == lang).select("id", F.coalesce(T.any_match(F.col("s"), own), F.lit(False)).alias("x")).collect():
            assert got[r.id].hits[T.LABELS.index("ACL")] == r.x


def test_scripts_and_markers(spark):
    texts = ["колено в норме with the knee", "abc аб", "γόνατο και", "ข้อเข่า", "", None, "the knee findings", "hallazgos rodilla the", "the rodilla", "123 !?"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    both = {r.id: r.f for r in df.select("id", T.folded_language(F.col("t")).alias("f")).collect()}
    assert [both[i].language for i in range(10)] == ["bg", "bg", "el", "th", "unk", "unk", "en", "es", "unk", "unk"]
    apart = {r.id: r.x for r in df.select("id", T.detect_language(F.col("t"), F.lower(T.strip_accents("t"))).alias("x")).collect()}
    assert apart == {i: f.language for i, f in both.items()} and both[2].folded == "γονατο και" and both[5].folded is None
    assert T.script("abcdefg аб") is None and T.script("абв abcdefg") is None and T.script("абв abcde") == "bg"
    m = P.Markers({"a": ["there is", "no"], "b": ["is", "no evidence"]})
    assert m.language("there is") == "unk" and m.language("no evidence is no") == "b" and m.language("nothere is x") == "b"
