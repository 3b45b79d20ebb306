"""Language, sections, sentences and the rule extractor on literal reports."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as T
from tallyframe.operators import rules

LANGUAGES = [
    ("en", "Findings: the knee shows a tear. Impression: tear with fluid."),
    ("es", "Hallazgos: derrame leve en la rodilla, sin rotura."),
    ("tr", "Bulgular: diz normal, menisküs doğal, yırtık saptanmadı."),
    ("de", "Befund: kein Riss, Erguss im Kniegelenk."),
    ("nl", "Bevindingen: geen scheur van de voorste band, knie normaal."),
    ("bg", "Малък излив. Менискът е запазен."),
    ("el", "Χωρίς ρήξη του έσω μηνίσκου."),
    ("th", "ไม่พบน้ำในข้อเข่า"),
    ("unk", ""),
    ("unk", "qqq 42 zzz"),
]

STATUS = [
    ("Findings: The ACL is torn with a partial rupture.", "ACL", "affirmed"),
    ("Findings: The ACL is intact without effusion.", "ACL", "negated"),
    ("Findings: The ACL is intact without effusion.", "Effusion", "negated"),
    ("Findings: The ACL is intact without effusion.", "Fracture", "not_mentioned"),
    ("Hallazgos: rodilla con rotura del cruzado anterior.", "ACL", "affirmed"),
    ("Hallazgos: sin derrame articular en la rodilla.", "Effusion", "negated"),
    ("Hallazgos: posible rotura del menisco externo de la rodilla.", "Lateral Meniscus", "uncertain"),
    ("Bulgular: diz. On capraz bag yirtik izlenmektedir.", "ACL", "affirmed"),
    ("Bulgular: diz. Medial menisküs normaldir.", "Medial Meniscus", "negated"),
    ("Findings: the knee has no tear of the medial meniscus. Impression: the medial meniscus shows a tear.", "Medial Meniscus", "affirmed"),
    ("Indication: the knee, medial meniscus tear? Findings: with the rest normal.", "Medial Meniscus", "not_mentioned"),
    ("Findings: with the lateral meniscus visualized.", "Lateral Meniscus", "not_mentioned"),
    ("Findings: the knee with a Baker's cyst.", "Baker's", "affirmed"),
    ("Findings: the knee with possible fracture.", "Fracture", "uncertain"),
]


def test_language(spark):
    rows = spark.createDataFrame([(i, x, w) for i, (w, x) in enumerate(LANGUAGES)], "id int, text string, want string")
    got = rows.select("want", T.detect_language(F.col("text"), F.lower(T.strip_accents("text"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_null_language(spark):
    row = spark.createDataFrame([(None,)], "text string")
    assert row.select(T.detect_language(F.col("text"), F.lower(T.strip_accents("text"))).alias("x")).first().x == "unk"


def test_sections(spark):
    df = spark.createDataFrame([("intro Findings: a. Impression: b. Findings: c",), ("nothing here",), ("TÉCNICA: x".upper(),)], "t string")
    got = [[(s.section, s.text) for s in r.s] for r in df.withColumn("f", T.strip_accents("t")).select(T.split_sections(F.col("f")).alias("s")).collect()]
    assert got[0] == [("other", "intro"), ("findings", "a. \n c"), ("impression", "b.")]
    assert got[1] == [("findings", "nothing here")]
    assert got[2] == [("technique", "X")]


def test_sentences(spark):
    df = spark.createDataFrame([(" a. b;\n\nc ...",), ("",)], "t string")
    assert [r.s for r in df.select(T.split_sentences(F.col("t")).alias("s")).collect()] == [["a", "b", "c"], []]


@pytest.fixture(scope="module")
def extracted(spark):
    reports = sorted({r for r, _, _ in STATUS})
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(reports)] + [("null", None)], "id string, report string")
    rows = rules.extract(df).collect()
    return reports, {(r.id, r.label): r for r in rows}


@pytest.mark.parametrize("report,label,want", STATUS)
def test_status(extracted, report, label, want):
    reports, rows = extracted
    assert rows[str(reports.index(report)), label].status == want


def test_scores_evidence_and_null(extracted):
    reports, rows = extracted
    both = str(next(i for i, r in enumerate(reports) if "Impression" in r))
    assert rows[both, "Medial Meniscus"].score == 0.95
    assert rows[both, "Medial Meniscus"].evidence == "the medial meniscus shows a tear"
    order = [rows[str(reports.index(r)), x].score for r, x, w in STATUS if w in ("affirmed", "uncertain", "not_mentioned", "negated")]
    assert set(order) <= {0.9, 0.95, 0.6, 0.35, 0.05}
    assert {rows["null", x].status for x in T.LABELS} == {"not_mentioned"}


def test_lexicon_is_whole():
    entries = T.lexicon()
    assert {k: sum(e[0] == k for e in entries) for k in ("term", "pathology", "negation", "uncertainty")} == {"term": 102, "pathology": 107, "negation": 97, "uncertainty": 69}
    assert {e[1] for e in entries if e[0] == "term"} == set(T.LABELS)


def test_reports_are_judged_where_they_are(spark):
    df = spark.createDataFrame([(1, STATUS[0][0]), (1, STATUS[1][0])], "id int, report string")
    out = rules.extract(df, labels=("ACL",))
    assert sorted(r.status for r in out.collect()) == ["affirmed", "negated"]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_headers_are_those_of_whole_texts(spark):
    """Headers found before colons are those that the expressions find in a whole text."""
    rng = random.Random(3)
    parts = ["findings", "Impression", "xconclusiones", "befundung", "klinische angaben", "technique", "TECNICA ", "  ", "\u00a0", "\n", ":", ": :", "a.", "мнение", "protocol", "impression findings", "\u0001", "text of a knee"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, t string")
    whole = F.col("t")
    for name, pattern in T.SECTIONS.items():
        whole = F.regexp_replace(whole, f"{T._FLAGS}(?:{pattern})\\s*:", f"{T._MARK}{name}{T._MARK}")
    off = df.select("t", T._marked_headers(F.col("t"), T.SECTIONS).alias("got"), whole.alias("want")).where("got <> want").collect()
    assert off == []
    # a custom expression without a bound is still searched as a whole
    odd = T._marked_headers(F.lit("so find it all : x"), {"a": "find.*all"})
    assert spark.range(1).select(odd.alias("s")).first().s == f"so {T._MARK}a{T._MARK} x"


def test_headers_of_a_long_text_take_its_length_once(spark):
    df = spark.range(1).select(F.repeat(F.lit("the knee is shown in three planes and is "), 200_000).alias("t"))
    df = df.select(F.concat("t", F.lit(" Impression: none")).alias("t"))
    start = time.perf_counter()
    got = df.select(T.split_sections(F.col("t")).alias("s")).select(F.col("s").getItem(1)["text"].alias("x")).first().x
    assert got == "none" and time.perf_counter() - start < 5
