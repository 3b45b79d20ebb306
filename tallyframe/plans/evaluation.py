"""More queries: last rows of sources, caches, evaluation against gold labels, sections, results and the gold checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corrections as C
from ..operators import metrics as M
from ..operators import referee, rules, splits
from ..operators import tables as J
from ..sources import readers, writers
from ..steps import shared_dir
from . import base as B
from .queries import _pairs, _weights, query, r6

t = B.table


def _new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# sources


@query("""WITH w AS (SELECT doc_id::VARCHAR AS id, quality * 0.7 AS q, CASE WHEN toxic = 1 THEN 0.5 ELSE 0.25 END AS p FROM labels)
SELECT id, 'quality' AS label, trunc(q)::INT AS y, p::DOUBLE AS p, 'truncated' AS mode FROM w UNION ALL SELECT id, 'quality', (q >= 0.5)::INT, p::DOUBLE, 'half' FROM w""")
def src03_oof_modes(spark, d):
    wide = t(spark, d, "labels").select(F.col("doc_id").cast("string").alias("id"), (F.col("quality") * 0.7).alias("quality_true"), F.when(F.col("toxic") == 0, 0.25).alias("quality_pred"))
    return readers.oof(wide, ["quality"], truncate=True).withColumn("mode", F.lit("truncated")).union(readers.oof(wide, ["quality"]).withColumn("mode", F.lit("half")))


def _runs(spark, d) -> DataFrame:
    """Orders as rows of predictions of customers, later orders being later rows."""
    truth = F.when(F.col("o_orderstatus") == "F", 0.9).when(F.col("o_orderstatus") == "O", 0.2)
    pred = F.when(~F.col("o_orderpriority").startswith("5"), F.pmod("o_orderkey", F.lit(1000)) / 1000.0)
    return t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("_ord"), truth.alias("A_true"), pred.alias("A_pred"))


RUNS = """ru AS (SELECT o_custkey::VARCHAR AS id, o_orderstatus AS st, CASE WHEN o_orderpriority NOT LIKE '5%' THEN (o_orderkey % 1000) / 1000::DOUBLE END AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)"""


@query("WITH " + RUNS + " SELECT id, 'A' AS label, (st = 'F')::INT AS y, coalesce(p, 0.5)::DOUBLE AS p FROM ru WHERE k = 1")
def src04_oof_last(spark, d):
    return readers.oof_last(_runs(spark, d), ["A"])


@query("WITH " + RUNS + " SELECT id, 'A' AS label, p FROM ru WHERE k = 1")
def src05_teacher(spark, d):
    return readers.teacher(_runs(spark, d), ["A"])


@query("SELECT id, x AS \"X\", 1.0::DOUBLE AS \"Y\" FROM (SELECT o_custkey::VARCHAR AS id, (o_orderstatus = 'F')::INT::DOUBLE AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '1%') WHERE k = 1")
def src06_gold_rows(spark, d):
    x = F.when(F.col("o_orderstatus") == "F", "1").when(F.col("o_orderstatus") == "O", "0").otherwise("n/a")
    y = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise("1")
    return readers.gold_rows(t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("_ord"), x.alias("X"), y.alias("Y")), ["X", "Y"])


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)
SELECT o_custkey::VARCHAR AS id, label, CASE WHEN o_orderstatus = 'P' THEN NULL WHEN label = 'B' OR o_orderstatus = 'O' THEN 'negated' ELSE 'affirmed' END AS status, CASE label WHEN 'A' THEN o_orderpriority ELSE '' END AS evidence, CASE WHEN o_orderstatus = 'P' THEN 'bad status for A' ELSE '' END AS error, 'model' AS engine
FROM l, (VALUES ('A'), ('B')) v(label) WHERE k = 1""")
def src07_json_results(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "affirmed").when(F.col("o_orderstatus") == "O", "negated").otherwise("maybe")
    labels = F.create_map(F.lit("A"), F.struct(status.alias("status"), F.col("o_orderpriority").alias("evidence")), F.lit("B"), F.struct(F.lit("negated").alias("status"), F.lit("").alias("evidence")))
    value = F.to_json(F.create_map(F.col("o_custkey").cast("string"), F.struct(F.lit("en").alias("language"), labels.alias("labels"))))
    return readers.json_results(t(spark, d, "orders").select(F.col("o_orderkey").alias("file_ord"), value.alias("value")), "model")


@query("""WITH c AS (SELECT DISTINCT o_custkey AS study, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS dir, o_orderpriority AS slot FROM orders)
SELECT study, slot, dir::DOUBLE AS value FROM c JOIN (SELECT study, min(dir) AS dir FROM c GROUP BY 1) USING (study, dir)""")
def src11_cache_index(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("study"), F.col("o_orderpriority").alias("slot"), F.when(F.col("o_orderstatus") == "F", 0.0).otherwise(1.0).alias("v")).distinct()
    paths = [_new_path(spark, f"cache{k}") for k in range(2)]
    for k, path in enumerate(paths):
        o.where(F.col("v") == k).select("study", "slot", F.array("v").alias("data")).write.parquet(path)
    return readers.array_cache(spark, paths).select("study", "slot", F.col("data")[0].alias("value"))


@query("""WITH m AS (SELECT user_id AS study, event_type AS key, count(*) AS n FROM events GROUP BY ALL), u AS (SELECT DISTINCT user_id AS study FROM events),
f AS (SELECT u.study, slot, coalesce(a.n, b.n) AS n FROM u, (VALUES ('click'), ('gone')) s(slot) LEFT JOIN m a ON a.study = u.study AND a.key = slot LEFT JOIN m b ON b.study = u.study AND b.key = 'view')
SELECT study, slot, n FROM f WHERE n IS NOT NULL""")
def src12_cached_slots(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("study"), F.col("event_type").alias("key"))
    wanted = e.select("study").distinct().select("study", F.explode(F.array(F.lit("click"), F.lit("gone"))).alias("slot"), F.lit("view").alias("series"))
    cache = e.groupBy("study", "key").agg(F.array(F.count(F.lit(1))).alias("data"))
    return readers.cached_slots(cache, wanted).select("study", "slot", F.col("data")[0].alias("n"))


@query("SELECT documents.doc_id AS id, CASE WHEN labels.doc_id IS NULL THEN length(coalesce(text, '')) ELSE -1 END AS chars FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
def src13_read_through(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    path = _new_path(spark, "read-through")
    t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit(-1).cast("long").alias("chars")).write.parquet(path)
    return readers.read_through(docs.select("id"), path, lambda missing: docs.join(missing, "id", "left_semi"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '5%' THEN 'unk' ELSE 'en' END AS language, CASE WHEN o_orderpriority NOT LIKE '5%' THEN 'A' END AS label, CASE WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderstatus = 'F' THEN 'affirmed' ELSE 'negated' END AS status, CASE WHEN o_orderpriority LIKE '5%' THEN NULL WHEN o_orderstatus = 'F' THEN 0.9 ELSE 0.05 END::DOUBLE AS score, CASE WHEN o_orderpriority NOT LIKE '5%' THEN o_orderpriority END AS evidence, CASE WHEN o_orderpriority LIKE '5%' THEN 'refused' ELSE '' END AS error FROM orders WHERE o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '1%'")
def txt08_decoded(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "affirmed").otherwise("negated")
    refused = F.col("o_orderpriority").startswith("5")
    response = F.struct(F.lit("en").alias("language"), F.create_map(F.lit("A"), F.struct(status.alias("status"), F.col("o_orderpriority").alias("evidence"))).alias("labels"))
    version = F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(2)
    entry = F.to_json(F.struct(F.lit("m").alias("model"), version.alias("prompt_version"), F.when(~refused, response).alias("response"), F.when(refused, "refused").alias("error")))
    cache = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", '{"model": ').otherwise(entry).alias("value"))
    return readers.decoded(readers.cached_results(cache, "m", 2))


# sections of reports


def _sectioned(spark, d) -> DataFrame:
    """Documents as reports with headers, one of which comes twice."""
    c = lambda x: F.coalesce(x, F.lit(""))
    report = F.concat(c("source"), F.lit(" Technique: "), c("lang"), F.lit("\nFindings: "), c("text"), F.lit("\nImpression: "), c("lang"), F.lit(" FINDINGS : "), c("source"))
    told = t(spark, d, "documents").select("doc_id", T.strip_accents(report).alias("folded"))
    return told.select("doc_id", F.explode(T.split_sections(F.col("folded"))).alias("s")).select("doc_id", "s.section", "s.text")


SECTIONED = """sc AS (SELECT doc_id, 'other' AS section, source AS text FROM documents UNION ALL SELECT doc_id, 'technique', lang FROM documents UNION ALL SELECT doc_id, 'impression', lang FROM documents
  UNION ALL SELECT doc_id, 'findings', trim(strip_accents(coalesce(text, '')) || chr(10) || chr(10) || ' ' || source, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) FROM documents)"""


@query("WITH " + SECTIONED + " SELECT doc_id, section, length(text) AS chars FROM sc")
def txt04_sections(spark, d):
    return _sectioned(spark, d).select("doc_id", "section", F.length("text").cast("long").alias("chars"))


@query("WITH " + SECTIONED + " SELECT section, count(*) AS n, sum(length(text))::BIGINT AS chars FROM sc WHERE section NOT IN ('technique', 'indication') GROUP BY 1")
def flt10_matchable_sections(spark, d):
    kept = _sectioned(spark, d).where(~F.col("section").isin(*T.EXCLUDED_SECTIONS))
    return kept.groupBy("section").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT doc_id AS id, 'Medial Meniscus' AS label, CASE WHEN toxic = 1 THEN 'not_mentioned' WHEN quality = 1 THEN 'affirmed' ELSE 'negated' END AS status, CASE WHEN toxic = 1 THEN 0.35 WHEN quality = 1 THEN 0.95 ELSE 0.05 END::DOUBLE AS score FROM labels")
def agg22_impression_first(spark, d):
    found = F.lit("Findings: the knee has no tear of the medial meniscus.")
    asked = F.lit("Indication: the knee, medial meniscus tear? Findings: with the rest normal.")
    report = F.when(F.col("toxic") == 1, asked).when(F.col("quality") == 1, F.concat(found, F.lit(" Impression: the medial meniscus shows a tear."))).otherwise(found)
    return rules.extract(t(spark, d, "labels").select(F.col("doc_id").alias("id"), report.alias("report")), labels=("Medial Meniscus",)).select("id", "label", "status", "score")


@query("""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN translate(text, 'etaoin', 'етаоин') WHEN 1 THEN translate(text, 'etaoin', 'εταοιν') ELSE translate(text, 'e', 'е') END AS t FROM documents),
n AS (SELECT doc_id, coalesce(t, '') AS t, len(regexp_extract_all(t, '\\p{L}')) AS letters, len(regexp_extract_all(t, '[Ѐ-ӿ]')) AS bg, len(regexp_extract_all(t, '[Ͱ-Ͽ]')) AS el FROM x)
SELECT doc_id, CASE WHEN t <> '' AND letters > 0 AND bg / letters > 0.30 THEN 'bg' WHEN t <> '' AND letters > 0 AND el / letters > 0.30 THEN 'el' ELSE 'unk' END AS language FROM n""")
def txt02_scripts(spark, d):
    own = F.pmod("doc_id", F.lit(3))
    text = F.when(own == 0, F.translate("text", "etaoin", "етаоин")).when(own == 1, F.translate("text", "etaoin", "εταοιν")).otherwise(F.translate("text", "e", "е"))
    return t(spark, d, "documents").select("doc_id", T.detect_language(text, F.lit("")).alias("language"))


# joins, orders, sets, sinks


@query("""WITH l AS (SELECT o_custkey AS c, o_totalprice AS a FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1)
SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS place, o_custkey::VARCHAR AS id, a AS "A", s_acctbal AS "A_pred" FROM orders JOIN supplier ON s_suppkey = o_custkey JOIN l ON c = o_custkey""")
def jn03_left_order(spark, d):
    left = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("at"), F.col("o_totalprice").alias("A"))
    right = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("at"), F.col("s_acctbal").alias("A_pred"))
    return J.aligned_in_order(left, right, "id", ["A"], "at", "at")


@query("SELECT CASE WHEN o_orderpriority LIKE '5%' THEN o_orderkey::VARCHAR ELSE o_custkey::VARCHAR END AS patient, count(DISTINCT o_orderkey % 5) AS folds FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(DISTINCT o_orderkey % 5) > 1")
def jn07_fold_lookup(spark, d):
    o = t(spark, d, "orders")
    folds = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("study"), F.pmod("o_orderkey", F.lit(5)).alias("fold"))
    train = o.select(F.col("o_orderkey").alias("study"), F.when(F.col("o_orderpriority").startswith("5"), "").otherwise(F.col("o_custkey").cast("string")).alias("patient"))
    return splits.group_leaks(folds, train)


@query("WITH " + B.SCORES + """,
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0 AS r FROM s),
a AS (SELECT label, count(*) AS n, avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END) AS acc, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn, sum(r) FILTER (WHERE y = 1) AS sr FROM k GROUP BY label),
u AS (SELECT *, (sr - np * (np + 1) / 2.0) / nullif(np * nn, 0) AS auc FROM a)
SELECT label, n, round(acc, 6)::DOUBLE AS accuracy, round(auc, 6)::DOUBLE AS auc, round((SELECT avg(auc) FROM u), 6)::DOUBLE AS macro_auc FROM u""")
def jn08_gold_evaluation(spark, d):
    gold = J.to_long(t(spark, d, "labels"), "doc_id", ["quality", "toxic"], "y")
    p = lambda k: (F.pmod(F.col("doc_id") * 7919 + k, F.lit(1000)) / 1000.0).alias("p")
    each = F.explode(F.array(F.struct(F.lit("quality").alias("label"), p(0)), F.struct(F.lit("toxic").alias("label"), p(13))))
    pseudo = t(spark, d, "documents").select(F.col("doc_id").alias("id"), each.alias("s")).select("id", "s.label", "s.p")
    return M.evaluated(gold, pseudo).select("label", "n", *[r6(c).alias(c) for c in ("accuracy", "auc", "macro_auc")])


@query("WITH " + B.ENGINES + " SELECT row_number() OVER (ORDER BY rl.id::VARCHAR) - 1 AS place, rl.id::VARCHAR AS id, 'A' AS label, rl.status AS rules_status, md.status AS model_status FROM rl JOIN md ON rl.id = md.id WHERE md.error = '' AND rl.status <> md.status")
def srt05_audit_order(spark, d):
    return J.audit(*B.two_engines(spark, d))


@query("SELECT o_orderpriority AS label, count(DISTINCT o_orderstatus) AS groups, true AS known FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) <> 1 UNION ALL SELECT p_brand, 1, false FROM part GROUP BY 1")
def set05_partition_faults(spark, d):
    o, brands = t(spark, d, "orders"), t(spark, d, "part").select(F.lit("brand").alias("group"), F.col("p_brand").alias("label"))
    return referee.partition_faults(o.select(F.col("o_orderstatus").alias("group"), F.col("o_orderpriority").alias("label")).union(brands), o.select(F.col("o_orderpriority").alias("label")))


@query("SELECT doc_id, source, CASE WHEN toxic = 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS toxic, lang, CASE WHEN quality = 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS quality FROM labels JOIN documents USING (doc_id)")
def snk08_identity_round(spark, d):
    soft = lambda c: F.when(F.col(c) == 1, 0.9).otherwise(0.1).alias(c)
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    original = docs.join(t(spark, d, "labels"), "doc_id").select("doc_id", "source", soft("toxic"), "lang", soft("quality"))
    done = C.run_corrections(B.soft(spark, d), _weights(spark), docs.where("source = 'src0'").select(F.col("doc_id").alias("id")), _pairs(spark), identity=True)
    return writers.restored(done, original, ["quality", "toxic"], "doc_id")


@query("WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(abs(x::DOUBLE) * 255)::DOUBLE) AS v FROM embeddings) SELECT vec_id, len(v)::INT AS n, round(list_sum(list_transform(v, lambda x: (x / 255)::FLOAT::DOUBLE)), 4) AS total FROM q")
def prj10_dtype_scaled(spark, d):
    v = writers.dtype_scaled(F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 255)))
    e = t(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.size("v").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


# gold checks and stopping


def _boot(prev: str, new: str) -> str:
    """Bootstrap agreement of all scores in the reports' 3000 draws."""
    return f"""{B.SCORES},
rows_ AS (SELECT label, y, {prev} AS prev, {new} AS new, row_number() OVER (PARTITION BY label, y ORDER BY id) AS place, count(*) OVER (PARTITION BY label, y) AS size FROM s),
dr AS (SELECT label, y, draw, ('0x' || substr(sha256('2026|' || label || '|' || y || '|' || draw || '|' || place), 1, 8))::BIGINT % size + 1 AS place FROM rows_, range(1, {referee.DRAWS + 1}) t(draw)),
tk AS (SELECT dr.label, draw, y, prev, new FROM dr JOIN rows_ USING (label, y, place) UNION ALL SELECT label, 0, y, prev, new FROM rows_),
pr AS (SELECT label, draw, y, 'prev' AS which, prev AS p FROM tk UNION ALL SELECT label, draw, y, 'new', new FROM tk),
rk AS (SELECT *, rank() OVER (PARTITION BY label, draw, which ORDER BY p) + (count(*) OVER (PARTITION BY label, draw, which, p) - 1) / 2.0 AS r FROM pr),
au AS (SELECT label, draw, which, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn, sum(r) FILTER (WHERE y = 1) AS sr FROM rk GROUP BY ALL),
de AS (SELECT label, draw, sum(CASE WHEN which = 'new' THEN 1 ELSE -1 END * (sr - np * (np + 1) / 2.0) / (np * nn)) AS d FROM au WHERE np * nn > 0 GROUP BY ALL),
la AS (SELECT z.label, p.d AS point, avg(CASE WHEN (z.d > 0) = (p.d > 0) AND z.d <> 0 THEN 1.0 ELSE 0 END) AS agreement FROM de z JOIN de p ON p.label = z.label AND p.draw = 0 WHERE z.draw > 0 GROUP BY ALL),
al AS (SELECT avg(point) AS delta, avg(agreement) AS agreement FROM la)"""


def _gold(spark, d, better: bool) -> DataFrame:
    p, q = F.col("p"), F.col("p") * 0.7 + F.col("y") * 0.3
    return B.scores(spark, d).select("id", "label", "y", (p if better else q).alias("prev"), (q if better else p).alias("new"))


@query("WITH " + _boot("p", "p * 0.7 + y * 0.3") + " SELECT true AS ran, round(delta, 5)::DOUBLE AS macro_delta, round(agreement, 5)::DOUBLE AS agreement, CASE WHEN agreement >= 0.9 AND delta >= 0.02 THEN 'positive' WHEN agreement >= 0.9 AND delta <= -0.02 THEN 'negative' ELSE 'inconclusive' END AS signal, agreement >= 0.9 AND delta <= -0.02 AS veto FROM al")
def itr08_gold_check(spark, d):
    return referee.gold_check(_gold(spark, d, True), 2).select("ran", F.round("macro_delta", 5).alias("macro_delta"), F.round("agreement", 5).alias("agreement"), "signal", "veto")


@query("WITH " + _boot("p * 0.7 + y * 0.3", "p") + " SELECT round(delta, 5)::DOUBLE AS macro_delta, round(agreement, 5)::DOUBLE AS agreement, CASE WHEN delta < -0.1 THEN 'negative' ELSE 'inconclusive' END AS signal, delta < -0.1 AS veto FROM al")
def itr09_final_check(spark, d):
    return referee.final_check(_gold(spark, d, False), unlock=True).select(F.round("macro_delta", 5).alias("macro_delta"), F.round("agreement", 5).alias("agreement"), "signal", "veto")


@query("""WITH g AS (SELECT c_custkey AS id, c_acctbal > 0 AS a, c_nationkey % 2 = 0 AS v, c_nationkey % 4 AS r FROM customer)
SELECT id, a AS accepted, v AS veto, r::INT AS round, NOT a OR v OR r >= 3 AS stop, NOT a OR v AS rollback,
CASE WHEN NOT a THEN 'cv gate rejected' WHEN v THEN 'gold check strong negative' WHEN r >= 3 THEN 'round cap reached (3 rounds)' ELSE 'accepted; continue' END AS reason FROM g""")
def itr10_stop_branches(spark, d):
    rounds = t(spark, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("accepted"), (F.pmod("c_nationkey", F.lit(2)) == 0).alias("veto"), F.pmod("c_nationkey", F.lit(4)).cast("int").alias("round"))
    return referee.stop_decisions(rounds)
