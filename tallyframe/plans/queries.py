"""A query for each operator over the tables of a folder, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions import values as V
from ..operators import corrections as C
from ..operators import metrics as M
from ..operators import ranks as R
from ..operators import referee, rules, splits, volumes
from ..operators import slots as S
from ..operators import tables as J
from ..operators import windows as W
from ..sources import readers, writers
from . import base as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


t = B.table


# sources and sinks


@query("SELECT doc_id AS id, length(text) AS chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def src01_label_scan(spark, d):
    docs = J.require(t(spark, d, "documents"), ["doc_id", "text"])
    return docs.join(t(spark, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.length("text").cast("long").alias("chars"), "quality", "toxic")


@query("WITH " + B.SCORES + " SELECT id, label, CAST(trunc(p + y * 0.5) AS INT) AS y_trunc, CAST(p + y * 0.5 >= 0.5 AS INT) AS y_half FROM s")
def src03_truth_modes(spark, d):
    v = F.col("p") + F.col("y") * 0.5
    return B.scores(spark, d).select("id", "label", v.cast("int").alias("y_trunc"), V.binarise(v).alias("y_half"))


@query("SELECT o_custkey AS id, max(o_orderkey) AS last_order FROM orders GROUP BY 1")
def src05_teacher_keep_last(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("last_order"))
    return J.keep_last(o, ["id"], ["last_order"])


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def src07_json_props(spark, d):
    e = t(spark, d, "events").select("event_type", F.from_json("props", "k bigint").alias("j"))
    return e.groupBy("event_type", F.col("j.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS label, CASE WHEN p_brand LIKE '%5' THEN 0.5 ELSE max(p_size) / 100.0 END::DOUBLE AS w FROM part GROUP BY 1")
def src09_label_weights(spark, d):
    brands = t(spark, d, "part").groupBy(F.col("p_brand").alias("label")).agg((F.max("p_size") / 100.0).alias("w"))
    # a file of weights is one JSON object, with a number for each label
    given = brands.where(~F.col("label").endswith("5")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "w")))).alias("value"))
    return readers.label_weights(given, brands)


@query("WITH " + B.SCORES + " SELECT id, max(CASE WHEN label = 'quality' THEN p END) AS quality, max(CASE WHEN label = 'toxic' THEN p END) AS toxic FROM s GROUP BY id")
def snk01_wide_labels(spark, d):
    return J.to_wide(B.scores(spark, d), ["quality", "toxic"])


@query("SELECT doc_id AS id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def snk03_submission(spark, d):
    labels = t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return writers.submission(labels, J.keep_last(labels, ["id"], ["quality", "toxic"]), ["quality", "toxic"])


@query("WITH " + B.SCORES + " SELECT id, printf('%.6f', max(CASE WHEN label = 'quality' THEN y END)::DOUBLE) AS quality_true, printf('%.6f', max(CASE WHEN label = 'quality' THEN p END)) AS quality_pred, printf('%.6f', max(CASE WHEN label = 'toxic' THEN y END)::DOUBLE) AS toxic_true, printf('%.6f', max(CASE WHEN label = 'toxic' THEN p END)) AS toxic_pred FROM s GROUP BY id")
def snk04_oof_format(spark, d):
    return writers.oof_table(B.scores(spark, d), ["quality", "toxic"])


# filters and projections


@query("SELECT doc_id FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def flt01_gold_mask(spark, d):
    return t(spark, d, "labels").where(readers.gold_mask(["quality", "toxic"])).select("doc_id")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50")
def flt02_limit(spark, d):
    return t(spark, d, "documents").orderBy("doc_id").limit(50).select("doc_id", "lang")


@query("WITH " + B.SERIES + " SELECT slot, count(*) AS n, CAST(sum(n) AS BIGINT) AS slices FROM se JOIN ru ON plane = rp AND fluid = rf AND (rs IS NULL OR fat = rs) GROUP BY slot")
def flt03_slot_rule_join(spark, d):
    return S.slot_candidates(B.series(spark, d), S.rule_table(spark, B.RULES)).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("slices"))


@query("SELECT l.doc_id, l.quality FROM labels l WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def flt04_slice_semi(spark, d):
    locked = t(spark, d, "documents").where("source = 'src0'").select("doc_id")
    return t(spark, d, "labels").join(locked, "doc_id", "left_semi").select("doc_id", "quality")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND ('0x' || substr(sha256('42|' || o_custkey), 1, 8))::BIGINT % 5 = 3")
def flt05_fold_semi(spark, d):
    o = t(spark, d, "orders").where(V.hash_fold(F.col("o_custkey").cast("string"), 5, 42) == 3)
    return o.join(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select(F.col("o_orderkey").alias("id"))


@query("WITH " + B.SCORES + " SELECT label FROM s GROUP BY label HAVING min(y) <> max(y)")
def flt06_scorable(spark, d):
    return M.scorable(B.scores(spark, d))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def flt07_uncached(spark, d):
    return readers.uncached(t(spark, d, "documents").select(F.col("doc_id").alias("id")), t(spark, d, "labels").select(F.col("doc_id").alias("id")))


@query("SELECT lang, term, count(*) AS n FROM documents JOIN (VALUES ('*', 'x'), ('en', 'the'), ('fr', 'le'), ('de', 'der')) t(tl, term) ON tl = '*' OR tl = lang GROUP BY ALL")
def flt09_language_terms(spark, d):
    # one row for each language before the terms meet it: the theta join is of two constant-size tables
    docs = t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    terms = spark.createDataFrame([("*", "x"), ("en", "the"), ("fr", "le"), ("de", "der")], "tl string, term string")
    return docs.join(F.broadcast(terms), (F.col("tl") == "*") | (F.col("tl") == F.col("lang"))).select("lang", "term", "n")


@query("SELECT doc_id FROM labels WHERE quality = 1")
def flt11_locked_guard(spark, d):
    good, bad = (t(spark, d, "labels").where(F.col("quality") == q).select("doc_id") for q in (1, 0))
    return J.locked_guard(good, bad, "doc_id")


@query("SELECT c_custkey AS id, round(greatest(0, least(1, c_acctbal / 10000)), 6) AS p, CAST(c_acctbal / 10000 >= 0.5 AS INT) AS y FROM customer")
def prj02_unit_clip(spark, d):
    v = F.col("c_acctbal") / 10000
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), r6(V.unit(v)).alias("p"), V.binarise(v).alias("y"))


@query("WITH " + B.SCORES + " SELECT id, round(0.25 + 0.75 * least(1, greatest(0, avg(abs(p - 0.5) * 2))), 6) AS weight FROM s GROUP BY id")
def prj03_confidence_weight(spark, d):
    wide = J.to_wide(B.scores(spark, d), ["quality", "toxic"])
    return wide.select("id", r6(V.confidence_weight([F.col("quality"), F.col("toxic")])).alias("weight"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' AND o_orderpriority < '3' THEN 0.95 WHEN o_orderstatus = 'F' THEN 0.9 WHEN o_orderstatus = 'O' THEN 0.6 ELSE 0.05 END::DOUBLE AS score FROM orders")
def prj04_status_score(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "affirmed").when(F.col("o_orderstatus") == "O", "uncertain").otherwise("negated")
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), V.status_score(status, F.col("o_orderpriority") < "3").alias("score"))


@query("WITH a AS (SELECT n_nationkey AS k, 0.5 + n_nationkey / 100.0::DOUBLE AS auc FROM nation) SELECT k, round(greatest(0, (auc - 0.5) / ((SELECT max(auc) FROM a) - 0.5)), 3) AS w FROM a")
def prj05_noise_weight(spark, d):
    a = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), (0.5 + F.col("n_nationkey") / 100.0).cast("double").alias("auc"))
    return a.select("k", V.noise_weight(F.col("auc"), F.max("auc").over(Window.partitionBy())).alias("w"))


@query("SELECT n_nationkey AS k, round(0.3 * (1 - (0.02 + 0.18 * least(1, greatest(0, (n_nationkey / 24.0 - 0.65) / 0.35)))), 6)::DOUBLE AS low, round(0.3 * (1 + (0.02 + 0.18 * least(1, greatest(0, (n_nationkey / 24.0 - 0.65) / 0.35)))), 6)::DOUBLE AS high FROM nation")
def prj06_prevalence_band(spark, d):
    low, high = V.prevalence_band(F.lit(0.3), F.col("n_nationkey") / 24.0)
    return t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), r6(low).alias("low"), r6(high).alias("high"))


@query("SELECT lang, round((count(*) * (avg(length(text)) / 3.2 + 900) / 1e6 * 1.0 + count(*) * 260 / 1e6 * 5.0) * 0.5, 6) AS usd FROM documents GROUP BY lang")
def prj08_cost(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg(F.length("text")).alias("c")).select("lang", r6(V.token_cost(F.col("n"), F.col("c"), 1.0, 5.0)).alias("usd"))


@query("WITH " + B.SOFT + " SELECT id, label, CASE WHEN p > 0.8 THEN CASE WHEN cur >= 0.5 THEN 0 ELSE 1 END ELSE cur END::DOUBLE AS new FROM soft")
def prj09_flip(spark, d):
    return B.soft(spark, d).select("id", "label", V.flipped(F.col("cur"), F.col("p") > 0.8).alias("new"))


# joins


@query("SELECT o_orderkey AS id, c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def jn01_strict_left(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"))
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return J.strict_left(o, c, "k", ["name"]).select("id", "name")


@query("SELECT a.doc_id AS id, a.quality AS prev_y, b.n_chars AS new_y FROM labels a JOIN documents b USING (doc_id)")
def jn02_aligned(spark, d):
    a = t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("y"))
    b = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("y"))
    return J.aligned(a, b, "id", ["y"])


@query("WITH " + B.ENGINES + " SELECT rl.id, 'A' AS label, CASE WHEN md.error = '' THEN md.status ELSE rl.status END AS status, CASE WHEN md.error = '' THEN md.score ELSE rl.score END AS score, CASE WHEN md.error = '' THEN 'model' ELSE 'rules' END AS engine FROM rl LEFT JOIN md ON rl.id = md.id")
def jn04_merge(spark, d):
    return J.merged(*B.two_engines(spark, d))


@query("WITH " + B.ENGINES + " SELECT rl.id, 'A' AS label, rl.status AS rules_status, md.status AS model_status FROM rl JOIN md ON rl.id = md.id WHERE md.error = '' AND rl.status <> md.status")
def jn05_disagreements(spark, d):
    return J.disagreements(*B.two_engines(spark, d))


@query("SELECT d.doc_id AS id, coalesce(l.quality, 0.5)::DOUBLE AS p, CASE WHEN l.doc_id IS NULL THEN 1.0 ELSE 3.0 END::DOUBLE AS weight FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn06_override(spark, d):
    pseudo = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.lit(0.5).alias("p"), F.lit(1.0).alias("weight"))
    gold = t(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("p"), F.lit(3.0).alias("weight"))
    return J.overridden(pseudo, gold, "id")


@query("SELECT doc_id AS id, 1::BIGINT AS members FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn09_members_agree(spark, d):
    a, b = (t(spark, d, n).select(F.lit(n).alias("member"), F.col("doc_id").alias("id")) for n in ("documents", "labels"))
    return R.members_agree(a.union(b))


@query("SELECT c_custkey AS id, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def jn12_slice_counts(spark, d):
    n = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return J.left_default(t(spark, d, "customer").select(F.col("c_custkey").alias("id")), n, "id", "n", F.lit(0).cast("long"))


# aggregations

AUC = B.SCORES + """,
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0 AS r FROM s),
a AS (SELECT label, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y <> 1) AS n_neg, sum(r) FILTER (WHERE y = 1) AS sr FROM k GROUP BY label),
auc AS (SELECT label, n_pos, n_neg, (sr - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) AS auc FROM a)"""


@query("WITH " + AUC + " SELECT label, n_pos, n_neg, round(auc, 6)::DOUBLE AS auc FROM auc")
def agg01_auc(spark, d):
    return M.auc_by(B.scores(spark, d), ["label"]).withColumn("auc", r6("auc"))


@query("WITH " + AUC + " SELECT round(avg(auc), 6)::DOUBLE AS macro_auc, count(*) AS n_labels FROM auc")
def agg02_macro(spark, d):
    return M.macro(M.auc_by(B.scores(spark, d), ["label"])).select(r6("macro_auc").alias("macro_auc"), "n_labels")


@query("""WITH li AS (SELECT l_returnflag AS label, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS y, l_extendedprice AS p FROM lineitem),
k AS (SELECT *, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0 AS r FROM li)
SELECT label, count(*) FILTER (WHERE y = 1) AS n_pos, count(*) FILTER (WHERE y <> 1) AS n_neg, round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y <> 1)), 6)::DOUBLE AS auc FROM k GROUP BY label""")
def agg03_auc_lineitem(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_linestatus") == "F").cast("int").alias("y"), F.col("l_extendedprice").alias("p"))
    return M.auc_by(li, ["label"]).withColumn("auc", r6("auc"))


@query("WITH " + B.SCORES + " SELECT label, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS accuracy FROM s GROUP BY label")
def agg04_accuracy(spark, d):
    return M.accuracy(B.scores(spark, d)).withColumn("accuracy", r6("accuracy"))


@query("SELECT o_custkey, count(DISTINCT o_orderkey % 5) AS folds FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 5) > 1")
def agg06_leaks(spark, d):
    return splits.leaks(t(spark, d, "orders").select("o_custkey", F.pmod("o_orderkey", F.lit(5)).alias("fold")), "o_custkey")


@query("SELECT (SELECT count(*) FROM orders) AS studies, 0::BIGINT AS without, count(*) AS patients, count(*) FILTER (WHERE n > 1) AS with_several, max(n) AS most FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def agg07_multiplicity(spark, d):
    return splits.multiplicity(t(spark, d, "orders"), "o_custkey")


@query("SELECT o_custkey AS id, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def agg08_first_row(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min_by("o_orderkey", "o_orderkey").alias("first_order"))


@query("WITH " + B.SOFT + " SELECT label, count(*) FILTER (WHERE cur >= 0.5) AS n FROM soft WHERE id IN (SELECT doc_id FROM documents WHERE source = 'src1') GROUP BY label")
def agg09_positive_counts(spark, d):
    return C.positive_counts(B.soft(spark, d), t(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("id")))


THRESHOLDS = B.SOFT + """,
e AS (SELECT label, coalesce(avg(p) FILTER (WHERE cur >= 0.5), 0.5) AS e, CASE label WHEN 'quality' THEN 0.9 ELSE 0.6 END::DOUBLE AS w, CASE label WHEN 'quality' THEN 50 ELSE 3 END AS n FROM soft GROUP BY label),
th AS (SELECT label, CASE WHEN n < 10 THEN (w - 0.5) / 0.5 * e + (1 - (w - 0.5) / 0.5) * (SELECT sum(e * w) / sum(w) FROM e) ELSE e END AS threshold, CASE WHEN n < 10 THEN 'pooled_backoff' ELSE 'empirical' END AS origin FROM e)"""


def _weights(spark) -> DataFrame:
    return spark.createDataFrame([("quality", 0.9), ("toxic", 0.6)], "label string, w double")


@query("WITH " + THRESHOLDS + " SELECT label, round(threshold, 6)::DOUBLE AS threshold, origin FROM th")
def agg12_thresholds(spark, d):
    gold = spark.createDataFrame([("quality", 50), ("toxic", 3)], "label string, n long")
    return C.thresholds(C.prepared(B.soft(spark, d)), _weights(spark), gold).withColumn("threshold", r6("threshold"))


def _pairs(spark) -> DataFrame:
    return C.pair_table(spark, (("quality", "toxic"),))


@query("SELECT 'quality' AS first, 'toxic' AS second, round(avg(quality * toxic), 6)::DOUBLE AS joint FROM labels JOIN documents USING (doc_id)")
def agg13_cooccurrence(spark, d):
    return C.cooccurrence(C.prepared(B.soft(spark, d)), _pairs(spark)).withColumn("joint", r6("joint"))


@query("WITH " + B.SOFT + ", f AS (SELECT a.id, a.p > 0.7 AS fa, b.p > 0.7 AS fb FROM soft a JOIN soft b ON a.id = b.id AND a.label = 'quality' AND b.label = 'toxic'), c AS (SELECT count(*) AS n, count(*) FILTER (WHERE fa) AS n_a, count(*) FILTER (WHERE fb) AS n_b, count(*) FILTER (WHERE fa AND fb) AS joint FROM f) SELECT 'quality' AS first, 'toxic' AS second, n_a, n_b, joint, round(n_a * n_b / n::DOUBLE, 6) AS expected, round(joint / (n_a * n_b / n::DOUBLE), 6) AS ratio, joint >= 3 AND joint / (n_a * n_b / n::DOUBLE) >= 2 AS flagged FROM c")
def agg14_codrift(spark, d):
    rows = C.prepared(B.soft(spark, d)).withColumn("accepted", F.col("p") > 0.7)
    return C.codrift(rows, _pairs(spark)).withColumns({"expected": r6("expected"), "ratio": r6("ratio")})


@query("WITH " + B.SCORES + ", v AS (SELECT label, var_pop(p) AS v FROM s GROUP BY label) SELECT round(max(v), 6) AS max_variance, max(v) > 0.01 AS passes FROM v")
def agg16_variance(spark, d):
    return M.collapsed(B.scores(spark, d)).withColumn("max_variance", r6("max_variance"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 12")
def agg17_language_counts(spark, d):
    return t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(12)


@query("WITH " + B.SCORES + " SELECT label, round(sum((1 + p) * (greatest(4 * p - 2, 0) - (4 * p - 2) * y + ln(1 + exp(-abs(4 * p - 2))))) / greatest(sum(1 + p), 1e-8), 6) AS loss FROM s GROUP BY label")
def agg18_weighted_loss(spark, d):
    return B.scores(spark, d).groupBy("label").agg(r6(M.weighted_loss(4 * F.col("p") - 2, F.col("y"), 1 + F.col("p"))).alias("loss"))


@query("SELECT event_type, round(CASE WHEN a < b THEN a ELSE l END, 6) AS lo, round(CASE WHEN a < b THEN b ELSE h END, 6) AS hi FROM (SELECT event_type, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b, min(value) AS l, max(value) AS h FROM events GROUP BY 1)")
def agg19_percentiles(spark, d):
    return volumes.intensity_bounds(t(spark, d, "events"), ["event_type"], "value").select("event_type", r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("SELECT label, i::INT AS i, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(range(0, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL")
def agg20_centroid(spark, d):
    each = t(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    return each.groupBy("label", "i").agg(r6(F.avg(F.col("x").cast("double"))).alias("x"))


@query("SELECT o_custkey AS id, CASE max(CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) WHEN 3 THEN 'affirmed' WHEN 2 THEN 'uncertain' ELSE 'negated' END AS status FROM orders GROUP BY 1")
def agg21_status_precedence(spark, d):
    rank = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    names = F.create_map(*[F.lit(x) for kv in rules.STATUSES.items() for x in kv])
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max(rank).alias("r")).select("id", F.element_at(names, F.col("r")).alias("status"))


@query("SELECT o_custkey AS id, coalesce(arg_max(o_orderkey, o_orderkey) FILTER (WHERE o_orderstatus = 'F'), min(o_orderkey)) AS evidence FROM orders GROUP BY 1")
def agg23_evidence_pick(spark, d):
    sure = F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey"))
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.coalesce(F.max_by("o_orderkey", sure), F.min("o_orderkey")).alias("evidence"))


@query("WITH px AS (SELECT l_suppkey AS k, l_partkey % 200 AS r, l_orderkey % 200 AS c, max(l_quantity) AS v FROM lineitem GROUP BY ALL), t AS (SELECT * FROM px WHERE v > 10), b AS (SELECT k, count(*) AS n, min(r) AS a, max(r) AS b, min(c) AS d, max(c) AS e FROM t GROUP BY k) SELECT k, CASE WHEN n >= 100 THEN greatest(0, a - 4) END AS r0, CASE WHEN n >= 100 THEN b + 5 END AS r1, CASE WHEN n >= 100 THEN greatest(0, d - 4) END AS c0, CASE WHEN n >= 100 THEN e + 5 END AS c1, n FROM b")
def agg24_projection_box(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.pmod("l_partkey", F.lit(200)).alias("r"), F.pmod("l_orderkey", F.lit(200)).alias("c"), F.col("l_quantity").alias("v"))
    return volumes.max_projection_box(li, ["k"], 10.0)


@query("""WITH w AS (SELECT user_id AS id, event_type AS label, CASE event_type WHEN 'click' THEN 'max' WHEN 'view' THEN 'top2' ELSE 'mean' END AS mode, CASE event_type WHEN 'click' THEN 8.0 ELSE 6.0 END::DOUBLE AS beta, 1 / (1 + exp(-value / 100)) AS p FROM events),
g AS (SELECT id, label, mode, beta, max(p) AS mx, avg(p) AS mn, list_avg(list_reverse_sort(list(p))[1:2]) AS t2, list(p) AS ps FROM w GROUP BY ALL),
h AS (SELECT *, CASE mode WHEN 'max' THEN mx WHEN 'top2' THEN t2 ELSE mn END AS hard, list_sum(list_transform(ps, lambda x: exp(beta * (x - mx)) * x)) / list_sum(list_transform(ps, lambda x: exp(beta * (x - mx)))) AS soft FROM g)
SELECT id, label, round(CASE WHEN mode = 'mean' THEN hard ELSE 0.8 * hard + 0.2 * soft END, 6) AS p FROM h""")
def agg25_pool_windows(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("label"), V.sigmoid(F.col("value") / 100).alias("p"))
    kinds = e.select("label").distinct()
    modes = kinds.select("label", F.when(F.col("label") == "click", "max").when(F.col("label") == "view", "top2").otherwise("mean").alias("mode"), F.when(F.col("label") == "click", 8.0).otherwise(6.0).alias("beta"))
    return W.pool(e, modes).withColumn("p", r6("p"))


@query("""WITH base AS (SELECT c_mktsegment AS label, CASE WHEN c_acctbal > 4000 THEN 1 ELSE 0 END AS y, c_custkey AS id, c_acctbal AS prev, (c_custkey * 7919) % 1000 + c_acctbal / 10 AS new FROM customer),
rows_ AS (SELECT *, row_number() OVER (PARTITION BY label, y ORDER BY id) AS place, count(*) OVER (PARTITION BY label, y) AS size FROM base),
dr AS (SELECT label, y, draw, ('0x' || substr(sha256('2026|' || label || '|' || y || '|' || draw || '|' || place), 1, 8))::BIGINT % size + 1 AS place FROM rows_, range(1, 21) t(draw)),
tk AS (SELECT dr.label, draw, y, prev, new FROM dr JOIN rows_ USING (label, y, place) UNION ALL SELECT label, 0, y, prev, new FROM rows_),
pr AS (SELECT label, draw, y, 'prev' AS which, prev AS p FROM tk UNION ALL SELECT label, draw, y, 'new', new FROM tk),
rk AS (SELECT *, rank() OVER (PARTITION BY label, draw, which ORDER BY p) + (count(*) OVER (PARTITION BY label, draw, which, p) - 1) / 2.0 AS r FROM pr),
au AS (SELECT label, draw, which, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn, sum(r) FILTER (WHERE y = 1) AS sr FROM rk GROUP BY ALL),
de AS (SELECT label, draw, sum(CASE WHEN which = 'new' THEN 1 ELSE -1 END * (sr - np * (np + 1) / 2.0) / (np * nn)) AS d FROM au WHERE np * nn > 0 GROUP BY ALL)
SELECT z.label, round(p.d, 6)::DOUBLE AS point, round(avg(CASE WHEN (z.d > 0) = (p.d > 0) AND z.d <> 0 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS agreement FROM de z JOIN de p ON p.label = z.label AND p.draw = 0 WHERE z.draw > 0 GROUP BY z.label, p.d""")
def agg26_bootstrap(spark, d):
    return _agreement(t(spark, d, "customer"), 20)


def _agreement(customers: DataFrame, draws: int) -> DataFrame:
    c = customers.select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 4000).cast("int").alias("y"), F.col("c_acctbal").alias("prev"), (F.pmod(F.col("c_custkey") * 7919, F.lit(1000)) + F.col("c_acctbal") / 10).alias("new"))
    return M.bootstrap_agreement(c, draws).where("point is not null").select("label", r6("point").alias("point"), r6("agreement").alias("agreement"))


@query(None)
def agg26_bootstrap_whole(spark, d):
    return _agreement(t(spark, d, "customer"), referee.DRAWS)


# ranks, windows, order


@query("WITH " + B.MEMBERS + " SELECT member, id, avg_rank::DOUBLE AS avg_rank, round(avg_rank / n, 6)::DOUBLE AS pct, round((avg_rank - 1) / (n - 1), 6)::DOUBLE AS fold FROM r")
def win01_ranks(spark, d):
    m = R.with_ranks(B.members(spark, d).select("member", "id", "p"), ["member"], "p")
    return m.select("member", "id", "avg_rank", r6(R.percentile()).alias("pct"), r6(R.fold_rank("p")).alias("fold"))


@query("WITH " + B.MEMBERS + " SELECT id, 'a' AS label, round(sum(avg_rank / n * CASE member WHEN 'm0' THEN 3.0 WHEN 'm1' THEN 1.0 ELSE 2.0 END) / 6.0, 6)::DOUBLE AS score FROM r GROUP BY id")
def win04_rank_blend(spark, d):
    w = spark.createDataFrame([("m0", 3.0), ("m1", 1.0), ("m2", 2.0)], "member string, w double")
    return R.rank_average(B.members(spark, d), w).withColumn("score", r6("score"))


@query("WITH " + B.SERIES + " SELECT study, slot, series FROM top")
def win05_select_slots(spark, d):
    return S.select_slots(B.series(spark, d), S.rule_table(spark, B.RULES))


@query("WITH " + B.SERIES + " SELECT x.study, max(CASE WHEN slot = 'S0' THEN top.series END) AS s0, max(CASE WHEN slot = 'S1' THEN top.series END) AS s1, max(CASE WHEN slot = 'S2' THEN top.series END) AS s2, max(CASE WHEN slot = 'S3' THEN top.series END) AS s3 FROM (SELECT DISTINCT study FROM se) x LEFT JOIN top ON top.study = x.study GROUP BY x.study")
def win06_slot_table(spark, d):
    wide = S.slot_table(B.series(spark, d), S.rule_table(spark, B.RULES), [r[0] for r in B.RULES])
    return wide.select("study", *[F.col(r[0]).alias(r[0].lower()) for r in B.RULES])


WINDOWS = """n AS (SELECT o_custkey AS id, count(*)::INT AS n FROM orders GROUP BY 1),
b AS (SELECT *, greatest(0, least(floor(0.2 * n)::INT, n - 3)) AS low, least(ceil(0.8 * n)::INT, n) AS high FROM n),
w AS (SELECT *, CASE WHEN n < 3 THEN 0 ELSE low END AS s0, CASE WHEN n < 3 THEN 0 ELSE greatest(low, least(high - 3, n - 3)) END AS s1 FROM b)"""


def _stacks(spark, d) -> DataFrame:
    return t(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("WITH " + WINDOWS + " SELECT id, start::INT AS start, CASE WHEN n < 3 THEN least(2, n - 1) ELSE start + 2 END::INT AS last FROM w, LATERAL (SELECT unnest(range(s0, s1 + 1)) AS start)")
def win07_windows(spark, d):
    w = _stacks(spark, d).select("id", "n", F.explode(W.window_starts(F.col("n"))).alias("start"))
    return w.select("id", "start", F.element_at(W.window_indices(F.col("n"), F.col("start")), -1).alias("last"))


@query("WITH " + WINDOWS + " SELECT id, k::INT AS k, (s0 + round_even(k * (s1 - s0) / greatest(least(8, s1 - s0 + 1) - 1, 1)::DOUBLE, 0))::INT AS start FROM w, LATERAL (SELECT unnest(range(0, least(8, s1 - s0 + 1))) AS k)")
def win08_spread(spark, d):
    w = _stacks(spark, d).withColumn("s", W.window_starts(F.col("n")))
    return w.select("id", F.posexplode(W.spread(F.col("s"), W.window_count(F.size("s")))).alias("k", "start"))


@query("WITH g AS (SELECT user_id AS id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY 1) SELECT id, CASE WHEN len(v) >= 3 THEN greatest(ceil(0.85 * len(v)) - floor(0.15 * len(v)), 1) ELSE len(v) END::INT AS kept, round(CASE WHEN len(v) >= 3 THEN v[floor(0.15 * len(v))::INT + 1] ELSE v[1] END, 6) AS first FROM g")
def win10_central_band(spark, d):
    e = t(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "event_id", "value")
    kept = W.central_rows(e, "id", ["ts", "event_id"])
    return kept.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("kept"), r6(F.min_by("value", "at")).alias("first"))


@query("SELECT o_orderkey, ((dense_rank() OVER (ORDER BY o_custkey) - 1) % 5)::INT AS fold FROM orders")
def win12_regroup_folds(spark, d):
    return splits.round_robin(t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 5, "fold").select("o_orderkey", "fold")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_shipdate DESC) AS k FROM lineitem) WHERE k = 1")
def ded01_keep_last(spark, d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    return J.keep_last(t(spark, d, "lineitem").select("l_orderkey", *order), ["l_orderkey"], order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def ded02_first_seen(spark, d):
    return J.first_seen(t(spark, d, "documents"), "source", "doc_id")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey")
def srt01_multi_key(spark, d):
    return t(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders")
def srt01_whole(spark, d):
    return splits.placed(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], "place").select("o_orderkey", "place")


@query("SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(range(1, 65), lambda i: {'p': embedding[i], 'i': i})), lambda s: s.i - 1), ',') AS places FROM embeddings")
def srt03_argsort(spark, d):
    return t(spark, d, "embeddings").select("vec_id", F.array_join(G.order_by_position(F.col("embedding")).cast("array<string>"), ",").alias("places"))


@query("WITH " + B.SCORES + " SELECT id, label FROM s ORDER BY round(abs(p - 0.5), 6) DESC, id, label")
def srt04_confidence_order(spark, d):
    return B.scores(spark, d).orderBy(F.desc(F.round(F.abs(F.col("p") - 0.5), 6)), "id", "label").select("id", "label")


@query("WITH " + B.SCORES + " SELECT id, label, row_number() OVER (ORDER BY round(abs(p - 0.5), 6) DESC, id, label) - 1 AS place FROM s")
def srt04_whole(spark, d):
    s = B.scores(spark, d).select("id", "label", F.round(F.abs(F.col("p") - 0.5), 6).alias("sure"))
    return splits.placed(s, [F.desc("sure"), "id", "label"], "place").select("id", "label", "place")


@query("SELECT user_id AS id, round(list_sum(list_reverse_sort(list(value))[1:2]), 6) AS top2 FROM events GROUP BY 1")
def srt07_top2(spark, d):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value")))
    return t(spark, d, "events").select("user_id", "value", k.alias("k")).where("k <= 2").groupBy(F.col("user_id").alias("id")).agg(r6(F.sum("value")).alias("top2"))


@query("SELECT c_custkey FROM customer ORDER BY sha256('2026|' || c_custkey)")
def srt08_seeded_shuffle(spark, d):
    return t(spark, d, "customer").orderBy(F.sha2(F.concat(F.lit("2026|"), F.col("c_custkey").cast("string")), 256)).select("c_custkey")


@query("SELECT c_custkey, row_number() OVER (ORDER BY sha256('2026|' || c_custkey), c_custkey) - 1 AS place FROM customer")
def srt08_whole(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.lit("2026|"), F.col("c_custkey").cast("string")), 256).alias("at"))
    return splits.placed(c, ["at", "c_custkey"], "place").select("c_custkey", "place")


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set01_intersect(spark, d):
    return t(spark, d, "documents").select("doc_id").intersect(t(spark, d, "labels").select("doc_id"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)) = 0 AS same")
def set02_same_ids(spark, d):
    return J.same_ids(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def set03_union_all(spark, d):
    return t(spark, d, "documents").select("doc_id").unionByName(t(spark, d, "labels").select("doc_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set04_except(spark, d):
    return t(spark, d, "documents").select("doc_id").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


# text

_VOTES = ", ".join(f"({' + '.join(chr(40) + 'regexp_matches(f, ' + chr(39) + '(^|[^a-z])' + w + '([^a-z]|$)' + chr(39) + ')' + chr(41) + '::INT' for w in ws)}) AS v_{k}" for k, ws in B.WORDS.items())
_TOP = "list_reverse_sort([" + ", ".join(f"{{'n': v_{k}, 'lang': '{k}'}}" for k in B.WORDS) + "])"


@query("SELECT doc_id, md5(lower(strip_accents(text))) AS folded FROM documents")
def txt01_strip_accents(spark, d):
    return t(spark, d, "documents").select("doc_id", F.md5(F.lower(T.strip_accents("text"))).alias("folded"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\p{L}'))::INT AS letters, len(regexp_extract_all(text, '[À-ÿ]'))::INT AS accented FROM documents")
def txt02_script_counts(spark, d):
    return t(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"\p{L}")).alias("letters"), F.regexp_count("text", F.lit("[À-ÿ]")).alias("accented"))


@query(f"WITH x AS (SELECT doc_id, lower(strip_accents(text)) AS f FROM documents), v AS (SELECT doc_id, {_VOTES} FROM x), k AS (SELECT doc_id, {_TOP} AS k FROM v) SELECT doc_id, CASE WHEN k[1].n > 0 AND k[1].n > k[2].n THEN k[1].lang ELSE 'unk' END AS language FROM k")
def txt03_detect_language(spark, d):
    docs = t(spark, d, "documents")
    return docs.select("doc_id", T.detect_language(F.col("text"), F.lower(T.strip_accents("text")), B.WORDS).alias("language"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.;\\n]+'), lambda s: regexp_matches(s, '\\S')))::INT AS sentences, list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]+'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')[1] AS first FROM documents")
def txt05_sentences(spark, d):
    s = T.split_sentences(F.col("text"))
    return t(spark, d, "documents").select("doc_id", F.size(s).alias("sentences"), F.get(s, F.lit(0)).alias("first"))


ENTRIES = [("term", "A", "*", r"tion"), ("term", "A", "fr", r"eau"), ("term", "B", "en", r"ing"), ("term", "B", "de", r"keit"), ("pathology", "", "en", r"the"), ("pathology", "", "fr", r"le"), ("pathology", "", "de", r"der"), ("negation", "", "en", r"not"), ("negation", "", "fr", r"pas"), ("negation", "", "de", r"nicht"), ("uncertainty", "", "en", r"est"), ("uncertainty", "", "fr", r"que"), ("uncertainty", "", "de", r"sch")]


def _rule_sql() -> str:
    langs = ["de", "en", "fr"]

    def test(kind: str) -> str:
        own = {x: "|".join(p for k, _, y, p in ENTRIES if k == kind and y == x) for x in langs}
        whole = "|".join(own[x] for x in langs)
        return "CASE language " + " ".join(f"WHEN '{x}' THEN regexp_matches(f, '{own[x]}')" for x in langs) + f" WHEN 'unk' THEN regexp_matches(f, '{whole}') ELSE false END"

    def term(label: str) -> str:
        of = lambda x: [p for k, y, z, p in ENTRIES if k == "term" and y == label and z == x]
        cases = " ".join(f"WHEN '{x}' THEN regexp_matches(f, '{'|'.join(of(x))}')" for x in langs if of(x))
        every = "|".join(p for x in langs for p in of(x))
        common = f"regexp_matches(f, '{'|'.join(of('*'))}') OR " if of("*") else ""
        return f"({common}CASE language {cases} WHEN 'unk' THEN regexp_matches(f, '{every}') ELSE false END)"

    return f"""WITH x AS (SELECT doc_id AS id, strip_accents(text) AS t, lower(strip_accents(text)) AS f FROM documents), v AS (SELECT id, t, {_VOTES} FROM x), k AS (SELECT id, t, {_TOP} AS k FROM v),
l AS (SELECT id, t, CASE WHEN k[1].n > 0 AND k[1].n > k[2].n THEN k[1].lang ELSE 'unk' END AS language FROM k),
se AS (SELECT id, language, s, no FROM l, LATERAL (SELECT unnest(z) AS s, generate_subscripts(z, 1) AS no FROM (SELECT list_filter(list_transform(regexp_split_to_array(t, '[.;\\n]+'), lambda q: regexp_replace(q, '^\\s+|\\s+$', '', 'g')), lambda q: q <> '') AS z))),
fo AS (SELECT id, language, s, no, lower(s) AS f FROM se),
cu AS (SELECT *, CASE WHEN {test('uncertainty')} THEN 2 WHEN {test('negation')} THEN 1 WHEN {test('pathology')} THEN 3 END AS cue FROM fo),
m AS (SELECT id, language, 'A' AS label, s, no, CASE WHEN {term('A')} THEN coalesce(cue, 3) END AS rank FROM cu UNION ALL SELECT id, language, 'B', s, no, CASE WHEN {term('B')} THEN cue END FROM cu),
g AS (SELECT id, language, label, max(rank) AS r, arg_max(s, no) FILTER (WHERE rank = 3) AS af, arg_min(s, no) FILTER (WHERE rank IS NOT NULL) AS fi FROM m GROUP BY ALL),
w AS (SELECT l.id, l.language, la.label, g.r, g.af, g.fi FROM l CROSS JOIN (VALUES ('A'), ('B')) la(label) LEFT JOIN g ON g.id = l.id AND g.label = la.label)
SELECT id, language, label, CASE coalesce(r, 0) WHEN 3 THEN 'affirmed' WHEN 2 THEN 'uncertain' WHEN 1 THEN 'negated' ELSE 'not_mentioned' END AS status,
  CASE coalesce(r, 0) WHEN 3 THEN 0.9 WHEN 2 THEN 0.6 WHEN 1 THEN 0.05 ELSE 0.35 END::DOUBLE AS score, coalesce(substr(af, 1, 160), substr(fi, 1, 160), '') AS evidence FROM w"""


@query(_rule_sql())
def txt07_rules_extractor(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("report"))
    return rules.extract(docs, ENTRIES, ("A", "B"), ("A",), B.WORDS)


@query("SELECT o_orderkey AS id, array_to_string(list_distinct_sorted, '|') AS items FROM (SELECT o_orderkey, [trim(o_orderstatus), lower(o_orderpriority)] AS list_distinct_sorted FROM orders)")
def txt11_comma_list(spark, d):
    both = F.array(F.concat(F.lit(" "), "o_orderstatus", F.lit(", "), F.lower("o_orderpriority")), F.concat("o_orderstatus", F.lit(",,")))
    return t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(T.comma_list(both), "|").alias("items"))


# hashes, numbers, geometry, arrays


@query("SELECT o_orderkey AS study, (('0x' || substr(sha256('7|' || CASE WHEN o_orderstatus = 'P' THEN o_orderkey::VARCHAR ELSE o_custkey::VARCHAR END || '|' || o_orderpriority || '|unknown'), 1, 8))::BIGINT % 5)::INT AS fold FROM orders")
def num02_cv_splits(spark, d):
    o = t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("study"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_custkey").cast("string")).alias("patient"), F.col("o_orderpriority").alias("site"))
    return splits.cv_splits(o, 5, 7).select(F.col("study").cast("long").alias("study"), "fold")


@query("SELECT event_id, round(1 / (1 + exp(-value / 50)), 6) AS p, round(greatest(value / 50, 0) - value / 50 + ln(1 + exp(-abs(value / 50))), 6) AS bce FROM events")
def num03_sigmoid_bce(spark, d):
    x = F.col("value") / 50
    return t(spark, d, "events").select("event_id", r6(V.sigmoid(x)).alias("p"), r6(V.bce(x, F.lit(1.0))).alias("bce"))


GEO = """g AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
c AS (SELECT *, e[2]*e[6]-e[3]*e[5] AS x, e[3]*e[4]-e[1]*e[6] AS y, e[1]*e[5]-e[2]*e[4] AS z FROM g),
n AS (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM c)"""


def _geo(spark, d) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    return t(spark, d, "embeddings").select("vec_id", "label", F.slice(e, 1, 6).alias("o"), F.slice(e, 7, 3).alias("p")).withColumn("n", G.slice_normal(F.col("o")))


@query("WITH " + GEO + " SELECT vec_id, round(x / l, 5) AS nx, round(y / l, 5) AS ny, round(z / l, 5) AS nz FROM n WHERE l > 1e-9")
def geo01_normals(spark, d):
    return _geo(spark, d).where("n is not null").select("vec_id", *[F.round(F.col("n")[i], 5).alias(k) for i, k in enumerate(("nx", "ny", "nz"))])


@query("WITH " + GEO + " SELECT vec_id, round((e[7]*x + e[8]*y + e[9]*z) / l, 5) AS pos FROM n WHERE l > 1e-9")
def geo02_positions(spark, d):
    return _geo(spark, d).where("n is not null").select("vec_id", F.round(G.dot(F.col("p"), F.col("n")), 5).alias("pos"))


@query("SELECT vec_id, CASE WHEN label = 1 THEN 'L' WHEN label = 2 THEN 'R' WHEN embedding[1] >= 0 THEN 'L' ELSE 'R' END AS side FROM embeddings")
def geo03_laterality(spark, d):
    tag = F.when(F.col("label") == 1, " left").when(F.col("label") == 2, "Right")
    return t(spark, d, "embeddings").select("vec_id", G.laterality(tag, F.col("embedding")[0].cast("double")).alias("side"))


@query("WITH p AS (SELECT p_partkey AS id, p_size * 10 AS r, p_size * 7 AS c, p_size / 10.0 AS s FROM part), z AS (SELECT *, least(r, greatest(1, round_even(13.0 / s, 0)::INT)) AS h, least(c, greatest(1, round_even(13.0 / (s / 2), 0)::INT)) AS w FROM p) SELECT id, ((r - h) // 2)::INT AS r0, ((r - h) // 2 + h)::INT AS r1, ((c - w) // 2)::INT AS c0, ((c - w) // 2 + w)::INT AS c1 FROM z")
def geo04_crop_bounds(spark, d):
    p = t(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10).alias("r"), (F.col("p_size") * 7).alias("c"), (F.col("p_size") / 10.0).alias("s"))
    return p.select("id", G.crop_bounds(F.col("r"), F.col("c"), F.col("s"), F.col("s") / 2, 13.0).alias("b")).select("id", "b.*")


@query("WITH u AS (SELECT vec_id, unnest(range(0, len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), b AS (SELECT vec_id, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM u GROUP BY vec_id) SELECT vec_id, i::INT AS i, round((least(hi, greatest(lo, x)) - lo) / (hi - lo), 5) AS x FROM u JOIN b USING (vec_id)")
def arr02_normalise(spark, d):
    v = volumes.normalised_array(F.col("embedding").cast("array<double>"))
    return t(spark, d, "embeddings").select("vec_id", F.posexplode(v).alias("i", "x")).select("vec_id", "i", F.round("x", 5).alias("x"))


@query("SELECT vec_id, (i // 32)::INT AS slice, (i % 32)::INT AS col, round(CASE WHEN label % 2 = 0 THEN embedding[i + 1] WHEN label % 4 = 1 THEN embedding[(i + 32) % 64 + 1] ELSE embedding[i // 32 * 32 + 32 - i % 32] END::DOUBLE, 6) AS v FROM embeddings, range(0, 64) t(i)")
def arr03_side_normalised(spark, d):
    e = F.col("embedding").cast("array<double>")
    stack = F.array(F.array(F.slice(e, 1, 32)), F.array(F.slice(e, 33, 32)))
    out = volumes.side_normalised(stack, F.when(F.pmod("label", F.lit(4)) == 1, " Sagittal").otherwise("axial"), F.when(F.pmod("label", F.lit(2)) == 0, "L").otherwise("R"))
    slices = t(spark, d, "embeddings").select("vec_id", F.posexplode(out).alias("slice", "rows"))
    return slices.select("vec_id", "slice", F.posexplode(F.col("rows")[0]).alias("col", "v")).select("vec_id", "slice", "col", r6("v").alias("v"))


@query("WITH m AS (SELECT user_id AS study, event_type AS slot, count(*)::DOUBLE AS n FROM events GROUP BY ALL) SELECT study, coalesce(max(CASE WHEN slot = 'click' THEN n END), 0) AS a, coalesce(max(CASE WHEN slot = 'none' THEN n END), 0) AS b, max(CASE WHEN slot = 'click' THEN 1 END) IS NOT NULL AS has_a FROM m GROUP BY study")
def arr06_slot_stack(spark, d):
    g = t(spark, d, "events").groupBy(F.col("user_id").alias("study"), F.col("event_type").alias("slot")).agg(F.array(F.count(F.lit(1)).cast("double")).alias("data"))
    s = volumes.slot_stack(g, ["click", "none"], 1)
    return s.select("study", F.col("data")[0][0].alias("a"), F.col("data")[1][0].alias("b"), F.col("mask")[0].alias("has_a"))


@query("SELECT vec_id, 70::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total FROM embeddings")
def arr07_pad(spark, d):
    p = volumes.padded(F.col("embedding").cast("array<double>"), 70)
    return t(spark, d, "embeddings").select("vec_id", F.size(p).alias("n"), F.round(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("WITH e AS (SELECT vec_id, list_transform(range(1, 9), lambda i: {'v': embedding[i]::DOUBLE, 's': embedding[i + 8]::DOUBLE}) AS z FROM embeddings), f AS (SELECT vec_id, list_filter(z, lambda x: x.v > 0) AS z FROM e) SELECT vec_id, round(list_sum(list_transform(z, lambda x: exp(x.s) * x.v)) / list_sum(list_transform(z, lambda x: exp(x.s))), 6) AS pooled FROM f WHERE len(z) > 0")
def ml01_masked_softmax(spark, d):
    e = F.col("embedding").cast("array<double>")
    v = F.slice(e, 1, 8)
    out = W.masked_softmax_mean(v, F.slice(e, 9, 8), F.transform(v, lambda x: x > 0))
    return t(spark, d, "embeddings").select("vec_id", r6(out).alias("pooled")).where("pooled is not null")


# order-dependent operators


@query(None)
def itr01_stratified_split(spark, d):
    return splits.stratified_split(t(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic"), ["quality", "toxic"], 12)


CANDIDATES = THRESHOLDS + """,
q AS (SELECT soft.*, threshold AS t, CASE WHEN p >= threshold AND (p < threshold OR greatest(1e-6, least(1 - 1e-6, p)) >= 0.5) THEN 1 WHEN 1 - p >= 1 - threshold THEN 0 WHEN p >= threshold THEN 1 END AS sure FROM soft JOIN th USING (label)),
n AS (SELECT label, given, count(*) AS n, count(*) FILTER (WHERE sure = 1 - given) AS off, count(sure) AS al FROM q GROUP BY ALL),
pr AS (SELECT label, given, CASE WHEN n > 10 THEN round_even(off / al::DOUBLE * n, 0) ELSE 0 END AS prune FROM n),
mg AS (SELECT id, label, given, CASE WHEN given = 1 THEN 1 - 2 * p ELSE 2 * p - 1 END AS margin FROM q),
rk AS (SELECT *, row_number() OVER (PARTITION BY label, given ORDER BY margin DESC, id) AS r FROM mg WHERE margin > 0),
fl AS (SELECT id, label FROM rk JOIN pr USING (label, given) WHERE r <= prune)"""


@query("WITH " + CANDIDATES + " SELECT id, label FROM fl")
def itr02_candidates(spark, d):
    gold = spark.createDataFrame([("quality", 50), ("toxic", 3)], "label string, n long")
    rows = C.prepared(B.soft(spark, d))
    return C.candidates(rows, C.thresholds(rows, _weights(spark), gold)).where("flag").select("id", "label")


@query("WITH RECURSIVE " + CANDIDATES + """,
bd AS (SELECT label, count(*) AS n, sum(given) AS pos, CASE label WHEN 'quality' THEN 0.02 + 0.18 * (0.9 - 0.65) / 0.35 ELSE 0.02 END AS rel FROM soft GROUP BY label),
lim AS (SELECT label, pos, ceil(pos * (1 - rel) - 1e-9) AS low, floor(pos * (1 + rel) + 1e-9) AS high FROM bd),
seq AS (SELECT id, label, given, row_number() OVER (PARTITION BY label ORDER BY -abs(p - 0.5), id) AS k FROM fl JOIN soft USING (id, label)),
wk AS (SELECT label, 0::BIGINT AS k, pos AS x, NULL::BIGINT AS id, false AS ok FROM lim
  UNION ALL SELECT wk.label, seq.k, CASE WHEN wk.x + 1 - 2 * given BETWEEN low AND high THEN wk.x + 1 - 2 * given ELSE wk.x END, seq.id, wk.x + 1 - 2 * given BETWEEN low AND high FROM wk JOIN seq ON seq.label = wk.label AND seq.k = wk.k + 1 JOIN lim ON lim.label = wk.label)
SELECT id, label FROM wk WHERE ok""")
def itr03_capped(spark, d):
    gold = spark.createDataFrame([("quality", 50), ("toxic", 3)], "label string, n long")
    rows = C.prepared(B.soft(spark, d))
    flagged = C.candidates(rows, C.thresholds(rows, _weights(spark), gold))
    return C.capped(flagged, C.bands(rows, _weights(spark))).where("accepted").select("id", "label")


@query("""WITH """ + B.SOFT + """,
b AS (SELECT a.id, a.given AS ga, b.given AS gb, a.p > 0.6 AS xa, b.p > 0.6 AS xb, CASE WHEN a.p > 0.6 THEN 1 - a.given ELSE a.given END AS na, CASE WHEN b.p > 0.6 THEN 1 - b.given ELSE b.given END AS nb, abs(a.p - 0.5) AS ca, abs(b.p - 0.5) AS cb FROM soft a JOIN soft b ON a.id = b.id AND a.label = 'quality' AND b.label = 'toxic'),
st AS (SELECT count(*) AS n, sum(ga * gb) AS bef, sum(na * nb) AS aft FROM b),
lm AS (SELECT *, greatest(0, aft - floor(n * (bef / n::DOUBLE * 1.2 + 1e-9))) AS ov, greatest(0, ceil(n * (bef / n::DOUBLE * 0.8 - 1e-9)) - aft) AS un FROM st),
of AS (SELECT id, CASE WHEN ov > 0 THEN least(CASE WHEN xa AND ga = 0 AND nb = 1 THEN {'c': ca, 'l': 'quality'} END, CASE WHEN xb AND gb = 0 AND na = 1 THEN {'c': cb, 'l': 'toxic'} END) ELSE least(CASE WHEN xa AND ga = 1 AND nb = 1 THEN {'c': ca, 'l': 'quality'} END, CASE WHEN xb AND gb = 1 AND na = 1 THEN {'c': cb, 'l': 'toxic'} END) END AS o, ov + un AS m FROM b, lm WHERE ov + un > 0),
gone AS (SELECT id, o.l AS label FROM (SELECT *, row_number() OVER (ORDER BY o.c, o.l, id) AS r FROM of WHERE o IS NOT NULL) WHERE r <= m)
SELECT id, label FROM soft WHERE p > 0.6 EXCEPT SELECT id, label FROM gone""")
def itr04_joint_bands(spark, d):
    rows = C.prepared(B.soft(spark, d)).withColumn("accepted", F.col("p") > 0.6)
    return C.enforce_joint_bands(rows, _pairs(spark))[0].where("accepted").select("id", "label")


#: A whole round: thresholds by the gold rows' positives, candidates that aren't gold, capped, within joint bands, paused.
ROUND = B.SOFT + """,
gl AS (SELECT soft.*, source = 'src0' AS gold FROM soft JOIN documents ON doc_id = id),
e AS (SELECT label, coalesce(avg(p) FILTER (WHERE cur >= 0.5), 0.5) AS e, CASE label WHEN 'quality' THEN 0.9 ELSE 0.6 END::DOUBLE AS w, count(*) FILTER (WHERE cur >= 0.5 AND gold) AS n FROM gl GROUP BY label),
""" + THRESHOLDS[THRESHOLDS.index("th AS") :] + CANDIDATES[len(THRESHOLDS) :] + """,
fg AS (SELECT id, label FROM fl JOIN gl USING (id, label) WHERE NOT gold),
bd AS (SELECT label, count(*) AS n, sum(given) AS pos, CASE label WHEN 'quality' THEN 0.02 + 0.18 * (0.9 - 0.65) / 0.35 ELSE 0.02 END AS rel FROM soft GROUP BY label),
lim AS (SELECT label, pos, ceil(pos * (1 - rel) - 1e-9) AS low, floor(pos * (1 + rel) + 1e-9) AS high FROM bd),
seq AS (SELECT id, label, given, row_number() OVER (PARTITION BY label ORDER BY -abs(p - 0.5), id) AS k FROM fg JOIN soft USING (id, label)),
wk AS (SELECT label, 0::BIGINT AS k, pos AS x, NULL::BIGINT AS id, false AS ok FROM lim
  UNION ALL SELECT wk.label, seq.k, CASE WHEN wk.x + 1 - 2 * given BETWEEN low AND high THEN wk.x + 1 - 2 * given ELSE wk.x END, seq.id, wk.x + 1 - 2 * given BETWEEN low AND high FROM wk JOIN seq ON seq.label = wk.label AND seq.k = wk.k + 1 JOIN lim ON lim.label = wk.label),
ac AS (SELECT soft.*, fg.id IS NOT NULL AS flag, w.id IS NOT NULL AS x FROM soft LEFT JOIN fg USING (id, label) LEFT JOIN (SELECT id, label FROM wk WHERE ok) w USING (id, label)),
b AS (SELECT a.id, a.given AS ga, b.given AS gb, a.x AS xa, b.x AS xb, CASE WHEN a.x THEN 1 - a.given ELSE a.given END AS na, CASE WHEN b.x THEN 1 - b.given ELSE b.given END AS nb, abs(a.p - 0.5) AS ca, abs(b.p - 0.5) AS cb FROM ac a JOIN ac b ON a.id = b.id AND a.label = 'quality' AND b.label = 'toxic'),
st AS (SELECT count(*) AS n, sum(ga * gb) AS bef, sum(na * nb) AS aft FROM b),
lm AS (SELECT *, greatest(0, aft - floor(n * (bef / n::DOUBLE * 1.2 + 1e-9))) AS ov, greatest(0, ceil(n * (bef / n::DOUBLE * 0.8 - 1e-9)) - aft) AS un FROM st),
of AS (SELECT id, CASE WHEN ov > 0 THEN least(CASE WHEN xa AND ga = 0 AND nb = 1 THEN {'c': ca, 'l': 'quality'} END, CASE WHEN xb AND gb = 0 AND na = 1 THEN {'c': cb, 'l': 'toxic'} END) ELSE least(CASE WHEN xa AND ga = 1 AND nb = 1 THEN {'c': ca, 'l': 'quality'} END, CASE WHEN xb AND gb = 1 AND na = 1 THEN {'c': cb, 'l': 'toxic'} END) END AS o, ov + un AS m FROM b, lm WHERE ov + un > 0),
gone AS (SELECT id, o.l AS label FROM (SELECT *, row_number() OVER (ORDER BY o.c, o.l, id) AS r FROM of WHERE o IS NOT NULL) WHERE r <= m),
dn AS (SELECT ac.*, x AND gone.id IS NULL AS kept FROM ac LEFT JOIN gone USING (id, label)),
df AS (SELECT count(*) AS n, count(*) FILTER (WHERE a.kept) AS na, count(*) FILTER (WHERE b.kept) AS nb, count(*) FILTER (WHERE a.kept AND b.kept) AS joint FROM dn a JOIN dn b ON a.id = b.id AND a.label = 'quality' AND b.label = 'toxic'),
pz AS (SELECT coalesce(joint >= 3 AND joint / nullif(na * nb / n::DOUBLE, 0) >= 2, false) AS paused FROM df)"""


@query("WITH RECURSIVE " + ROUND + """
SELECT label, avg(given)::DOUBLE AS prevalence_before, avg(CASE WHEN kept AND NOT paused THEN 1 - given ELSE given END)::DOUBLE AS prevalence_after, count(*) FILTER (WHERE flag) AS candidates, count(*) FILTER (WHERE kept AND NOT paused) AS accepted, bool_or(paused) AS paused FROM dn, pz GROUP BY label""")
def itr06_round(spark, d):
    gold = t(spark, d, "documents").where("source = 'src0'").select(F.col("doc_id").alias("id"))
    return C.run_corrections(B.soft(spark, d), _weights(spark), gold, _pairs(spark))["counts"]


GATE = B.SCORES + """,
w AS (SELECT id, label, y, 'prev' AS which, p FROM s UNION ALL SELECT id, label, y, 'new', p * 0.7 + y * 0.3 FROM s),
k AS (SELECT *, rank() OVER (PARTITION BY label, which ORDER BY p) + (count(*) OVER (PARTITION BY label, which, p) - 1) / 2.0 AS r FROM w),
a AS (SELECT label, which, count(*) FILTER (WHERE y = 1) AS np, count(*) FILTER (WHERE y = 0) AS nn, sum(r) FILTER (WHERE y = 1) AS sr FROM k GROUP BY ALL),
u AS (SELECT label, which, (sr - np * (np + 1) / 2.0) / (np * nn) AS auc FROM a),
dl AS (SELECT label, max(auc) FILTER (WHERE which = 'prev') AS pa, max(auc) FILTER (WHERE which = 'new') AS na FROM u GROUP BY label)"""


def _gate(spark, d) -> DataFrame:
    s = B.scores(spark, d).select("id", "label", "y", F.col("y").alias("y_new"), F.col("p").alias("prev"), (F.col("p") * 0.7 + F.col("y") * 0.3).alias("new"))
    return referee.cv_gate(referee.auc_deltas(s), trusted=("quality",))


@query("WITH " + GATE + " SELECT round(pa, 5)::DOUBLE AS macro_prev, round(na, 5)::DOUBLE AS macro_new, round(na - pa, 5)::DOUBLE AS macro_delta, na - pa >= 0.003 AS accepted FROM dl WHERE label = 'quality'")
def itr07_gate(spark, d):
    return _gate(spark, d).select(*[F.round(c, 5).alias(c) for c in ("macro_prev", "macro_new", "macro_delta")], "accepted")


@query("SELECT false AS stop, false AS rollback, 'accepted; continue' AS reason")
def itr10_stop(spark, d):
    return referee.stop_decision(_gate(spark, d), None, 1)


from . import evaluation, jobs  # noqa: E402, F401  their queries register themselves
