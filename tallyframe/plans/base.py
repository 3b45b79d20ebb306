"""The tables in the roles that the operators work on, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scores(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, y, p): two labels of documents with a score made from the id."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels")
    both = labels.join(docs, "doc_id")
    p = lambda k: (F.pmod(F.col("doc_id") * 7919 + k, F.lit(1000)) / 1000.0).cast("double")
    pairs = F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("y"), p(0).alias("p")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("y"), p(13).alias("p")))
    return both.select(F.col("doc_id").alias("id"), F.explode(pairs).alias("s")).select("id", "s.*")


SCORES = """s AS (
  SELECT doc_id AS id, 'quality' AS label, quality AS y, ((doc_id * 7919) % 1000) / CAST(1000 AS DOUBLE) AS p FROM labels JOIN documents USING (doc_id)
  UNION ALL SELECT doc_id, 'toxic', toxic, ((doc_id * 7919 + 13) % 1000) / CAST(1000 AS DOUBLE) FROM labels JOIN documents USING (doc_id))"""


def soft(spark: SparkSession, d: str) -> DataFrame:
    """(id, label, cur, p): soft labels near the given ones, and a teacher's probability."""
    cur = F.when(F.col("y") == 1, 0.9).otherwise(0.1)
    return scores(spark, d).select("id", "label", cur.alias("cur"), "p")


SOFT = SCORES + """,
soft AS (SELECT id, label, CASE WHEN y = 1 THEN 0.9 ELSE 0.1 END::DOUBLE AS cur, p, y AS given FROM s)"""


def members(spark: SparkSession, d: str) -> DataFrame:
    """(member, id, label, p): three predictions of each document."""
    docs = table(spark, d, "documents")
    ps = [F.pmod(F.col("doc_id") * 7919, F.lit(1000)), F.pmod(F.col("doc_id") * 104729, F.lit(97)), F.col("n_chars")]
    each = F.explode(F.array(*[F.struct(F.lit(f"m{i}").alias("member"), p.cast("double").alias("p")) for i, p in enumerate(ps)]))
    return docs.select(F.col("doc_id").alias("id"), F.lit("a").alias("label"), each.alias("s")).select("s.member", "id", "label", "s.p")


MEMBERS = """m AS (
  SELECT 'm0' AS member, doc_id AS id, CAST((doc_id * 7919) % 1000 AS DOUBLE) AS p FROM documents
  UNION ALL SELECT 'm1', doc_id, CAST((doc_id * 104729) % 97 AS DOUBLE) FROM documents
  UNION ALL SELECT 'm2', doc_id, CAST(n_chars AS DOUBLE) FROM documents),
r AS (SELECT *, rank() OVER (PARTITION BY member ORDER BY p) + (count(*) OVER (PARTITION BY member, p) - 1) / 2.0 AS avg_rank, count(*) OVER (PARTITION BY member) AS n FROM m)"""

RULES = (("S0", "a", 1, 1), ("S1", "n", 0, 0), ("S2", "r", 1, None), ("S3", "n", 1, None))


def series(spark: SparkSession, d: str) -> DataFrame:
    """(study, series, plane, fluid, fat, n): orders as studies, their lines as series."""
    li = table(spark, d, "lineitem")
    own = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd"), F.col("l_extendedprice").cast("decimal(18,2)"))
    return li.select(F.col("l_orderkey").alias("study"), own.alias("series"), F.concat(F.lit(" "), "l_returnflag").alias("plane"), (F.col("l_linestatus") == "F").cast("int").alias("fluid"), F.pmod("l_linenumber", F.lit(2)).cast("int").alias("fat"), F.col("l_quantity").cast("int").alias("n"))


SERIES = """se AS (
  SELECT l_orderkey AS study, concat_ws('-', l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'), CAST(l_extendedprice AS DECIMAL(18,2))) AS series,
    lower(l_returnflag) AS plane, CAST(l_linestatus = 'F' AS INT) AS fluid, l_linenumber % 2 AS fat, CAST(l_quantity AS INT) AS n FROM lineitem),
ru AS (SELECT * FROM (VALUES ('S0', 'a', 1, 1), ('S1', 'n', 0, 0), ('S2', 'r', 1, NULL), ('S3', 'n', 1, NULL)) t(slot, rp, rf, rs)),
top AS (SELECT * FROM (SELECT study, slot, series, row_number() OVER (PARTITION BY study, slot ORDER BY n DESC, series) AS k FROM se JOIN ru ON plane = rp AND fluid = rf AND (rs IS NULL OR fat = rs)) WHERE k = 1)"""

WORDS = {"en": ["the", "of", "and"], "fr": ["le", "la", "et"], "de": ["der", "die", "und"], "es": ["el", "que", "y"]}


def two_engines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Status rows (id, label, status, score[, error]) of orders by two sources."""
    orders = table(spark, d, "orders")
    rules = orders.select(F.col("o_orderkey").alias("id"), F.lit("A").alias("label"), F.when(F.col("o_orderstatus") == "F", "affirmed").otherwise("negated").alias("status"), F.lit(0.5).alias("score"))
    model = orders.where("o_totalprice > 100000").select(F.col("o_orderkey").alias("id"), F.lit("A").alias("label"), F.when(F.col("o_orderpriority") < "3", "affirmed").otherwise("uncertain").alias("status"), F.lit(0.75).alias("score"), F.when(F.col("o_orderpriority").startswith("5"), "refused").otherwise("").alias("error"))
    return rules, model


ENGINES = """rl AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'affirmed' ELSE 'negated' END AS status, 0.5::DOUBLE AS score FROM orders),
md AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN 'affirmed' ELSE 'uncertain' END AS status, 0.75::DOUBLE AS score, CASE WHEN o_orderpriority LIKE '5%' THEN 'refused' ELSE '' END AS error FROM orders WHERE o_totalprice > 100000)"""
