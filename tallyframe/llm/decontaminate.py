"""Operator 4: benchmark decontamination by winnowing, with DataFrame functions only.

A text's fingerprints are the least hashes of K-word sequences in each run of W of them (Schleimer et al., 2003), so two
texts that share SPAN = K + W - 1 words in a row share a fingerprint. Documents that share one with a benchmark item are
read again; each place where a K-word sequence of such a document has an item's fingerprint gives an alignment, and the
item's words are compared with the document's along it. Runs of equal words that hold a whole window are hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SPAN, K = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII characters that aren't part of a word.
SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Rows that a broadcast may have: about 100 MB.
MOST_BROADCAST = 2_000_000


def let(value: Column, body) -> Column:
    """body(value), in which value is evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z in lower case; null has none."""
    breaks = "".join(c for c in SEPARATORS if c not in UPPER)
    plain = F.translate(F.coalesce(text, F.lit("")), UPPER + breaks, LOWER + " " * len(breaks))
    return F.array_remove(F.split(plain, " "), "")


def gram_hashes(words: Column, k: int) -> Column:
    """Hashes of each k words in a row."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    grams = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[h[i + j] for j in range(k)]))
    return let(hashed, lambda h: F.when(F.size(h) >= k, grams(h)).otherwise(F.array().cast("array<bigint>")))


def fingerprints(words: Column, span: int = SPAN, k: int = K) -> Column:
    """Distinct winnowing fingerprints: the least hash in each run of span - k + 1 hashes."""
    w = span - k + 1
    least = lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - w), lambda i: F.least(*[g[i + j] for j in range(w)]))
    return let(gram_hashes(words, k), lambda g: F.when(F.size(g) >= w, F.array_distinct(least(g))).otherwise(F.array().cast("array<bigint>")))


def _anchors(docs: DataFrame, marks: DataFrame, n_marks: int, k: int) -> DataFrame:
    """(doc, item, shift): alignments at which k words in a row of a document may equal an item's."""
    placed = docs.select("doc", F.posexplode(gram_hashes(F.col("words"), k)).alias("p", "mark"))
    return placed.join(common.small(marks, n_marks, MOST_BROADCAST), "mark").select("doc", "item", (F.col("p") - F.col("q")).alias("shift")).distinct()


def _whole(items: DataFrame, n: int) -> DataFrame:
    """The marks of items of n words: the hash of all their words."""
    return items.where((F.col("n") == n) & F.lit(n > 0)).select(F.element_at(gram_hashes(F.col("words"), max(n, 1)), 1).alias("mark"), "item", F.lit(0).alias("q"), F.lit(n).alias("k"))


def contaminated(docs: DataFrame, items: DataFrame, span: int = SPAN, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(counts, hits): counts has doc, key and n_words of each document; hits has (doc, key, item_id, pos, length), a row
    for each occurrence of a window of an item: `span` words in a row, or all words of an item with fewer.

    items: (item_id, text). Null text has no words; items without words hit nothing. Rows that repeat a doc_id are one
    document, with the most words of them and the hits of all; items that repeat an item_id likewise. Rows without a
    doc_id are one document for each text, told apart by `key` (see row_key), which is null for all others; items without
    an item_id are one item, whose id stays null in hits. Very long
    texts are read whole; a window that several items have is a hit of each of them (ties). An empty table of documents
    gives no counts and no hits, an empty table of items no hits. Extra columns, whatever their names, are not carried.
    """
    spark = docs.sparkSession
    items = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    bench = items.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct()
    bench = common.written(bench.select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")
    sized = bench.withColumn("n", F.size("words"))
    n_words = sized.agg(F.sum("n")).first()[0] or 0
    short = sorted(r.n for r in sized.where(F.col("n") < span).select("n").distinct().collect())  # span - 1 rows at most
    # marks: (mark, item, q, k): an item's chosen hashes and where they stand; whole short items are their only mark
    marks = common.written(
        sized.where(F.col("n") >= span)
        .select("item", let(F.struct(gram_hashes(F.col("words"), k).alias("g"), fingerprints(F.col("words"), span, k).alias("f")), lambda s: F.filter(F.transform(s["g"], lambda m, q: F.struct(m.alias("mark"), q.alias("q"))), lambda m: F.array_contains(s["f"], m["mark"]))).alias("m"))
        .select("item", F.explode("m").alias("m"))
        .select("m.mark", "item", "m.q", F.lit(k).alias("k"))
        .unionByName(reduce(DataFrame.unionByName, [_whole(sized, n) for n in short], _whole(sized, 0))),
        "marks",
    )
    n_marks = marks.count()

    text = F.col(text_col).cast("string")
    own = docs.select(F.col(id_col).alias("doc"), row_key(F.col(id_col), text).alias("key"), text.alias("text"))
    # which documents share a fingerprint with an item, and how many words each has
    chosen = lambda w: F.flatten(F.array(fingerprints(w, span, k), *[F.array_distinct(gram_hashes(w, n)) for n in short]))
    seen = own.select("doc", "key", let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), chosen(w).alias("marks"))).alias("s"))
    seen = seen.select("doc", "key", F.col("s.n_words").cast("long").alias("n_words"), F.explode_outer("s.marks").alias("mark"))
    known = common.small(marks.select("mark", F.lit(1).alias("known")).distinct(), n_marks, MOST_BROADCAST)
    counts = common.written(seen.join(known, "mark", "left").groupBy("doc", "key").agg(F.max("n_words").alias("n_words"), F.max("known").alias("known")), "seen")

    maybe = counts.where("known = 1").select(F.col("doc").alias("d"), F.col("key").alias("k"))
    maybe = common.small(maybe, maybe.count(), MOST_BROADCAST)
    near = own.join(maybe, F.col("doc").eqNullSafe(F.col("d")) & F.col("key").eqNullSafe(F.col("k")), "left_semi").select("doc", "key", words_of(F.col("text")).alias("words")).distinct()
    row = common.written(near.select(F.monotonically_increasing_id().alias("row"), "doc", "key", "words"), "maybe")
    keyed = row.select(F.col("row").alias("doc"), "words")
    anchors = reduce(DataFrame.unionByName, [_anchors(keyed, marks.where(F.col("k") == n).select("mark", "item", "q"), n_marks, n) for n in sorted({k, *short})])
    # along each alignment, the windows of the item that the document holds in full
    both = anchors.withColumnRenamed("doc", "row").join(row, "row").join(common.small(bench.select("item", "item_id", F.col("words").alias("own")), n_words, MOST_BROADCAST), "item")
    length = F.least(F.size("own"), F.lit(span))
    at = lambda j: F.get(F.col("words"), F.col("shift") + j)
    equal = F.transform(F.col("own"), lambda v, j: (F.col("shift") + j >= 0) & at(j).eqNullSafe(v))
    starts = let(equal, lambda e: F.filter(F.sequence(F.lit(0), F.size("own") - length), lambda j: ~F.array_contains(F.slice(e, j + 1, length), False)))
    hits = both.select("doc", "key", "item_id", "shift", length.alias("length"), F.explode(starts).alias("j"))
    hits = hits.select("doc", "key", "item_id", (F.col("shift") + F.col("j")).alias("pos"), F.col("length")).distinct()
    hits = common.written(hits, "hits")
    common.forget(bench, marks, row)
    return counts.select("doc", "key", "n_words"), hits


def row_key(doc: Column, text: Column) -> Column:
    """The digest of the text of a row without an id; null for rows that have one."""
    return F.when(doc.isNull(), F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def same_document(a: DataFrame, b: DataFrame) -> Column:
    """Whether rows of two tables have the same doc and key, nulls included."""
    return a["doc"].eqNullSafe(b["doc"]) & a["key"].eqNullSafe(b["key"])


def hit_words(hits: DataFrame) -> DataFrame:
    """(doc, key, n_hit): words of each document inside any hit, each counted once."""
    spans = hits.groupBy("doc", "key", "pos").agg(F.max("length").alias("length"))
    before = F.max(F.col("pos") + F.col("length")).over(Window.partitionBy("doc", "key").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("doc", "key", "pos", (F.col("pos") + F.col("length")).alias("end"), before.alias("before"))
    new = F.col("end") - F.least(F.col("end"), F.greatest(F.col("pos"), F.coalesce("before", F.lit(0))))
    return spans.groupBy("doc", "key").agg(F.sum(new).cast("long").alias("n_hit"))


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each document, as `contaminated` tells them apart. A
    null item_id counts as one item, written as nothing among the ids."""
    counts, hits = contaminated(docs, items)
    ids = hits.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    words = hit_words(hits)
    found = words.join(ids, same_document(words, ids)).select(words["doc"], words["key"], "n_hit", "items")
    out = counts.join(found, same_document(counts, found), "left").select(counts["doc"].alias("doc_id"), "n_words", "n_hit", "items")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of an item; a row without an id is judged by its own text.

    Null and empty texts stay. Of rows that repeat an id, all go if one holds a window. All columns are kept, whatever
    their names; an empty table gives an empty table. Up to MOST_BROADCAST contaminated ids are broadcast, so the texts
    stay where they are.
    """
    _, hits = contaminated(docs, items)
    gone = common.written(hits.select("doc", F.col("key").alias("_key")).distinct(), "gone")
    common.forget(hits)
    gone = common.small(gone, gone.count(), MOST_BROADCAST)
    same = docs["doc_id"].eqNullSafe(gone["doc"]) & row_key(docs["doc_id"], docs["text"]).eqNullSafe(gone["_key"])
    return docs.join(gone, same, "left_anti")


QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES: dict[str, str] = {
    "op4_decontaminate": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hits AS (SELECT doc_id, item_id, i, g.n FROM grams g JOIN win USING (s, n)),
words AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits),
nh AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
ni AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN ni USING (doc_id)
"""
}
