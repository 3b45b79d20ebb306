"""Operator 12: spelling variants by an even-partition pigeonhole join (after Li, Deng, Wang and Feng, Pass-Join, 2011).

Two words are near if one inserted, deleted or replaced code point tells them apart. A word of length l is cut into two
even segments. One edit leaves one of them whole, so a near word of the same length holds that segment at its place, and
one that is longer by one holds it at its place or one further on. Words are indexed by what is left without a segment,
and near words of their own or the next length probe the index. A bucket that many words share is cut again: the segment
that may hold the edit is halved, until a bucket holds few words or a single place. What is left after that differs in
one code point, so no bucket is larger than the alphabet allows. Candidates are verified where they meet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_RUN = re.compile("[a-zÀ-ÿ]+")
#: Words, and code points of words, that a task counts before it sends the counts on.
HELD_WORDS, HELD_CHARS = 200_000, 8_000_000


def runs_of(text: bytes) -> list[str]:
    """The maximal runs [A-Za-z\\u00C0-\\u00FF]+ of a text, A-Z in lower case."""
    return _RUN.findall(text.lower().decode("utf-8", "replace"))


def misspelt(doc: int | None, run: str, every: int) -> str:
    """run without one code point if `every` divides crc32 of `<doc>:<run>`: the one at that crc32 modulo its length. A null
    doc is written as nothing."""
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, min_chars: int = 7, min_count: int = 2, misspell_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all texts, for words of at least min_chars code points and min_count
    occurrences. With misspell_every, runs are misspelt as in `misspelt` before they are counted.

    Null and empty texts have no words; very long texts and runs are read whole. Repeated rows count again. Extra columns,
    whatever their names, are not carried; an empty table gives an empty table. Tasks add up their own counts first, so
    a frequent word is a row for each task and not for each occurrence.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        chars = 0

        def sent() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                # a run of fewer code points can't become a word
                for run, n in Counter(r for r in runs_of(text.as_buffer().to_pybytes()) if len(r) >= min_chars).items():
                    word = misspelt(doc, run, misspell_every) if misspell_every else run
                    if len(word) >= min_chars:
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                    yield sent()
                    chars = 0
        if held:
            yield sent()

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _key() -> Column:
    """What names a bucket of words of class (l, i, j): all but the segment i to j, by a hash. Other buckets that come to
    the same hash add candidates only."""
    left = F.substring(F.col("word"), F.lit(1), F.col("i"))
    right = F.substring(F.col("word"), F.col("j") + F.col("extra") + 1, F.length("word"))
    return F.xxhash64("l", "i", "j", F.concat(left, right))


def near_pairs(words: DataFrame, most: int = 64) -> DataFrame:
    """(a, na, b, nb): each pair of near words of (word, n) once, with their counts. Words are distinct and not null.

    A bucket of more than `most` words is cut again while the segment that may hold the edit has two places or more.
    """
    # l is the length of the indexed word of a pair, extra what the word itself has more
    length = F.length("word")
    classes = F.array(F.struct(length.alias("l"), F.lit(0).alias("extra")), F.struct((length - 1).alias("l"), F.lit(1).alias("extra")))
    each = words.select("word", "n", F.explode(classes).alias("c")).select("word", "n", "c.l", "c.extra")
    each = each.withColumns({"i": F.lit(0), "j": F.col("l")})
    steps: list[DataFrame] = []
    tagged_before = None
    while True:
        middle = F.floor((F.col("i") + F.col("j")) / 2).cast("int")
        halves = F.array(F.struct("i", middle.alias("j")), F.struct(middle.alias("i"), "j"))
        rows = each.select("word", "n", "l", "extra", F.explode(halves).alias("s")).select("word", "n", "l", "extra", "s.i", "s.j").withColumn("key", _key())
        rows = common.written(rows, "segments")
        if tagged_before is not None:
            common.forget(tagged_before)
        sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min("extra").alias("least")).where("size > 1 and least = 0").drop("least")
        n_rows = rows.count()
        tagged = common.written(common.join_groups(rows, sizes, ["key"], "size", n_rows), "buckets")
        common.forget(rows)
        cut = (F.col("size") > most) & (F.col("j") - F.col("i") > 1)
        small = tagged.where(~cut)
        s, r = small.where("extra = 0").select("key", F.col("word").alias("a"), F.col("n").alias("na")), small.select("key", "extra", F.col("word").alias("b"), F.col("n").alias("nb"))
        near = s.join(r, "key").where("(extra = 1 or b > a)").where(F.levenshtein("a", "b", 1) == 1).select("a", "na", "b", "nb")
        steps.append(common.written(near.distinct(), "near-words"))
        each, tagged_before = tagged.where(cut).drop("key", "size"), tagged
        if each.isEmpty():
            common.forget(tagged)
            break
    # a pair may meet in several buckets
    found = common.written(reduce(DataFrame.unionByName, steps).distinct(), "near-words")
    common.forget(*steps)
    return found


def spelling_forms(words: DataFrame, ratio: int = 10, most: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n): the near word of largest n (ties: smallest in code-point
    order) if that n is at least ratio times the word's own, where forms lead to, and how many near words there are.

    Null words are left out; rows that repeat a word are added up. Extra columns, whatever their names, are not carried;
    an empty table gives an empty table. A null n counts as 0; ratio is at least 2, so forms can't go round in a circle.
    """
    if ratio < 2:
        raise ValueError("ratio is at least 2")
    base = words.where("word is not null").groupBy("word").agg(F.sum(F.coalesce(F.col("n"), F.lit(0))).cast("long").alias("n"))
    base = common.written(base, "words")
    pairs = near_pairs(base, most)
    both = pairs.union(pairs.select("b", "nb", "a", "na")).toDF("word", "n", "other", "m")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.max("n").alias("n"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("word"))).alias("best"))
    # a word that never occurs has no form to be that many times as frequent
    form = (F.col("n") > 0) & (-F.col("best.m") >= ratio * F.col("n"))
    best = best.select("word", "n_near", F.when(form, F.col("best.word")).alias("form"), F.when(form, -F.col("best.m")).alias("form_n"))
    best = common.written(best, "forms")
    common.forget(pairs)
    forms = best.where("form is not null").select("word", "form")
    # counts grow tenfold from form to form, so few steps end every way
    now = common.written(forms.select("word", F.col("form").alias("top")), "roots")
    while True:
        further = now.join(forms.toDF("top", "next"), "top", "left")
        further = common.written(further.select("word", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")), "roots")
        common.forget(now)
        now = further.drop("moved")
        if further.where("moved").isEmpty():
            break
        # `now` is read from what `further` is stored in
        now = common.written(now, "roots")
        common.forget(further)
    out = base.join(best, "word", "left").join(now.select("word", "top"), "word", "left")
    return out.select("word", "form", F.coalesce("top", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return spelling_forms(word_counts(docs, min_chars=7, min_count=2, misspell_every=31), ratio=10)


QUERIES = {"op12_spelling": op12_spelling}
ORACLES: dict[str, str] = {
    "op12_spelling": r"""
WITH RECURSIVE bits AS (SELECT range AS i, CAST(range AS BIGINT) AS v, 0 AS k FROM range(256) UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY doc, run),
hexed AS (SELECT *, hex(encode(doc || ':' || run)) AS x FROM counted),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(x) // 2), lambda i: CAST((instr('0123456789ABCDEF', substr(x, CAST(2 * i + 1 AS INT), 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, CAST(2 * i + 2 AS INT), 1)) - 1 AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) AS INT) + 1])), 4294967295) AS h
  FROM hexed, crc),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, length(word) AS l, i, substr(word, 1, CAST(i - 1 AS INT)) || substr(word, CAST(i + 1 AS INT)) AS v FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cuts a JOIN cuts b ON a.i = b.i AND a.l = b.l AND a.v = b.v AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cuts a JOIN words b ON a.v = b.word
  UNION SELECT b.word, a.word FROM cuts a JOIN words b ON a.v = b.word),
ranked AS (SELECT a, b, nb.n AS bn, na.n AS an, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY nb.n DESC, b) AS place FROM pairs JOIN words na ON na.word = a JOIN words nb ON nb.word = b),
best AS (SELECT a AS word, n_near, CASE WHEN bn >= 10 * an THEN b END AS form, CASE WHEN bn >= 10 * an THEN bn END AS form_n FROM ranked WHERE place = 1),
chase AS (SELECT word, form AS top, 1 AS k FROM best WHERE form IS NOT NULL UNION ALL SELECT chase.word, best.form, k + 1 FROM chase JOIN best ON best.word = chase.top WHERE best.form IS NOT NULL),
roots AS (SELECT word, arg_max(top, k) AS top FROM chase GROUP BY word)
SELECT words.word, form, coalesce(top, words.word) AS root, words.n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN best ON best.word = words.word LEFT JOIN roots ON roots.word = words.word
"""
}
