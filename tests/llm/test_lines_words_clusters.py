"""Line dedup, spelling variants and clusters against SQL, brute force and odd inputs."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import clusters, common, lines, spelling

WS = " \t\n\x0b\x0c\r"


# line dedup


def brute_lines(rows, min_docs, min_chars, keep):
    lower = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    key = lambda line: lower(line).strip(WS)
    digest = lambda s: hashlib.sha256(s.encode()).digest()[:16]
    holders, firsts = defaultdict(set), {}
    for doc, text in rows:
        text = text or ""
        who = ("id", doc) if doc is not None else ("text", text)
        for k in map(key, text.split("\n")):
            if len(k) >= min_chars:
                holders[k].add(who)
                place = (doc is None, doc or 0, digest(text))
                firsts[k] = min(firsts.get(k, place), place)
    out = []
    for doc, text in rows:
        kept, seen, text = [], set(), text or ""
        for line in text.split("\n"):
            k = key(line)
            stays = len(k) < min_chars or len(holders[k]) < min_docs
            if not stays and keep == "first" and k not in seen:
                stays = firsts[k] == (doc is None, doc or 0, digest(text))
            seen.add(k)
            if stays:
                kept.append(line)
        out.append((doc, "\n".join(kept), text.count("\n") + 1, text.count("\n") + 1 - len(kept)))
    return Counter(out)


ROWS = [
    (0, "Header\nbody of zero\n\n footer \t"),
    (1, "HEADER\nbody of one\n\nfooter"),
    (2, None),
    (3, ""),
    (4, "\n\n"),
    (5, "header\r\nheader\r\nunique line\nÉtude\nfooter\x0b"),
    (5, "header again\nétude\nfooter"),
    (5, "header again\nétude\nfooter"),
    (6, "é\nÉ\nx\nheader"),
    (7, "é\nx\nx"),
    (None, "header\nno id"),
    (None, "header\nno id"),
    (None, "footer\nno id"),
    (8, "line of its own " * 20000 + "\nfooter"),
    (9, "İ\nKelvin K\nheader"),
]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("most", [1000, 0])
def test_lines_brute_force(spark, keep, most):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"n_lines": F.lit("clash"), "key": F.lit("k"), "doc": F.lit(1), "whole": F.lit("w"), "copies": F.lit(0)}).repartition(5)
    for min_docs, min_chars in ((2, 1), (3, 2), (4, 1)):
        out = lines.dedup_lines(df, min_docs, min_chars, keep, most_broadcast=most)
        assert set(out.columns) == {*df.columns, "n_dropped"}
        got = out.collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(ROWS, min_docs, min_chars, keep)
        assert {(r.key, r.doc, r.whole, r.copies) for r in got} == {("k", 1, "w", 0)}


@pytest.mark.parametrize("most", [1000, 0])
def test_lines_with_full_filters_and_hot_text(spark, most):
    rng = random.Random(1)
    pool = [f"line number {i}" for i in range(400)]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(600)]
    rows += [(1000 + i, "hot line\nline number 3\nown to the copies") for i in range(1300)] + [(3000 + i, None) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    # filters of 64 bits suspect every line: results are the same
    for bits in (10, 29):
        got = lines.dedup_lines(df, 10, 1, "none", most_bits=bits, most_broadcast=most).collect()
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(rows, 10, 1, "none")


def test_filters_hold_every_repeat():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    for bits in (10, 16, 25):
        width = 1 << min(bits, lines.SLICE)
        second = np.zeros((max(1, 1 << (bits - min(bits, lines.SLICE))), width), bool)
        for s, at in lines.sparse(h[:700], bits).items():
            second[s, at] = True
        twice = np.packbits(second.ravel(), bitorder="little")
        assert lines.suspected(twice, h[:700], bits).all()
        if bits == 25:
            assert lines.suspected(twice, h[700:], bits).sum() < 5


def test_lines_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").where("1 = 0")
    assert lines.dedup_lines(df).count() == 0 and lines.dedup_lines(df, most_broadcast=-1).count() == 0
    with pytest.raises(ValueError):
        lines.dedup_lines(df, keep="last")


# spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_forms(words, ratio):
    out = {}
    for w, n in words.items():
        others = [o for o in words if o != w and near(w, o)]
        best = min(others, key=lambda o: (-words[o], o.encode()), default=None)
        form = best if best is not None and n > 0 and words[best] >= ratio * n else None
        out[w] = (form, n, len(others), words[form] if form is not None else None)
    res = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        res.add((w, form, root, n, k, m))
    return res


@pytest.mark.parametrize("most", [1, 4, 64])
def test_forms_brute_force(spark, most):
    rng = random.Random(5)
    base = ["colour", "abcabcabcabc", "aaaaaaaa", "straße", "ÿÿÿÿÿÿÿ", "a", "", "ab"]
    words = {}
    for w in base:
        n = 100_000
        for _ in range(60):
            words.setdefault(w, max(1, n))
            at = rng.randint(0, len(w))
            letter = rng.choice("abcé🙂")
            w = rng.choice([w[:at] + letter + w[at:], w[:at] + w[at + 1 :], w[:at] + letter + w[at + 1 :]])
            n //= rng.choice([1, 2, 10, 12])
            w = rng.choice([w, *words])
    # many words that share a segment
    for i in range(150):
        words["internat" + "".join(rng.choice("abcdef") for _ in range(3))] = rng.randint(1, 300)
    words["zero"], words["zeros"] = 0, 5
    rows = [(w, n) for w, n in words.items()] + [(None, 3)]
    df = spark.createDataFrame(rows, "word string, n long").withColumns({"key": F.lit(1), "form": F.lit("x"), "extra": F.lit(2)})
    got = {tuple(r) for r in spelling.spelling_forms(df, 10, most).collect()}
    assert got == brute_forms(words, 10)


def test_forms_odd_input(spark):
    df = spark.createDataFrame([("hello", 3), ("hello", 30), ("hallo", 3), ("halloo", None)], "word string, n long")
    got = {tuple(r) for r in spelling.spelling_forms(df, 10).collect()}
    assert got == {("hello", None, "hello", 33, 1, None), ("hallo", "hello", "hello", 3, 2, 33), ("halloo", None, "halloo", 0, 1, None)}
    assert spelling.spelling_forms(df.where("1 = 0")).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_forms(df, 1)


def test_long_words_and_hot_prefix(spark):
    """Words of one common half don't meet in one bucket, however many there are."""
    rng = random.Random(2)
    words = {"prefixes" + "".join(rng.choice("abcdefghijklmnop") for _ in range(8)): 1 for _ in range(3000)}
    words["x" * 3000], words["x" * 2999], words["x" * 2998] = 1, 1, 1
    some = rng.sample(sorted(words), 50)
    words |= {w[:5] + "q" + w[5:]: 20 for w in some}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    pairs = {(r.a, r.b) for r in spelling.near_pairs(df, 8).collect()}
    cuts = defaultdict(set)
    for w in words:
        if len(w) < 100:
            for i in range(len(w)):
                cuts[w[:i] + w[i + 1 :], i].add(w)
    want = {frozenset((a, b)) for group in cuts.values() for a in group for b in group if a != b and len(a) == len(b)}
    for (v, _), group in cuts.items():
        if v in words:
            want |= {frozenset((v, w)) for w in group}
    want |= {frozenset(("x" * 3000, "x" * 2999)), frozenset(("x" * 2999, "x" * 2998))}
    assert {frozenset(p) for p in pairs} == want and len(pairs) == len(want)


def test_word_counts(spark):
    rows = [(1, "Über-Straße STRASSE strasse x×y÷z ÀÉÿ"), (1, "strasse"), (None, "strasse naïve Naïve"), (2, None), (3, ""), (4, "naïve " * 5000), (5, "w" * 100000), (6, "汉字abc_def9ghi")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    want, plain = Counter(), Counter()
    import re

    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            plain[run] += 1
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            want[run if h % 3 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    got = {r.word: r.n for r in spelling.word_counts(df, 3, 1, misspell_every=3).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 3}
    got = {r.word: r.n for r in spelling.word_counts(df, 1, 2).collect()}
    assert got == {w: n for w, n in plain.items() if n >= 2}
    assert spelling.word_counts(df.where("1 = 0")).count() == 0


# clusters


def brute_clusters(rows, k, rounds, dim, scale=256):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in first[:k]]
    nearest = lambda v: min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(centroids)]
    return Counter((i, *nearest(v)[::-1]) for i, v in kept), centroids


def vectors(spark, seed=0, n=400, dim=6, spread=0.2, kind="double"):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dim))
    # coarse numbers make ties; repeated rows make empty centroids
    rows = [(i, np.round((centres[i % 9] + spread * rng.standard_normal(dim)) * 8) / 2048) for i in range(n)]
    rows = [(i, v.tolist()) for i, v in rows] + [(n + i, rows[0][1].tolist()) for i in range(30)]
    rows += [(900, None), (901, []), (902, [1.0] * (dim + 1)), (903, [None] + [1.0] * (dim - 1)), (904, [float("nan")] * dim), (905, [float("-inf")] * dim), (None, [0.25] * dim), (7, [0.5] * dim), (7, [-0.5] * dim), (906, [1000.5] * dim), (907, [0.0] * dim)]
    return rows, spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({"id": F.lit("clash"), "cluster": F.lit(1), "v": F.lit(0)})


@pytest.mark.parametrize("k, rounds, spread", [(12, 4, 0.2), (3, 1, 2.0), (60, 6, 0.0), (1000, 2, 0.1), (1, 3, 0.2)])
def test_clusters_brute_force(spark, k, rounds, spread):
    rows, df = vectors(spark, k, spread=spread)
    found, centroids = clusters.elkan(df.repartition(3), k, rounds, dim=6)
    want, final = brute_clusters(rows, k, rounds, 6)
    assert centroids.tolist() == final
    assert Counter((r.id, r.cluster, r.distance) for r in found.collect()) == want


def test_bounds_skip_and_hold():
    """Bounds hold after every move, and most distances aren't calculated."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-200, 200, (30, 16))
    x = np.concatenate([c + rng.integers(-20, 20, (100, 16)) for c in centres])
    now, before, cached, calculated = centres + rng.integers(-15, 15, centres.shape), None, (None, None, None), []
    for _ in range(5):
        bounds = clusters.Bounds(now, before)
        a, upper, lower, least, n = bounds.assign(x, *cached)
        d = ((x[:, None] - now[None]) ** 2).sum(2)
        assert (a == d.argmin(1)).all() and (least == d.min(1)).all()
        assert (upper.astype(np.float64) >= np.sqrt(least.astype(np.float64))).all() and (lower <= np.sqrt(d.astype(np.float64))).all()
        calculated.append(n)
        cached, before = (a.astype(np.int32), upper, lower), now
        now = np.array([x[a == c].sum(0) // max(1, (a == c).sum()) if (a == c).any() else now[c] for c in range(len(now))])
    assert calculated[0] == len(x) * 30 and all(n < len(x) * 4 for n in calculated[1:])


def test_rounding_is_directed():
    rng = np.random.default_rng(1)
    squares = rng.integers(0, 1 << 62, 20000)
    exact = [int(s) for s in squares]
    low, high = clusters.below(clusters.root_below(squares)), clusters.above(clusters.root_above(squares))
    from fractions import Fraction

    assert all(Fraction(float(a)) ** 2 <= s <= Fraction(float(b)) ** 2 for a, b, s in zip(low, high, exact, strict=True))


def test_clusters_odd_input(spark):
    rows, df = vectors(spark, kind="float")
    empty, centroids = clusters.elkan(df.where("1 = 0"), 5, 2, dim=6)
    assert empty.count() == 0 and len(centroids) == 0
    only_null = clusters.elkan(df.where("vec_id is null"), 5, 2, dim=6)[0]
    assert only_null.count() == 0
    huge = spark.createDataFrame([(1, [1e30] * 6)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        clusters.elkan(huge, 5, 1, dim=6)


def test_cluster_query_columns(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(90)] + [(90, None), (91, [1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = clusters.op13_clusters(spark, str(tmp_path)).collect()
    rows = [(r.vec_id, [float(x) for x in r.embedding] if r.embedding is not None else None) for r in common.table(spark, str(tmp_path), "embeddings").collect()]
    want, final = brute_clusters(rows, 40, 5, 64)
    sums = Counter()
    for (_, c, d), n in want.items():
        sums[c] += d * n
    shas = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in final]
    assert sorted(map(tuple, got)) == sorted((i, c, d, sums[c], sum(sums.values()), shas[c]) for i, c, d in want)
