"""The numbered operators against SQL, brute force, round trips and odd inputs."""

import hashlib
import random
import re
import string
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe import llm
from tallyframe.llm import chat, common, decontaminate, jaccard, near_vectors, packing, pii, quality, sharding, token_counts, token_files, tokens
from tests.conftest import same_rows

BYTE = public_tokenizers.path("byte_bpe_50k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")

LONG = " ".join(f"word{i % 977}x" for i in range(30000))
ODD = [
    (0, "The quick brown fox jumps over the lazy dog and runs far away from here"),
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "one two"),
    (6, "ONE  Two"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, "é ünï ﬁ ½ 汉字 🙂 <|endoftext|> </s>[INST]  x\u00a0y\u2003 z"),
    (None, "no id"),
    (5, "one two"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"score": F.lit("clash"), "n_tokens": F.lit("clash"), "component": F.lit(1), "spans": F.lit(2), "shard": F.lit("x"), "mark": F.lit(0)})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("1 = 0")


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_oracle(spark, duck, sf_dir, name):
    same_rows(llm.QUERIES[name](spark, sf_dir), duck.execute(llm.ORACLES[name]).df())


def texts_of(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in common.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}


# tokens


def same_ids(codec, texts):
    """The codec's ids and counts are those of the library for whole texts."""
    texts = list(texts)
    own, want = pa.array(texts, pa.string()), codec.whole(texts) if texts else []
    ids, counts = codec.encode(own)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]
    assert codec.counts(own).tolist() == counts.tolist()


RUNS = ["a\n\n\nb", "a b\n\n", *(f"{head}{chr(10) * n}{tail}" for n in range(1, 6) for head in ("", "a", "a b", "a ") for tail in ("", "c", " c", "'s", " \n"))]
SPACES = ["  ", " ", "a  b", " a", "a ", "  a  ", "a \t b", "a\u00a0 b c", "a \u2003b  c", "a   b c  d ", "▁a ▁", "x  ▁y", "x▁", "▁"]


@pytest.mark.parametrize("path", [BYTE, PIECE, WORD])
def test_codec_is_the_library(spark, sf_dir, path):
    codec = tokens.load_codec(path)
    same_ids(codec, [*texts_of(spark, sf_dir).values(), *[t or "" for _, t in ODD], "a<|endoftext|> b", " 's it's 'tis", "a\n\nb \n c", "x ▁y", " lead", "trail "])
    same_ids(codec, RUNS + SPACES)


@pytest.mark.parametrize("path", [BYTE, PIECE])
@pytest.mark.parametrize("run", ["abcdefghij" * 6, "0123456789" * 6, "-" * 60, "=*" * 30, "Zm9vYmFy" * 2000])
def test_codec_on_long_runs(path, run):
    began = time.perf_counter()
    same_ids(tokens.load_codec(path), [f"{run}{end}" for end in ("'", "汉", "д", "\t", "'s x", "\n\n\n")])
    assert time.perf_counter() - began < 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,%aZé1▁\u00a0<|>s"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=5))
def test_codec_on_any_text(texts):
    for path in (BYTE, PIECE):
        same_ids(tokens.load_codec(path), texts)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdefghijklmnopqrstuvwxyz0189-_'"), min_size=55, max_size=60), max_size=4))
def test_codec_on_long_words(words):
    for path in (BYTE, PIECE):
        same_ids(tokens.load_codec(path), [" ".join(words), *words])


def test_codec_table_is_bounded(monkeypatch):
    for name, most in (("MAX_WORDS", 50), ("MAX_CHARS", 200)):
        monkeypatch.setattr(tokens, name, most)
        codec = tokens.JsonCodec(BYTE)
        for k in range(20):
            same_ids(codec, [" ".join(f"w{k}q{i}" for i in range(40))])
        assert codec.n_words < 130


def test_text_batches():
    texts = pa.array(["ab", None, "é" * 5, "", "x" * 30, "y"])
    found = [(a, b, t.to_pylist()) for a, b, t in tokens.text_batches(texts, 12)]
    assert found == [(0, 4, ["ab", "", "é" * 5, ""]), (4, 5, ["x" * 30]), (5, 6, ["y"])]
    assert [*tokens.text_batches(pa.array([], pa.string()), 12)] == []


def test_token_counts(odd, empty):
    rows = token_counts.count_tokens(odd, PIECE, limit=10).collect()
    codec = tokens.load_codec(PIECE)
    for r in rows:
        assert r.n_bytes == len((r.text or "").encode()) and r.n_tokens == len(codec.whole([r.text or ""])[0]) and r.over_limit == (r.n_tokens > 10) and r.score == "clash"
    assert len(rows) == len(ODD) and token_counts.count_tokens(empty, PIECE).count() == 0


def test_token_queries(spark, sf_dir):
    docs = texts_of(spark, sf_dir)
    piece, byte, at = tokens.load_codec(PIECE), tokens.load_codec(BYTE), 0
    for r in token_counts.op5_token_counts(spark, sf_dir).collect():
        n = len(piece.whole([docs[r.doc_id]])[0])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)
    rows = token_files.op2_simple8b(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*byte.whole([docs[r.doc_id]])[0], 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    packed = {}
    for r in packing.op9_best_fit_packing(spark, sf_dir).collect():
        packed.setdefault(r.doc_id, []).append(r)
    for i, text in docs.items():
        ids = np.array([*byte.whole([text])[0], 2], "<u4")
        assert sum(r.length for r in packed[i]) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in packed[i])


# token files


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 50000), st.integers(0, 2**64 - 1), st.integers(0, 64).map(lambda b: max(0, 2**b - 1))), max_size=700))
def test_simple8b_round_trip(values):
    x = np.array(values, np.uint64)
    words, starts = token_files.encode_ids(x)
    assert (token_files.decode_ids(words, starts, len(x)) == x).all()


def test_simple8b_selectors():
    for n, bits in token_files.SELECTORS[2:]:
        x = np.full(240, (1 << bits) - 1, np.uint64)
        words, _ = token_files.encode_ids(x)
        assert len(words) == -(-240 // n)
    assert len(token_files.encode_ids(np.zeros(240, np.uint64))[0]) == 1


def test_token_files(spark, odd, empty):
    path = common.shared_path(spark, "t")
    token_files.write_ids(odd, path, BYTE, 0, block_ids=64)
    rows = token_files.read_ids(spark, path).collect()
    codec, at = tokens.load_codec(BYTE), 0
    want = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    for r, (i, t) in zip(sorted(rows, key=lambda r: r.start), want, strict=True):
        ids = [*codec.whole([t or ""])[0], 0]
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids)) and np.frombuffer(r.ids, "<u4").tolist() == ids
        at += len(ids)
    path = common.shared_path(spark, "t")
    token_files.write_ids(empty, path, BYTE)
    assert token_files.read_ids(spark, path).count() == 0


# packing


def check_packed(rows, docs, codec, size, end_id):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, text in docs.items():
        ids = [*codec.whole([text or ""])[0], end_id]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert [r.start for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))] and all(r.length == size for r in own[1:])
    for own in by_seq.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= size
    return len(by_seq)


def test_packing(spark, sf_dir, odd, empty):
    docs = texts_of(spark, sf_dir)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    rows = packing.pack(df.coalesce(1), BYTE, 2).collect()
    n = check_packed(rows, docs, tokens.load_codec(BYTE), 1024, 2)
    assert n <= -(-sum(r.length for r in rows) // 1024) * 1.03 + 1
    small = packing.pack(odd.where("doc_id <> 5 or doc_id is null"), BYTE, 2, size=16, most_open=2).collect()
    check_packed(small, {i: t for i, t in ODD if i != 5}, tokens.load_codec(BYTE), 16, 2)
    assert packing.pack(empty, BYTE, 2).count() == 0


def test_open_bins_stay_few():
    bins, rng = packing.OpenBins(100, 3), random.Random(0)
    fill = {}
    for _ in range(500):
        n = rng.randint(1, 100)
        b, at = bins.put(n)
        assert fill.get(b, 0) == at and at + n <= 100 and bins.n_open <= 3
        fill[b] = at + n
    assert bins.put(100)[1] == 0


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(t)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(t) if 13 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1259@..-+_ ()é\n:/"), max_size=60))
def test_base_spans_on_any_text(text):
    assert [s for s in pii.spans_of(text) if s[0] in pii.BASE] == base_spans(text)


@pytest.mark.parametrize(
    "text,want",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "IBAN [IBAN] BIC COBADEFFXXX"),
        ("IBAN DE89 3704 0044 0532 0130 00 Please", "IBAN [IBAN] Please"),
        ("IBAN: DE89370400440532013000 PAY NOW", "IBAN: [IBAN] PAY NOW"),
        ("iban GB29 NWBK 6016 1331 9268 19 BIC NWBKGB2L", "iban [IBAN] BIC NWBKGB2L"),
        ("konto DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "konto [IBAN] BIC COBADEFFXXX"),
        ("IBAN DE00 3704 0044 0532 0130 00 Please", "IBAN [ACCOUNT] Please"),
        ("account 12345678 BIC COBADEFFXXX", "account [ACCOUNT] BIC COBADEFFXXX"),
        ("account no: 12345678 Please", "account no: [ACCOUNT] Please"),
        ("passport AB 123456 Xyz", "passport [ACCOUNT] Xyz"),
        ("account 12345678abc", "account [ACCOUNT]abc"),
        ("account 123456 7890abc", "account [ACCOUNT]abc"),
        ("IBAN DE89 3704 0044 0532 0130 00please", "IBAN [IBAN]please"),
        ("account 12345 OK", "account 12345 OK"),
    ],
)
def test_account_ends(text, want):
    assert pii.redact(text, pii.spans_of(text)) == want


def test_pii(spark, sf_dir, odd, empty):
    docs = texts_of(spark, sf_dir)
    rows = {r.doc_id: r for r in pii.op7_pii(spark, sf_dir).collect()}
    assert any(r.n_email + r.n_card + r.n_ip + r.n_phone for r in rows.values())
    for i, t in docs.items():
        want = base_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and rows[i].spans.startswith(joined)
    found = pii.find_pii(odd)
    assert found.count() == len(ODD) and found.where("text is null").first().redacted_text is None
    assert pii.find_pii(empty).count() == 0
    assert set(found.columns) == {*odd.columns, "pii_spans", "redacted_text"}


def test_added_spans_and_redaction():
    t = "mail a.b@c.org, see ftp://bob:pw@host.net/x, IBAN DE89 3704 0044 0532 0130 00 and account no: 12345678, accountant"
    spans = pii.spans_of(t)
    assert {s[0] for s in spans} == {"email", "url_login", "iban", "account"}
    assert pii.redact(t, spans) == "mail [EMAIL], see [URL_LOGIN]/x, IBAN [IBAN] and account no: [ACCOUNT], accountant"
    assert pii.redact("plain", []) == "plain" and pii.redact("abcd", [("a", 0, 2), ("b", 1, 4)]) == "[A]"


def test_long_numbers_take_linear_time():
    began = time.perf_counter()
    for t in ("1" * 1_000_000, "1." * 300_000, "account " + "A B " * 200_000, "IBAN " * 20_000, "+1" * 300_000, "a@" * 300_000, "a" * 500_000 + "@", "account" + " " * 500_000, "1.1.1.1" * 50_000):
        pii.spans_of(t)
    assert time.perf_counter() - began < 20
    for t in ("1" * 500, "1." * 300, "+1" * 300, "a@" * 300, "1.1.1.1" * 50, "1 1-1 " * 90):
        assert [s for s in pii.spans_of(t) if s[0] in pii.BASE] == base_spans(t)


def test_redacted_documents(spark):
    rows = [(1, "mail a@b.org", "x"), (None, None, None), (1, "mail a@b.org", "x"), (2, "", "y"), (3, "v" * 50_000 + " +49 30 1234567 x", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string").withColumn("n_chars", F.lit(7).cast("long"))
    out = pii.redact_documents(df)
    assert out.columns == df.columns and pii.redact_documents(df.where("1 = 0")).count() == 0
    got = sorted(((r.doc_id or 0, r.text, r.spans, r.n_chars) for r in out.collect()), key=lambda r: r[0])
    assert got == [(0, None, None, None), (1, "mail [EMAIL]", "x", 12), (1, "mail [EMAIL]", "x", 12), (2, "", "y", 0), (3, "v" * 50_000 + " [PHONE] x", "z", 50_010)]


# quality


def test_quality(spark):
    d = "/root/testdata/sf0.1"
    rows = quality.op6_quality(spark, d).join(common.table(spark, d, "labels"), "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(1 - r.predicted for r in bad) >= 0.8 * len(bad)
    wins = np.mean([[g.score > b.score for b in bad] for g in good])
    assert wins > 0.95 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_quality_on_odd_input(spark, odd, empty):
    one = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, None)], "doc_id long, label int")
    model = quality.fit(odd, one)
    rows = quality.classify(odd, model).collect()
    assert len(rows) == len(ODD) and len({r.score for r in rows}) == 1
    two = spark.createDataFrame([(0, 1), (9, 0)], "doc_id long, label int")
    assert all(0 <= r.score <= 1 for r in quality.classify(odd, quality.fit(odd, two)).collect())
    assert quality.classify(empty, quality.fit(empty, one.where("1 = 0"))).count() == 0


def test_features_and_scores(spark):
    good, bad = ["the cat sat on the mat and slept " * (3 + i % 5) for i in range(60)], [f"zq{i} $$ buy now !!! {i * 7919}" * 4 for i in range(60)]
    docs = spark.createDataFrame([*enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, label int")
    model = quality.fit(docs, labels)
    import zstandard as z

    def size(data, d):
        return len(z.ZstdCompressor(level=model.level, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))

    for r in quality.classify(docs, model).collect():
        data = r.text.encode()
        parts = [data[k : k + model.chunk] for k in range(0, len(data), model.chunk)]
        a, b = (sum(size(p, d) for p in parts) for d in (model.good, model.bad))
        x, left = (b - a) / (a + b + 2 * quality.SMOOTH), min(1.5, (a + quality.SMOOTH) / (len(data) + 2 * quality.SMOOTH))
        want = 1 / (1 + np.exp(-np.clip(np.dot([x, left, left * left, x * left, 1.0], model.weights), -30, 30)))
        assert abs(r.score - want) < 1e-9 and r.predicted == int(r.score >= 0.3) == int(r.doc_id < 60)


def test_sample_covers_sparse_labels_and_long_texts(spark):
    rng = random.Random(0)
    words = [["".join(rng.choices("bcdfg", k=5)) for _ in range(300)], ["".join(rng.choices("aeiou", k=5)) for _ in range(300)]]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words[i % 2], k=2000))) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(i, i % 2) for i in range(1000, 6000)], "doc_id long, label int")
    model = quality.fit(docs, labels, per_class=18, sample_bytes=2500)
    # all 40 labels with a document are sampled, not the 5000 without one, and so are texts longer than sample_bytes
    assert len(model.good) > 100 and len(model.bad) > 100 and model.weights[0] > 0


def test_keep_good(spark, sf_dir):
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    odd = docs.withColumns({"_": F.lit(1), "score": F.lit("own"), "predicted": F.lit(None).cast("int"), "label": F.lit("l")})
    odd = odd.unionByName(odd.limit(2).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})).unionByName(odd.limit(3))
    model = quality.fit(odd, quality.training_labels(labels))
    kept, scored = quality.keep_good(odd, labels), quality.classify(odd.drop("score", "predicted"), model)
    assert kept.columns == odd.columns and {r.score for r in kept.collect()} == {"own"}
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(r.doc_id or 0 for r in scored.where("predicted = 1").collect())
    assert quality.keep_good(odd.where("1 = 0"), labels).count() == 0


# sharding


def brute_capacity(sizes, k):
    def fits(c):
        n, a = 1, 0
        for s in sizes:
            if a + s > c:
                n, a = n + 1, 0
            a += s
        return n <= k

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("index", [8, 1 << 15])
def test_minimax(spark, index):
    rng = random.Random(index)
    sizes = [int(rng.paretovariate(0.8) * 10) + 8 for _ in range(400)]
    ends = np.cumsum(sizes).tolist()
    df = spark.createDataFrame([(e,) for e in ends], "end long")
    capacity, cuts = sharding.minimax_cuts(df, ends[-1], max(sizes), 7, index)
    assert capacity == brute_capacity(sizes, 7) and cuts[-1] == ends[-1]
    even = sharding.even_cuts(df, capacity, ends[-1], 7)
    assert max(np.diff([0, *even])) <= capacity and even[-1] == ends[-1]


def test_sharding(spark, sf_dir, odd, empty):
    docs, rows = texts_of(spark, sf_dir), sharding.op8_sharding(spark, sf_dir).collect()
    shards, groups, order = {}, {}, {}
    for r in rows:
        t = docs[r.doc_id]
        assert r["size"] == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "bytes" and r.grown_shard is None
        shards.setdefault(r.shard, []).append(r)
        groups.setdefault(t, set()).add(r.shard)
        order.setdefault(t, [r.doc_id, 0])
        order[t] = [min(order[t][0], r.doc_id), order[t][1] + r["size"]]
    assert len(rows) == len(docs) and all(len(g) == 1 for g in groups.values()) and set(shards) <= set(range(24))
    assert all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    assert max(sum(r["size"] for r in own) for own in shards.values()) <= brute_capacity([s for _, s in sorted(order.values())], 24)
    copies = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.lit("same")).alias("text")).withColumnRenamed("id", "doc_id")
    many = sharding.shard_contiguous(copies.unionByName(spark.range(3000, 3100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))), 4).collect()
    assert len(many) == 3100 and len({r.shard for r in many if r.text_crc32 == zlib.crc32(b"same")}) == 1 and len({r.shard for r in many if r["size"] == 8}) == 1
    out = sharding.shard_contiguous(odd, 4).collect()
    assert len(out) == len(ODD) and len({r.shard for r in out if r.text_crc32 == zlib.crc32(ODD[0][1].encode())}) == 1
    assert sharding.shard_contiguous(empty, 4).count() == 0


# chat


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a] b]", "tool\\", ""]), st.text(alphabet=st.sampled_from("\\<>s/[INST]|] ab\n"), max_size=30)), min_size=1, max_size=6))
def test_chat_round_trip(spark, turns):
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.linear_replies(df)).withColumn("turns", chat.parse(F.col("formatted"))).first()
    assert [(t.role, t.text) for t in out.turns] == turns and out.n_turns == len(turns)
    said = [out.formatted[s.start : s.end] for s in out.loss_spans]
    assert [re.sub(r"\\([\s\S])", r"\1", s) for s in said] == [t for r, t in turns if r == "assistant"]


def test_reply_trees(spark):
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 2.0), ("t", 4, 2, 1.0), ("t", 5, 2, 9.0), ("u", 1, 77, None), ("c", 1, 2, 1.0), ("c", 2, 1, 1.0), (None, 1, None, 1.0), ("t", 3, 1, 2.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    paths = {}
    for r in chat.reply_paths(df).collect():
        paths.setdefault((r.tree, r.leaf), []).append((-r.back, r.node))
    got = {k: [n for _, n in sorted(v)] for k, v in paths.items()}
    assert got == {("t", 3): [1, 3], ("t", 4): [1, 2, 4], ("t", 5): [1, 2, 5], ("u", 1): [1]}
    assert {(r.tree, r.leaf) for r in chat.reply_paths(df, top=1).collect()} == {("t", 5), ("u", 1)}
    # a cycle with a tail, beside a tree: nothing that hangs from the cycle is in a path
    loop = spark.createDataFrame([("z", 1, 2, 1.0), ("z", 2, 1, 1.0), ("z", 3, 1, 1.0), ("z", 4, 3, 1.0), ("z", 5, None, 1.0), ("z", 6, 5, 1.0)], df.schema)
    assert sorted((r.leaf, r.node, r.back) for r in chat.reply_paths(loop).collect()) == [(6, 5, 1), (6, 6, 0)]
    deep = spark.range(70).select(F.lit("d").alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(1.0).alias("score"))
    assert chat.reply_paths(deep).count() == 70
    assert chat.reply_paths(df.where("1 = 0")).count() == 0


def test_best_branches(spark):
    rows = [("t", 1, None, 1.0, "user", "q"), ("t", 2, 1, 5.0, "assistant", "good"), ("t", 3, 1, 2.0, "assistant", "bad"), ("t", 4, 1, 5.0, "assistant", "as good"), ("u", 1, None, None, "user", None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string").withColumn("leaf", F.lit("clash"))
    best = {(r.tree, r.leaf): r.n_turns for r in chat.format_paths(df, top=1).collect()}
    assert best == {("t", 2): 2, ("u", 1): 1} and chat.format_paths(df, top=2).count() == 3
    assert chat.format_paths(df.where("1 = 0"), top=1).count() == 0


def test_chat_odd_turns(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (None, 0, "assistant", "y"), (1, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit("clash"))
    out = {r.tree: r for r in chat.format_paths(chat.linear_replies(df)).collect()}
    assert out["1"].n_turns == 3 and out["null"].formatted == "<s>[INST:assistant] y [/INST]</s>"


# near duplicates


def brute_components(sets, num, den):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in ids}


def word_sets(docs, n):
    out = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
        out[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    return out


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (2, 70), (1, 50)])
def test_jaccard_loses_no_link(spark, n, num):
    rng = random.Random(n)
    docs = {}
    for g in range(30):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 40)) for _ in range(rng.randint(1, 90))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice("xyz") + str(rng.randint(0, 9))
            docs[len(docs)] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc: r for r in jaccard.jaccard_components(df, n, num, 100).collect()}
    sets = word_sets(docs, n)
    assert {i: r.component for i, r in got.items()} == brute_components(sets, num, 100)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("most", [0, 8])
def test_boilerplate_brings_few_together(spark, monkeypatch, most):
    """Texts that have half of their words in common meet only where they are alike in the rest, too."""
    monkeypatch.setattr(jaccard, "TILE", 3000)
    monkeypatch.setattr(jaccard, "MOST_TILES", most)
    rng = random.Random(4)
    common_part = " ".join(f"banner{i}" for i in range(60))
    met, written = {}, common.written

    def watched(df, what):
        out = written(df, what)
        if what == "families":
            met["pairs"] = sum(r["count"] ** 2 for r in out.groupBy("first").count().collect())
        return out

    monkeypatch.setattr(common, "written", watched)
    pairs = []
    for n in (60, 240):
        docs = {i: common_part + " " + " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for i in range(n)}
        for i in range(0, n, 6):  # near copies, and some that are just too far
            words = docs[i].split()
            for k in rng.sample(range(60, 120), rng.choice([2, 4, 6])):
                words[k] = "changed"
            docs[n + i] = " ".join(words)
        df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
        got = {r.doc: r.component for r in jaccard.jaccard_components(df, 3, 80, 100).collect()}
        assert got == brute_components(word_sets(docs, 3), 80, 100) and len(set(got.values())) > n
        pairs.append(met["pairs"])
    if most == 0:  # all families are large: the work grows as the texts do
        assert pairs[1] <= 6 * max(pairs[0], 10)


def test_copies_of_one_text_meet_it_first(spark, monkeypatch):
    """Near copies of one text that are less alike among themselves are tied to it at once: few of them go on to tiles."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    docs = {200: " ".join(base)}
    for i in [*range(150), *range(300, 400)]:
        w = list(base)
        for k in rng.sample(range(300), 8):
            w[k] = f"x{rng.randint(0, 10**6)}"
        docs[i] = " ".join(w)
    left, written = [], common.written

    def watched(df, what):
        out = written(df, what)
        if what == "undecided":
            left.append(out.count())
        return out

    monkeypatch.setattr(common, "written", watched)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc: r.component for r in jaccard.jaccard_components(df, 3, 80, 100).collect()}
    assert got == brute_components(word_sets(docs, 3), 80, 100) and set(got.values()) == {0}
    assert left == [0]


@pytest.mark.parametrize("most", [0, 8])
def test_rare_elements_make_no_family_twice(spark, monkeypatch, most):
    """Members that share many rare elements meet once, and not at all within a component."""
    monkeypatch.setattr(jaccard, "TILE", 500)
    monkeypatch.setattr(jaccard, "MOST_TILES", most)
    rng, rows, written = random.Random(8), [], common.written

    def watched(df, what):
        out = written(df, what)
        if what == "families":
            rows.append(out.count())
        return out

    monkeypatch.setattr(common, "written", watched)
    banner, docs = " ".join(f"banner{i}" for i in range(100)), {}
    for g in range(40):  # pairs that share a third of their rarer words, but aren't similar enough
        both = [f"g{g}w{i}" for i in range(10)]
        for k in range(2):
            docs[2 * g + k] = banner + " " + " ".join(both + [f"v{rng.randint(0, 10**6)}" for _ in range(20)])
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {r.doc: r.component for r in jaccard.jaccard_components(df, 3, 70, 100).collect()}
    assert got == brute_components(word_sets(docs, 3), 70, 100)
    if most == 0:
        assert rows[-1] <= 6 * len(docs)


@settings(max_examples=40, deadline=None)
@given(st.integers(4, 300), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100), (60, 100)]), st.sampled_from([(2, 1), (1, 0), (3, 1), (4, 2)]))
def test_similar_sets_share_a_signature(size, seed, bound, parts):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    num, den = bound
    most = (den - num) * 2 * len(a) // (den + num) // 2
    gone = rng.permutation(len(a))[: rng.integers(0, most + 1)] if most else []
    b = np.unique(np.concatenate([np.delete(a, gone), rng.integers(0, 2**63, len(gone)).astype(np.uint64)]))
    if (a == b).all() if len(a) == len(b) else False:
        return
    scheme = jaccard.Scheme(num, den, *parts)
    both = len(np.intersect1d(a, b))
    if den * both >= num * (len(a) + len(b) - both):
        assert np.intersect1d(scheme.signatures(a), scheme.signatures(b)).size


def test_jaccard_odd_input(spark, odd, empty):
    rows = jaccard.jaccard_components(odd).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc, set()).add((r.n_shingles, r.component))
    assert len(rows) == len(ODD) and got[1] == {(11, 0)} and got[2] == {(0, 2)} and got[3] == {(0, 3)} and got[4] == {(0, 4)} and got[6] == {(1, 5)} and got[8].pop()[1] == 7
    assert got[None] == {(1, None)}
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(odd)
    assert {r.doc_id for r in kept.collect()} == {0, 2, 3, 4, 5, 7, 9, None} and kept.columns == odd.columns


def test_jaccard_marks_in_common(spark, monkeypatch):
    """No link is lost between classes whose marks are equal, however few bits a mark has."""
    rows = [(i, " ".join(f"w{(i // 3 * 50 + k) % 400}" for k in range(60 - i % 3))) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for bits in (40, 1):
        monkeypatch.setattr(jaccard, "MARK_BITS", bits)
        got.append(sorted(jaccard.jaccard_components(df, 3, 80, 100).collect()))
    assert got[0] == got[1] and {r.component for r in got[0]} == set(range(0, 24, 3))


def test_jaccard_id_with_two_texts(spark):
    one, two = (" ".join(f"{k}{i}" for i in range(60)) for k in "xy")
    rows = [(3, one), (5, one), (5, two), (9, two + " tail"), (20, two + " end"), (20, two + " end"), (30, "alone " + "z " * 3), (30, "alone " + "z " * 3), (30, ""), (30, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc: r.component for r in jaccard.jaccard_components(df).collect()} == {3: 3, 5: 3, 9: 3, 20: 3, 30: 30}
    assert sorted((r.doc_id, r.text) for r in jaccard.keep_one(df).collect()) == [(3, one), (30, ""), (30, ""), (30, rows[6][1])]
    two_ids = df.where("doc_id in (5, 9)").unionByName(df.where("doc_id = 5"))
    assert sorted((r.doc_id, r.text) for r in jaccard.keep_one(two_ids).collect()) == [(5, one), (5, two)]


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + rng.standard_normal(24) * (0.05 + 0.02 * (i % 5))).tolist()) for i in range(300)]
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] + [1.0] * 23), (303, [None] + [1.0] * 23), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, rows[0][1]), (308, [float("inf")] * 24), (None, rows[0][1]), (310, [1e200, 2e200]), (311, [1e-200, 2e-200]), (312, [3e-310, 6e-310])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    ok = [(i, np.array(v) / max(map(abs, v))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    n, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}
    for _ in range(3):
        for i, x in ok:
            for j, y in ok:
                if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                    root[i] = min(root[i], root[j])
    for i, x in ok:
        n[i] = sum(i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95 for j, y in ok)
    for tile in (8192, 16):
        got = {r.id: r for r in near_vectors.near_vectors(df, tile=tile).collect() if r.id is not None}
        for i in got:
            assert (got[i].n_links, got[i].component, got[i].kept) == (n[i], root[i], root[i] == i)
    assert near_vectors.near_vectors(df.where("1 = 0")).count() == 0


def test_near_vectors_shuffle_in_proportion(spark):
    """Vectors that all share a large cell are shuffled in proportion to their number, not to that of their pairs."""
    rng, sent = np.random.default_rng(1), []
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    for n in (150, 600):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 24)))]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
        before = written()
        assert near_vectors.near_vectors(df, tile=20).where("n_links = 0 and kept").count() == n
        sent.append(written() - before)
    assert sent[1] < 8 * sent[0]


def test_written_leaves_no_shuffle(spark):
    """What was shuffled for a written step goes with it, without the driver's garbage collection; the setting is put back."""

    def left():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = left(), spark.conf.get(key, None)
    step = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "step")
    until = time.time() + 10
    while left() - before and time.time() < until:
        time.sleep(0.1)
    assert not left() - before and spark.conf.get(key, None) == setting
    assert step.agg(F.sum("count")).first()[0] == 1000
    common.forget(step)


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 300), (300, 250)], "a long, b long")
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200, 250: 200, 300: 200}
    assert common.components(edges.where("1 = 0")).count() == 0


def test_join_groups(spark):
    rows = spark.createDataFrame([(i, i % 7 if i % 50 else None) for i in range(2500)] + [(9000 + i, 99) for i in range(1500)], "id long, k long")
    groups = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    least = {}
    for r in rows.collect():
        if r.k is not None:
            least[r.k] = min(least.get(r.k, r.id), r.id)
    assert least == {0: 7, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 99: 9000}
    got = sorted((r.id, r.k, r.least, r.n) for r in common.join_groups(rows, groups, ["k"], "n", 4000).collect())
    held = [(r.id, r.k) for r in rows.collect() if r.k is not None]
    sizes = {k: sum(k == x for _, x in held) for k in least}
    assert got == sorted((i, k, least[k], sizes[k]) for i, k in held)
    # the group of 1500 goes by the broadcast, the others by the shuffle
    assert max(sizes.values()) == 1500 > common.HOT_ROWS > max(n for k, n in sizes.items() if k != 99)


# decontamination


def test_contamination_odd_input(spark, odd, empty):
    items = spark.createDataFrame([(1, "brown fox jumps over the lazy dog, and runs far away"), (2, "two"), (3, None), (4, "!!"), (5, "never seen words in here at all my dear friend of mine"), (2, "two")], "item_id long, text string").withColumn("doc_id", F.lit(0))
    counts, hits = decontaminate.contaminated(odd, items)
    n = {r.doc: r.n_words for r in counts.collect()}
    assert n[0] == 15 and n[2] == 0 and n[3] == 0 and n[4] == 0 and n[None] == 2
    got = {}
    for r in hits.collect():
        got.setdefault((r.doc, r.item_id), set()).add((r.pos, r.length))
    assert got == {(0, 1): {(2, 10), (3, 10)}, (1, 1): {(2, 10), (3, 10)}, (5, 2): {(1, 1)}, (6, 2): {(1, 1)}}
    assert {r.doc: r.n_hit for r in decontaminate.hit_words(hits).collect()} == {0: 11, 1: 11, 5: 1, 6: 1}
    assert decontaminate.contaminated(empty, items)[0].count() == 0
    assert decontaminate.contaminated(odd, items.where("1 = 0"))[1].count() == 0
    clean = decontaminate.drop_contaminated(odd, items)
    assert {r.doc_id for r in clean.collect()} == {2, 3, 4, 7, 8, 9, None} and clean.columns == odd.columns


def test_items_without_id(spark):
    """Items without an id are one item, whose id is written as nothing."""
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "w0 w1"), (3, "short one"), (4, "x short one " + " ".join(words))], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(words)), (None, "short one"), (5, "one")], "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judged(docs, items).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {1: (12, 1, sha(""), True), 2: (0, 0, sha(""), False), 3: (2, 2, sha(",5"), True), 4: (14, 2, sha(",5"), True)}


def test_repeated_windows(spark):
    words = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(1, " ".join(words * 3)), (2, " ".join(words[:9])), (3, "x " + " ".join(words[1:11]).upper())], "doc_id long, text string")
    _, hits = decontaminate.contaminated(docs, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    assert {r.doc: r.n_hit for r in decontaminate.hit_words(hits).collect()} == {1: 36, 3: 10}


def test_contaminated_rows_without_id(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    rows = [(None, f"a {passage}"), (None, f"A {passage} b"), (None, "clean text"), (None, None), (1, passage), (2, "clean text"), (1, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, passage)], "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontaminate.judged(docs, items).collect()))
    assert got == [(0, 0, 0, False), (0, 2, 0, False), (0, 13, 12, True), (0, 14, 12, True), (1, 12, 12, True), (2, 2, 0, False)]
    kept = decontaminate.drop_contaminated(docs, items).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, ""), (0, "clean text"), (2, "clean text")]


# pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    docs = common.table(spark, sf_dir, "documents")
    kept = [docs]
    for name, stage in P.STAGES[:-1]:
        kept.append(common.written(stage(spark, kept[-1], sf_dir), name))
        assert kept[-1].columns == docs.columns
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[0] > ids[1] >= ids[2] >= ids[3] == ids[4]
    texts = {r.doc_id: r.text for r in kept[1].collect()}
    roots = brute_components(word_sets(texts, 5), 80, 100)
    assert ids[2] == {i for i, r in roots.items() if r == i}
    items = common.table(spark, sf_dir, "benchmark").collect()
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in t or ""))
    windows = {tuple(w[k : k + min(10, len(w))]) for i in items if (w := words(i.text)) for k in range(max(1, len(w) - 9))}
    assert ids[3] == {i for i in ids[2] if not any(tuple(w[k : k + n]) in windows for w in [words(texts[i])] for n in {len(x) for x in windows} for k in range(len(w) - n + 1))}
    for r in kept[4].collect():
        assert r.text == pii.redact(texts[r.doc_id], pii.spans_of(texts[r.doc_id])) and r.n_chars == len(r.text)
    packed = P.STAGES[-1][1](spark, kept[4], sf_dir).collect()
    check_packed(P.packing.pack(kept[4], BYTE, 2).collect(), {r.doc_id: r.text for r in kept[4].collect()}, tokens.load_codec(BYTE), 1024, 2)
    assert {r.doc_id for r in packed} == ids[4]
    model = quality.fit(docs, quality.training_labels(common.table(spark, sf_dir, "labels")))
    assert ids[1] == {r.doc_id for r in quality.classify(docs, model).where("score >= 0.3").collect()}
    again = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in P.run(spark, sf_dir).collect())
    assert again == sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_on_odd_input(spark, sf_dir, odd, empty):
    import corpus_pipeline as P

    for _, stage in P.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
    for _, stage in P.STAGES[1:4]:
        out = stage(spark, odd.withColumns({"_": F.lit(1), "gone": F.lit(2), "doc": F.lit(3), "n_chars": F.lit(0).cast("long")}), sf_dir)
        assert out.columns[:2] == ["doc_id", "text"] and {*out.columns} == {*odd.columns, "_", "gone", "doc", "n_chars"} and out.count() >= 8
    assert P.STAGES[4][1](spark, odd, sf_dir).select("doc_id").distinct().count() == 11
