"""A tokenizer's tables keep the words that come often when they are full."""

import public_tokenizers
import pyarrow as pa

from tallyframe.llm import tokens


def test_frequent_words_stay(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 40)
    codec = tokens.JsonCodec(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    ids_of = codec._rest_ids
    monkeypatch.setattr(codec, "_rest_ids", lambda words: asked.extend(words) or ids_of(words))
    for k in range(12):
        texts = [f"start{k} of the common" + "".join(f" w{k}x{i} the common" for i in range(20)), "", " x  y\n the", "the common"]
        ids, sizes = codec.encode(pa.array(texts))
        want = codec.whole(texts)
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert asked.count("common") == 1 and codec.n_words <= 70


def test_signs_and_line_feeds_fall_off(monkeypatch):
    """Words that differ in the signs behind them, or stand around a line feed, ask for their letters once."""
    codec = tokens.JsonCodec(public_tokenizers.path("byte_bpe_50k.json"))
    asked = []
    ids_of = codec._rest_ids
    monkeypatch.setattr(codec, "_rest_ids", lambda words: asked.extend(words) or ids_of(words))
    odd = ["it's, we'll. x'.", "a....  b,\n", "w\n\nv \nu t\n s", "<|endoftext|> x<|endoftext|>. y<|endoftext|", "é? ÿ! ×. ÷, Ж; 1. ª.", "q́. q.́", "e.\r\nf, g,\x1ch h　.", " .", "", "n\t.\no"]
    for texts in (["the qalpha, qalpha. qalpha", "the qalpha### qalpha!?\nQbeta. qalpha,"], odd, [" ".join(odd)]):
        ids, sizes = codec.encode(pa.array(texts))
        want = codec.whole(texts)
        assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert [w for w in asked if "qalpha" in w] == ["qalpha"]
