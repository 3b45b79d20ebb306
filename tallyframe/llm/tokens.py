"""Tokenising text in Arrow batches, each distinct word encoded by the library once.

A text is cut at spaces that no token and no merge of the tokenizer crosses (see the codecs), so the ids of the parts,
put together, are the ids of the whole text. Words repeat, so most parts are found in a bounded per-process table and
only the rest go to the tokenizer library. A tokenizer for which no cut is proven safe gets every text whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of the word table, and their characters, before it starts anew: bounds a worker's memory at about 100 MB.
MAX_WORDS = 250_000
MAX_CHARS = 1 << 24
#: Characters of unknown words that the library gets in one text or call.
CALL_CHARS = 1 << 16
#: What Python takes as white space, in RE2's notation.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


class _Words(dict):
    """word -> place in the codec's tables; unknown words get the next place and wait for the library."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec, self.waiting = codec, []

    def __missing__(self, word: str) -> int:
        place = self[word] = self.codec.n_words
        self.codec.n_words += 1
        self.waiting.append(word)
        return place


class Codec:
    """Ids of texts as one tokenizer gives them, without begin, end or added special tokens.

    `cut` matches the spaces that may be cut out of a text; `odd` (RE2) finds texts that have spaces of other kinds.
    """

    def __init__(self, splits: bool, cut: str, odd: str):
        self.splits, self.cut, self.odd = splits, re.compile(cut), odd
        self._reset()

    def _reset(self) -> None:
        self.first, self.rest = _Words(self), _Words(self)
        self.n_words = self.n_chars = 0
        self.starts, self.sizes, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), array("i")
        self.used = np.empty(0, np.int64)  # how often each word came, first words apart

    def _trim(self) -> None:
        """Make room in the tables: the words behind cuts that came most often stay, half of the most words at most."""
        often = np.sort(self.used)[::-1]
        least = max(2, int(often[MAX_WORDS // 2]) + 1 if len(often) > MAX_WORDS // 2 else 2)
        at = np.fromiter(self.rest.values(), np.int64, len(self.rest))
        stay = self.used[at] >= least
        at, kept = at[stay], list(compress(self.rest, stay))
        n_chars = sum(map(len, kept))
        if not kept or n_chars > MAX_CHARS // 2:
            self._reset()
            return
        flat, sizes, used = self._flat_of(at), self.sizes[at], self.used[at] // 2
        self._reset()
        self.sizes, self.used, self.starts = sizes, used, np.cumsum(sizes) - sizes
        self.flat.frombytes(flat.tobytes())
        self.rest.update(zip(kept, range(len(kept))))
        self.n_words, self.n_chars = len(kept), n_chars

    def whole(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, straight from the library."""
        raise NotImplementedError

    def _first_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that start a text, one after another, and the number of each."""
        found = [ids for at, end in batches_of(np.fromiter(map(len, words), np.int64, len(words)), CALL_CHARS) for ids in self.whole(words[at:end])]
        return np.fromiter((x for ids in found for x in ids), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def _rest_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words behind a cut, given without the space before them."""
        return self._first_ids(words)

    def _pieces(self, words: list[str]) -> tuple[list[int], list[list[str]]]:
        """Which words behind cuts fall apart, and their pieces, whose ids, put together, are the word's: what stays behind
        the cut, and the rest as texts of their own."""
        return [], []

    def _take_apart(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which unknown words behind cuts fall apart, their numbers of pieces, and the places of all these. Unknown pieces
        wait, too."""
        which, pieces = self._pieces(self.rest.waiting)
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        places, heads = np.empty(n.sum(), np.int64), np.cumsum(n) - n
        own = np.zeros(len(places), bool)
        own[heads] = True
        places[own] = [self.rest[x[0]] for x in pieces]
        places[~own] = [self.first[y] for x in pieces for y in x[1:]]
        return np.array(which, np.int64), n, places

    def _encode_waiting(self, apart: np.ndarray, n: np.ndarray, places: np.ndarray) -> None:
        """Put the ids of unknown words into the tables: of those that _take_apart told by their pieces. Places were given in
        the order of asking, first words last."""
        rest, first = self.rest.waiting, self.first.waiting
        self.rest.waiting, self.first.waiting = [], []
        if not rest and not first:
            return
        known = len(self.starts)
        asked = np.ones(len(rest), bool)
        asked[apart] = False
        sizes = np.zeros(len(rest) + len(first), np.int64)
        at = len(self.flat)
        for own, words, ids_of in ((np.flatnonzero(asked), list(compress(rest, asked)), self._rest_ids), (np.arange(len(rest), len(sizes)), first, self._first_ids)):
            if words:
                ids, sizes[own] = ids_of(words)
                self.flat.frombytes(ids.astype(np.int32).tobytes())
        order = np.concatenate([np.flatnonzero(asked), np.arange(len(rest), len(sizes))])
        starts = np.zeros(len(sizes), np.int64)
        starts[order] = at + np.cumsum(sizes[order]) - sizes[order]
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        if len(apart):
            whole, own = known + apart, self._flat_of(places)
            self.sizes[whole] = np.add.reduceat(self.sizes[places], np.cumsum(n) - n)
            self.starts[whole] = len(self.flat) + np.cumsum(self.sizes[whole]) - self.sizes[whole]
            self.flat.frombytes(own.tobytes())
        self.n_chars += sum(map(len, rest)) + sum(map(len, first))

    def _flat_of(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at some places, one after another."""
        starts, sizes = self.starts[places], self.sizes[places]
        take = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        take += np.arange(len(take))
        return np.frombuffer(self.flat, np.int32)[take] if self.flat else np.empty(0, np.int32)

    def _parts(self, texts: pa.Array) -> pa.Array:
        """The parts of each text as a list."""
        if not self.splits:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32)), texts)
        if not (odd := pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)).any():
            return pc.split_pattern(texts, " ")
        plain, other = pc.split_pattern(texts.filter(pa.array(~odd)), " "), texts.filter(pa.array(odd)).to_pylist()
        both = pa.concat_arrays([plain, pa.array(map(self.cut.split, other), pa.list_(pa.string()))])
        return both.take(pa.array(np.argsort(np.argsort(odd, kind="stable"), kind="stable")))

    def _places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all parts of all texts in order, and the number of parts of each text."""
        if self.n_words > MAX_WORDS or self.n_chars > MAX_CHARS:
            self._trim()
        parts = self._parts(texts)
        words, ends = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        ends -= ends[0]
        firsts = words.take(pa.array(ends[:-1])).to_numpy(zero_copy_only=False)
        # first words are looked up apart; here they stand in by a word of the batch
        later = np.ones(len(words), bool)
        later[ends[:-1]] = False
        coded = words.filter(pa.array(later)).dictionary_encode()
        known = np.fromiter(map(self.rest.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64, len(coded.dictionary))
        places = np.empty(len(words), np.int64)
        places[later] = known[coded.indices.to_numpy()]
        apart = self._take_apart()
        places[ends[:-1]] = [self.first[t] for t in firsts.tolist()]
        self._encode_waiting(*apart)
        self.used = np.concatenate([self.used, np.zeros(self.n_words - len(self.used), np.int64)])
        self.used += np.bincount(apart[2][np.cumsum(apart[1]) - apart[1]], minlength=self.n_words)
        self.used[known] += np.bincount(coded.indices.to_numpy(), minlength=len(known))
        return places, np.diff(ends)

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not len(texts):
            return np.empty(0, np.int64)
        places, parts = self._places(texts)
        return np.add.reduceat(self.sizes[places], np.cumsum(parts) - parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (int32) of all texts one after another, and the number of ids of each text."""
        if not len(texts):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        places, parts = self._places(texts)
        return self._flat_of(places), np.add.reduceat(self.sizes[places], np.cumsum(parts) - parts)


class JsonCodec(Codec):
    """A tokenizers .json file. Special strings inside texts are handled as the library does by default.

    GPT-2's pattern gives a space to what follows it unless that is white space, so every text falls apart before a
    space that stands before another character, and so does a text put together from such parts. It also parts letters
    from signs behind them, apostrophes apart, and a single line feed from what stands on both sides of it; so words that
    differ in these alone ask the library for their letters once.
    """

    #: Signs that fall off a letter at a word's end.
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: One to three of them behind a letter, in RE2's notation.
    TAIL = "[A-Za-zÀ-ÖØ-öø-ÿ][!-&(-/:-@\\[-`{-~]{1,3}"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        safe = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        safe = safe and not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in added)
        self.added, self.tail = [t["content"] for t in added], re.compile(self.TAIL)
        # bytes of each id: a letter of a byte-level token stands for one byte
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            if i < len(self.n_bytes):
                self.n_bytes[i] = len(token)
        for t in added:
            if t["id"] < len(self.n_bytes):
                self.n_bytes[t["id"]] = len(t["content"].encode())
        super().__init__(bool(safe), r" (?=\S)", rf" (?:[{_WHITE}]|\z)")

    def _pieces(self, words: list[str]) -> tuple[list[int], list[list[str]]]:
        told = pa.array(words, pa.string())
        # single line feeds between other characters; added tokens may hold any sign
        tails, feeds = pc.match_substring_regex(told, self.TAIL + r"\z"), pc.match_substring(told, "\n")
        some = pc.or_(tails, feeds)
        if self.added:
            some = pc.and_not(some, pc.match_substring_regex(told, "|".join(map(re.escape, self.added))))
        which, pieces = [], []
        for i in np.flatnonzero(some.to_numpy(zero_copy_only=False)).tolist():
            word, lines = words[i], words[i].split("\n")
            if len(lines) == 1:
                stem = word.rstrip(self.SIGNS)
                own = [stem, word[len(stem) :]]
            elif all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                own = []
                for line in lines:
                    stem = line.rstrip(self.SIGNS)
                    own += [stem, line[len(stem) :], "\n"] if self.tail.fullmatch(line, max(0, len(stem) - 1)) else [line, "\n"]
                own.pop()
            else:
                continue
            which.append(i)
            pieces.append(own)
        return which, pieces

    def _rest_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words behind cuts make one text again; the bytes of its ids say which word each is of."""
        ids, sizes = [], []
        for at, end in batches_of(np.fromiter(map(len, words), np.int64, len(words)), CALL_CHARS):
            some = words[at:end]
            got = np.array(self.whole([" " + " ".join(some)])[0], np.int64)
            ends = np.cumsum(pc.binary_length(pa.array(some, pa.string())).to_numpy().astype(np.int64) + 1)
            covered = np.cumsum(self.n_bytes[got])
            last = np.searchsorted(covered, ends)
            if len(covered) <= last[-1] or (covered[last] != ends).any() or covered[-1] != ends[-1]:
                raise ValueError("the tokenizer's ids don't spell the text")
            ids.append(got.astype(np.int32))
            sizes.append(np.diff(last, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    def whole(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in encode(texts, add_special_tokens=False)]


class PieceCodec(Codec):
    """A sentencepiece .model file.

    Spaces are the mark U+2581. No piece has a mark behind another character, so nothing crosses from a character that
    isn't a space to one that is; and each part is encoded alone, as the library puts one mark in front of it.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        mark = "▁"
        safe = not any(mark in p.id_to_piece(i).lstrip(mark) for i in range(p.get_piece_size()))
        safe = safe and p.normalize("ﬁ ½  x ") == f"{mark}ﬁ{mark}½{mark}{mark}x{mark}" and p.normalize(mark) == 2 * mark
        super().__init__(safe, r"(?<=[^ ]) (?!\Z)", r"  |\A | \z")

    def _parts(self, texts: pa.Array) -> pa.Array:
        return super()._parts(pc.replace_substring(texts, "▁", " ") if self.splits else texts)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.processor.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def load_codec(path: str) -> Codec:
    """The codec of a tokenizer file, once per worker process."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return PieceCodec(path) if path.endswith(".model") else JsonCodec(path)


def batches_of(sizes: np.ndarray, most: int):
    """Slices (start, end), in order, of items whose sizes sum up to at most `most`; a larger item is a slice of its own."""
    total, at = np.cumsum(sizes), 0
    while at < len(sizes):
        before = int(total[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        yield at, end
        at = end


def text_batches(texts: pa.Array, most: int):
    """(start, end, texts without nulls) for slices of an Arrow array of about `most` bytes; null is the empty text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for at, end in batches_of(sizes, most):
        yield at, end, pc.fill_null(texts.slice(at, end - at), "").cast(pa.string())
