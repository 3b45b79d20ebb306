"""SHA-256 of many short numbered texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

#: Hashes side by side: enough that a call costs little beside its work, few enough that what they take, 30 numbers each,
#: stays near a core.
LANES = 32_768


def _primes() -> list[int]:
    return [n for n in range(2, 312) if all(n % k for k in range(2, int(n**0.5) + 1))]


def _root(n: int, k: int) -> int:
    """The first 32 bits of the fractional part of a root of n, in whole numbers."""
    value = n << (32 * k)
    low, high = 0, 1 << 40
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid**k <= value else (low, mid)
    return low & 0xFFFFFFFF


_START = [np.uint32(_root(p, 2)) for p in _primes()[:8]]
_ROUND = [np.uint32(_root(p, 3)) for p in _primes()]
_NONE = np.zeros((1, 1), np.uint32)


def _distances(low: int, mid: int, high: int) -> list[np.ndarray]:
    """What _turned shifts by."""
    return [np.array(x, np.uint32) for x in (high - mid, mid - low, low, 32 - high)]


_SMALL = (_distances(3, 7, 18), _distances(10, 17, 19))
_LARGE = (_distances(2, 13, 22), _distances(6, 11, 25))
_ADDED = [np.array(x) for x in _ROUND]


def _turned(x: np.ndarray, by: list[np.ndarray], whole: bool, out: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
    """x turned right by a low, a middle and a high number of bits (shifted by the low one unless `whole`), in exclusive or."""
    high_mid, mid_low, low, rest = by
    out = np.right_shift(x, high_mid, out)
    np.bitwise_xor(out, x, out)
    np.right_shift(out, mid_low, out)
    np.bitwise_xor(out, x, out)
    np.right_shift(out, low, out)
    spare = np.left_shift(x, mid_low if whole else high_mid, spare)
    np.bitwise_xor(spare, x, spare)
    if whole:
        np.left_shift(spare, high_mid, spare)
        np.bitwise_xor(spare, x, spare)
    np.left_shift(spare, rest, spare)
    return np.bitwise_xor(out, spare, out)


class _Room:
    """Arrays for blocks of one shape, cut out of a store and written over in each round: new ones for every sum would cost
    as much as the sums."""

    #: Arrays of a room: 16 words, 8 of the state, 4 in between.
    ARRAYS = 28

    def __init__(self, store: np.ndarray, rows: int, columns: int):
        self.size = rows * columns
        own = [x[: self.size].reshape(rows, columns) for x in store]
        self.words, self.state = own[:16], own[16:24]
        self.one, self.two, self.now, self.before = own[24:]

    def next_word(self, w: list[np.ndarray], t: int) -> np.ndarray:
        """The schedule's word t, in the room of word t - 16 if it differs from block to block."""
        parts, out = [w[t % 16], w[(t - 7) % 16]], self.words[t % 16]
        wide = [x for x in parts if x.size == self.size]
        narrow = [x for x in parts if x.size < self.size]
        later = []
        for x, by in ((w[(t - 15) % 16], _SMALL[0]), (w[(t - 2) % 16], _SMALL[1])):
            if x.size == self.size:
                later.append((x, by))
            else:
                narrow.append(_turned(x, by, False))
        rest = sum(sorted(narrow, key=np.size), _NONE)
        if not wide and not later and rest.size < self.size:
            return rest
        begun = w[t % 16] is out
        if not begun:
            np.copyto(out, rest)
        elif narrow:
            np.add(out, rest, out)
        for x in wide[begun:]:
            np.add(out, x, out)
        for x, by in later:
            np.add(out, _turned(x, by, False, self.one, self.two), out)
        return out

    def first_word(self, words: list[np.ndarray]) -> np.ndarray:
        """The first 32 bits of the hashes of blocks of 16 words, whose shapes broadcast: what blocks have in common is
        reckoned once."""
        w, state, wide = list(words), [np.full((1, 1), x) for x in _START], False
        one, two, now, before = self.one, self.two, self.now, self.before
        for t in range(64):
            if t >= 16:
                w[t % 16] = self.next_word(w, t)
            own = w[t % 16]
            a, b, c, d, e, f, g, h = state
            if not wide:
                t1 = h + _turned(e, _LARGE[1], True) + (g ^ (e & (f ^ g))) + (own + _ADDED[t])
                t2 = _turned(a, _LARGE[0], True) + (((a ^ b) & (b ^ c)) ^ b)
                state = [t1 + t2, a, b, c, d + t1, e, f, g]
                if wide := state[0].size == self.size:
                    for x, room in zip(state, self.state, strict=True):
                        np.copyto(room, x)
                    state = self.state
                    np.bitwise_xor(state[1], state[2], before)
                continue
            np.add(h, np.add(own, _ADDED[t], one if own.size == self.size else None), h)
            np.add(h, _turned(e, _LARGE[1], True, one, two), h)
            np.bitwise_xor(f, g, one)
            np.bitwise_and(one, e, one)
            np.bitwise_xor(one, g, one)
            np.add(h, one, h)
            np.add(d, h, d)
            np.bitwise_xor(a, b, now)
            np.bitwise_and(now, before, before)
            np.bitwise_xor(before, b, before)
            np.add(h, before, h)
            np.add(h, _turned(a, _LARGE[0], True, one, two), h)
            state = [h, a, b, c, d, e, f, g]
            now, before = before, now
        return state[0] + _START[0]


def _digits(numbers: np.ndarray, length: int, at: int, end: bytes) -> np.ndarray:
    """Blocks of 16 words, a row for each number, of zeros but for the number's digits from a place on, and an end."""
    block = np.zeros((len(numbers), 64), np.uint8)
    for i in range(length):
        block[:, at + i] = 48 + numbers // 10 ** (length - 1 - i) % 10
    block[:, at + length : at + length + len(end)] = np.frombuffer(end, np.uint8)
    return block


def _by_length(numbers: np.ndarray) -> list[tuple[int, np.ndarray]]:
    lengths = np.array([len(str(n)) for n in numbers.tolist()])
    return [(int(k), np.flatnonzero(lengths == k)) for k in np.unique(lengths)]


def first_words(head: bytes, first: np.ndarray, between: bytes, second: np.ndarray) -> np.ndarray:
    """The first 32 bits of SHA-256 of head, a first number, `between` and a second number, both 0 or more, in decimal: a
    row for each first number, a column for each second one. Texts of over 55 bytes are hashed one by one."""
    out = np.empty((len(first), len(second)), np.uint32)
    store = np.empty((_Room.ARRAYS, min(out.size, max(LANES, len(second)))), np.uint32)
    for m, rows in _by_length(first):
        for n, columns in _by_length(second):
            size = len(head) + m + len(between) + n
            if size > 55:
                for i in rows.tolist():
                    own = hashlib.sha256(head + b"%d" % first[i] + between)
                    for j in columns.tolist():
                        one = own.copy()
                        one.update(b"%d" % second[j])
                        out[i, j] = int.from_bytes(one.digest()[:4], "big")
                continue
            left = _digits(first[rows], m, len(head), between)
            left[:, : len(head)] = np.frombuffer(head, np.uint8)
            right = _digits(second[columns], n, size - n, b"\x80")
            right[:, 62:] = np.frombuffer((8 * size).to_bytes(2, "big"), np.uint8)
            left, right = left.view(">u4").astype(np.uint32), right.view(">u4").astype(np.uint32)
            step = max(1, LANES // len(columns))
            for k in range(0, len(rows), step):
                words = []
                for q in range(16):
                    x, y = left[k : k + step, q : q + 1], right[None, :, q]
                    words.append((x if (x != x[0]).any() else x[:1]) | (y if (y != y[0, 0]).any() else y[:, :1]))
                room = _Room(store, len(rows[k : k + step]), len(columns))
                out[np.ix_(rows[k : k + step], columns)] = room.first_word(words)
    return out
