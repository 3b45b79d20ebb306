"""Many patterns in one pass: an automaton of literals finds out which regular expressions can match at all."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

def alternatives(pattern: str) -> list[str]:
    """A regular expression cut at the bars that stand in no group or class."""
    out, start = [], 0
    for i, part in _parts(pattern):
        if part == "|":
            out.append(pattern[start:i])
            start = i + 1
    return [*out, pattern[start:]]


def _parts(pattern: str) -> Iterator[tuple[int, str]]:
    """(place, part) of the parts of a regular expression: escapes, classes, groups and single characters."""
    i = 0
    while i < len(pattern):
        start = i
        if pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            i += 2
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif pattern[i] == "(":
            depth = 0
            for at, part in _flat(pattern, i):
                depth += (part == "(") - (part == ")")
                if not depth:
                    i = at + 1
                    break
            else:
                raise ValueError(f"open group: {pattern}")
        else:
            i += 1
        yield start, pattern[start:i]


def _flat(pattern: str, i: int) -> Iterator[tuple[int, str]]:
    """Like _parts from a place on, but with brackets of groups as single characters."""
    while i < len(pattern):
        start = i
        if pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            i += 2
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        else:
            i += 1
        yield start, pattern[start:i]


def literals(pattern: str) -> set[str] | None:
    """Some strings of which every match of a regular expression holds one; None if none are plain to see."""
    out: set[str] = set()
    for a in alternatives(pattern):
        if (own := _of_one(a)) is None:
            return None
        out |= own
    return out


def _of_one(alternative: str) -> set[str] | None:
    """literals of an expression without bars: a run of characters that must come, or those of a group that must come."""
    parts = [part for _, part in _parts(alternative)]
    best: set[str] | None = None
    run = ""

    def offer(found: set[str] | None) -> None:
        nonlocal best
        if found and all(found) and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for k, part in enumerate(parts):
        after = parts[k + 1] if k + 1 < len(parts) else ""
        optional = after in ("?", "*", "{")
        if part[0] == "(":
            offer({run} if run else None)
            run = ""
            if not optional and not part.startswith(("(?!", "(?=", "(?<")):
                offer(literals(part.removeprefix("(?:").removeprefix("(")[:-1]))
        elif part[0] == "[" or part in (".", "^", "$", "?", "*", "+", "{", "}") or (part[0] == "\\" and part[1].isalnum()):
            offer({run} if run else None)
            run = ""
            if part == "{":
                return best  # counts aren't looked into
        elif optional:
            offer({run} if run else None)
            run = ""
        else:
            run += part[-1]
            if after == "+":
                offer({run})
                run = ""
    offer({run} if run else None)
    return best


def widest(pattern: str) -> int | None:
    """The most characters that a match of a regular expression can have; None if there is no bound, or if a match depends
    on what is around it."""
    most = 0
    for a in alternatives(pattern):
        parts = [part for _, part in _parts(a)]
        own = 0
        for part in parts:
            if part in ("^", "$", "*", "+", "{") or (part[0] == "\\" and part[1:] not in ("d", "D", "s", "S", "w", "W") and part[1:].isalnum()):
                return None
            if part[0] == "(":
                if part.startswith("(?") and not part.startswith("(?:"):
                    return None
                if (inner := widest(part.removeprefix("(?:").removeprefix("(")[:-1])) is None:
                    return None
                own += inner
            elif part != "?":
                own += 1
        most = max(most, own)
    return most


class Matcher:
    """Which of some groups of patterns occur in a text: groups are named, each a list of regular expressions.

    Patterns are for lower-case text and are matched as they are. One pass of an automaton finds the literals that a text
    holds; an expression is tried only if it has one of its own there, or if none is known of it.
    """

    def __init__(self, groups: dict[object, list[str]]):
        import ahocorasick

        needed: dict[str, list[tuple[object, re.Pattern]]] = {}
        self.always: list[tuple[object, re.Pattern]] = []
        for name, patterns in groups.items():
            for p in (a for whole in patterns for a in alternatives(whole)):
                own = (name, re.compile(p))
                words = literals(p)
                for word in words or ():
                    needed.setdefault(word, []).append(own)
                if not words:
                    self.always.append(own)
        self.automaton = ahocorasick.Automaton()
        for word, own in needed.items():
            self.automaton.add_word(word, (word, own))
        if needed:
            self.automaton.make_automaton()
        self.some = bool(needed)

    def found(self, text: str) -> set[object]:
        out = {name for name, pattern in self.always if pattern.search(text)}
        if self.some:
            for own in dict(value for _, value in self.automaton.iter(text)).values():
                for name, pattern in own:
                    if name not in out and pattern.search(text):
                        out.add(name)
        return out


class Markers:
    """Which language most marker words speak for. A marker stands between characters that are not a to z."""

    def __init__(self, markers: dict[str, list[str]]):
        self.words: dict[str, list[str]] = {}
        self.others: list[tuple[str, str, re.Pattern]] = []
        self.languages = list(markers)
        for lang, own in markers.items():
            for w in own:
                if re.fullmatch("[a-z]+", w):
                    self.words.setdefault(w, []).append(lang)
                else:
                    self.others.append((lang, w, re.compile(f"(?<![a-z]){re.escape(w)}(?![a-z])")))

    def language(self, folded: str) -> str:
        """The language of most markers in a lower-case text without accents, each counted once; none or a tie: unk."""
        votes = dict.fromkeys(self.languages, 0)
        for w in self.words.keys() & set(_WORDS.findall(folded)):
            for lang in self.words[w]:
                votes[lang] += 1
        for lang, w, pattern in self.others:
            if w in folded and pattern.search(folded):
                votes[lang] += 1
        first, *rest = sorted(votes.values(), reverse=True) or [0]
        if not first or (rest and rest[0] == first):
            return "unk"
        return max(votes, key=votes.__getitem__)


_WORDS = re.compile("[a-z]+")


@lru_cache(maxsize=64)
def markers_of(items: tuple) -> Markers:
    return Markers({lang: list(words) for lang, words in items})


@lru_cache(maxsize=16)
def matcher_of(items: tuple) -> Matcher:
    return Matcher({name: list(patterns) for name, patterns in items})
