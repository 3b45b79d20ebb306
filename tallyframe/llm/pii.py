"""Operator 7: personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, dots, plus signs, digits, URL schemes and words that announce an
identifier. Small parsers expand each anchor to the bounds of an address, number or account and validate it. A parser
goes on behind its last match, so each kind's matches are the leftmost ones that don't overlap, and each anchor costs
no more than the text around it.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which spans are listed; the base ones have a fixed form.
BASE = ("email", "ip", "card", "phone")
ADDED = ("url_login", "iban", "account")
KINDS = BASE + ADDED
SCHEMES = ("://",)
CUES = ("iban", "account", "acct", "customer id", "passport", "ssn", "tax id", "konto", "compte", "cuenta")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DIGITS = frozenset(string.digits)
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}\Z")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&*+,;=-]+(?::[^\s@/]*)?@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
#: A code behind a cue, more of it than the longest account number has.
_AFTER_CUE = re.compile(r"(?:\s*(?:number|no\.?|nr\.?|id|#|is|:|=))*\s*([A-Z0-9](?:[ -]?[A-Z0-9]){0,69})", re.ASCII)


def luhn(digits: str) -> bool:
    """The check of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(code: str) -> bool:
    """The check of international bank account numbers."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", code):
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def account(text: str, start: int, end: int, is_iban: bool) -> tuple[str, int, int] | None:
    """(kind, start, end) of the account number that starts a run of parts of capitals and digits, if there is one.

    It ends with a part. An international number is the longest code of at most 34 characters that passes its check, at a
    word boundary if one does; any other ends before the first part without digits that follows six digits, so only a
    part with digits that goes on in lower case, which would stay in the text, is cut inside a word. Without an IBAN
    cue, a shorter international number doesn't replace a longer other one.
    """
    parts, whole = [], ""
    for p in re.finditer(r"[A-Z0-9]+", text[start:end]):
        whole += p[0]
        parts.append((p.end() + start, whole))
    other, before = None, ""
    for stop, code in parts:
        if other and not any(c.isdigit() for c in code[len(before) :]):
            break
        if 6 <= len(code) <= 34 and sum(c.isdigit() for c in code) >= 6:
            other = ("account", start, stop)
        before = code
    least = other[2] if other and not is_iban else 0
    ends = [(stop, code) for stop, code in parts if stop >= least and len(code) <= 34 and iban(code)]
    ends = [e for e in ends if not text[e[0] : e[0] + 1].isalnum()] or ends
    return ("iban", start, ends[-1][0]) if ends else other


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word in ("@", ".", "+", *string.digits, *SCHEMES, *{f for c in CUES for f in (c, c.upper(), c.capitalize(), c.title())}):
        found.add_word(word, (word, "0" if word in _DIGITS else "://" if word in SCHEMES else word if len(word) == 1 else "cue"))
    found.make_automaton()
    return found


def _run_start(text: str, at: int, least: int, of: frozenset[str]) -> int:
    """Where the run of characters in `of` that ends before `at` starts, not before `least`."""
    while at > least and text[at - 1] in of:
        at -= 1
    return at


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all spans, by kind as in KINDS, then by start; code points, end exclusive."""
    found: list[tuple[str, int, int]] = []
    email_end = ip_end = card_end = phone_end = 0
    for end, (word, kind) in _anchors().iter(text):
        at = end + 1 - len(word)
        if kind == "0":
            if at >= card_end and (m := _CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", at, card_end))
        elif kind == ".":
            if at > ip_end and text[at - 1] in _DIGITS and (m := _IP.match(text, _run_start(text, at, ip_end, _DIGITS))):
                ip_end = m.end()
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                    found.append(("ip", m.start(), ip_end))
        elif kind == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                    found.append(("phone", at, phone_end))
        elif kind == "@":
            if at < email_end or not (m := _DOMAIN.match(text, at + 1)):
                continue
            if (start := _run_start(text, at, email_end, _LOCAL)) < at:
                found.append(("email", start, m.end()))
                email_end = m.end()
        elif kind == "://":
            scheme = _SCHEME.search(text, max(0, at - 17), at)
            if scheme and (m := _LOGIN.match(text, end + 1)):
                found.append(("url_login", scheme.start(), m.end()))
        elif (m := _AFTER_CUE.match(text, end + 1)) and not text[max(0, at - 1) : at].isalnum():
            if code := account(text, m.start(1), m.end(1), word.lower() == "iban"):
                found.append(code)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (order[s[0]], s[1], s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span, or union of overlapping spans, replaced by its (first) kind in brackets."""
    out, at = [], 0
    kind, start, end = "", -1, -1
    for k, a, b in [*sorted(spans, key=lambda s: (s[1], -s[2])), ("", len(text) + 1, len(text) + 1)]:
        if a < end:
            end = max(end, b)
            continue
        if start >= 0:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        kind, start, end = k, a, b
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def pii(text: Column, redacted: bool = True) -> Column:
    """struct<spans, text>: the spans of personal data in a text column, and the text with them replaced.

    Null text has no spans and stays null. With redacted=False the text isn't returned.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    kind = pa.struct([("spans", pa.list_(span)), ("text", pa.string())])

    @F.arrow_udf(f"struct<spans:{SPANS},text:string>")
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                spans = spans_of(text) if text else []
                own = redact(text, spans) if redacted and text else text if redacted else None
                rows.append({"spans": [{"kind": k, "start": a, "end": b} for k, a, b in spans], "text": own})
            yield pa.array(rows, kind)

    return search(text)


def find_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with pii_spans and redacted_text (input columns of these names are replaced; all others stay).

    Empty and null texts have no spans; very long texts are searched whole. Spans of several kinds may overlap, and at one
    place (ties) the order of KINDS counts. Repeated rows stay repeated; an empty table gives an empty table.
    """
    found = docs.withColumn("pii_spans", pii(F.col(text_col).cast("string")))
    return found.withColumns({"redacted_text": F.col("pii_spans.text"), "pii_spans": F.col("pii_spans.spans")})


def redact_documents(docs: DataFrame) -> DataFrame:
    """documents with personal data replaced in text, and n_chars of the new text.

    Null text stays null, with n_chars null; empty text stays empty; very long texts are searched whole. Where spans
    overlap, their union becomes the kind of the first, of the longest at one place (ties). All other columns are kept, and
    repeated rows stay repeated; an empty table gives an empty table.
    """
    found = docs.withColumn("text", pii(F.col("text"))["text"])
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", pii(F.col("text"), redacted=False)["spans"].alias("s"))
    of = lambda kind: F.filter("s", lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("s", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("s")).alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
