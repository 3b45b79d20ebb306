"""Columns for multilingual report text: accents, language, sections, sentences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import markers_of, widest

#: Scripts that tell a language, words that mark one, and section headers.
SCRIPTS = {"bg": "[Ѐ-ӿ]", "el": "[Ͱ-Ͽ]", "th": "[฀-๿]"}
MARKERS = {
    "en": ["the", "findings", "impression", "there is", "no evidence", "knee", "with"],
    "es": ["hallazgos", "impresion", "tecnica", "rodilla", "derrame", "sin", "rotura"],
    "tr": ["bulgular", "sonuc", "izlenmektedir", "menisküs", "menikus", "saptanmadi", "diz", "yirtik", "duzeyinde"],
    "it": ["reperti", "conclusioni", "versamento", "ginocchio", "menisco mediale", "non si"],
    "pt": ["achados", "impressao", "joelho", "nao", "ruptura do", "conclusao"],
    "de": ["befund", "beurteilung", "kein", "erguss", "kniegelenk", "vorderes", "riss"],
    "fr": ["resultats", "conclusion", "epanchement", "menisque", "pas de", "genou"],
    "hr": ["nalaz", "misljenje", "koljena", "prednja", "ukrstena", "krizni", "izljev"],
    "nl": ["bevindingen", "besluit", "knie", "geen", "voorste", "scheur", "meniscusscheur"],
}
SECTIONS = {
    "impression": "impression|impresion|impressao|conclusion(?:i|e|s|es)?|conclusao|beurteilung|sonuc|kanaat|заключение|мнение|misljenje|zakljucak|besluit|συμπερασμα|εντυπωση|γνωμη|kanı",
    "findings": "findings|hallazgos|resultados|achados|reperti|befund(?:e|ung)?|bulgular|resultats|nalaz|bevindingen|ευρηματα|данни|описание|opis",
    "technique": "technique|tecnica|technik|teknik|protocol[oe]?|scanprotocol|tetkik protokolu|metodika|метод",
    "indication": "indication|indicacion|indicazione|klinik|clinical (?:history|information)|diagnostische vraagstelling|vraagstelling|anamnese|anamnez|historia clinica|quesito|renseignements? cliniques?|klinische angaben|endikasyon|история",
}
EXCLUDED_SECTIONS = ("technique", "indication")
LABELS = ("ACL", "MCL", "Medial Meniscus", "Lateral Meniscus", "Medial OA", "Lateral OA", "PF OA", "Effusion", "Synovitis", "Baker's", "Contusion", "Fracture")
SELF_EVIDENT = ("Effusion", "Synovitis", "Baker's", "Contusion", "Fracture", "Medial OA", "Lateral OA", "PF OA")

_FLAGS = "(?iuU)"


_FAR = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(maxsize=1)
def _combining() -> tuple[re.Pattern, re.Pattern]:
    """All combining marks, those of the first plane apart: a class of these alone is looked up in a table."""
    marks = [c for c in map(chr, range(0x110000)) if unicodedata.combining(c)]
    return tuple(re.compile(f"[{''.join(c for c in marks if (c > chr(0xFFFF)) == far)}]+") for far in (False, True))


def plain(text: str) -> str:
    if text.isascii():
        return text
    near, far = _combining()
    out = near.sub("", unicodedata.normalize("NFKD", text))
    return far.sub("", out) if _FAR.search(out) else out


def strip_accents(text: Column | str) -> Column:
    """NFKD without combining marks, by an Arrow function: no built-in function of Spark decomposes characters."""

    @F.arrow_udf("string")
    def fold(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if t is None else plain(t) for t in batch.to_pylist()], pa.string())

    return fold(text)


#: What \\s matches in a text.
_SPACE = " \t\n\x0b\f\r"


def script(text: str, share: float = 0.30) -> str | None:
    """The first script over a share of a text's letters. Letters are counted only where a text has one of the scripts."""
    if not _any_script().search(text):
        return None
    letters = sum(map(str.isalpha, text))
    own = {lang: sum(len(x) for x in re.findall(f"{p}+", text)) for lang, p in SCRIPTS.items()}
    return next((lang for lang, n in own.items() if letters and n / letters > share), None)


@lru_cache(maxsize=1)
def _any_script() -> re.Pattern:
    return re.compile("|".join(SCRIPTS.values()))


def _marked(markers: dict[str, list[str]] | None) -> tuple:
    return tuple((lang, tuple(plain(w) for w in words)) for lang, words in (markers or MARKERS).items())


def detect_language(text: Column, folded: Column, markers: dict[str, list[str]] | None = None) -> Column:
    """Language of a text: one of the scripts if over 30 % of its letters are of it, else the language of which most
    markers occur (each counts once) in `folded`, its lower-case text without accents; none or a tie: unk."""
    own = _marked(markers)

    @F.arrow_udf("string")
    def detect(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        found = markers_of(own)
        for texts, foldeds in columns:
            yield pa.array(["unk" if not t else script(t) or found.language(f or "") for t, f in zip(texts.to_pylist(), foldeds.to_pylist(), strict=True)], pa.string())

    return detect(text, folded)


def folded_language(text: Column, markers: dict[str, list[str]] | None = None) -> Column:
    """struct<folded, language>: strip_accents and detect_language in one pass; null text has the language unk."""
    own = _marked(markers)

    @F.arrow_udf("folded string, language string")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = markers_of(own)
        for batch in batches:
            texts = batch.to_pylist()
            folded = [None if t is None else plain(t) for t in texts]
            langs = ["unk" if not t else script(t) or found.language(f.lower()) for t, f in zip(texts, folded, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(folded, pa.string()), pa.array(langs, pa.string())], names=["folded", "language"])

    return both(text)


#: What \\s matches in the Unicode mode of _FLAGS.
_UNICODE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: What stands around a header's name while a text is cut, and what a text's own U+0001 becomes meanwhile, so that no text
#: can look like it.
_MARK, _OWN, _ESCAPED = "\u0001\u0002", "\u0001", "\u0001\u0003"


def _marked_headers(text: Column, sections: dict[str, str]) -> Column:
    """A text with its headers' names in marks. A header stands right before a colon, so expressions are tried only on the
    last characters before each colon, as many as a header can have; a text is not searched place by place."""
    widths = [widest(p) for p in sections.values()]
    if None in widths or any(":" in p.replace("(?:", "") for p in sections.values()):
        for name, pattern in sections.items():
            text = F.regexp_replace(text, f"{_FLAGS}(?:{pattern})\\s*:", f"{_MARK}{name}{_MARK}")
        return text
    ending = lambda p: f"{_FLAGS}(?:{p})\\z"
    most = F.lit(max(widths))

    def headed(piece: Column) -> Column:
        def told(trimmed: Column) -> Column:
            def named(tail: Column) -> Column:
                out = F.lit(None).cast("string")
                for name, pattern in reversed(sections.items()):
                    out = F.when(F.regexp_like(tail, F.lit(ending(pattern))), F.concat(F.regexp_replace(tail, ending(pattern), ""), F.lit(f"{_MARK}{name}{_MARK}"))).otherwise(out)
                some = F.when(F.regexp_like(tail, F.lit(ending("|".join(sections.values())))), out)
                before = F.substring(trimmed, F.lit(1), F.length(trimmed) - F.length(tail))
                return F.coalesce(F.concat(before, some), F.concat(piece, F.lit(":")))

            return bound(F.right(trimmed, most), named)

        return bound(F.rtrim(piece, F.lit(_UNICODE_SPACE)), told)

    def whole(pieces: Column) -> Column:
        last = F.size(pieces) - 1
        return F.array_join(F.transform(pieces, lambda p, i: F.when(i == last, p).otherwise(headed(p))), "")

    return bound(F.split(text, ":"), whole)


def split_sections(folded: Column, sections: dict[str, str] | None = None) -> Column:
    """array<struct<section, text>> in order: text before the first header is `other`, without any header `findings`;
    parts of one section are joined by line feeds.

    Works on text whose accents are stripped, so that headers and contents have the same positions.
    """
    escaped = F.replace(folded, F.lit(_OWN), F.lit(_ESCAPED))
    marked = _marked_headers(escaped, sections or SECTIONS)

    def pairs(parts: Column) -> Column:
        # parts: text, name, text, name, text ...
        name = lambda i: F.when(i == 0, F.when(F.size(parts) == 1, "findings").otherwise("other")).otherwise(F.get(parts, i - 1))
        each = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), lambda i: F.struct(name(i).alias("section"), F.replace(F.get(parts, i), F.lit(_ESCAPED), F.lit(_OWN)).alias("text")))
        return F.filter(each, lambda h: (h["section"] != "other") | (h["text"] != ""))

    def joined(kept: Column) -> Column:
        whole = lambda n: F.array_join(F.transform(F.filter(kept, lambda h: h["section"] == n), lambda h: h["text"]), "\n")
        return F.transform(F.array_distinct(F.transform(kept, lambda h: h["section"])), lambda n: F.struct(n.alias("section"), F.btrim(whole(n), F.lit(_SPACE)).alias("text")))

    # a header ends in a colon
    return bound(F.split(F.when(F.contains(folded, F.lit(":")), marked).otherwise(escaped), _MARK), lambda parts: bound(pairs(parts), joined))


def bound(value: Column, body) -> Column:
    """body(value), in which value is evaluated once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_sentences(text: Column) -> Column:
    """Sentences between full stops, semicolons and line feeds, trimmed, without empty ones."""
    parts = F.transform(F.split(text, r"[.;\n]+"), lambda s: F.btrim(s, F.lit(_SPACE)))
    return F.filter(parts, lambda s: s != "")


def comma_list(items: Column) -> Column:
    """Items of an array of comma-separated lists, trimmed, without empty ones and repeats, in order."""
    flat = F.flatten(F.transform(items, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(y))))
    return F.array_distinct(F.filter(flat, lambda x: x != ""))


def lexicon() -> list[tuple[str, str, str, str]]:
    """(kind, label, language, pattern) of the rule extractor's terms and cues."""
    lines = files("tallyframe").joinpath("resources/lexicon.tsv").read_text("utf-8").splitlines()
    return [tuple(x.split("\t")) for x in lines if x and x[0] != "#"]  # type: ignore[misc]


def any_match(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern occurs: one regular expression, so that each text is scanned by one matcher."""
    return F.regexp_like(text, F.lit(_FLAGS + "|".join(f"(?:{p})" for p in patterns))) if patterns else F.lit(False)
