"""Column expressions on text: normalisation, markup removal, slugs and song titles."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectura import constants as K



def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Name an intermediate value, so that an expression using it twice computes it once."""
    return F.transform(F.array(value), use)[0]


SOFT_HYPHEN = "­"
_COMBINING_MARKS = "̧̨̀́̂̃̈̊̌"


def _composed_pairs() -> list[tuple[str, str]]:
    """(base + mark, single character) for Latin letters, by the composition rule of Unicode."""
    letters = [chr(c) for c in range(ord("A"), ord("z") + 1) if chr(c).isalpha()]
    pairs = ((a + m, unicodedata.normalize("NFC", a + m)) for a in letters for m in _COMBINING_MARKS)
    return [(two, one) for two, one in pairs if len(one) == 1]


def _accent_table() -> tuple[str, str]:
    """Latin letters whose decomposition starts with one ASCII letter, and those letters."""
    source, target = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


# Marks and jamo join what stands before them; the rest have a composed form of their own.
MAY_COMPOSE = (
    r"[\p{M}\u1100-\u11ff\u0340-\u0387\u0958-\u09df\u0a33-\u0a5e\u0b5c\u0b5d\u0f43-\u0fb9\u1f71-\u1fff\u2000\u2001"
    r"\u2126\u212a\u212b\u2329\u232a\u2adc\uf900-\ufaff\ufb1d-\ufb4e\x{1d15e}-\x{1d1c0}\x{2f800}-\x{2fa1f}]"
)


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


# Characters that compatibility composition leaves as they are, whatever stands beside them.
PLAIN_CHARACTERS = r"\x00-\x9f\xa1-\xa7\xa9\xab-\xae\xb0\xb1\xb6\xb7\xbb\xbf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e‘’“”«»–—"


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def compatible(text: Column) -> Column:
    """NFKC; only texts with a character that it may change make an Arrow round trip."""
    return F.coalesce(_nfkc(F.when(F.regexp_like(text, F.lit(f"[^{PLAIN_CHARACTERS}]")), text)), text)


def compose_latin(text: Column) -> Column:
    """NFC for Latin letters with the common combining marks, without leaving the JVM.

    Only texts that hold such a pair pay for it: each distinct pair is replaced once.
    """
    table = F.create_map(*[F.lit(v) for pair in _composed_pairs() for v in pair])

    def composed(raw: Column) -> Column:
        pairs = F.array_distinct(F.regexp_extract_all(raw, F.lit(f"[A-Za-z][{_COMBINING_MARKS}]"), F.lit(0)))
        return F.aggregate(
            pairs, raw, lambda done, two: F.replace(done, two, F.coalesce(F.try_element_at(table, two), two))
        )

    has_mark = F.lit(f"[{_COMBINING_MARKS}]")
    return let(text, lambda raw: F.when(F.regexp_like(raw, has_mark), composed(raw)).otherwise(raw))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, K.WHITESPACE + "+", " "))


def normalize_text(text: Column, full_nfc: bool = False) -> Column:
    """Compose accents, drop soft hyphens, collapse white space, strip.

    ``full_nfc`` covers every script; the texts that composition can change, and only those, make an
    Arrow round trip.
    """
    composed = compose_latin(text)
    if full_nfc:
        composed = F.coalesce(_nfc(F.when(F.regexp_like(text, F.lit(MAY_COMPOSE)), text)), text)
    return collapse_space(F.replace(composed, F.lit(SOFT_HYPHEN), F.lit("")))


def sentences(text: Column) -> Column:
    """The sentences of a paragraph, trimmed and in order; a text without words may be one too.

    Points of abbreviations, initials and decimals end no sentence, nor does an ellipsis before a small letter.
    """
    kept = text
    for _ in range(2):  # initials in a row share the blank between them
        kept = F.regexp_replace(kept, K.SENTENCE_POINT, "$1$2\u0002")
    parts = F.split(F.regexp_replace(kept, K.SENTENCE_END, "$1\u0001$2"), "\u0001")
    trimmed = F.transform(parts, lambda s: collapse_space(F.replace(s, F.lit("\u0002"), F.lit("."))))
    return F.filter(trimmed, lambda s: s != "")


def accent_fold(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def lemma_id(lemma: Column) -> Column:
    """The global identity of a word: its lemma, trimmed and lower-cased."""
    return F.lower(F.trim(lemma))


def decode_entities(text: Column) -> Column:
    """Character references to characters, in one pass so nothing is decoded twice."""
    named = F.create_map(*[F.lit(v) for n, c in name2codepoint.items() for v in (n, chr(c))])

    def code_point(number: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")

    def one(piece: Column) -> Column:
        body = F.substring(piece, F.lit(2), F.length(piece) - 2)
        return (
            F.when(F.regexp_like(piece, F.lit("^&#[0-9]{1,6};$")),
                   code_point(F.substring(body, F.lit(2), F.length(body)).cast("int")))
            .when(F.regexp_like(piece, F.lit("^&#[xX][0-9a-fA-F]{1,5};$")),
                  F.decode(F.unhex(F.lpad(F.substring(body, F.lit(3), F.length(body)), 8, "0")), "UTF-32"))
            .when(F.regexp_like(piece, F.lit("^&[A-Za-z][A-Za-z0-9]*;$")),
                  F.coalesce(F.try_element_at(named, body), piece))
            .otherwise(piece)
        )

    def decoded(raw: Column) -> Column:
        pieces = F.regexp_extract_all(raw, F.lit("&#?[0-9A-Za-z]+;|[^&]+|&"), F.lit(0))
        return F.array_join(F.transform(pieces, one), "")

    return let(text, lambda raw: F.when(F.contains(raw, F.lit("&")), decoded(raw)).otherwise(raw))


def drop_non_prose(html: Column) -> Column:
    """Remove comments and the subtrees that never hold prose."""
    cleaned = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in K.NON_PROSE_TAGS:
        cleaned = F.regexp_replace(cleaned, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    return cleaned


def strip_tags(html: Column, replacement: str = "") -> Column:
    return F.regexp_replace(html, r"(?s)<[^>]*>", replacement)


def element_text(html: Column) -> Column:
    """Text of a piece of markup, closed up where tags stood, normalised."""
    return normalize_text(decode_entities(strip_tags(html)))


def paragraph_texts(html: Column) -> Column:
    """Array of prose paragraphs: the ``<p>`` texts, or every text block where there are none."""

    def marked(prose: Column) -> Column:
        return F.regexp_replace(
            F.regexp_replace(prose, r"(?i)<p(?:\s[^>]*)?>", "\u0001"), r"(?i)</p\s*>", "\u0002"
        )

    def paragraphs(prose: Column) -> Column:
        found = F.regexp_extract_all(marked(prose), F.lit("\u0001([^\u0001\u0002]*)"), F.lit(1))
        return F.filter(F.transform(found, element_text), lambda t: t != "")

    def blocks(prose: Column) -> Column:
        pieces = F.split(strip_tags(prose, "\n"), "\n")
        return F.filter(F.transform(pieces, lambda t: normalize_text(decode_entities(t))), lambda t: t != "")

    return let(
        drop_non_prose(html),
        lambda prose: let(
            paragraphs(prose), lambda found: F.when(F.size(found) > 0, found).otherwise(blocks(prose))
        ),
    )


_HEADING = r"(?is)<h[1-6](?:\s[^>]*)?>(.*?)</h[1-6]\s*>"


def html_title(html: Column) -> Column:
    """Text of the first heading, null when there is none or it is blank."""
    return F.nullif(element_text(F.regexp_extract(html, _HEADING, 1)), F.lit(""))


def heading_sections(html: Column) -> Column:
    """Array of (title, anchor, html): one section per heading, heading text left out."""
    marked = F.regexp_replace(html, r"(?i)(<h[1-6][\s>])", "\u0001$1")
    pieces = F.split(marked, "\u0001")

    def section(piece: Column, index: Column) -> Column:
        headed = index > 0
        attrs = F.regexp_extract(piece, r"(?is)^<h[1-6]([^>]*)>", 1)
        anchor = F.regexp_extract(attrs, r"""(?i)\sid\s*=\s*["']([^"']*)["']""", 1)
        return F.struct(
            F.when(headed, html_title(piece)).alias("title"),
            F.when(headed, F.nullif(anchor, F.lit(""))).alias("anchor"),
            F.when(headed, F.regexp_replace(piece, r"(?is)^<h[1-6][^>]*>.*?</h[1-6]\s*>", ""))
            .otherwise(piece)
            .alias("html"),
        )

    populated = F.filter(F.transform(pieces, section), lambda s: strip_space(s["html"]) != "")
    whole = F.struct(F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("anchor"),
                     html.alias("html"))
    return let(populated, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(whole)))


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, K.WHITESPACE + "+", "")


def slugify(text: Column) -> Column:
    ascii_only = F.regexp_replace(accent_fold(text), r"[^\x00-\x7f]", "")
    return F.trim(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", "-"), F.lit("-"))


def make_book_id(author: Column, title: Column) -> Column:
    """Last word of the author plus the title; ``libro`` when both come out empty."""
    surname = F.element_at(F.split(collapse_space(author), " "), -1)
    parts = [F.nullif(slugify(F.coalesce(p, F.lit(""))), F.lit("")) for p in (surname, title)]
    return F.coalesce(F.nullif(F.concat_ws("-", *parts), F.lit("")), F.lit("libro"))


def normalize_title(text: Column) -> Column:
    """Display form of a song title used for matching: qualifiers cut, accents kept."""
    stop = "|".join(K.TITLE_STOP_TERMS)
    dashed = F.regexp_replace(F.lower(collapse_space(compatible(text))), "[‐-―−]", "-")
    title = dashed
    for _ in range(2):
        title = F.regexp_replace(title, rf"\s*[(\[](?:{stop})[)\]]\s*$", "")
    title = F.regexp_replace(title, r"(\S)\s+[(\[]?(?:feat\.|ft\.|con )\s*.*$", "$1")
    title = F.regexp_replace(title, rf"\s+-\s+(?:{stop})\s*$", "")
    return collapse_space(title)


def title_key(text: Column) -> Column:
    """Comparison form: as ``normalize_title``, accents folded."""
    return accent_fold(normalize_title(text))


def normalize_artist(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(collapse_space(compatible(text))), "[‐-―−]", "-")
    return collapse_space(F.regexp_replace(dashed, r"(\S)\s+[(\[]?(?:feat\.|ft\.)\s*.*$", "$1"))


def artist_key(text: Column) -> Column:
    return accent_fold(normalize_artist(text))


def line_key(text: Column) -> Column:
    """A lyric line without case, accents, punctuation or spacing differences."""
    return collapse_space(F.regexp_replace(accent_fold(F.lower(text)), r"[^\p{L}\p{N}\s]+", ""))
