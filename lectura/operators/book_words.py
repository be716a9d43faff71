"""Words of whole books, counted from their texts without a row per chapter and word."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import deal_in_order, ship

ENTRY = ("book_id", "lemma", "pos")
WORDS_TOGETHER, ROWS_A_BATCH = 1 << 18, 1 << 16


def book_entries(texts: DataFrame, forms: Mapping[str, tuple[str, str]], parts: int | None = None) -> DataFrame:
    """(book_id, lemma, pos, book_count, first_chapter, chapters) of ``texts(book_id, chapter_index, text)``, names too.

    The sums over the chapters of ``vocab.count_forms``, with the number of ``chapters`` that hold an entry. Texts are dealt
    out in the order of book and chapter, so a task sees a chapter whole and few books, and what leaves it is a row per book
    and word. ``forms`` gives lemma and part of speech of listed forms and goes to every task; a dictionary that is too large
    for that, or has a form twice, needs ``count_forms``. ``parts`` as in ``session.deal``.
    """
    ship(texts.sparkSession)
    dealt = deal_in_order(texts.select("book_id", "chapter_index", "text"), ("book_id", "chapter_index"), parts)
    kinds, listed = dict(texts.dtypes), dict(forms)
    schema = f"book_id {kinds['book_id']}, lemma string, pos string, book_count long, first_chapter {kinds['chapter_index']}, chapters long"
    return dealt.mapInArrow(lambda batches: count_entries(batches, listed), schema).groupBy(*ENTRY).agg(
        F.sum("book_count").alias("book_count"), F.min("first_chapter").alias("first_chapter"), F.sum("chapters").alias("chapters"))


def count_entries(batches: Iterable[pa.RecordBatch], forms: Mapping[str, tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """``book_entries`` of the texts of one task. Words become numbers as they are found; only different ones are looked at."""
    texts, types = defaultdict(list), None
    for batch in batches:
        types = [batch.schema.field(i).type for i in (0, 1)]
        for book, chapter, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if text:
                texts[book, chapter].append(text)
    places = sorted(texts, key=lambda p: (p[0] is None, p[0] or "", p[1] is None, p[1] or 0))
    words, opens, lengths = _words_of([texts.pop(place) for place in places])
    if not len(words):
        return
    encoded = words.dictionary_encode()  # one dictionary for all chunks
    codes = np.concatenate([c.indices.to_numpy() for c in encoded.chunks])
    entries, inside, opening = _entries_of(encoded.chunk(0).dictionary.to_numpy(zero_copy_only=False).tolist(), forms)
    at = inside[codes]
    at[opens] = opening[codes[opens]]
    all_at, times = np.unique(np.repeat(np.arange(len(places)), lengths) * len(entries) + at, return_counts=True)
    books = list(dict.fromkeys(book for book, _ in places))
    number = {book: i for i, book in enumerate(books)}
    chapter, entry = np.divmod(all_at, len(entries))
    rows, row = np.unique(np.array([number[book] for book, _ in places])[chapter] * len(entries) + entry, return_inverse=True)
    first = np.empty(len(rows), dtype=np.int64)
    first[row[::-1]] = chapter[::-1]  # the last one written stays, and nulls are sorted last
    n, held = np.bincount(row, weights=times).astype(np.int64), np.bincount(row)
    lemmas, kinds = (pa.array(c, pa.string()) for c in zip(*entries))
    book_ids, chapter_ids = pa.array(books, types[0]), pa.array([c for _, c in places], types[1])
    for i in range(0, len(rows), ROWS_A_BATCH):
        some = slice(i, i + ROWS_A_BATCH)
        of = rows[some] % len(entries)
        yield pa.RecordBatch.from_arrays(
            [book_ids.take(pa.array(rows[some] // len(entries))), lemmas.take(pa.array(of)), kinds.take(pa.array(of)), pa.array(n[some]),
             chapter_ids.take(pa.array(first[some])), pa.array(held[some])],
            names=["book_id", "lemma", "pos", "book_count", "first_chapter", "chapters"])


def _words_of(chapters: Iterable[Sequence[str]]) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray]:
    """The words of all chapters in order, the places of those that open a line, and how many words each chapter has."""
    chunks, opens, lengths, words, before = [], [], [], [], 0
    for texts in chapters:
        start = before + len(words)
        for text in texts:
            find = _word_pattern(_is_wide(text)).findall
            for line in text.split("\n"):
                found = find(line)
                if found:
                    opens.append(before + len(words))
                    words += found
            if len(words) >= WORDS_TOGETHER:
                chunks.append(pa.array(words, pa.string()))
                before += len(words)
                words = []
        lengths.append(before + len(words) - start)
    chunks.append(pa.array(words, pa.string()))
    return pa.chunked_array(chunks), np.array(opens, dtype=np.int64), np.array(lengths, dtype=np.int64)


def _entries_of(words: Sequence[str], forms: Mapping[str, tuple[str, str]]) -> tuple[list[tuple[str, str]], np.ndarray, np.ndarray]:
    """(entries, the number of the entry of each word inside a line, of each word that opens one)."""
    numbers: dict[tuple[str, str], int] = {}
    opening, inside = [], []
    for word in words:
        lower = word.lower()
        entry = forms.get(lower)
        number = numbers.setdefault(entry or (lower, "NOUN"), len(numbers))
        opening.append(number)
        if entry is None and not word.islower() and unicodedata.category(word[0]) == "Lu":
            number = numbers.setdefault((lower, "PROPN"), len(numbers))
        inside.append(number)
    return list(numbers), np.array(inside, dtype=np.int64), np.array(opening, dtype=np.int64)


def _is_wide(text: str) -> bool:
    """Whether a text has characters beyond the first 65,536, whose letters would make the pattern slow for all others."""
    return not text.isascii() and len(text.encode("utf-16-le")) > 2 * len(text)


@cache
def _word_pattern(wide: bool) -> re.Pattern:
    r"""``\p{L}[\p{L}\p{M}]*``, which ``re`` does not know by name."""
    kinds = [unicodedata.category(chr(i))[0] for i in range((sys.maxunicode if wide else 0xFFFF) + 1)]
    return re.compile(f"[{_ranges(kinds, 'L')}][{_ranges(kinds, 'LM')}]*")


def _ranges(kinds: Sequence[str], wanted: str) -> str:
    bounds, previous = [], False
    for i, kind in enumerate([*kinds, ""]):
        if (kind in wanted and kind != "") != previous:
            previous = not previous
            bounds.append(i)
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in zip(bounds[::2], bounds[1::2]))
