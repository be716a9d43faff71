"""Fill-in-the-middle order of documents, made and undone by block rotations in place.

A document is cut at two unit boundaries into prefix, middle and suffix. Sentinels are inserted into a byte array of
the text, two neighbouring blocks change places by three reversals, and the same reversals undo it.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, whole_text

# Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SEED = 1
PLAIN_FROM, SUFFIX_FIRST_BELOW = 90, 20  # of 100

SCAN = 1 << 20  # bytes looked at together
SWAP = 1 << 16  # bytes exchanged together

LETTER = np.zeros(256, dtype=bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = True


class Units:
    """The units `[A-Za-z]+|[^A-Za-z]` of a UTF-8 text: how many there are, and at which byte each one begins."""

    def __init__(self, data: bytes):
        self.bytes = np.frombuffer(data, dtype=np.uint8)
        self.counts = [int(self._starts(k).sum()) for k in range(0, len(data), SCAN)]
        self.n = sum(self.counts)

    def _starts(self, at: int) -> np.ndarray:
        block = self.bytes[at:at + SCAN]
        letter = LETTER[block]
        goes_on = np.empty_like(letter)
        goes_on[1:] = letter[:-1]
        goes_on[:1] = at > 0 and LETTER[self.bytes[at - 1]]
        return np.where(letter, ~goes_on, (block & 0xC0) != 0x80)

    def byte_of(self, unit: int) -> int:
        """The byte at which this unit begins; behind the last unit, the end of the text."""
        for k, count in enumerate(self.counts):
            if unit < count:
                return k * SCAN + int(np.flatnonzero(self._starts(k * SCAN))[unit])
            unit -= count
        return len(self.bytes)

    def points(self, begin: int, end: int) -> int:
        """Code points between two bytes."""
        return sum(int(((self.bytes[k:min(end, k + SCAN)] & 0xC0) != 0x80).sum()) for k in range(begin, end, SCAN))


def reverse(view: np.ndarray, begin: int, end: int) -> None:
    """Turn a block round in place."""
    while end - begin > 1:
        n = min(SWAP, (end - begin) // 2)
        head = view[begin:begin + n].copy()
        view[begin:begin + n] = view[end - n:end][::-1]
        view[end - n:end] = head[::-1]
        begin, end = begin + n, end - n


def exchange(buffer: bytearray, begin: int, cut: int, end: int) -> None:
    """Rotate begin:end so that the block from `cut` on stands first, by three reversals."""
    view = np.frombuffer(buffer, dtype=np.uint8)
    reverse(view, begin, cut)
    reverse(view, cut, end)
    reverse(view, begin, end)


def rotate(text: bytes, first: int, second: int, form: str) -> bytes:
    """`text` cut at these two bytes, in the order of the form."""
    buffer = bytearray(text)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    middle, suffix = len(PREFIX) + first, len(PREFIX) + len(MIDDLE) + second
    exchange(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return bytes(buffer)


def rotate_back(output: bytes, form: str) -> bytes:
    """The text that `rotate` was given, from its result and the form alone."""
    if form == "plain":
        return output
    buffer, end = bytearray(output), len(output)
    begin, cut = (buffer.find(SUFFIX), buffer.find(MIDDLE)) if form == "psm" else (0, buffer.find(PREFIX))
    middle = begin if form == "psm" else buffer.find(MIDDLE) - cut
    suffix = begin + end - cut
    exchange(buffer, begin, cut, end)
    for at, sentinel in ((suffix, SUFFIX), (middle, MIDDLE), (0, PREFIX)):
        del buffer[at:at + len(sentinel)]
    return bytes(buffer)


def draws(doc_id: str | None, seed: int = SEED) -> list[int]:
    """The four numbers that decide what happens to a document."""
    digest = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def rearrange(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output, per row.

    The draws of a document depend on its id and the seed only, so reruns agree and equal rows get equal results; rows
    without an id share their draws. Null text counts as empty. Empty texts and texts that hold a sentinel stay
    plain. Empty tables give no rows; further columns are ignored. Cuts are searched block by block, so that a very long
    text takes a few times its own size.
    """
    def make(ids: list[str | None], texts: list[bytes]) -> dict:
        out: dict = {"n": [], "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
        for doc_id, text in zip(ids, texts):
            units, (h1, h2, h3, h4) = Units(text), draws(doc_id, seed)
            plain = not text or h3 % 100 >= PLAIN_FROM or any(s in text for s in (PREFIX, SUFFIX, MIDDLE))
            form = "plain" if plain else "spm" if h4 % 100 < SUFFIX_FIRST_BELOW else "psm"
            prefix_chars = middle_chars = None
            if not plain:
                first, second = (units.byte_of(u) for u in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
                prefix_chars, middle_chars = units.points(0, first), units.points(first, second)
                text = rotate(text, first, second, form)
            for name, value in zip(out, (units.n, form, prefix_chars, middle_chars, text)):
                out[name].append(value)
        return out

    rows = docs.select("doc_id", F.col("doc_id").cast("string").alias("id"), whole_text(docs).cast("binary").alias("text"))
    made = map_rows(rows, make, "n long, form string, prefix_chars long, middle_chars long, output binary", ["id", "text"], ["doc_id"])
    return made.withColumn("output", F.col("output").cast("string"))


def restore(rows: DataFrame) -> DataFrame:
    """`rows` with the column restored: the text behind each output, from output and form only. Null stays null."""
    def make(outputs: list[bytes | None], forms: list[str]) -> dict:
        return {"restored": [None if o is None else rotate_back(o, f) for o, f in zip(outputs, forms)]}

    rows = rows.drop("restored")
    other = [c for c in rows.columns if c != "output"]
    made = map_rows(rows.withColumn("output", F.col("output").cast("binary")), make, "restored binary", ["output", "form"], [*other, "output"])
    return made.select(*(F.col(c).cast("string").alias(c) if c == "output" else F.col(c) for c in rows.columns), F.col("restored").cast("string").alias("restored"))
