"""Shortest-pack-first packing over the length histogram.

Documents are cut into pieces of at most one sequence. Only the histogram of piece lengths is packed: from the longest
length down, pieces go to the pack that has the most room left among those they fit, many equal packs at a time. The
resulting patterns are laid over the pieces by rank among pieces of equal length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectura.session import stored

from .common import map_rows, numbered, whole_text
from .tokens import encoder

SEQUENCE = 2048
END = (1).to_bytes(4, "little")
ROWS_PER_PART = 200_000

PIECES = "start long, length long, ids_crc32 long, doc_tokens long"
# A pattern: how many packs share it, and (length, pieces of that length) in the order in which they were placed.
Pattern = tuple[int, tuple[tuple[int, int], ...]]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: each document with its end id, cut every `sequence` ids."""
    def cut(texts: list[str]) -> dict:
        encode = encoder(path, lower=False).encode_bytes
        made = []
        for k, text in enumerate(texts):
            ids = encode(text) + END
            n = len(ids) // 4
            made += [(k, s, min(sequence, n - s), zlib.crc32(ids[4 * s:4 * (s + sequence)]), n) for s in range(0, n, sequence)]
        return dict(zip(("at", "start", "length", "ids_crc32", "doc_tokens"), zip(*made))) if made else dict.fromkeys(
            ("at", "start", "length", "ids_crc32", "doc_tokens"), ())

    texts = docs.select("doc_id", whole_text(docs).alias("text"))
    return stored(map_rows(texts, cut, PIECES, ["text"], ["doc_id"]), "pieces")


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[Pattern]:
    """Patterns for a histogram {length: pieces}; every piece is in exactly one pack of one pattern.

    open_packs holds patterns by room left. Of each length, pieces go one each to the packs with the most room; what
    fits nowhere opens new packs.
    """
    open_packs: dict[int, list[Pattern]] = defaultdict(list)
    done: list[Pattern] = []
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r, packs in open_packs.items() if packs and r >= length), default=None)
            if room is None:
                # A new pack is the shortest of all, so it takes pieces until it is full; the rest makes one more.
                each = sequence // length
                full, some = divmod(left, each)
                for packs, n in ((full, each), (1, some)):
                    if packs and n:
                        _put(open_packs, done, sequence - n * length, (packs, ((length, n),)))
                left = 0
                continue
            packs, held = open_packs[room].pop()
            used = min(packs, left)
            if used < packs:
                open_packs[room].append((packs - used, held))
            _put(open_packs, done, room - length, (used, _with(held, length)))
            left -= used
    return done + [p for packs in open_packs.values() for p in packs]


def _with(held: tuple[tuple[int, int], ...], length: int) -> tuple[tuple[int, int], ...]:
    if held[-1][0] == length:
        return (*held[:-1], (length, held[-1][1] + 1))
    return (*held, (length, 1))


def _put(open_packs, done, room: int, pattern: Pattern) -> None:
    if room:
        open_packs[room].append(pattern)
    else:
        done.append(pattern)


def slots(patterns: list[Pattern]) -> np.ndarray:
    """Rows (length, first rank, pieces a pack, first sequence, offset), sorted by length and rank.

    Pieces of a length get their places in the order of their ranks, pattern after pattern. A pack holds at most 63
    different lengths (1 + 2 + ... + 64 is over 2,048) and the histogram bounds the patterns, so the table stays small
    however many documents there are.
    """
    rows, used, first = [], defaultdict(int), 0
    for packs, held in patterns:
        offset = 0
        for length, n in held:
            rows.append((length, used[length], n, first, offset))
            used[length] += packs * n
            offset += length * n
        first += packs
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(ranked: DataFrame, table: np.ndarray) -> DataFrame:
    """Add sequence_id and offset to pieces that carry their `rank` among pieces of equal length."""
    shift = 1 << 48
    keys = table[:, 0] * shift + table[:, 1]

    def look_up(length: list[int], rank: list[int]) -> dict:
        lengths, ranks = np.array(length, dtype=np.int64), np.array(rank, dtype=np.int64)
        slot = table[np.searchsorted(keys, lengths * shift + ranks, side="right") - 1]
        pack, nth = np.divmod(ranks - slot[:, 1], slot[:, 2])
        return {"sequence_id": slot[:, 3] + pack, "offset": slot[:, 4] + nth * lengths}

    keep = [c for c in ranked.columns if c != "rank"]
    return map_rows(ranked, look_up, "sequence_id long, offset long", ["length", "rank"], keep)


def pack_documents(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null text counts as empty, so every row of `docs` has at least one piece, of its end id. Repeated rows are packed
    each on their own; a null doc_id is kept. An empty table gives no rows; further columns are ignored. The
    histogram, of at most `sequence` lengths, is all that reaches the driver, and the table of slots made from it is
    all that the tasks get. A length that very many pieces share is ranked in parts.
    """
    cut = pieces(docs, path, sequence)
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    patterns = shortest_pack_first(histogram, sequence)
    parts = max(64, sum(histogram.values()) // ROWS_PER_PART)
    ranked = numbered(cut, "length", ["doc_id", "start", "ids_crc32"], "rank", "doc_id", parts)
    return place(ranked, slots(patterns))
