"""Removal of passages that occur earlier, by relative Lempel-Ziv parsing against reference blocks.

The reference is the corpus itself. A document falls into pieces: every window of WINDOW words belongs to the sampled
gram of GRAM words with the least hash in it (its anchor), and the windows of one anchor make a piece. Equal windows have
equal anchors, so the reference blocks are the partitions of the anchors' hash: a piece looked up in its block has met
all of the reference that could give it a factor of WINDOW words, in whichever document.

A document is parsed greedily: a piece that stood earlier as a whole refers to its first place, and the factor goes on as
long as the next piece continues at the same distance in the same document. Where a factor ends, pieces share an anchor
with the reference but not all of their words; there, window by window is looked up. Factors of WINDOW words or more are the
duplicate spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectura.session import stored

from .common import map_rows, whole_text
from .tokens import Remembered

WINDOW = 20  # words; fixed value of the contract
GRAM = 6
WORDS_KEPT = 100_000  # hashes of words that a worker remembers
BUNCH = 1 << 16  # words looked at together

_draw = np.random.default_rng(12)
_odd = lambda *n: _draw.integers(0, 2**64, n, dtype=np.uint64) | np.uint64(1)
GRAM_TURN, PIECE_TURN, WINDOW_TURN, MIX = _odd(64), _odd(256), _odd(2, 128), _odd(1)[0]

_words: list[Remembered] = []


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; two windows are equal if all of their words' hashes are."""
    import xxhash

    if not _words:
        _words.append(Remembered(xxhash.xxh64_intdigest, WORDS_KEPT))
    hashes = np.fromiter(map(_words[0].__getitem__, words), dtype=np.uint64, count=len(words))
    _words[0].tidy()
    return hashes


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def least_at(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value in every run of `width` values."""
    at, held = np.arange(len(values)), 1
    while held < width:
        step = min(held, width - held)
        left, right = at[:-step], at[step:]
        at, held = np.where(values[right] < values[left], right, left), held + step
    return at


def together(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The texts' words in bunches of about BUNCH: number of the first text, hashes one after the other, words per text.

    Arrays of many short texts cost little more than those of one, and stay in the processor's cache."""
    words: list[bytes] = []
    lengths: list[int] = []
    for k, text in enumerate(texts):
        own = text.split()
        words += own
        lengths.append(len(own))
        if len(words) >= BUNCH or k == len(texts) - 1:
            yield k + 1 - len(lengths), word_hashes(words), np.array(lengths)
            words, lengths = [], []


def pieces(hashes: np.ndarray, lengths: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, anchor, piece, start, windows) of the texts with these lengths in a row: hash of the anchor, hash of all words
    of the piece, its first word in the text and how many windows start in it. Every window starts in exactly one piece."""
    n = len(hashes)
    if n < window:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    owner = np.repeat(np.arange(len(lengths)), lengths)
    grams = np.zeros(n - gram + 1, dtype=np.uint64)
    for k in range(gram):
        grams += hashes[k:n - gram + 1 + k] * GRAM_TURN[k]
    grams = mixed(grams)
    at = least_at(grams, window - gram + 1)
    inside = owner[:len(at)] == owner[window - 1:]
    fresh = inside.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    start, ends = np.flatnonzero(fresh), np.append(np.flatnonzero(fresh | ~inside), len(at))
    count = ends[np.searchsorted(ends, start, "right")] - start
    length = count + window - 1
    whole = (at[start] - start).astype(np.uint64) * PIECE_TURN[-1] + count.astype(np.uint64) * PIECE_TURN[-2]
    for k in range(int(length.max(initial=0))):
        own = slice(None) if k < window else np.flatnonzero(length > k)
        whole[own] += hashes[start[own] + k] * PIECE_TURN[k]
    text = owner[start]
    return text, grams[at[start]].view(np.int64), mixed(whole).view(np.int64), start - (np.cumsum(lengths) - lengths)[text], count


def window_hashes(hashes: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Two 64-bit hashes of each window that starts there."""
    out = np.zeros((2, len(starts)), dtype=np.uint64)
    for k in range(window):
        word = hashes[starts + k]
        out[0] += word * WINDOW_TURN[0, k]
        out[1] += word * WINDOW_TURN[1, k]
    return mixed(out).view(np.int64)


def parsed(starts: list[int], windows: list[int], refs: list[int], places: list[int], window: int = WINDOW) -> list[tuple]:
    """Factors (start, length, number of a part that it begins with) of one document, from where its parts, pieces and
    windows, stood first: greedily, each factor goes on as long as the reference does."""
    factors: list[tuple] = []
    begin = end = ref = shift = part = None
    for k in sorted(range(len(starts)), key=starts.__getitem__):
        at = starts[k]
        if begin is not None and refs[k] == ref and places[k] - at == shift and at <= end:
            end = max(end, at + windows[k])
            continue
        if begin is not None:
            factors.append((begin, end - begin + window - 1, part))
        begin, end, ref, shift, part = at, at + windows[k], refs[k], places[k] - at, k
    return factors if begin is None else [*factors, (begin, end - begin + window - 1, part)]


def document_key(docs: DataFrame) -> Column:
    """What names and orders documents: doc_id, and where ids repeat or are missing, the text as well."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n"), F.max(F.col("doc_id").isNull())).first()
    if (ids[0] or 0) <= 1 and not ids[1]:
        return F.struct("doc_id")
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(whole_text(docs)).alias("text_hash"))


def duplicate_parts(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, start, windows, ref.doc, ref.start): parts of the documents `texts` (doc, text as bytes) of which all windows
    start earlier too, and where. Together they hold every such window, each of them once."""
    def cut(texts: list[bytes]) -> dict:
        made = []
        for first, hashes, lengths in together(texts):
            text, *rest = pieces(hashes, lengths, window)
            made.append((text + first, *rest))
        return {name: _joined([m[k] for m in made]) for k, name in enumerate(("at", "anchor", "piece", "start", "windows"))}

    def explode(texts: list[bytes], starts: list[list[int]], windows: list[list[int]]) -> dict:
        made = []
        for first, hashes, lengths in together(texts):
            own = range(first, first + len(lengths))
            begin, count = (np.concatenate([np.array(x[k], dtype=np.int64) for k in own]) for x in (starts, windows))
            text = np.repeat(np.repeat(np.arange(len(lengths)), [len(starts[k]) for k in own]), count)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
            start = np.repeat(begin, count) + nth
            made.append((text + first, start, *window_hashes(hashes, start + (np.cumsum(lengths) - lengths)[text], window)))
        return {name: _joined([m[k] for m in made]) for k, name in enumerate(("at", "start", "h1", "h2"))}

    each = map_rows(texts, cut, "anchor long, piece long, start int, windows int", ["text"], ["doc"])
    # Sides that are aggregated by the key of a join are written first: then both sides come from plain exchanges, and
    # adaptive execution can split a key that very many documents hold.
    shared = stored(each.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    held = stored(each.join(shared, "anchor", "left_semi"), "shared-pieces")
    place = F.struct("doc", "start")
    first = stored(held.groupBy("anchor", "piece", "windows").agg(F.min(place).alias("ref")), "reference")
    whole = held.join(first, ["anchor", "piece", "windows"]).where(place != F.col("ref")).select("doc", "start", "windows", "ref")

    several = stored(first.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "several-pieces")
    ends = first.join(several, "anchor", "left_semi").select("ref.doc", F.struct("ref.start", "windows").alias("run"))
    ends = ends.groupBy("doc").agg(F.collect_list("run").alias("run"))  # of one document, so bounded by its text
    ends = texts.join(ends, "doc").select("doc", "text", F.col("run.start").alias("starts"), F.col("run.windows").alias("windows"))
    single = stored(map_rows(ends, explode, "start int, h1 long, h2 long", ["text", "starts", "windows"], ["doc"]), "windows")
    least = single.groupBy("h1", "h2").agg(F.min(place).alias("ref"), F.count("*").alias("n")).where("n > 1").drop("n")
    parts = single.join(stored(least, "shared-windows"), ["h1", "h2"]).where(place != F.col("ref")).select("doc", "start", F.lit(1).alias("windows"), "ref")
    return whole.unionByName(parts)


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, dtype=np.int64)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and factors, per row of `docs`.

    factors lists the duplicate spans in order: start, length (words), ref_doc_id and ref_start, the place where the words
    stood first. A word is removed if it lies in a span of `window` words or more that starts earlier as well, in a
    document with a smaller doc_id or in the same one; spans are judged on the input. Words are what lies between the
    six white space characters, unchanged. Null text has no words; texts shorter than a window keep all.

    Rows without an id come last. Rows that share an id, or have none, are ordered by a hash of their texts; a row
    repeated as a whole is one document and gets the same result each time. Empty tables give no rows; further columns are
    ignored. Nothing holds more than one document's places; a passage that very many documents share is rows of numbers in joins that
    adaptive execution can split, and aggregations that combine before they shuffle.
    """
    texts = docs.select("doc_id", document_key(docs).alias("doc"), whole_text(docs).cast("binary").alias("text"))
    parts = duplicate_parts(texts.select("doc", "text"), window)
    found = parts.groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "ref")).alias("found")).select(
        F.col("doc").alias("_doc"), F.col("found.start").alias("starts"), F.col("found.windows").alias("windows"),
        F.transform("found", lambda f: F.xxhash64(f["ref"]["doc"])).alias("refs"),
        F.col("found.ref.start").alias("places"), F.col("found.ref.doc.doc_id").alias("ref_ids"))
    kind = f"array<struct<start:int,length:int,ref_doc_id:{docs.schema['doc_id'].dataType.simpleString()},ref_start:int>>"

    def remove(texts: list[bytes], *columns: list[list | None]) -> dict:
        out: dict = {"n_words": [], "n_removed": [], "kept": [], "factors": []}
        for text, starts, windows, refs, places, ids in zip(texts, *columns):
            words = text.split()
            spans = parsed(starts, windows, refs, places, window) if starts else []
            stays, at = [], 0
            for start, length, _ in spans:
                stays += words[at:start]
                at = max(at, start + length)
            stays += words[at:]
            out["n_words"].append(len(words))
            out["n_removed"].append(len(words) - len(stays))
            out["kept"].append(b" ".join(stays))
            out["factors"].append([{"start": s, "length": n, "ref_doc_id": ids[k], "ref_start": places[k]} for s, n, k in spans])
        return out

    both = texts.join(found, texts["doc"] == found["_doc"], "left")
    made = map_rows(both, remove, f"n_words long, n_removed long, kept binary, factors {kind}",
                    ["text", "starts", "windows", "refs", "places", "ref_ids"], ["doc_id"])
    return made.withColumn("kept", F.col("kept").cast("string"))
