import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectura.llm.packing import pack_documents, shortest_pack_first, slots

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, offset string, length int, rank int"


def padding(fills):
    return sum(2048 - f for f in fills if f & (f - 1))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 2048), st.integers(1, 300), max_size=40))
def test_patterns_hold_every_piece_once(histogram):
    patterns = shortest_pack_first(histogram)
    used = Counter()
    for packs, held in patterns:
        assert packs > 0 and sum(n * k for n, k in held) <= 2048
        for n, k in held:
            used[n] += packs * k
    assert used == Counter(histogram)
    places = set()
    for length, first, each, sequence, offset in slots(patterns).tolist():
        rank = first
        while rank < histogram[length] and rank < first + each * next(p for p, s in _firsts(patterns) if s == sequence):
            pack, nth = divmod(rank - first, each)
            places.add((length, rank, sequence + pack, offset + nth * length))
            rank += 1
    assert {(n, r) for n, r, *_ in places} == {(n, r) for n, k in histogram.items() for r in range(k)}
    assert len({(s, o) for *_, s, o in places}) == len(places) == sum(histogram.values())


def _firsts(patterns):
    first = 0
    for packs, _ in patterns:
        yield packs, first
        first += packs


def test_same_packs_as_placing_pieces_one_by_one():
    """Worst fit, longest first, by the piece: fills of the packs agree with the histogram's."""
    rnd = random.Random(2)
    for _ in range(20):
        lengths = sorted((rnd.choice([rnd.randint(1, 300), rnd.randint(1, 2048)]) for _ in range(300)), reverse=True)
        rooms = []
        for n in lengths:
            best = max((k for k in range(len(rooms)) if rooms[k] >= n), key=lambda k: rooms[k], default=None)
            if best is None:
                rooms.append(2048 - n)
            else:
                rooms[best] -= n
        got = Counter()
        for packs, held in shortest_pack_first(dict(Counter(lengths))):
            got[2048 - sum(n * k for n, k in held)] += packs
        assert got == Counter(rooms)


def check(rows, got):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and 0 < r["length"] <= 2048
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    fills = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        fills.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return padding(fills) / sum(fills)


def test_documents(spark):
    rnd = random.Random(4)
    words = ["the", "Zug", "été", "12", "x,y", "\n", "naïve", "ﬁ"]
    rows = [(k, " ".join(rnd.choice(words) for _ in range(int(rnd.expovariate(1 / 300)))), "a", 1, None) for k in range(400)]
    rows += [(1000, None, None, None, None), (1001, "", "b", 0, 2), (2**53 + 1, "word " * 9000, "c", 1, 1), (None, "no id", "d", 1, 1)]
    got = pack_documents(spark.createDataFrame(rows, DOCS), PATH).collect()
    assert check(rows, got) < 0.02


def test_repeated_rows_one_length_and_empty_table(spark):
    rows = [(7, "same words again", "", 0, 0)] * 500
    got = pack_documents(spark.createDataFrame(rows, DOCS), PATH).collect()
    assert len(got) == 500 and len({(r["sequence_id"], r["offset"]) for r in got}) == 500
    assert pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
