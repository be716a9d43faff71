import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectura.llm.mixing import mix_documents, repeat_documents, sized, source_targets
from lectura.llm.sharding import place, shard_documents

DOCS = "doc_id long, text string, source string, size string, slot int"


def filled(sizes, weights=(5, 2, 1), most=3):
    """Targets by clamping and resharing until none is above; sizes in code-point order, null last."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    clamped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in clamped)
        total = sum(weight[s] for s in names if s not in clamped)
        share = {s: weight[s] * (left / total) for s in names if s not in clamped}
        above = {s for s, x in share.items() if x > most * sizes[s]}
        if not above:
            return {s: float(most * sizes[s]) if s in clamped else share[s] for s in names}
        clamped |= above


@pytest.mark.parametrize("seed", range(6))
def test_water_filling(spark, seed):
    rnd = random.Random(seed)
    sizes = {s: rnd.choice([0, 1, rnd.randint(1, 50), rnd.randint(1, 5000)]) for s in ["b", "a", "ä", "Z", "", None, "𝄞", "ﬁ"][: rnd.randint(1, 8)]}
    got = {r["source"]: r["target"] for r in source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    if sum(sizes.values()):
        assert got == pytest.approx(filled(sizes))
    else:
        assert set(got.values()) == {0.0}


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(k, " ".join(["w"] * rnd.randint(0, 400)), rnd.choice(["big"] * 12 + ["mid", "mid", "small", None, "ö"]), "x", 1) for k in range(1500)]
    rows += [(2000, None, "mid", "", 0), (2001, "one\x0btwo\tthree", None, None, None), (None, "no id here", "lonely", "", 0), (2005, "same", "mid", "", 0), (2005, "same", "mid", "", 0)]
    rows += [(3000, "long " * 50_000, "huge", "", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    got = mix_documents(frame).collect()
    assert len(got) == len(rows)
    source = {(r[0]): r[2] for r in rows}
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        s = source[r["doc_id"]]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        targets[s] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"] and abs(r["copies"] * r["size"] - r["taken"]) <= r["size"] / 2
    assert all(r["source_size"] == sizes[source[r["doc_id"]]] for r in got)
    assert targets == pytest.approx(filled(sizes))
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mix_documents(frame.repartition(5)).collect()))
    repeated = repeat_documents(frame)
    assert repeated.columns == frame.columns
    assert {tuple(r) for r in repeated.collect()} <= set(rows)
    assert Counter(r["doc_id"] for r in repeated.collect()) == +sum((Counter({r["doc_id"]: r["copies"]}) for r in got), Counter())


def test_mix_of_nothing(spark):
    assert mix_documents(spark.createDataFrame([], DOCS)).count() == 0
    got = mix_documents(spark.createDataFrame([(1, "", "a", "", 0), (2, None, None, "", 0)], DOCS)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
    assert set(sized(spark.createDataFrame([(1, " a\xa0b  c ", "a", "", 0)], DOCS)).select("size").first()) == {2}


def test_placing_balances_all_dimensions():
    rng = np.random.default_rng(1)
    items = rng.lognormal(0, 1, (3000, 1)) * rng.uniform(0.7, 1.4, (3000, 3))
    items /= items.sum(axis=0)
    where = place(items, 8)
    loads = np.array([items[where == k].sum(axis=0) for k in range(8)]) * 8
    assert np.abs(loads[:, 0] - 1).max() < 0.002 and np.abs(loads - 1).max() < 0.05
    assert set(place(np.full((4, 3), 0.25), 8)) <= set(range(8)) and len(place(np.zeros((0, 3)), 8)) == 0


def test_shards(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["a", "été", "longer-word"]) for _ in range(int(rnd.expovariate(1 / 80)))) for _ in range(900)]
    rows = [(k, rnd.choice(texts), "s", "x", 1) for k in range(2500)] + [(5000 + k, "copied text", "s", None, 1) for k in range(250)]
    rows += [(9000, None, None, None, None), (9001, "", "", "", 0), (None, "no id", "", "", 0), (9002, "very long " * 3000, "", "", 0), (9007, texts[0], "", "", 0), (9007, texts[0], "", "", 0)]
    frame = spark.createDataFrame(rows, DOCS)
    got = shard_documents(frame).collect()
    assert len(got) == len(rows)
    text, shard_of, slots, sizes = {r[0]: r[1] or "" for r in rows}, {}, defaultdict(list), Counter()
    for r in got:
        t = text[r["doc_id"]]
        assert (r["size"], r["text_crc32"]) == (len(t.encode()) + 1, zlib.crc32(t.encode()))
        assert shard_of.setdefault(t, r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert sorted(slots) == list(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    again = shard_documents(frame.repartition(7)).collect()
    assert sorted((r["doc_id"] or -1, r["shard"], r["size"]) for r in got) == sorted((r["doc_id"] or -1, r["shard"], r["size"]) for r in again)


def test_a_group_larger_than_a_shard_stays_whole(spark):
    rows = [(k, "the same long text here", "", "", 0) for k in range(300)] + [(1000 + k, f"other {k} text", "", "", 0) for k in range(200)]
    got = shard_documents(spark.createDataFrame(rows, DOCS)).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 300}) == 1
    rest = Counter(r["shard"] for r in got if r["doc_id"] >= 1000)
    assert len(rest) == 7 and max(rest.values()) - min(rest.values()) <= 2
    assert shard_documents(spark.createDataFrame([], DOCS)).count() == 0
