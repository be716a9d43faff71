import hashlib
import random

from lectura.llm import exact_dedup
from lectura.llm.exact_dedup import MAX_CHUNK, MIN_CHUNK, exact_groups, keep_one_of_each, verified_seed

DOCS = "doc_id long, text string, recipe string, chunk string, kept boolean"


def plain(rows):
    """(doc_id, keep_id, group_size, text_sha256) by comparing whole texts."""
    groups = {}
    for doc_id, text, *_ in rows:
        clean = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(clean, []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted(((d, min(g)[3], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for *_, d in g), key=str)


def test_groups_match_whole_texts(spark):
    rnd = random.Random(6)
    texts = ["", " \n", "a b", "ab", "a\tb  ", "a\xa0b", "ſ", "é", "é", "x" * (3 * MAX_CHUNK), "x" * (3 * MAX_CHUNK + 1)]
    long = "".join(rnd.choice("dinsx etaol\n") for _ in range(60_000))
    texts += [long, long + "!", "!" + long, long[:30_000] + "?" + long[30_001:], long.replace("\n", " \n "), long[: MIN_CHUNK]]
    rows = [(k, t, "r", None, False) for k, t in enumerate(texts * 3)] + [(500, None, None, "c", None), (None, "ab", "", "", None), (3, "a b", "", "", True)]
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, DOCS)
    got = exact_groups(frame).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == plain(rows)
    by_sha = {}
    for r in got:
        by_sha.setdefault(r["text_sha256"], []).append(r)
    for rs in by_sha.values():
        kept = [r for r in rs if r["kept"]]
        assert len(kept) == 1 and kept[0]["doc_id"] == kept[0]["keep_id"] and kept[0]["n_points"] == max(r["n_points"] for r in rs)
    kept = keep_one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((r["keep_id"] for rs in by_sha.values() for r in rs[:1]), key=str)


def test_wholly_repeated_rows_leave_one(spark):
    frame = spark.createDataFrame([(1, "same text", "", "", None)] * 5 + [(2, "other", "", "", None)], DOCS)
    assert sorted(r["doc_id"] for r in keep_one_of_each(frame).collect()) == [1, 2]
    assert sum(r["kept"] for r in exact_groups(frame).collect()) == 2


def test_shared_identifiers_are_found(spark, monkeypatch):
    from pyspark.sql import functions as F
    sound = exact_dedup.chunk_id
    monkeypatch.setattr(exact_dedup, "chunk_id", lambda c, seed: F.array(F.lit(0), F.lit(0)) if seed < 2 else sound(c, seed))
    frame = spark.createDataFrame([("a",), ("b",), ("a",)], "chunk string")
    assert verified_seed(frame) == 2
    assert len({r["keep_id"] for r in exact_groups(spark.createDataFrame([(1, "p", "", "", None), (2, "q", "", "", None)], DOCS)).collect()}) == 2


def test_empty_table_and_plan_without_python(spark):
    assert exact_groups(spark.createDataFrame([], DOCS)).count() == 0
    plan = exact_groups(spark.createDataFrame([(1, "a", "", "", None)], DOCS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
