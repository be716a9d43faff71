from collections import Counter, defaultdict
from pathlib import Path

import pytest
from test_exact_dedup import plain as plain_exact
from test_mixing_sharding import filled
from test_near_copies import plain_kept

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def words(text):
    for blank in "\t\n\x0b\x0c\r":
        text = text.replace(blank, " ")
    return len([w for w in text.split(" ") if w])


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")
def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs.collect(), spark.read.parquet(str(tmp_path / str(k)))
        rows[name] = (before, docs.collect())

    before, after = rows["quality classifier"]
    rated = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after}
    good = [d for d, x in rated.items() if x == (1, 0)]
    assert sum(d in kept for d in good) > 0.97 * len(good)
    bad = [d for d, (q, t) in rated.items() if t == 1 or q == 0]
    assert sum(d in kept for d in bad) < 0.1 * len(bad)

    before, after = rows["exact dedup"]
    want = {k for _, k, *_ in plain_exact([(r["doc_id"], r["text"]) for r in before])}
    assert sorted(r["doc_id"] for r in after) == sorted(want)
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}

    before, after = rows["near dedup"]
    assert sorted(r["doc_id"] for r in after) == plain_kept([(r["doc_id"], r["text"], None) for r in before])

    before, after = rows["mixing"]
    copies, sizes, taken = Counter(r["doc_id"] for r in after), Counter(), Counter()
    longest = defaultdict(int)
    for r in before:
        n = words(r["text"] or "")
        sizes[r["source"]] += n
        taken[r["source"]] += n * copies[r["doc_id"]]
        longest[r["source"]] = max(longest[r["source"]], n)
    assert max(copies.values()) <= 3
    for source, target in filled(sizes).items():
        assert abs(taken[source] - target) <= longest[source] / 2 + 1

    before, after = rows["packing"]
    assert Counter(r["doc_id"] for r in after if r["start"] == 0) == Counter(r["doc_id"] for r in before)
    once = [r for r in before if copies[r["doc_id"]] == 1]
    assert sum(r["length"] for r in after) == sum(r["doc_tokens"] for r in after if r["start"] == 0)
    assert once and check_sequences(after)


def check_sequences(pieces):
    by_sequence = defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    return True


def test_empty_table_and_nulls(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for name, rows in (("none", []), ("odd", [(1, None, None, None, None), (2, "", "en", None, 0), (3, None, None, "a", 1), (None, "x y z", None, None, 5)])):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(corpus_pipeline.run(spark, str(tmp_path / name)).columns)
        assert rows or not got
