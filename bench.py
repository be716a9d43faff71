"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lectura.plans.all_queries import QUERIES  # noqa: E402
from lectura.session import local_session  # noqa: E402

HEADLINE = (
    "t1_tokenize", "v1_chapter_vocabulary", "v2_build_lexicon", "p9_assemble_chapters", "c4_select_teach_set",
    "c8_split_segments", "g4_chapter_list", "g7_seed_sweep", "r7_stratified_sample", "d3_replay_reviews",
    "e2_replay_sessions", "x5_score_matches", "x8_language_gate", "x12_song_vocabulary", "l12_diagnostics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "lectura-bench")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
