"""A few registered queries against their SQL; ``tools/check_queries.py`` runs all of them."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_queries import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not here")
@pytest.mark.parametrize("name", [
    "p2_html_to_paragraphs", "t1_tokenize", "v2_build_lexicon", "c8_split_segments", "g4_chapter_list",
    "d3_replay_reviews_continued", "e2_replay_sessions_streamed", "x5_score_matches", "w5_stream_sittings", "w1_stream_card_state",
])
def test_query_matches_its_sql(spark, name):
    assert compare(spark, connect(SF), name, SF).startswith("ok")
