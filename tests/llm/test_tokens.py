import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lectura.llm.tokens import Encoder

KINDS = {"byte_bpe_50k.json": False, "word_bpe_49k.json": True}
PAIRS = {n: (Encoder(public_tokenizers.path(n), low), Tokenizer.from_file(public_tokenizers.path(n))) for n, low in KINDS.items()}
ODD = ["", " ", "  a", "a  b", "a \nb", "a\n b\t", "a\n\n  b ", "it's I'LL 's ' s", "12 345,6", "naïve É İ ı ſ ß ǅ", "Σίσυφος ΣΑΣ", "日本 語", "é é",
       "\xa0a\xa0b \x85", "a\x1cb \x1f c", "<|endoftext|> <|startoftext|>", "🙂 a🙂b", "a­b ªº ²³", "\x00 \x7f", "d'’s …", "x" * 9000, "A B " * 3000]


@pytest.mark.parametrize("name", KINDS)
def test_same_ids_as_the_tokenizer(name):
    mine, theirs = PAIRS[name]
    texts = ODD + [t for (t,) in duckdb.execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' LIMIT 150").fetchall() if t]
    for text in texts:
        assert np.frombuffer(mine.encode_bytes(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, text[:60]


@pytest.mark.parametrize("name", KINDS)
@settings(max_examples=400, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.characters(max_codepoint=0x250, exclude_categories=["Cs"]), st.sampled_from(" \n'sS12.-’…|<"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_on_any_text(name, text):
    mine, theirs = PAIRS[name]
    assert np.frombuffer(mine.encode_bytes(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_forgetting_changes_nothing():
    mine, theirs = PAIRS["byte_bpe_50k.json"]
    small = Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    small.units.limit = small.pieces.limit = 3
    for text in ("one two three four five", "five four six seven one", "two two nine ten eleven"):
        assert np.frombuffer(small.encode_bytes(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_a_worker_remembers_no_more_than_half_a_million_words_and_pieces():
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"), False)
    for first in range(0, 800_000, 20_000):
        encode.encode_bytes(" ".join(f"a{k}" for k in range(first, first + 20_000)))
    assert sum(len(kept) + len(kept.older) for kept in (encode.units, encode.pieces)) < 560_000
