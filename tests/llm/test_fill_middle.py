import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectura.llm import fill_middle
from lectura.llm.fill_middle import Units, exchange, rearrange, restore, rotate, rotate_back

DOCS = "doc_id long, text string"


def plain(doc_id, text):
    """The contract, over strings."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.DOTALL)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rows_follow_the_contract_and_come_back(spark):
    rnd = random.Random(5)
    letters = "abcXYZ   \n\t.,0é漢🙂<>PSM"
    rows = [(k, "".join(rnd.choice(letters) for _ in range(rnd.randrange(60)))) for k in range(400)]
    rows += [(500, None), (501, ""), (502, "a<P>b"), (503, "x <S> y"), (504, "<M>"), (None, "no id here"), (None, "no id here"),
             (505, "word " * 300_000 + "é" * 100_000), (7, "same id, other text"), (506, "\x00\x00 zero"), (507, "<<P <S")]
    made = restore(rearrange(spark.createDataFrame(rows, DOCS))).collect()
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in made), key=str) \
        == sorted(((d, *plain(d, t), t or "") for d, t in rows), key=str)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


def test_empty_tables_and_own_columns(spark):
    assert restore(rearrange(spark.createDataFrame([], DOCS))).collect() == []
    own = spark.createDataFrame([(3, "a b c", "x", "y", 9)], "doc_id long, text string, output string, form string, n long")
    got = rearrange(own)
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and got.first()["n"] == 5
    more = got.withColumn("restored", got["n"]).withColumn("other", got["n"])
    back = restore(more)
    assert back.columns == [*got.columns, "other", "restored"] and back.first()["restored"] == "a b c"
    assert restore(spark.createDataFrame([(None, "psm")], "output string, form string")).first()["restored"] is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>PSM é🙂", max_size=40), st.randoms())
def test_rotations_are_inverted(text, rnd):
    if any(s in text for s in ("<P>", "<S>", "<M>")):
        return
    a, b = sorted(rnd.randrange(len(text) + 1) for _ in range(2))
    parts = [p.encode() for p in (text[:a], text[a:b], text[b:])]
    for form in ("psm", "spm"):
        out = rotate(text.encode(), len(parts[0]), len(parts[0]) + len(parts[1]), form)
        order = (b"<P>", parts[0], b"<S>", parts[2], b"<M>", parts[1]) if form == "psm" else (b"<S>", parts[2], b"<P>", parts[0], b"<M>", parts[1])
        assert out == b"".join(order) and rotate_back(out, form) == text.encode()


@pytest.mark.parametrize("scan, swap", [(1, 1), (3, 2), (7, 5)])
def test_blocks_of_any_size(monkeypatch, scan, swap):
    monkeypatch.setattr(fill_middle, "SCAN", scan)
    monkeypatch.setattr(fill_middle, "SWAP", swap)
    text = "ab, çde  f漢g 12 hijkl"
    found, units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), Units(text.encode())
    assert units.n == len(found)
    for k in range(len(found) + 1):
        assert units.byte_of(k) == len("".join(found[:k]).encode())
        assert units.points(0, units.byte_of(k)) == len("".join(found[:k]))
    for begin, cut, end in ((0, 3, 11), (2, 2, 9), (1, 10, 10), (0, 5, 10)):
        buffer = bytearray(b"0123456789AB")
        exchange(buffer, begin, cut, end)
        assert bytes(buffer) == b"0123456789AB"[:begin] + b"0123456789AB"[cut:end] + b"0123456789AB"[begin:cut] + b"0123456789AB"[end:]
