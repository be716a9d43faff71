import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectura.llm.token_files import TokenFile, encode_documents, encode_file, read_documents, write_files

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, start long, n_tokens string"


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
@pytest.mark.parametrize("top", [1, 2, 300, 49_408, 2**32])
def test_round_trip(n, top):
    rng = np.random.default_rng(n + top)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[::37] = top - 1
    file = TokenFile(encode_file(ids, [5, None, -3], [n, 0, 0]))
    assert np.array_equal(file.ids(), ids)
    assert file.doc_ids == [5, None, -3] and file.n_tokens.tolist() == [n, 0, 0]
    for start, stop in ((0, 1), (n // 2, n), (1000, 1030), (n, n + 5), (3, 2)):
        assert np.array_equal(file.ids(start, stop), ids[start:stop])


def test_outliers_do_not_widen_a_block():
    small = np.tile(np.arange(8, dtype=np.uint32), 1024)
    spiked = small.copy()
    spiked[::100] = 49_000
    assert len(encode_file(spiked, [1], [len(small)])) < len(encode_file(small, [1], [len(small)])) + 6 * 82 + 1


def plain(rows):
    tokenizer, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_come_back(spark):
    rows = [(2**53 + 1, "big id", 1, "x"), (7, None, 2, None), (3, "", None, "y"), (-4, "Minus four\n\ttwo", 3, "z"),
            (1, "long text " * 20_000, 0, ""), (None, "no id", 9, "q")] + [(100 + k, f"text number {k}", 0, "") for k in range(300)]
    got = encode_documents(spark.createDataFrame(rows, DOCS).repartition(7), PATH).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == plain(rows)
    files = write_files(spark.createDataFrame(rows, DOCS), PATH, file_ids=500)
    assert files.count() > 4
    assert sorted(map(tuple, read_documents(files).collect()), key=lambda r: r[1]) == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "same", 0, ""), (5, "same", 0, ""), (5, "other words here", 0, ""), (2, "a", 0, "")]
    got = sorted(map(tuple, encode_documents(spark.createDataFrame(rows, DOCS), PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [2, 5, 5, 5] and [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    assert sorted((r[0], r[2], r[3]) for r in got) == sorted((r[0], r[2], r[3]) for r in plain(rows))
    assert encode_documents(spark.createDataFrame([], DOCS), PATH).count() == 0
