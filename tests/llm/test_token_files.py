import os
import re
import tempfile
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tenura.llm import token_files
from tenura.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("byte_bpe_50k.json")
DATA = os.environ.get("TENURA_TEST_DATA", "/root/testdata/sf0.001")


def by_hand(texts, path=MODEL):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    return [[*(model.encode(t, add_special_tokens=False).ids if t else []), 2] for t in texts]


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def fresh():
    return os.path.join(tempfile.mkdtemp(prefix="token-files-"), "out")


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 40_000])
@pytest.mark.parametrize("above", [1, 2, 50_257, 2**32])
@pytest.mark.parametrize("percentile", [1, 90, 100])
def test_segments_round_trip(n, above, percentile):
    rng = np.random.default_rng(n + above)
    ids = (rng.integers(0, above, n) // rng.choice([1, 1000], n)).astype(np.uint32)
    ids[2::50] = above - 1
    data = token_files.encode_segment(ids, percentile)
    assert token_files.segment_size(data) == n
    assert np.array_equal(token_files.decode_segment(data), ids)
    for a, b in ((0, 5), (100, 130), (127, 129), (900, 5000), (7, 7)):
        assert np.array_equal(token_files.decode_segment(data, a, b), ids[a:b])


def test_width_is_the_percentile_and_the_rest_are_exceptions():
    ids = np.full(128, 100, np.uint32)
    ids[:12] = 1 << 20  # a tenth, less than that
    words = np.frombuffer(token_files.encode_segment(ids + np.arange(128, dtype=np.uint32) % 8, 90), "<u4")
    head = int(words[token_files.HEADER + 1 + 1])
    assert (head & 0xFF, head >> 8) == (3, 12)


def test_only_segments_are_read():
    with pytest.raises(ValueError):
        token_files.segment_size(b"\0" * 12)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_give_the_ids_of_whole_texts(name):
    texts = [
        "", None, " ", "  ", "a", " a", "a  b   c\n d\t e  ", "é  à x's 's'S  'll 12 34 \n", "Foo bar, foo. Bar;foo",
        "foo <|endoftext|> bar", "日本 語 ʰa a ʰ", "\x1c a\x85b  c    d", "x" * 5000, "ab " * 3000, "ſ ß ſtraße",
    ]
    path = public_tokenizers.path(name)
    encoder = token_files.Encoder(path)
    for _ in range(2):  # from what is remembered too
        ids, lengths = encoder.encode(texts, 2)
        expected = by_hand(texts, path)
        assert lengths.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [i for x in expected for i in x]


def test_documents_in_order(spark, odd_docs):
    path = fresh()
    token_files.write(odd_docs.repartition(5, "n", "text"), path, MODEL)
    rows = token_files.read(spark, path).orderBy("start").collect()
    docs = odd_docs.collect()
    expected = zip((r.doc_id or -1 for r in docs), by_hand([r.text for r in docs]), strict=True)
    assert sorted((r.doc_id or -1, r.ids) for r in rows) == sorted(expected)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda x: (x is not None, x))
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), checksum(r.ids))
        at += r.n_tokens


def test_segments_end_with_documents_and_ranges_are_cut_out(spark, make_docs, monkeypatch):
    monkeypatch.setattr(token_files, "BYTES_PER_TASK", 20_000)
    texts = [f"word number {i} of the text, again {i % 7}. " * (i % 40) for i in range(400)]
    path = fresh()
    token_files.write(make_docs(texts), path, MODEL)
    rows = token_files.read(spark, path).orderBy("start").collect()
    flat = [i for x in by_hand(texts) for i in x]
    assert [r.doc_id for r in rows] == list(range(400))
    assert [i for r in rows for i in r.ids] == flat
    assert token_files.segments(spark, path).select("part").distinct().count() > 10
    for a, b in ((0, 10), (5000, 20_011), (len(flat) - 3, len(flat) + 9), (7, 7)):
        parts = token_files.read_range(spark, path, a, b).orderBy("start").collect()
        assert [i for p in parts for i in p.ids] == flat[a:b]


def test_one_id_on_all_rows_is_split(spark, make_docs, monkeypatch):
    monkeypatch.setattr(token_files, "BYTES_PER_TASK", 20_000)
    docs = make_docs(["the same text in every row of it " * 10] * 1000).selectExpr("1L AS doc_id", "text")
    path = fresh()
    token_files.write(docs, path, MODEL)
    assert token_files.segments(spark, path).select("part").distinct().count() > 5
    assert token_files.read(spark, path, with_ids=False).count() == 1000


def test_empty_table(spark, no_docs):
    path = fresh()
    token_files.write(no_docs, path, MODEL)
    assert token_files.read(spark, path).count() == 0
    assert token_files.read_range(spark, path, 0, 10).count() == 0


def test_query_against_whole_texts(spark):
    got = {r.doc_id: r for r in QUERIES["op11_token_files"](spark, DATA).collect()}
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda r: r.doc_id)
    at = 0
    for r, ids in zip(docs, by_hand([r.text for r in docs]), strict=True):
        own = got.pop(r.doc_id)
        assert (own.start, own.n_tokens, own.ids_crc32) == (at, len(ids), checksum(ids))
        at += len(ids)
    assert not got


def test_units_are_cut_in_arrow_before_blank_and_letter():
    encoder = token_files.Encoder(MODEL)
    letters = [chr(c) for c in [*range(1, 0x260), 0x3B1, 0x65E5, 0x1F600] if chr(c) != " "]
    texts = ["", None, " ", " a", "  a b", "a ", "b", "x 1 y  z", *(f"a {c}b {c}" for c in letters), "a ", "éa"]
    array = pa.concat_arrays([pa.array(["skipped "]), pa.array(texts, pa.string())]).slice(1)
    units, counts = encoder._units(array)
    expected = [[u for u in re.split(f"(?= {token_files._LETTER})", t or "") if u] for t in texts]
    assert counts.tolist() == [len(x) for x in expected]
    assert units.to_pylist() == [u for x in expected for u in x]
    ids, lengths = encoder.encode(array, 2)
    assert ids.tolist() == [i for x in by_hand(texts) for i in x] and lengths.sum() == len(ids)
