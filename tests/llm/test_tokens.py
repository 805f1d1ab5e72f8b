"""Operators 1, 3 and 9 against the tokenizers library on whole texts."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sediment.llm import encoding, packing, token_counts, token_files
from sediment.llm.common import fresh

ALPHABET = [" ", "  ", "\n", "\t", "a", "B", "é", "'s", "1", "23", "!", ".", ",", "&", "<|endoftext|>", " ", "　", "\x1c", "日本", "́", "Σ", "😀", "\r", "<|startoftext|>", "<|", "\x01", "İ", "Ĳ", "word", " "]
NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
WHOLE = {n: Tokenizer.from_file(encoding.default_path(n)) for n in NAMES}
MEMO = {n: encoding.Encoder(encoding.default_path(n)) for n in NAMES}


def whole(name, texts):
    return [e.ids for e in WHOLE[name].encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=14).map("".join), st.text(max_size=20)), max_size=6))
def test_pieces_equal_whole_texts(name, texts):
    flat, n = MEMO[name].encode(pa.array(texts, pa.string()))
    want = whole(name, texts)
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    assert MEMO[name].lengths(pa.array(texts, pa.string())).tolist() == n.tolist()


@pytest.mark.parametrize("name", NAMES)
def test_joined_pieces_equal_whole_texts(name):
    """Thousands of new words at once, so that they are encoded together; words in other letters are not."""
    r = random.Random(3)
    letters = ["abcdefgh", "ABcdé", "ÀÖÿß", "a1'2", "x.,-", "日本語", "ǰJ\u030c", "İıſK", "\u212b\u0301"]
    texts = [" ".join("".join(r.choice(r.choice(letters[: 5 if k % 3 else 9])) for _ in range(r.randint(1, 12))) for _ in range(400)) for k in range(30)]
    e = encoding.Encoder(encoding.default_path(name))
    flat, n = e.encode(pa.array(texts))
    want = whole(name, texts)
    assert n.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    joined = []
    e._library, library = lambda x: joined.append(max(map(len, x))) or library(x), e._library
    e.encode(pa.array([" ".join(f"w{i}x{r.random()}" for i in range(900))]))
    assert max(joined) > 1000


def test_a_text_without_spaces():
    text = pa.array(["Zm9v" * 50_000, "漢字" * 20_000])
    for name in NAMES:
        assert MEMO[name].lengths(text).tolist() == [len(w) for w in whole(name, text.to_pylist())]


def test_batches_are_gathered():
    batches = [pa.RecordBatch.from_pydict({"i": [k], "t": ["x" * 10]}) for k in range(25)]
    found = list(encoding.gathered(iter(batches), 1, 60))
    assert [i for b in found for i in b.column(0).to_pylist()] == list(range(25)) and 3 <= len(found) < 25


def test_memo_survives_being_cleared(monkeypatch):
    monkeypatch.setattr(encoding, "MEMO_PIECES", 5)
    e = encoding.Encoder(encoding.default_path(NAMES[0]))
    for k in range(4):
        texts = [f"some words {k} and some more words {i}" for i in range(9)]
        assert e.lengths(pa.array(texts)).tolist() == [len(w) for w in whole(NAMES[0], texts)]


def test_other_vocabularies_are_encoded_whole():
    e = encoding.Encoder(encoding.default_path("piece_bpe_32k.model"))
    assert e.safe_cuts is None
    assert e.lengths(pa.array(["one two", "", None])).tolist()[1:] == [0, 0]


def test_slices_cover_all_rows():
    texts = pa.array(["a" * 50, None, "b" * 500, "c", "", "d" * 99])
    ranges = list(encoding.slices(texts, 100))
    assert ranges[0][0] == 0 and ranges[-1][1] == 6 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert list(encoding.slices(texts.slice(0, 0))) == []


ROWS = [(3, "three words here"), (1, None), (2, ""), (None, "no id"), (7, "x " * 3000), (3, "three words here"), (9, "tail <|endoftext|> end")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame([(i, t, "extra") for i, t in ROWS], "doc_id long, text string, n_tokens string").repartition(3)


def test_token_counts(spark, docs):
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs).collect())
    want = sorted((i is not None, i or 0, len((t or "").encode()), len(w), len(w) > 1024) for (i, t), w in zip(ROWS, whole(NAMES[0], [t for _, t in ROWS]), strict=True))
    assert got == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_token_files(spark, docs):
    uri = fresh(spark, "test-token-files")
    manifest = token_files.write_token_files(docs, uri, length=16)
    got = token_files.read_token_files(spark, manifest).collect()
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(text) h").collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r]))
    at, want = 0, []
    for (i, _), w in zip(order, whole(NAMES[0], [t for _, t in order]), strict=True):
        ids = np.array([*w, 0], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted([tuple(r) for r in got], key=lambda r: r[1]) == want
    for r in manifest.collect():
        reader = token_files.ShardReader(r.path)
        n_rows = -(-r.n_tokens // 16)
        real = 0
        for k in range(n_rows):
            ids, mask = reader.row(k)
            assert len(ids) == 16 and not ids.flags.owndata
            real += sum(mask.to_pylist())
        assert real == r.n_tokens
    empty = token_files.write_token_files(docs.limit(0), fresh(spark, "test-empty"))
    assert token_files.read_token_files(spark, empty).count() == 0


def test_rows_without_ids_fill_no_shard(spark):
    rows = [(None, "the same text")] * 3000 + [(i, f"text {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    manifest = token_files.write_token_files(docs, fresh(spark, "test-hot-ids"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in manifest.collect()) < 2500
    got = token_files.read_token_files(spark, manifest).orderBy("start").collect()
    assert [g.doc_id for g in got] == [None] * 3000 + list(range(3000)) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:], strict=False))


def test_packing(spark, docs):
    got = packing.pack(docs, length=64, keep_ids=True).collect()
    ids = {}
    for (i, t), w in zip(ROWS, whole(NAMES[1], [t for _, t in ROWS]), strict=True):
        ids.setdefault(i, []).append([*w, 1])
    cells = {}
    for r in got:
        piece = np.frombuffer(r.ids, np.uint16).tolist()
        assert len(piece) == r.length and r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        assert any(w[r.start : r.start + r.length] == piece and len(w) == r.doc_tokens for w in ids[r.doc_id])
        for k in range(r.length):
            assert (r.sequence_id, r.offset + k) not in cells
            cells[r.sequence_id, r.offset + k] = 1
    total = sum(len(w) for ws in ids.values() for w in ws)
    assert sorted(cells) == [divmod(k, 64) for k in range(total)]
    assert packing.pack(docs.limit(0)).count() == 0
    assert list(packing.cut(60, 70, 64)) == [(0, 4, 0, 60), (4, 64, 1, 0), (68, 2, 2, 0)]
