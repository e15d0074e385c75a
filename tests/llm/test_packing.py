"""Token ids against the tokenizers library; packing, matrices and token files by exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from fernbank.llm import packing, token_files
from fernbank.llm.bpe import tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, length string, sequence_id int"
ROWS = [
    (1, "Hello world. It's 12 o'clock,\nisn't it?", "x", 1),
    (2, "", "x", 1),
    (3, None, None, None),
    (None, "no id here", "x", 1),
    (4, "word " * 9000, "x", 1),
    (5, "twice", "x", 1),
    (5, "twice", "x", 1),
    (6, "<|endoftext|> is text", "x", 1),
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def ids(text):
    t = tokenizer(PATH)
    return np.frombuffer(t.encode(text or ""), t.dtype).tolist()


def test_ids_equal_the_librarys(library):
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "'s", "12", "...", "😀", " ", "　", "<|endoftext|>", "日本", "\x00", "\x1f", "word", " the"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert ids(text) == library(text), repr(text)
    for text in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist():
        assert ids(text) == library(text)


@pytest.mark.parametrize("fit", [packing.first_fit, packing.best_fit])
def test_fit_against_brute_force(fit):
    rng = random.Random(5)
    for _ in range(200):
        cap = rng.choice([1, 7, 16, 100])
        lengths = sorted((rng.randint(1, cap) for _ in range(rng.randrange(40))), reverse=True)
        bins, free = [], []
        for k, n in enumerate(lengths):
            fits = [b for b in range(len(bins)) if free[b] >= n]
            if fit is packing.best_fit:
                fits.sort(key=lambda b: free[b])
                fits = [b for b in fits if free[b] == free[fits[0]]]
            b = fits[0] if fits else len(bins)
            if not fits:
                bins.append([])
                free.append(cap)
            bins[b].append(k)
            free[b] -= n
        got = fit(lengths, cap)
        if fit is packing.first_fit:
            assert got == bins
        else:  # equally full bins may be taken in any order
            assert sorted(sum(lengths[k] for k in b) for b in got) == sorted(sum(lengths[k] for k in b) for b in bins)
        assert sorted(k for b in got for k in b) == list(range(len(lengths)))


@pytest.mark.parametrize("pack", [packing.pack_first_fit, packing.pack_best_fit])
def test_round_trip(spark, library, pack):
    docs = spark.createDataFrame(ROWS, DOCS)
    rows = pack(docs, PATH, capacity=64, group_bytes=5000).collect()
    found, sequences = {}, {}
    for r in rows:
        piece = np.frombuffer(r.ids, "<u4").tolist()
        assert len(piece) == r.length and 0 < r.length
        found.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, piece))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 64
    for doc_id, text, *_ in ROWS:
        whole = [*library(text), 1]
        parts = sorted(found[doc_id, len(whole)])
        if doc_id == 5:
            parts = parts[::2]
        assert [i for _, p in parts for i in p] == whole
        assert [s for s, _ in parts] == np.cumsum([0, *(len(p) for _, p in parts[:-1])]).tolist()
    assert pack(spark.createDataFrame([], DOCS), PATH).count() == 0


def test_repeated_rows_spread(spark):
    """Rows that repeat everything, nulls included, are dealt over all groups."""
    docs = spark.createDataFrame([(None, None)] * 2000 + [(7, "same words again")] * 2000, "doc_id long, text string").repartition(5)
    rows = packing.pack_first_fit(docs, PATH, capacity=8, group_bytes=1000).collect()
    assert len(rows) == 4000
    for doc_id in (None, 7):
        groups = {}
        for r in rows:
            if r.doc_id == doc_id:
                groups[r.sequence_id // packing.BINS] = groups.get(r.sequence_id // packing.BINS, 0) + 1
        assert len(groups) >= 30 and max(groups.values()) < 300


def test_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fills = {}
    for r in packing.pack_first_fit(docs, PATH).select("sequence_id", "length").collect():
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    padding = sum(2048 - n for n in fills.values() if n & (n - 1))
    assert padding < 0.005 * sum(fills.values())


def test_matrices(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    pieces = packing.pack_best_fit(docs, PATH, capacity=32)
    by_seq = {}
    for r in pieces.collect():
        by_seq.setdefault(r.sequence_id, []).append(r)
    rows = packing.pack_matrices(docs, PATH, capacity=32).collect()
    assert len(rows) == len(by_seq)
    for r in rows:
        want = sorted(by_seq[r.sequence_id], key=lambda p: p.offset)
        matrix, positions = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.position_ids, "<u2")
        assert len(matrix) == len(positions) == 32
        assert r.cu_seqlens == [0, *np.cumsum([p.length for p in want]).tolist()]
        assert matrix[: r.n_tokens].tobytes() == b"".join(bytes(p.ids) for p in want)
        assert r.doc_ids == [p.doc_id for p in want] and r.starts == [p.start for p in want]
        for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]):
            assert positions[a:b].tolist() == list(range(b - a))
        assert not matrix[r.n_tokens :].any()


def test_crc_is_of_32_bit_ids(spark, library):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    row = packing.pack_first_fit(docs, PATH).select(F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(np.array([*library("some text"), 1], "<u4").tobytes())


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_token_counts(spark, library, tmp_path, block):
    docs = spark.createDataFrame(ROWS, DOCS)
    target = f"file://{tmp_path}/files"
    rows = token_files.token_counts(docs, PATH, block=block, target=target).collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens) for r in rows) == sorted(((d is None, d or 0), len(library(t))) for d, t, *_ in ROWS)
    shards = {}
    for r in rows:
        shards.setdefault(r.shard, []).append((r.ordinal, r.start, r.n_tokens))
    for found in shards.values():
        at = 0
        for k, (ordinal, start, n) in enumerate(sorted(found)):
            assert (ordinal, start) == (k, at)
            at += n + 1
    for f in (tmp_path / "files").rglob("kind=tokens/*/part-*"):
        flat = np.fromfile(f, "<u2")
        assert flat[-1] == 50256
    assert token_files.token_counts(spark.createDataFrame([], DOCS), PATH).count() == 0
