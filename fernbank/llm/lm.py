"""Language-model scoring by deleted interpolation of n-grams over all words.

Every word of the corpus is itself in the model, by a 64-bit hash; nothing is capped.
A token's probability mixes the maximum-likelihood estimates of all orders:

    P(w | context) = sum over k of l_k c(last k-1 words, w) / c(last k-1 words)  +  l_0 / (V + 1)

The weights l belong to the *bucket* of the context: the longest part of it that
training has seen, and the power of two of that part's count. Estimates whose context
was never seen have no weight, so every context's probabilities over the training
vocabulary and one unknown word sum to one. The weights are learned by
expectation-maximisation on held-out counts: a tenth of the training documents is
deleted from the counts, and the weights maximise the likelihood of what was deleted.
Final scores use the counts of all training documents.

How it scales. All work is linear in the tokens:

1. texts become *blocks* of about ``block_tokens`` tokens, one row each, with the
   block's distinct words and its tokens as numbers among them. Documents that are
   deleted have blocks of their own. Blocks are written once, bucketed by number;
2. each block asks for its distinct n-grams of all orders with its own counts of them.
   Keys meet in ranges of the hash, are added up and answered in the order asked. A key
   travels once for each block however frequent it is, so no word or word pair is hot,
   and a block sends no more messages than it has keys;
3. the blocks of deleted documents, joined with their answers, give a histogram of
   bounded size, which is all that the driver sees;
4. all blocks are joined with their answers (the block table needs no shuffle) and
   every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from .exchange import gathered, names, pack, pack_sorted, rows, slices, unpack, unpack_sorted
from .memory import cogroup, group, stream
from .sketch import mix, range_hashes, word_bounds
from .work import bucketed, materialise, tasks

#: Length of the longest n-grams; four at most.
ORDER = 3
#: Tokens in a block, and n-grams in a range of keys, about.
BLOCK_TOKENS = 1 << 20
ROUNDS = 40
#: Bits of an n-gram's key beyond those that number all n-grams: of a million n-grams about one shares another's key.
SPARE_BITS = 20
#: Steps of the histogram for each factor of two in a probability, and the step of zero.
_FINE, _ZERO = 1, 255
#: Buckets of each context length.
_BUCKETS = 64


def token_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of a text after lower-casing A-Z, and of the end."""
    flat = b" ".join((text or "").encode().lower().split()) + b"\n"  # a line feed is in no word
    data = np.frombuffer(flat, np.uint8)
    starts, ends = word_bounds(data)
    return range_hashes(data, np.append(starts, len(data) - 1), np.append(ends, len(data)))


END = int(token_hashes("")[0])


# ---- blocks

_BLOCKS = "b long, deleted boolean, doc_ids array<long>, held_out array<boolean>, lengths array<long>, n_words long, words binary, tokens binary"


class _Open:
    """Documents gathered for one block."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.held: list[bool] = []
        self.hashes: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, held: bool, hashes: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.held.append(held)
        self.hashes.append(hashes)
        self.size += len(hashes)

    def close(self, b: int, deleted: bool) -> pa.RecordBatch:
        words, tokens = np.unique(np.concatenate(self.hashes), return_inverse=True)
        lengths = [len(h) for h in self.hashes]
        values = ([b], [deleted], [self.ids], [self.held], [lengths], [len(words)], [pack_sorted(words)], [pack(tokens)])
        kinds = (pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names(_BLOCKS))


def _encode(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, blocks = TaskContext.get().partitionId() << 24, {False: _Open(), True: _Open()}
        for batch in batches:
            for doc_id, held, deleted, text in zip(*(c.to_pylist() for c in batch.columns)):
                block = blocks[deleted]
                block.add(doc_id, held, token_hashes(text))
                if block.size >= block_tokens:
                    yield block.close(number, deleted)
                    number += 1
        for deleted, block in blocks.items():
            if block.ids:
                yield block.close(number, deleted)
                number += 1

    return run


class Block:
    """A block's tokens and its distinct n-grams of all orders, as ascending ``keys`` of ``bits`` bits; ``at[k]`` has where each token's n-gram of k+1 words is."""

    def __init__(self, row: dict, order: int, bits: int) -> None:
        self.doc_ids, self.held, self.lengths = row["doc_ids"], np.array(row["held_out"], bool), np.array(row["lengths"], np.int64)
        n = int(self.lengths.sum())
        tokens = unpack_sorted(row["words"], row["n_words"])[unpack(row["tokens"], n).astype(np.int64)]
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1])).astype(np.int64)
        key, context, mask = tokens, tokens, np.uint64((1 << 64) - (1 << 64 - bits))
        keys, at = [], []
        for k in range(order):
            if k:
                context = self._before(context)  # the token k places back
                key = mix(key ^ (context * np.uint64(2 * k + 1) + np.uint64(k)))
            # keys have the n-gram's order less one in their low bits
            found, where = np.unique((key if k else mix(tokens)) & mask | np.uint64(k), return_inverse=True)
            keys.append(found)
            at.append(where)
        n_distinct, keys = [len(k) for k in keys], np.concatenate(keys)
        by_key = np.argsort(keys, kind="stable")
        place = np.empty(len(keys), np.int64)
        place[by_key] = np.arange(len(keys))
        self.keys, begin = keys[by_key], 0
        self.at = []
        for where, n_own in zip(at, n_distinct):
            self.at.append(place[begin : begin + n_own][where].astype(np.uint32))
            begin += n_own

    def _before(self, x: np.ndarray) -> np.ndarray:
        """What stands one place before each token; the end token before a document's first."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.starts] = np.uint64(END)
        return out

    def counts(self, of_tokens: np.ndarray) -> np.ndarray:
        """Sums over the tokens of each key."""
        return sum(np.bincount(at, of_tokens, len(self.keys)) for at in self.at).astype(np.int64)

    def estimates(self, counts: np.ndarray, totals: Totals) -> tuple[np.ndarray, np.ndarray]:
        """(each token's context bucket, its maximum-likelihood estimates from one word upwards; zero where the context is new)."""
        own = [counts[at].astype(np.float64) for at in self.at]
        # a context's count: that of the n-gram that ends before the token; before the first, documents
        contexts = [np.full(len(own[0]), float(totals.tokens))]
        for k in range(1, len(own)):
            before = np.empty_like(own[0])
            before[1:] = own[k - 1][:-1]
            before[self.starts] = totals.documents
            contexts.append(before)
        parts = np.stack([np.divide(c, t, out=np.zeros_like(c), where=t > 0) for c, t in zip(own, contexts)])
        bucket = np.zeros(len(own[0]), np.int64)
        for k, t in enumerate(contexts):
            seen = t > 0
            bucket[seen] = ((k + 1) * _BUCKETS + np.log2(np.maximum(t, 1)).astype(np.int64))[seen]
        return bucket, parts


# ---- questions and answers


_ASKED = "p long, b long, deleted boolean, n long, keys binary, numbers binary"
_ANSWERED = "b long, p long, deleted boolean, n long, counts binary, kept binary, types long, kept_types long"


def _ask(order: int, bits: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary())
        for batch in batches:
            for row in rows(batch):
                block = Block(row, order, bits)
                counts = block.counts(np.repeat(~block.held, block.lengths).astype(np.float64))
                found = [(p, row["b"], row["deleted"], b - a, pack_sorted(block.keys[a:b]), pack(counts[a:b])) for p, a, b in slices(block.keys, ranges)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names(_ASKED))

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The sums of a range's keys, for every block that asked: all of training, and for deleted blocks also what is kept without them."""
    asked = table.to_pylist()
    keys, at = np.unique(np.concatenate([unpack_sorted(r["keys"], r["n"]) for r in asked]), return_inverse=True)
    numbers = [unpack(r["numbers"], r["n"]).astype(np.float64) for r in asked]
    sums = np.bincount(at, np.concatenate(numbers), len(keys)).astype(np.uint64)
    deleted = np.concatenate([x if r["deleted"] else np.zeros(len(x)) for x, r in zip(numbers, asked)])
    kept = sums - np.bincount(at, deleted, len(keys)).astype(np.uint64)
    word = keys & np.uint64(3) == 0
    out, begin = [], 0
    for k, r in enumerate(asked):
        own = at[begin : begin + r["n"]]
        begin += r["n"]
        types = (int((sums[word] > 0).sum()), int((kept[word] > 0).sum())) if not k else (0, 0)
        out.append((r["b"], r["p"], r["deleted"], r["n"], pack(sums[own]), pack(kept[own]) if r["deleted"] else None, *types))
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)], names=names(_ANSWERED))


@dataclass
class Totals:
    """Training tokens, documents and distinct tokens."""

    tokens: int
    documents: int
    types: int


# ---- weights


def _steps(p: np.ndarray) -> np.ndarray:
    """Histogram steps of probabilities."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.round(-np.log2(p) * _FINE), _ZERO - 1), _ZERO).astype(np.int64)


def _cells(order: int, bits: int, totals: Totals):
    """The histogram of a deleted block's tokens over (bucket, step of each estimate)."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], pa.int64())] * 2, names=["cell", "weight"])
        block = Block(table.to_pylist()[0], order, bits)
        cell, parts = block.estimates(gathered(answers, "kept"), totals)
        for p in parts:
            cell = cell << 8 | _steps(p)
        found, weight = np.unique(cell, return_counts=True)
        return pa.table([pa.array(found), pa.array(weight)], names=["cell", "weight"])

    return run


def learn(cells: np.ndarray, weights: np.ndarray, order: int, types: int, rounds: int = ROUNDS) -> np.ndarray:
    """``[bucket, part]``: mixture weights of the uniform part and of each order, by expectation-maximisation over the histogram.

    Only orders whose context the bucket has seen get weight. A bucket without held-out
    counts takes the weights of the nearest one with the same context length, or even ones.
    """
    buckets = (order + 1) * _BUCKETS
    parts = [np.full(len(cells), 1 / (types + 1))]
    for k in range(order):
        step = cells >> 8 * (order - 1 - k) & 255
        parts.append(np.where(step == _ZERO, 0.0, np.exp2(-step / _FINE)))
    parts, b = np.stack(parts, 1), cells >> 8 * order
    length = np.arange(buckets) // _BUCKETS
    allowed = (np.arange(order + 1)[None, :] <= length[:, None]).astype(float)
    mixed = allowed / allowed.sum(1, keepdims=True)
    seen = np.bincount(b, weights, buckets) > 0
    for _ in range(rounds):
        share = mixed[b] * parts
        share *= (weights / np.maximum(share.sum(1), 1e-300))[:, None]
        sums = np.stack([np.bincount(b, share[:, k], buckets) for k in range(order + 1)], 1) + 1e-3 * allowed
        mixed = np.where(seen[:, None], sums / sums.sum(1, keepdims=True), mixed)
    for k in np.flatnonzero(~seen):
        like = np.flatnonzero(seen & (length == length[k]))
        if len(like):
            mixed[k] = mixed[like[np.abs(like - k).argmin()]]
    return mixed


# ---- scores

_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def probabilities(block: Block, counts: np.ndarray, totals: Totals, mixed: np.ndarray) -> np.ndarray:
    """Each token's probability."""
    bucket, parts = block.estimates(counts, totals)
    weights = mixed[bucket].T
    return weights[0] / (totals.types + 1) + (weights[1:] * parts).sum(0)


def _score(order: int, bits: int, totals: Totals, mixed: np.ndarray):
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names(_SCORED))
        block = Block(table.to_pylist()[0], order, bits)
        counts = gathered(answers, "counts")
        logs = np.log10(probabilities(block, counts, totals, mixed))
        c = counts[block.at[0]].astype(np.float64)
        base = np.log10((c + 0.5) / (totals.tokens + 0.5 * (totals.types + 1)))
        by_doc = lambda x: np.add.reduceat(x, block.starts)
        values = (block.doc_ids, block.held, block.lengths, by_doc((c > 0).astype(np.int64)), np.full(len(block.held), totals.tokens), by_doc(base), by_doc(logs))
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=names(_SCORED))

    return run


def score(docs: DataFrame, held_out: Column, *, doc: str = "doc_id", text: str = "text", order: int = ORDER, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Score every row of ``docs``, learning from those where ``held_out`` is not true.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: tokens
    with the end, those seen in training, training tokens, the log10 probability under
    the add-0.5 unigram, and under the model. A null text is an empty one (the end
    alone). A null id is kept, and such rows are trained on. Repeated rows count and
    score each. Without training rows the one unknown word has all probability. An
    empty table gives no rows. Other columns are ignored.
    """
    if not 1 <= order <= 4:
        raise ValueError("order must be 1 to 4")
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(doc).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    deleted = ~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(10)) == 0)
    texts = source.select("doc_id", "held_out", deleted.alias("deleted"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = bucketed(texts.mapInArrow(stream(_encode(block_tokens)), _BLOCKS), "lm_blocks", max(32, tasks(size, 4 * block_tokens)), "b")
    train = F.arrays_zip("held_out", "lengths")
    trained = F.aggregate(F.filter(train, lambda x: ~x["held_out"]), F.lit(0).cast("long"), lambda a, x: a + x["lengths"])
    sums = blocks.groupBy("deleted").agg(F.sum(trained).alias("tokens"), F.sum(F.size(F.filter("held_out", lambda x: ~x))).alias("documents"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all"))
    by = {r.deleted: r for r in sums.collect()}
    n_keys = order * sum(r["all"] for r in by.values())
    ranges, bits = max(32, -(-n_keys // block_tokens)), min(62, n_keys.bit_length() + SPARE_BITS)
    asked = blocks.select(names(_BLOCKS)).mapInArrow(stream(_ask(order, bits, ranges)), _ASKED)
    answered = materialise(asked.repartition(tasks(ranges, 4), "p").groupBy("p").applyInArrow(group(_answer), _ANSWERED), "lm-answers")
    found = answered.agg(F.coalesce(F.sum("types"), F.lit(0)), F.coalesce(F.sum("kept_types"), F.lit(0))).first()
    sum_of = lambda name, kinds: sum(by[k][name] for k in kinds if k in by)
    kept = Totals(sum_of("tokens", [False]), sum_of("documents", [False]), int(found[1]))
    totals = Totals(sum_of("tokens", [False, True]), sum_of("documents", [False, True]), int(found[0]))
    joined = lambda only: blocks.where(only).groupBy("b").cogroup(answered.where(only).groupBy("b"))
    cells = joined(F.col("deleted")).applyInArrow(cogroup(_cells(order, bits, kept)), "cell long, weight long").groupBy("cell").agg(F.sum("weight").alias("weight")).toArrow()
    mixed = learn(cells.column("cell").to_numpy(), cells.column("weight").to_numpy().astype(np.float64), order, kept.types)
    return joined(F.lit(True)).applyInArrow(cogroup(_score(order, bits, totals, mixed)), _SCORED)
