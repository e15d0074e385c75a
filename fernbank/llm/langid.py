"""Language identification by error-correcting output codes over byte n-grams.

Each language gets a codeword; one binary classifier for each bit says on which
side of the code a text's n-grams lie. All bits are linear in hashed n-gram
features, so a text's bit margins are the mean of the weight rows at its n-grams.
Decoding is loss-weighted: a codeword's loss is the logistic loss of its bits
against the margins, each bit weighted by how reliable it was on the fitting
sample for that language. The language of least loss is chosen, and a text whose
two best lie close is flagged as ambiguous.

The model is fitted on a sample of rows: about ``SAMPLE_ROWS`` different texts of each
language, fewer if languages are many, chosen by a hash; all of a language that has no
more. Sampled texts are read whole, and every language with a labelled text is learned.
N-grams are counted and weighed on the executors; the driver gets the weights, whose size
depends on the number of languages alone and which go to executors with the code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.shipping import ship
from .memory import group, stream
from .work import materialise

#: The fitting sample: different texts of each language, and in all; so many of each language at least, however many there are.
SAMPLE_ROWS, SAMPLE_TOTAL, SAMPLE_LEAST = 600, 20_000, 50
#: Buckets of hashed n-grams.
FEATURES = 1 << 16
#: Margins of best and second language below which a prediction is ambiguous, as a difference of probability.
AMBIGUOUS = 0.2
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
#: Bytes scored at once, to bound memory on very long texts.
_SLAB = 1 << 20


def codewords(n: int) -> np.ndarray:
    """One row of +1/-1 for each of n languages.

    Up to seven languages get the exhaustive code (every way to split them); more get
    the best-separated of a few seeded random codes of about 10 log2 n bits.
    """
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        return np.array([[1 if (split >> k) & 1 else -1 for split in range(1, 1 << (n - 1))] for k in range(n)], float)
    rng = np.random.default_rng(7)
    bits = int(np.ceil(10 * np.log2(n)))
    best, most = None, -1
    for _ in range(200 if n <= 64 else 5):
        code = rng.choice((-1.0, 1.0), (n, bits))
        code = code[:, np.abs(code.sum(0)) < n]
        # the largest agreement of two rows, in slabs of rows
        agree = max(float((part @ code.T - 2 * bits * (np.arange(at, at + len(part))[:, None] >= np.arange(n)[None, :])).max()) for at in range(0, n, 1024) if len(part := code[at : at + 1024]))
        apart = (code.shape[1] - agree) / 2
        if apart > most:
            best, most = code, apart
    return best


def normal_bytes(text: str) -> np.ndarray:
    """The text's bytes in ASCII lower case with single spaces around words."""
    return np.frombuffer(b" " + b" ".join(text.encode().lower().split()) + b" ", np.uint8)


def features(b: np.ndarray, at: int = 0, to: int | None = None) -> np.ndarray:
    """Hashed 1-, 2- and 3-byte n-grams of ``b`` that begin from ``at`` on and before ``to``."""
    to = len(b) if to is None else min(to, len(b))
    b = b[at : to + 2].astype(np.uint32)
    n = to - at
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    grams = np.concatenate((b[:n] | 1 << 24, two[:n] | 1 << 25, three[:n] | 1 << 26))
    return (grams * np.uint32(0x9E3779B1)) >> np.uint32(16)


def counted(text: str) -> np.ndarray:
    """How often each feature occurs in the whole text."""
    b = normal_bytes(text)
    return sum(np.bincount(features(b, at, at + _SLAB), minlength=FEATURES) for at in range(0, len(b), _SLAB))


@dataclass
class Model:
    """Fitted codes: ``weights[feature, bit]``, ``codes[language, bit]`` and the bits' weight for each language."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    reliable: np.ndarray
    scale: float = 8.0

    def margins(self, text: str) -> np.ndarray:
        """The bits' mean margins over all n-grams of the whole text."""
        b = normal_bytes(text)
        if 3 * len(b) > FEATURES:
            return (counted(text) @ self.weights.astype(np.float64)) / max(3 * len(b) - 3, 1)
        found = features(b)
        return self.weights[found].sum(0, dtype=np.float64) / max(len(found), 1)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Each language's weighted loss."""
        return (self.reliable * np.logaddexp(0, -self.scale * self.codes * margins)).sum(1)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability of it, whether it is ambiguous)."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, False
        loss = self.losses(self.margins(text)) * self.codes.shape[1]
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        best = int(p.argmax())
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        return self.languages[best], float(p[best]), float(p[best]) - second < AMBIGUOUS


def bit_weights(share: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """``[feature, bit]``: log-odds of features on either side of each bit, from ``share[language, feature]``; languages count alike."""
    tiny = 1e-6
    up, down = (codes > 0).T.astype(float), (codes < 0).T.astype(float)
    mean = lambda side: (side @ share) / np.maximum(side.sum(1, keepdims=True), 1) + tiny
    both = (up.any(1) & down.any(1))[:, None]
    return np.where(both, np.log(mean(up) / mean(down)), 0.0).T.astype(np.float32)


def reliability(codes: np.ndarray, right: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """``[language, bit]``: the weight of bits in a language's loss, from the texts that fell on the right side of ``seen``."""
    part = np.maximum((right + 1) / (seen[:, None] + 1), 1e-3)
    return part / part.sum(1, keepdims=True)


def sample(docs: DataFrame, *, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> DataFrame:
    """``lang, text`` of the fitting sample: labelled rows whose hash of ``key`` and text is small enough; equal ones once.

    Of each language about ``rows`` are expected, or an even share of ``SAMPLE_TOTAL``,
    but no fewer than ``SAMPLE_LEAST``; a language with no more different texts gives all.
    """
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("h")).where("lang is not null and text is not null")
    totals = materialise(labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")), "languages")
    rows = max(SAMPLE_LEAST, min(rows, SAMPLE_TOTAL // max(1, totals.count())))
    limits = totals.select(F.col("lang").alias("of"), F.least(F.lit(1.0), F.lit(1.1 * rows) / F.col("n")).alias("part"))
    chosen = labelled.join(limits, F.col("lang") == F.col("of")).where(F.shiftrightunsigned("h", 1).cast("double") / float(1 << 63) <= F.col("part"))
    return materialise(chosen.dropDuplicates(["lang", "h"]).select("lang", "text"), "language-sample")


_BLOCK = 1 << 10  # features weighed in one task


def fit_documents(docs: DataFrame, *, lang: str = "lang", text: str = "text", key: str = "doc_id", rows: int = SAMPLE_ROWS) -> Model:
    """Fit the binary classifiers on a sample of ``docs`` and weigh the bits. Without labelled rows the model knows no language."""
    spark = docs.sparkSession
    ship(spark)
    chosen = sample(docs, lang=lang, text=text, key=key, rows=rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for k, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["lang", "feature", "n"])
            held.clear()

        for batch in batches:
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held.get(k, 0) + counted(body)
                if len(held) > 32:
                    yield from flush()
        yield from flush()

    counts = materialise(chosen.mapInArrow(stream(count), "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "language-counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    codes, index = codewords(len(languages)), {k: i for i, k in enumerate(languages)}

    def weigh(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        share = np.zeros((len(languages), _BLOCK))
        langs = table.column("lang").to_pylist()
        share[[index[k] for k in langs], table.column("feature").to_numpy() - block * _BLOCK] = table.column("n").to_numpy() / np.array([totals[k] for k in langs], float)
        return pa.table({"block": pa.array([block], pa.int64()), "weights": pa.array([bit_weights(share, codes).tobytes()], pa.binary())})

    weights = np.zeros((FEATURES, codes.shape[1]), np.float32)
    blocks = counts.withColumn("block", F.floor(F.col("feature") / _BLOCK)).groupBy("block").applyInArrow(group(weigh), "block long, weights binary")
    for r in blocks.collect() if languages else ():
        weights[r.block * _BLOCK : (r.block + 1) * _BLOCK] = np.frombuffer(r.weights, np.float32).reshape(_BLOCK, -1)
    model = Model(languages, codes, weights, np.ones_like(codes) / max(codes.shape[1], 1))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list] = {}
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = index[k]
                own = found.setdefault(i, [0, 0])
                own[0] += 1
                own[1] = own[1] + (codes[i] * model.margins(body) > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.list_(pa.int64()))], ["i", "seen", "right"])

    judged = chosen.mapInArrow(stream(judge), "i long, seen long, right array<long>") if languages else None
    if judged is not None:
        sums = [F.sum(F.get("right", F.lit(k))).alias(f"r{k}") for k in range(codes.shape[1])]
        seen, right = np.zeros(len(languages)), np.zeros(codes.shape)
        for r in judged.groupBy("i").agg(F.sum("seen").alias("seen"), F.array(*sums).alias("right")).collect():
            seen[r.i], right[r.i] = r.seen, r.right
        model.reliable = reliability(codes, right, seen)
    return model


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` (columns of these names are replaced).

    Null texts and texts without a letter are ``und`` with score 0. Predictions look
    at nothing but the text. All other columns pass through.
    """
    ship(docs.sparkSession)
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    own = docs.select(*kept)
    schema = StructType(list(own.schema.fields)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column(at).to_pylist()]
            added = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return own.mapInArrow(stream(run), schema)
