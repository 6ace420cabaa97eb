"""Quality classifier: supervised subword embeddings, trained with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import free_names, keep, mix64, small_batches

BITS, DIM = 16, 12
BUCKETS = 1 << BITS
STEP = np.uint64(0x9E3779B97F4A7C15)
BLANK = np.uint64(32)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of texts: for each kind (words, pairs of words, 3-, 4- and 5-grams of characters) the buckets, in text
    order, and where each text's begin (one more than there are texts).

    Words stand between blanks; a gram lies in a word or takes the blank before or after it along.
    """
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    gap = (codes == BLANK) | ((codes >= np.uint64(9)) & (codes <= np.uint64(13)))
    codes[gap] = BLANK
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])  # of the blank before each text
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    out = []
    blanks = np.concatenate([[0], np.cumsum(gap)])
    grams = codes * STEP + codes
    for n in (2, 3, 4, 5):
        if len(codes) < n:
            grams = grams[:0]
        else:
            grams = grams[: len(codes) - n + 1] * STEP + codes[n - 1 :]
        if n > 2:
            at = np.arange(len(grams))
            inner = np.flatnonzero(blanks[at + n - 1] == blanks[at + 1])
            out.append((_bucket(grams[inner] + np.uint64(n)), np.searchsorted(inner, begin)))
    # A word's hash is a sum over its characters and places in it.
    if len(start):
        of = np.repeat(np.arange(len(start)), end - start)
        letters = np.flatnonzero(~gap)
        inside = (letters - start[of]).astype(np.uint64)
        words = np.add.reduceat(mix64(codes[letters] + (inside << np.uint64(24))), np.concatenate([[0], np.cumsum(end - start)[:-1]]))
    else:
        words = np.zeros(0, np.uint64)
    first = np.searchsorted(start, begin)
    pairs = words[:-1] * STEP + words[1:]
    same = np.ones(max(0, len(words) - 1), bool)
    cut = first[1:-1] - 1
    same[cut[(cut >= 0) & (cut < len(same))]] = False
    kept = np.flatnonzero(same)
    return [(_bucket(words), first), (_bucket(pairs[kept]), np.searchsorted(kept, first)), *out]


def chunks(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    lo = held = 0
    for i, t in enumerate(texts):
        if i > lo and held + len(t) > most:
            yield lo, i
            lo, held = i, 0
        held += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 5, rate: float = 0.5, seed: int = 3) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent on a softmax over averaged vectors.

    As the output is linear in the averaged vectors, the model is handed back as one number for each bucket and a constant:
    the log-odds of a text are the mean of its features' numbers plus the constant.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    total, done = epochs * max(1, len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, n = docs[i]
            step = rate * (1 - done / total)
            done += 1
            share = n / n.sum() if len(n) else n
            mean = share @ table[at] if len(n) else np.zeros(dim, np.float32)
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            if len(n):
                # A long text spreads one step over many rows; scaled by the features' spread so that it still moves.
                table[at] -= (step * np.minimum(share * len(n), 8.0))[:, None] * (p @ out)[None, :]
            out -= step * np.outer(p, mean)
            bias -= 0.05 * step * p
    return (table @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def _train_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep("quality")
    rows: list[tuple] = []
    for b in batches:
        for key, label, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            buckets = np.concatenate([f for f, _ in features([text or ""])])
            found, n = np.unique(buckets, return_counts=True)
            rows.append((key, label, (found.astype(np.uint16), n.astype(np.float32))))  # BUCKETS entries of 6 bytes at most
    rows.sort(key=lambda r: (r[0], r[1]))  # the exchange hands rows over in any order
    weights, bias = train([r[2] for r in rows], np.array([r[1] for r in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias])], names=["weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, key: str = "doc_id", text: str = "text", label: str = "quality", fold: int | None = 5) -> tuple[np.ndarray, float]:
    """Fit on at most `sample` labelled rows, the first in the order of a hash of the key.

    Rows with crc32(key as text) mod `fold` = 0 are held out. Rows without a key or a label of 0 or 1 teach nothing, nor do
    texts of over `max_bytes` bytes: both bounds bound the memory of the one task that fits. Repeated keys with one label
    count once. Without any row, the model scores every text the same. The model is BUCKETS floats, whatever the input.
    """
    small_batches(docs)
    rows = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key IS NOT NULL AND label IN (0, 1)").distinct()
    if fold:
        rows = rows.where(F.crc32(F.col("key").cast("string").cast("binary")) % fold != 0)
    chosen = rows.orderBy(F.xxhash64(F.col("key"), F.lit(1)), "key", "label").limit(sample)  # ids only: bounded, so it may be broadcast
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    taught = texts.join(F.broadcast(chosen), "key").groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    row = taught.coalesce(1).mapInArrow(_train_all, "weights binary, bias double").first()
    if row is None:
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(bytes(row["weights"]), np.float32), row["bias"]


def _score(batches: Iterator[pa.RecordBatch], model: tuple[np.ndarray, float], threshold: float, name: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    keep("quality")
    weights, bias = model
    weights = weights.astype(np.float64)
    for batch in batches:
        texts = [v.as_py() or "" for v in batch.column(batch.num_columns - 1)]
        odds = np.full(len(texts), bias)
        for lo, hi in chunks(texts):
            total, count = np.zeros(hi - lo), np.zeros(hi - lo)
            for buckets, first in features(texts[lo:hi]):
                n = np.diff(first[: hi - lo + 1])
                some = n > 0
                if some.any():
                    total[some] += np.add.reduceat(weights[buckets], first[: hi - lo][some])
                count += n
            odds[lo:hi] += total / np.maximum(count, 1)
        scores = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=[*batch.schema.names[:-1], *name])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", threshold: float = 0.3, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Score every whole text with a fitted model; all columns come back, with the score (0 to 1) and the class.

    Null and empty texts have no features and get the score of the model's constant. Columns named as in `names` are
    replaced. The model (a fixed number of floats) travels with the tasks; there is no shuffle.
    """
    docs = small_batches(docs).drop(*names)
    schema = T.StructType(docs.schema.fields).add(names[0], T.DoubleType()).add(names[1], T.IntegerType())
    (own,) = free_names([*docs.columns, *names], "text")
    return docs.withColumn(own, F.col(text)).mapInArrow(partial(_score, model=model, threshold=threshold, name=names), schema)
