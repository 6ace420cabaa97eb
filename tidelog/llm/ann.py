"""Approximate nearest neighbours with an inverted multi-index."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch

FOUND = "query_id long, vec_id long, score double"
FOUND_FIELDS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of the vectors that take part: with an id, not empty, every component finite, one of them not zero."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0))


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from k distinct points; an empty cell keeps its centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(distances(points[i : i + 8192], centres), axis=1) for i in range(0, len(points), 8192)] or [np.zeros(0, np.int64)])


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, up to rounding."""
    return (points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None, :]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _assign(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    half, dim = books[0].shape[1], books[0].shape[1] + books[1].shape[1]
    for batch in batches:
        points = matrix(batch.column("v"), dim)
        cell = nearest(points[:, :half], books[0]) * len(books[1]) + nearest(points[:, half:], books[1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])


def traverse(first: np.ndarray, second: np.ndarray, counts: dict[int, tuple[int, int]], enough: int) -> list[int]:
    """Multi-sequence traversal: pairs of centroids by the sum of both distances, until their cells hold `enough` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, cells, held = [(float(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i]) * len(second) + int(b[j])
        if n := counts.get(cell):
            cells.append(cell)
            held += n[1]
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (float(first[a[x]] + second[b[y]]), x, y))
    return cells


def _route(batches: Iterator[pa.RecordBatch], books: tuple[np.ndarray, np.ndarray], counts: dict[int, tuple[int, int]], enough: int, chunk: int) -> Iterator[pa.RecordBatch]:
    """Each query at every part of every cell it visits."""
    half, dim = books[0].shape[1], books[0].shape[1] + books[1].shape[1]
    for batch in batches:
        points = matrix(batch.column("v"), dim)
        d1, d2 = distances(points[:, :half], books[0]), distances(points[:, half:], books[1])
        for lo in range(batch.num_rows):
            cells = traverse(d1[lo], d2[lo], counts, enough)
            places = [(c, p) for c in cells for p in range(-(-counts[c][0] // chunk))]
            n = len(places)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in places], pa.int32()), pa.array([p for _, p in places], pa.int32()), batch.column("id").take(pa.array([lo] * n, pa.int64())), batch.column("v").take(pa.array([lo] * n, pa.int64()))], names=["cell", "part", "id", "v"])


def _searcher(k: int, dim: int):
    def search(key, queries, entries):
        """The k nearest entries of one part of a cell for each query that visits it, reranked exactly."""
        if not queries.num_rows or not entries.num_rows:
            return FOUND_FIELDS.empty_table()
        q, e = matrix(queries.column("v"), dim), matrix(entries.column("v"), dim)
        qi, ei = queries.column("id").to_numpy(), entries.column("id").to_numpy()
        order = np.argsort(ei, kind="stable")
        e, ei = e[order], ei[order]
        rough = distances(q, e)
        rough[ei[None, :] == qi[:, None]] = np.inf
        n = min(k, len(e))
        # Rounding of the fast form may not decide: keep what is as near as the k-th up to its error, then rerank exactly.
        slack = 1e-9 * ((q**2).sum(1) + (e**2).sum(1).max())
        limit = np.partition(rough, n - 1, axis=1)[:, n - 1] + slack
        rows = []
        for i in range(len(q)):
            at = np.flatnonzero((rough[i] <= limit[i]) & (rough[i] < np.inf))
            exact = np.sqrt(((e[at] - q[i]) ** 2).sum(1))
            best = np.lexsort((ei[at], exact))[:k]
            rows.append((np.full(len(best), qi[i]), ei[at][best], exact[best]))
        return pa.table([pa.array(np.concatenate([r[j] for r in rows]), f.type) for j, f in enumerate(FOUND_FIELDS)], schema=FOUND_FIELDS)

    return search


def share_to_visit(points: np.ndarray, books: tuple[np.ndarray, np.ndarray], k: int, recall: float, queries: int = 256) -> float:
    """The share of all entries that a query must visit for `recall` of its k nearest, measured on a sample of the entries.

    Among more entries the nearest lie closer to a query, so a share that does for the sample does for the table.
    """
    half, shares = books[0].shape[1], []
    d1, d2 = (np.maximum(distances(p, b), 0) for p, b in ((points[:, :half], books[0]), (points[:, half:], books[1])))
    own1, own2 = d1.argmin(1), d2.argmin(1)
    for i in np.unique(np.linspace(0, len(points) - 1, min(queries, len(points))).astype(int)):
        far = distances(points[i : i + 1], points)[0]
        far[i] = np.inf
        near = np.argpartition(far, min(k, len(far)) - 1)[: min(k, len(far) - 1)]
        sums = d1[i][own1] + d2[i][own2]
        shares += [float((sums <= s).mean()) for s in sums[near]]
    return float(np.quantile(shares, recall)) if shares else 1.0


def search(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 100, k: int = 10, centroids: int | None = None,
           visit: float | None = None, recall: float = 0.95, sample: int = 20_000, chunk: int = 4096) -> DataFrame:
    """The k nearest vectors found for each query: query_id, rank, vec_id, score (Euclidean distance in double precision).

    Queries are the ids divisible by `every`; candidates are all rows but the query's own (its id). Both halves of the vectors
    are quantised by k-means, fitted on the `sample` rows first in the order of a hash of the id; every row is indexed under
    its pair of centres. There are as many centres for a half as give cells of 64 entries, 32 to 256 (`centroids`: that many).
    A query visits pairs by summed distance with a heap until they hold a share of all entries, and their entries are reranked
    by exact distance, ties to smaller ids. The share is the one that reaches `recall` on the sample (`visit`: that share), so
    the work for a query follows how well the vectors cluster.

    Entries of a large cell are dealt out over parts of `chunk` rows by a hash of the id, so a vector that a third of all rows
    share is many parts. Driver and tasks hold the centres and one count for each pair, whatever the input.

    Vectors that are null, empty, zero, or hold a null or a component that is not finite take no part, nor do rows without an
    id or with another length than most. An id that repeats is one query, by its smallest vector in the order of components;
    as candidates, repeated rows count each. Fewer than k candidates: all found. No vectors: an empty result. Other columns are
    not looked at.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    good = usable(vectors, key, vector)
    sizes = good.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, rows = sizes["dim"], sizes["n"]
    good = good.where(F.size("v") == dim)
    taught = np.array([r["v"] for r in good.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    half = max(1, dim // 2)
    centroids = centroids or int(np.clip(np.sqrt(rows / 64), 32, 256))
    books = (kmeans(taught[:, :half], centroids), kmeans(taught[:, half:], centroids) if dim > 1 else np.zeros((1, 0)))
    if visit is None:
        visit = share_to_visit(taught, books, k, recall)
    index = scratch.settle(good.mapInArrow(partial(_assign, books=books), "id long, v array<double>, cell int"))
    # A vector that repeats is worth k + 1 entries at most, or its copies would fill a query's share.
    copies = index.groupBy("cell", F.xxhash64("v").alias("same")).agg(F.count("*").alias("n"))
    cells = copies.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.least("n", F.lit(k + 1))).alias("worth")).collect()  # 256 ** 2 rows at most
    counts = {r["cell"]: (r["n"], r["worth"]) for r in cells}
    enough = max(200, int(np.ceil(visit * sum(r["worth"] for r in cells))))
    asked = index.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    queries = asked.mapInArrow(partial(_route, books=books, counts=counts, enough=enough, chunk=chunk), "cell int, part int, id long, v array<double>")
    parts = spark.createDataFrame([(c, -(-n // chunk)) for c, (n, _) in counts.items()], "cell int, parts long")
    entries = index.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), "parts").cast("int")).drop("parts")
    found = queries.groupBy("cell", "part").cogroup(entries.groupBy("cell", "part")).applyInArrow(_searcher(k, dim), FOUND)
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
