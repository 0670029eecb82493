"""Exact top-k inner-product search by pivot-table elimination.

The table holds, for each vector, what its distances to all pivots say: d(c, p) for many pivots p fixes c's coordinates y(c) in
the pivots' span and the length r(c) of the part outside it.  The greatest lower bound on the distance that holds for all vectors with these
distances is |q - c|^2 >= |y(q) - y(c)|^2 + (r(q) - r(c))^2, so the least upper bound on the score is y(q).y(c) + r(q) r(c).  (The
bound by single pivots, the largest |d(q, p) - d(c, p)|, leaves 98 % of these vectors open; this one leaves about 1 %.)
Candidates are evaluated in the order of the bound until it falls below the k-th best score found, which makes the search exact.

1. Pivots: of ``SAMPLE`` rows (those of smallest hash, a documented sample) each time the one farthest from the span of those
   chosen.  Any pivots give the same result.  They are a table of fixed size.
2. Vectors are range-partitioned by (nearest of the first ``CELLS`` pivots, distance to it), so that neighbours share a block; a hot cell
   spans many blocks of at most ``ROWS`` vectors.  The blocked table is stored.
3. Each query searches its own block; its k-th best score there is a threshold.
4. Queries go to the blocks of those cells whose bound reaches the threshold.  Rows of one block arrive sorted, vectors
   first, so that a task holds one block and streams the queries past it.
5. The best k of each query's partial results.

Scores are inner products of floor(scale * x), exact whole numbers (clipped to 64 bits).  Vectors that are NULL or hold NULL, NaN or
infinite components take no part; shorter vectors count as padded with zeros.  A NULL vec_id sorts before all others and is never a
query.  Rows that repeat a vec_id are different candidates; a query leaves out only its own row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sluice.llm.base import as_batch, from_key, id_key, query, table
from sluice.session import stored

PIVOTS = 48
CELLS = 16
SAMPLE = 1024
ROWS = 4096
# Queries whose bounds are computed together.
TOGETHER = 128
# Candidates evaluated between two looks at the bound.
STEP = 128
# Queries that may stream past one copy of a block; beyond it the block is sent more than once.
QUERIES_PER_COPY = 500_000

_EXACT = float(1 << 53)
_HIT = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max()) if len(lengths) else 0
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    at = np.repeat(np.arange(len(lengths)), lengths)
    out[at, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _wide(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def pivots(vectors: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Independent rows, each far from the span of those before it, among a fixed number of rows."""
    rows = vectors.orderBy(F.xxhash64("vec_id", "v"), "v").limit(sample).select("v").toArrow()
    m = _matrix(rows.column("v"))
    if not m.size:
        return np.zeros((0, 0))
    chosen, left = [], m.copy()
    smallest = 1e-3 * max(1.0, float(np.linalg.norm(m, axis=1).max()))
    for _ in range(count):
        far = np.linalg.norm(left, axis=1)
        best = int(far.argmax())
        if not far[best] > smallest:
            break
        chosen.append(best)
        axis = left[best] / far[best]
        left = left - np.outer(left @ axis, axis)
    return m[chosen]


def _tabulate(pivot: np.ndarray):
    """Adds y, r, cell, the distance to the cell's pivot and the squared norm."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inverse = np.linalg.inv(np.linalg.cholesky(pivot @ pivot.T)) if len(pivot) else np.zeros((0, 0))
        own = np.einsum("ij,ij->i", pivot, pivot)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("v"))
            width = max(m.shape[1], pivot.shape[1])
            m, p = _wide(m, width), _wide(pivot, width)
            norm = np.einsum("ij,ij->i", m, m)
            squared = np.maximum(norm[:, None] + own - 2 * (m @ p.T), 0.0)  # of the distances
            y = ((norm[:, None] + own - squared) / 2) @ inverse.T
            r = np.sqrt(np.maximum(norm - np.einsum("ij,ij->i", y, y), 0.0))
            first = squared[:, :CELLS]
            cell = first.argmin(axis=1) if first.shape[1] else np.zeros(len(m), np.int64)
            near = np.sqrt(first[np.arange(len(m)), cell]) if first.shape[1] else np.zeros(len(m))
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.array(list(y), pa.list_(pa.float64())), pa.array(r),
                                   pa.array(cell, pa.int32()), pa.array(near), pa.array(norm)],
                                  names=["vec_id", "v", "y", "r", "cell", "near", "norm"])

    return add


def upper_bounds(q: dict, block: dict) -> np.ndarray:
    """Queries by candidates: no score is greater; rounding is paid for by a margin."""
    size = np.sqrt(q["norm"])[:, None] * np.sqrt(block["norm"])
    return q["y"] @ block["y"].T + q["r"][:, None] * block["r"] + 1e-6 * (1.0 + size)


def _exact(m: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers."""
    width = max(m.shape[1], len(q))
    m, q = _wide(m, width), np.pad(q, (0, width - len(q)))
    if not len(m) or float((np.abs(m) @ np.abs(q)).max()) < _EXACT:
        return (m @ q).astype(np.int64)
    whole = [int(x) for x in q]
    sums = [sum(int(a) * b for a, b in zip(row, whole, strict=True)) for row in m]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in sums], np.int64)


def search(block: dict, bound: np.ndarray, q: np.ndarray, own: int, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the candidates of a block that can be among the k best; ``least``: a known k-th best score."""
    open_ = np.flatnonzero(bound >= least) if least is not None else np.arange(len(bound))
    open_ = open_[block["row"][open_] != own]
    open_ = open_[np.argsort(-bound[open_], kind="stable")]
    places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for a in range(0, len(open_), STEP):
        if len(scores) == k and bound[open_[a]] < scores[-1]:
            break
        new = open_[a:a + STEP]
        found = _exact(block["v"][new], q)
        if least is not None:
            good = found >= least
            new, found = new[good], found[good]
        places, scores = np.concatenate([places, new]), np.concatenate([scores, found])
        best = np.lexsort((block["vec_id"][places], -scores))[:k]
        places, scores = places[best], scores[best]
    return places, scores


def _arrays(t: pa.Table | pa.RecordBatch) -> dict:
    return {"v": _matrix(t.column("v")), "y": _matrix(t.column("y")), "r": t.column("r").to_numpy(), "norm": t.column("norm").to_numpy()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, pa.RecordBatch | None]]:
    """Rows sorted by (key, asks): yields (block, its vectors' batch) once per block, then (block, batch of queries)."""
    key, held, block = None, [], {}

    def build() -> dict:
        t = pa.Table.from_batches(held).combine_chunks()
        return _arrays(t) | {"row": t.column("row").to_numpy(), "vec_id": t.column("vec_id").to_numpy()}

    for batch in batches:
        keys, asks = batch.column("key").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(np.int8)
        cuts = np.flatnonzero((np.diff(keys) != 0) | (np.diff(asks) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if a == b:
                continue
            if keys[a] != key:
                key, held, block = keys[a], [], {}
            if not asks[a]:
                held.append(batch.slice(a, b - a))
            elif held:
                if not block:
                    block = build()
                yield block, batch.slice(a, b - a)


def _finder(k: int, only_least: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, asked in _blocks(batches):
            out: list[list] = [[], [], [], []]
            for start in range(0, asked.num_rows, TOGETHER):
                part = asked.slice(start, TOGETHER)
                q = _arrays(part)
                bounds = upper_bounds(q, block)
                for i, (row, qid, least) in enumerate(zip(*(part.column(n).to_pylist() for n in ("row", "vec_id", "least")), strict=True)):
                    places, scores = search(block, bounds[i], q["v"][i], row, k, least)
                    if only_least:
                        if len(scores) == k:
                            for column, value in zip(out, (row, qid, None, int(scores[-1])), strict=True):
                                column.append(value)
                        continue
                    out[0] += [row] * len(places)
                    out[1] += [qid] * len(places)
                    out[2] += block["vec_id"][places].tolist()
                    out[3] += scores.tolist()
            yield as_batch(_HIT, *out)

    return find


def _router(lows: np.ndarray, highs: np.ndarray, rest: np.ndarray, norms: np.ndarray, cells: np.ndarray):
    """Adds the cells that may hold a score of at least ``least``, by bounds from the ranges of each cell's coordinates."""
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _arrays(batch)
            wanted = []
            for i, least in enumerate(batch.column("least").to_pylist()):
                bound = (np.maximum(q["y"][i] * lows, q["y"][i] * highs).sum(axis=1) + q["r"][i] * rest
                         + 1e-6 * (1.0 + np.sqrt(q["norm"][i] * norms)))
                wanted.append(cells[bound >= least].tolist() if least is not None else cells.tolist())
            yield pa.record_batch([*batch.columns, pa.array(wanted, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    return route


_COLUMNS = ["row", "vec_id", "v", "y", "r", "norm"]


def _streamed(vectors: DataFrame, asked: DataFrame, k: int, only_least: bool) -> DataFrame:
    """Vectors (key + columns) and queries (key, least + columns) brought together by block."""
    sides = [vectors.select("key", F.lit(False).alias("asks"), *_COLUMNS, F.lit(None).cast("bigint").alias("least")),
             asked.select("key", F.lit(True).alias("asks"), *_COLUMNS, "least")]
    return (sides[0].unionByName(sides[1]).repartition("key").sortWithinPartitions("key", "asks")
            .mapInArrow(_finder(k, only_least), "row long, query_id long, vec_id long, score long"))


def top_k(vectors: DataFrame, asks: Column, k: int, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) for which ``asks`` holds."""
    x = F.col("embedding").cast("array<double>")
    sound = F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))), F.lit(False))
    whole = (vectors.select(id_key("vec_id").alias("vec_id"), F.col("embedding")).filter(sound)
             .select("vec_id", F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("double")).alias("v")))
    pivot = pivots(whole)
    tabled = whole.mapInArrow(_tabulate(pivot), "vec_id long, v array<double>, y array<double>, r double, cell int, near double, norm double")
    placed = tabled.repartitionByRange("cell", "near", "vec_id").sortWithinPartitions("cell", "near", "vec_id")
    # Row numbers begin anew in each partition, above its number in the upper bits: a block never spans two.
    blocked = stored(placed.withColumn("row", F.monotonically_increasing_id())
                     .withColumn("block", F.expr(f"(row div {ROWS}) * {CELLS} + cell")))
    queries = blocked.filter(asks & (F.col("vec_id") != F.lit(-(1 << 63))))
    own = queries.withColumn("least", F.lit(None).cast("bigint"))
    least = _streamed(blocked.withColumnRenamed("block", "key"), own.withColumnRenamed("block", "key"), k, True).select(
        F.col("row"), F.col("score").alias("least"))
    known = stored(queries.join(least, "row", "left"))
    # A row per cell: the ranges of its coordinates.
    spread = [F.min(F.element_at("y", i + 1)).alias(f"a{i}") for i in range(len(pivot))] + [
        F.max(F.element_at("y", i + 1)).alias(f"b{i}") for i in range(len(pivot))]
    ranges = blocked.groupBy("cell").agg(*spread, F.max("r").alias("r"), F.max("norm").alias("norm")).collect()
    cells = np.array([x["cell"] for x in ranges], np.int32)
    lows, highs = (np.array([[x[f"{side}{i}"] for i in range(len(pivot))] for x in ranges]).reshape(len(ranges), len(pivot)) for side in "ab")
    rest, norms = (np.array([x[n] for x in ranges], float) for n in ("r", "norm"))
    copies = max(1, -(-known.count() // QUERIES_PER_COPY))
    spots = blocked.select("cell", "block").distinct()
    routed = known.select(*_COLUMNS, "least").mapInArrow(
        _router(lows, highs, rest, norms, cells),
        "row long, vec_id long, v array<double>, y array<double>, r double, norm double, least long, cells array<int>")
    copy = F.pmod(F.xxhash64("row"), F.lit(copies))
    asked = (routed.withColumn("cell", F.explode("cells")).join(spots, "cell")
             .withColumn("key", F.col("block") * copies + copy))
    spread_out = (blocked.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
                  .withColumn("key", F.col("block") * copies + F.col("copy")))
    hits = _streamed(spread_out, asked, k, False)
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return (hits.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), from_key(F.col("vec_id")).alias("vec_id"), "score"))


SQL = """
WITH e AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op1_topk_search", SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
