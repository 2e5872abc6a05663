"""Exact top-k by inner product: multi-resolution segment statistics bound distances, coarse to fine.

A vector is cut into segments; over each, the squared distance of two vectors is at least
size * ((difference of means)**2 + (difference of deviations)**2). With |q - v|**2 = |q|**2 + |v|**2 - 2 q.v, a bound from
below on the distance bounds the inner product from above. A candidate whose bound at some resolution is under the query's
bar goes no further; those that survive all resolutions get their exact score. The bar is the query's k-th best exact
score so far; it starts from a sample of the rows, so bounds already spare a task's first candidates.

Vectors without a telling order of components, such as independent ones of equal size, need fine segments: 4 and 16 of
64 components spare nothing there, 32 about three pairs in four, 48 all but a few in a hundred.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyarrow import fs as filesystems
from pyarrow import parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_folder, remove_at_exit, shared_dir, spread, staged

K = 5
EVERY = 50
SCALE = 256
#: Segments for each component, coarse to fine.
RESOLUTIONS = (1 / 16, 1 / 4, 1 / 2, 3 / 4)
#: Queries that a task holds at once, candidates that it holds, and candidates compared at a time.
QUERY_ROWS, CHUNK, BLOCK = 2048, 1 << 16, 1024
#: Rows of the sample that sets the first bars.
SEEDS = 4096
#: Below this, sums of products are exact in double precision.
EXACT = 2.0**53


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, x as double. Vectors with null or non-finite components go."""
    x = F.col(embedding).cast("array<double>")
    fit = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(fit).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * scale).cast("double")).alias("v"))


def statistics(v: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each segment's size and, by vector, its mean and deviation times the root of its size."""
    cuts = np.linspace(0, v.shape[1], min(segments, v.shape[1]) + 1).astype(int)
    size = np.diff(cuts).astype(float)
    mean = np.add.reduceat(v, cuts[:-1], axis=1) / size
    square = np.add.reduceat(v * v, cuts[:-1], axis=1) / size
    return size, mean * np.sqrt(size), np.sqrt(np.maximum(square - mean * mean, 0)) * np.sqrt(size)


def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a from all rows of b."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of q with all of v; beyond double precision, by whole numbers, held within 64 bits."""
    if np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * q.shape[1] < EXACT:
        return (q @ v.T).astype(np.int64)
    whole = [[sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for y in v] for x in q]
    return np.array([[max(-(2**63), min(2**63 - 1, s)) for s in row] for row in whole], np.int64).reshape(len(q), len(v))


def bars(ids: np.ndarray, q: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the seeds, none with its own id; the least number without k of them."""
    out = np.full(len(ids), -(2**63), np.int64)
    if len(seeds) > k:
        score = np.where(ids[:, None] == seed_ids[None], -(2**63), _exact(q, seeds))
        out = np.partition(score, -k, axis=1)[:, -k]
    return out


class Best:
    """The k best (score, vec_id) of each query so far; ``bar``: scores that the k-th best reaches anyhow."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, bar: np.ndarray | None = None):
        self.ids, self.q, self.k = ids, q, k
        self.bar = np.full(len(ids), -(2**63), np.int64) if bar is None else bar
        self.norm = (q * q).sum(1)
        self.cuts = sorted({max(1, round(q.shape[1] * share)) for share in RESOLUTIONS}) if q.shape[1] else []
        self.levels = [statistics(q, n) for n in self.cuts]
        self.score = np.full((len(ids), k), -(2**63), np.int64)
        self.vec = np.full((len(ids), k), 2**63 - 1, np.int64)
        self.filled = np.zeros(len(ids), int)
        self.exact = 0  # pairs that no bound has spared

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        for at in range(0, len(ids), BLOCK):
            self._see(ids[at : at + BLOCK], v[at : at + BLOCK])

    def _see(self, ids: np.ndarray, v: np.ndarray) -> None:
        bar = np.maximum(self.bar, np.where(self.filled >= self.k, self.score[:, -1], -(2**63))).astype(float)
        rows, columns = np.arange(len(self.ids)), np.arange(len(ids))
        norm = (v * v).sum(1)
        alive = self.ids[:, None] != ids[None]
        for n, (_, mean, deviation) in zip(self.cuts, self.levels, strict=True):
            # Only queries and candidates that have a pair left are looked at more closely.
            rows, columns = rows[alive.any(1)], columns[alive.any(0)]
            alive = alive[np.ix_(alive.any(1), alive.any(0))]
            if not alive.size:
                return
            most = (self.norm[rows][:, None] + norm[columns][None]) / 2
            _, m, d = statistics(v[columns], n)
            bound = most - (_gap(mean[rows], m) + _gap(deviation[rows], d)) / 2
            alive &= bound + 1e-9 * (most + 1) >= bar[rows][:, None]
        at, of = np.nonzero(alive)
        if not len(at):
            return
        self.exact += len(at)
        scores = _exact(self.q[rows], v[columns])
        alive &= scores >= bar[rows][:, None]
        for block in np.array_split(np.arange(len(rows)), max(1, len(rows) // 64)):
            at, of = np.nonzero(alive[block])
            if not len(at):
                continue
            mine = rows[block[at]]
            own = np.unique(mine)
            q_all = np.r_[np.repeat(own, self.k), mine]
            s_all, v_all = np.r_[self.score[own].ravel(), scores[block[at], of]], np.r_[self.vec[own].ravel(), ids[columns[of]]]
            order = np.lexsort((v_all, ~s_all, q_all))  # ~s falls as s rises, without overflow
            q_all, s_all, v_all = q_all[order], s_all[order], v_all[order]
            take = np.searchsorted(q_all, own)[:, None] + np.arange(self.k)
            self.score[own], self.vec[own] = s_all[take], v_all[take]
            self.filled[own] = np.minimum(self.k, self.filled[own] + np.bincount(np.searchsorted(own, mine), minlength=len(own)))

    def rows(self) -> list[np.ndarray]:
        q, k = np.nonzero(np.arange(self.k) < self.filled[:, None])
        return [self.ids[q], self.vec[q, k], self.score[q, k]]


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Rows and their vectors, by length."""
    sizes = np.asarray(pa.compute.list_value_length(column), dtype=np.int64)
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, flat[(ends - sizes)[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))))
    return out


def _queries(folder: str, block: int, k: int) -> dict[int, Best]:
    """The queries of a block, by length, ready to see candidates."""
    system, path = open_folder(f"{folder}/block={block}")
    if system.get_file_info(path).type == filesystems.FileType.NotFound:
        return {}
    names = [f.path for f in system.get_file_info(filesystems.FileSelector(path)) if f.path.endswith(".parquet")]
    rows = pa.concat_tables(parquet.ParquetFile(system.open_input_file(n)).read() for n in names).combine_chunks()
    ids, bar = rows.column("vec_id").to_numpy(), rows.column("bar").to_numpy()
    return {m.shape[1]: Best(ids[at], m, k, bar[at]) for at, m in _matrix(rows.column("v").combine_chunks())}


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def search(vectors: DataFrame, every: int = EVERY, k: int = K, query_rows: int = QUERY_ROWS, seeds: int = SEEDS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by ``every``, the k best others.

    Score: integer inner product; ties go to the smaller vec_id. Vectors are compared with those of equal length; null
    ones, those with null or non-finite components, and those without vec_id take no part; very long ones are as others.
    Rows repeated with one vec_id are candidates one by one, and no row is a candidate for its own vec_id; a repeated query
    asks once, with its vector of the least hash. An empty table gives no rows. Columns other than vec_id and embedding
    are not looked at. Queries lie in the shared folder in blocks of about ``query_rows``; a task holds a chunk of the
    candidates and reads the blocks one by one. ``seeds`` rows, those of the least hashes, only set the first bars.
    """
    spark = vectors.sparkSession
    held = staged(integers(spread(vectors)), "vectors")
    asked = held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    sample = spark.sparkContext.broadcast(held.orderBy(F.xxhash64("vec_id", "v")).limit(seeds).toArrow())

    def barred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sample.value.combine_chunks()
        seed_ids = known.column("vec_id").to_numpy()
        by_size = {m.shape[1]: (seed_ids[rows], m) for rows, m in _matrix(known.column("v").combine_chunks())} if known.num_rows else {}
        for batch in batches:
            bar, ids = np.full(batch.num_rows, -(2**63), np.int64), batch.column("vec_id").to_numpy()
            for rows, m in _matrix(batch.column("v")) if batch.num_rows else []:
                if m.shape[1] in by_size:
                    bar[rows] = bars(ids[rows], m, *by_size[m.shape[1]], k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bar)], ["vec_id", "v", "bar"])

    ready = staged(asked.mapInArrow(barred, "vec_id bigint, v array<double>, bar bigint"), "queries")
    blocks = max(1, -(-ready.count() // query_rows))
    folder = f"{shared_dir(spark).rstrip('/')}/staged/query-blocks-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    ready.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, CHUNK):
            own = chunk.column("vec_id").to_numpy()
            candidates = _matrix(chunk.column("v").combine_chunks())
            for block in range(blocks):
                best = _queries(folder, block, k)
                for rows, m in candidates:
                    if m.shape[1] in best:
                        best[m.shape[1]].see(own[rows], m)
                for b in best.values():
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in b.rows()], ["query_id", "vec_id", "score"])

    found = held.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


OP6_SQL = """
with held as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, h.vec_id, list_inner_product(q.v, h.v)::bigint as score
  from held q join held h on q.vec_id % 50 = 0 and q.vec_id <> h.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
