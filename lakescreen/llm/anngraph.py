"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard, searched by beams.

The largest inner product becomes the least distance by one more component: with ``M`` the largest norm in a shard, a
vector gets ``sqrt(M**2 - |v|**2)`` and a query 0. Equal vectors are one node, which keeps the smallest ids that an answer
can hold, so a vector that a third of all rows have is no crowd. Shards are ranges of norm and, within it, of a hash.

In a shard nodes enter in batches, each twice the one before up to a bound: a greedy search of the graph so far proposes
neighbours; pruning takes the nearest and strikes those that are nearer to it, by a factor, than to the node itself, so
long edges in other directions stay. Edges run back as well, and a node with too many is pruned again. In the end nodes
that the entry does not reach get an edge from one that it does. All of a batch's searches and prunings advance together in
numpy. Each query searches each shard's graph by a beam; answers are scored on the original vectors in double precision.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as filesystems
from pyarrow import parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import open_folder, remove_at_exit, shared_dir, spread, staged
from .topk import _matrix

K = 20
EVERY = 20
#: Nodes of a shard, about; edges of a node; factor of the pruning; widths of the beams that build and that search.
SHARD_NODES, DEGREE, RELAXED, BUILD_BEAM, BEAM = 8192, 32, 1.2, 64, 120
#: Nodes that enter a graph at a time; queries that search at a time; nodes that a beam expands at a step.
ENTER, ASK, STEP = 512, 256, 4
#: Queries of a block in the shared folder; rows of an index that are returned at a time.
QUERY_ROWS, SLICE = 4096, 1024
#: Nodes of the sample that sets each query's bar, at most, and their bytes. The bar is the sample's (SPARE * k)-th best, as a
#: graph may miss some of what reaches it.
SEEDS, SEED_BYTES, SPARE = 4096, 8 << 20, 3


def fit_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v) as double: without null, zero or empty vectors, those with null or non-finite components, and those without an id."""
    v = F.col(embedding).cast("array<double>")
    fit = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(v, lambda c: c != 0)
    return vectors.where(F.coalesce(fit & F.col(vec_id).isNotNull(), F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda c: c + F.lit(0.0)).alias("v"))


# ---- a graph ----------------------------------------------------------------------------------------------------------


class Graph:
    """Nodes with vectors ``x`` (single precision) and, for each, the numbers of its neighbours, -1 where there are fewer."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int):
        self.x, self.edges, self.entry = np.ascontiguousarray(x, np.float32), edges, entry
        self.norm = (self.x * self.x).sum(1)

    def beams(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nodes of its beam, nearest first, and |x|^2 - 2 q.x of each; -1 and infinity where there are fewer.

        A step expands the ``STEP`` nearest nodes of each beam that are not expanded yet; a query ends when there is none.
        """
        n, width = len(q), min(width, len(self.x))
        node = np.full((n, width), -1, np.int32)
        far = np.full((n, width), np.inf, np.float32)
        done = np.ones((n, width), bool)
        node[:, 0], done[:, 0] = self.entry, False
        far[:, 0] = self.norm[self.entry] - 2 * (q @ self.x[self.entry])
        seen = np.zeros((n, len(self.x)), bool)
        seen[:, self.entry] = True
        live = np.arange(n)
        while len(live):
            todo = np.where(done[live], np.inf, far[live])
            pick = np.argpartition(todo, min(STEP, width - 1), axis=1)[:, :STEP] if width > STEP else np.tile(np.arange(width), (len(live), 1))
            open_ = ~np.take_along_axis(done[live], pick, 1)
            going = open_.any(1)
            live, pick, open_ = live[going], pick[going], open_[going]
            if not len(live):
                break
            done[live[:, None], pick] = True
            from_ = np.where(open_, node[live[:, None], pick], -1)
            to = np.where(from_[..., None] >= 0, self.edges[from_], -1).reshape(len(live), -1)
            # Of a neighbour that comes twice in a step, the first counts.
            to.sort(axis=1)
            new = (to >= 0) & ~seen[live[:, None], to]
            new[:, 1:] &= to[:, 1:] != to[:, :-1]
            most = int(new.sum(1).max())
            if not most:
                continue
            order = np.argsort(~new, axis=1, kind="stable")[:, :most]
            to, new = np.take_along_axis(to, order, 1), np.take_along_axis(new, order, 1)
            seen[live[:, None], np.where(new, to, self.entry)] = True
            away = self.norm[to] - 2 * np.matmul(self.x[to], q[live][:, :, None])[..., 0]
            away[~new] = np.inf
            all_far = np.concatenate([far[live], away], 1)
            keep = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            far[live] = np.take_along_axis(all_far, keep, 1)
            node[live] = np.take_along_axis(np.concatenate([node[live], np.where(new, to, -1)], 1), keep, 1)
            done[live] = np.take_along_axis(np.concatenate([done[live], ~new], 1), keep, 1)
        order = np.lexsort((node, far))
        return np.take_along_axis(node, order, 1), np.take_along_axis(far, order, 1)


def pruned(x: np.ndarray, of: np.ndarray, near: np.ndarray, degree: int, relaxed: float = RELAXED) -> np.ndarray:
    """Neighbours of the nodes ``of`` from candidates ``near`` (a row each; -1 is none): the nearest is taken, those go that are
    nearer to it, by the factor, than to the node, and so on."""
    out = np.full((len(of), degree), -1, np.int32)
    near = np.sort(near, axis=1)
    alive = (near >= 0) & (near != of[:, None])
    alive[:, 1:] &= near[:, 1:] != near[:, :-1]
    c = x[near]
    norm = (c * c).sum(2)
    away = np.maximum(norm + (x[of] ** 2).sum(1)[:, None] - 2 * np.matmul(c, x[of][:, :, None])[..., 0], 0)
    between = np.maximum(norm[:, :, None] + norm[:, None] - 2 * np.matmul(c, c.transpose(0, 2, 1)), 0)
    rows = np.arange(len(of))
    for k in range(degree):
        todo = np.where(alive, away, np.inf)
        best = todo.argmin(1)
        there = np.isfinite(todo[rows, best])
        if not there.any():
            break
        out[there, k] = near[rows, best][there]
        alive &= relaxed * relaxed * between[rows, best] > away
        alive[rows, best] = False
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED) -> Graph:
    """The graph of all rows of ``x``. Rows enter in the order given; the entry is the one nearest to the mean."""
    n = len(x)
    x = np.ascontiguousarray(x, np.float32)
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    graph = Graph(x, np.full((n, degree), -1, np.int32), entry)
    order = np.r_[entry, np.delete(np.arange(n), entry)]
    at = 1
    while at < n:
        new = order[at : at + min(at, ENTER)]
        for part in np.array_split(new, -(-len(new) // ASK)):
            near, _ = graph.beams(x[part], beam)
            graph.edges[part] = pruned(x, part, near, degree, relaxed)
        _run_back(graph, new, degree, relaxed)
        at += len(new)
    _reach_all(graph)
    return graph


def _run_back(graph: Graph, new: np.ndarray, degree: int, relaxed: float) -> None:
    """Edges to the new nodes from their neighbours; who gets too many is pruned."""
    to = graph.edges[new]
    back = np.stack([to.ravel(), np.repeat(new, degree)], 1)[to.ravel() >= 0]
    back = back[np.argsort(back[:, 0], kind="stable")]
    owner, start, count = np.unique(back[:, 0], return_index=True, return_counts=True)
    place = np.arange(len(back)) - np.repeat(start, count)
    added = np.full((len(owner), int(count.max(initial=0))), -1, np.int32)
    added[np.repeat(np.arange(len(owner)), count), place] = back[:, 1]
    have = graph.edges[owner]
    total = (have >= 0).sum(1) + count
    for few in (True, False):
        rows = np.flatnonzero((total <= degree) == few)
        # Owners of like numbers go together, so that no wide row makes all rows wide.
        for part in np.array_split(rows[np.argsort(count[rows], kind="stable")], max(1, -(-len(rows) // ASK))):
            if not len(part):
                continue
            both = np.concatenate([have[part], added[part, : count[part].max()]], 1)
            if few:
                both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
                graph.edges[owner[part]] = np.pad(both, ((0, 0), (0, degree - both.shape[1])), constant_values=-1)
            else:
                graph.edges[owner[part]] = pruned(graph.x, owner[part], both, degree, relaxed)


def _reached(graph: Graph) -> np.ndarray:
    seen = np.zeros(len(graph.x), bool)
    at = np.array([graph.entry])
    while len(at):
        seen[at] = True
        to = np.unique(graph.edges[at])
        at = to[(to >= 0) & ~seen[np.maximum(to, 0)]]
    return seen


def _reach_all(graph: Graph) -> None:
    """Nodes that no path from the entry leads to get an edge from the nearest node that one leads to, and so stay findable."""
    while not (seen := _reached(graph)).all():
        lost = np.flatnonzero(~seen)
        near = np.concatenate([graph.beams(graph.x[part], 1)[0] for part in np.array_split(lost, -(-len(lost) // ASK))])[:, 0]
        # One more edge for each node that is to lead on; rows grow where there is no room.
        from_, first = np.unique(near, return_index=True)
        room = np.argmin(graph.edges[from_], axis=1)
        if (graph.edges[from_, room] >= 0).any():
            graph.edges = np.pad(graph.edges, ((0, 0), (0, 1)), constant_values=-1)
            room = np.argmin(graph.edges[from_], axis=1)
        graph.edges[from_, room] = lost[first]


# ---- shards -----------------------------------------------------------------------------------------------------------

INDEX = "part int, d int, level int, node long, entry boolean, v array<double>, ids array<long>, edges array<int>"
#: Columns that name a graph.
GRAPH = ("part", "d", "level")


def nodes(held: DataFrame, most_ids: int) -> DataFrame:
    """(v, ids): each vector once, with its ``most_ids`` smallest ids."""
    order = Window.partitionBy("v").orderBy("vec_id")
    first = held.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= most_ids)
    return first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def index(vectors: DataFrame, most_ids: int = K + 1, shard_nodes: int = SHARD_NODES, degree: int = DEGREE, beam: int = BUILD_BEAM) -> DataFrame:
    """The index of rows (vec_id, v), a row for each node (``INDEX``), to be searched or written to a table.

    Shards are ranges of length, level and hash, a task each. A level holds norms within a factor of two, and has a graph
    of its own: beside a far larger norm, vectors could not be told apart.
    """
    largest = F.array_max(F.transform("v", F.abs))
    square = F.aggregate(F.transform("v", lambda c: c / largest), F.lit(0.0), lambda s, c: s + c * c)
    level = F.floor(F.log2(largest) + F.log2(square) / 2 + 0.5).cast("int")  # norms of about 1 are in the middle of one
    every = staged(nodes(vectors, most_ids).withColumn("level", level), "nodes")
    shards = max(1, -(-every.count() // shard_nodes))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # a shard
        if not any(b.num_rows for b in held):
            return
        shard = pa.Table.from_batches(held).combine_chunks()
        shard = shard.take(pa.array(np.argsort(shard.column("order").to_numpy(), kind="stable"))).combine_chunks()
        levels = shard.column("level").to_numpy()
        for rows, v in _matrix(shard.column("v").combine_chunks()):
            for one in np.unique(levels[rows]):
                yield from rows_of(shard, rows[levels[rows] == one], v[levels[rows] == one])

    def rows_of(shard: pa.Table, rows: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
        graph = build(augmented(v, norms(v).max()), degree, beam)
        for at in np.array_split(np.arange(len(v)), -(-len(v) // SLICE)):
            own = shard.take(pa.array(rows[at]))
            edges = pa.array([e[e >= 0] for e in graph.edges[at]], pa.list_(pa.int32()))
            columns = [own.column("part"), pa.array(np.full(len(at), v.shape[1], np.int32)), own.column("level"), pa.array(at), pa.array(at == graph.entry), own.column("v"), own.column("ids"), edges]
            yield from pa.table(columns, ["part", "d", "level", "node", "entry", "v", "ids", "edges"]).to_batches()

    hashed = F.xxhash64("v")
    dealt = every.repartitionByRange(shards, F.size("v"), "level", hashed).select(F.spark_partition_id().alias("part"), "level", "v", "ids", hashed.alias("order"))
    return dealt.mapInArrow(grow, INDEX)


def norms(v: np.ndarray) -> np.ndarray:
    """Lengths of vectors without zero ones, whatever their size."""
    most = np.abs(v).max(1)
    return most * np.sqrt(((v / most[:, None]) ** 2).sum(1))


def augmented(v: np.ndarray, norm: float) -> np.ndarray:
    """Vectors over the largest norm, with the component that makes nearness the inner product."""
    v = v / norm
    return np.c_[v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1)))].astype(np.float32)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products, row by row, summed from the first component to the last: the same for equal vectors wherever they are."""
    total = np.zeros(len(q))
    for k in range(q.shape[1]):
        total += q[:, k] * v[:, k]
    return total


def bars(seed_ids: np.ndarray, seeds: np.ndarray, asked: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's best answers reach, from some rows; none of its own id counts. A little lower, for rounding."""
    if len(seeds) <= SPARE * k:
        return np.full(len(q), -np.inf)
    score = np.where(asked[:, None] == seed_ids[None], -np.inf, q @ seeds.T)
    best = np.partition(score, -SPARE * k, axis=1)[:, -SPARE * k]
    return best - 1e-9 * norms(q) * norms(seeds).max()


def barred(queries: DataFrame, indexed: DataFrame, k: int) -> DataFrame:
    """``queries`` with their bars, so that a shard returns no rows that cannot be among the best."""
    widest = indexed.agg(F.max("d")).first()[0] or 1
    sample = indexed.select("v", "ids").orderBy(F.xxhash64("v"), "v").limit(max(1, min(SEEDS, SEED_BYTES // (8 * widest))))
    known = queries.sparkSession.sparkContext.broadcast(sample.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = known.value.combine_chunks()
        ids = held.column("ids").to_pylist()
        by_size = {}
        for rows, v in _matrix(held.column("v").combine_chunks()) if held.num_rows else []:
            sizes = [len(ids[r]) for r in rows]
            by_size[v.shape[1]] = np.concatenate([ids[r] for r in rows]), np.repeat(v, sizes, axis=0)
        for batch in batches:
            bar, asked = np.full(batch.num_rows, -np.inf), batch.column("vec_id").to_numpy()
            for rows, q in _matrix(batch.column("v")) if batch.num_rows else []:
                if q.shape[1] in by_size:
                    bar[rows] = bars(*by_size[q.shape[1]], asked[rows], q, k)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(bar)], ["vec_id", "v", "bar"])

    return queries.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<double>, bar double")


def answers(graph: Graph, v: np.ndarray, ids: list[np.ndarray], asked: np.ndarray, q: np.ndarray, bar: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query_id, vec_id, score): the k best of a shard for each query, none with its own id, none below its bar."""
    directions = np.c_[q / norms(q)[:, None], np.zeros(len(q))].astype(np.float32)
    found, _ = graph.beams(directions, beam)
    row, _ = np.nonzero(found >= 0)
    node = found[found >= 0]
    score = scores(q[row], v[node])
    sizes = np.array([len(ids[n]) for n in node], np.int64)
    row, score, vec = np.repeat(row, sizes), np.repeat(score, sizes), np.concatenate([ids[n] for n in node])
    keep = (vec != asked[row]) & (score >= bar[row])
    row, score, vec = row[keep], score[keep], vec[keep]
    order = np.lexsort((vec, -score, row))
    row, score, vec = row[order], score[order], vec[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return asked[row[best]], vec[best], score[best]


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a partition that is in order of part, d, level and node, a table for each graph."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in GRAPH], 1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)]
        for start, end in zip(cuts, cuts[1:], strict=False):
            part = batch.slice(start, end - start)
            if held and part.num_rows and any(held[0].column(c)[0] != part.column(c)[0] for c in GRAPH):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            if part.num_rows:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def search(indexed: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row (vec_id, v) of ``queries``, from an index.

    Queries lie in the shared folder in blocks; a task holds a shard's graph and reads the blocks of its length one by one.
    """
    spark = queries.sparkSession
    asked = staged(barred(queries, indexed, k), "asked")
    blocks = max(1, -(-asked.count() // query_rows))
    folder = f"{shared_dir(spark).rstrip('/')}/staged/ann-queries-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).repartition("block").write.partitionBy("block").parquet(folder)
    shards = indexed.select("part").distinct().count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _by_shard(batches):
            v = np.asarray(shard.column("v").combine_chunks().flatten(), float).reshape(shard.num_rows, -1)
            lists = shard.column("edges").to_pylist()
            edges = np.full((len(v), max(1, max(map(len, lists)))), -1, np.int32)
            for row, e in zip(edges, lists, strict=True):
                row[: len(e)] = e
            graph = Graph(augmented(v, norms(v).max()), edges, int(np.argmax(shard.column("entry").to_numpy())))
            ids = [np.array(i, np.int64) for i in shard.column("ids").to_pylist()]
            for block in range(blocks):
                query_ids, q, bar = _block(f"{folder}/block={block}").get(v.shape[1], ((), (), ()))
                for at in range(0, len(query_ids), ASK):
                    part = slice(at, at + ASK)
                    columns = answers(graph, v, ids, query_ids[part], q[part], bar[part], k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    dealt = indexed.repartition(max(1, shards), "part").sortWithinPartitions(*GRAPH, "node")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _block(folder: str) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and bars of a block's queries, by length."""
    system, path = open_folder(folder)
    if system.get_file_info(path).type == filesystems.FileType.NotFound:
        return {}
    names = [f.path for f in system.get_file_info(filesystems.FileSelector(path)) if f.path.endswith(".parquet")]
    rows = pa.concat_tables(parquet.ParquetFile(system.open_input_file(n)).read() for n in names).combine_chunks()
    ids, bar = rows.column("vec_id").to_numpy(), rows.column("bar").to_numpy()
    return {m.shape[1]: (ids[at], m, bar[at]) for at, m in _matrix(rows.column("v").combine_chunks())}


def op12_digest(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose vec_id is divisible by ``every``, the k nearest others found.

    Nearness is the largest inner product; ties go to the smaller vec_id. Null, zero and empty vectors, those with null or
    non-finite components, and rows without vec_id take no part; vectors are compared with those of equal length. Every row
    is indexed: of more than k + 1 rows with one vector, those of the smallest ids stand for it, as no others can be in an
    answer. Rows repeated in vec_id and vector are one; a repeated query asks once, with its vector of the least hash, and
    no row is a candidate for its own vec_id. An empty table gives no rows. Columns other than vec_id and embedding are not
    looked at. Where all candidates are fewer than k, all are returned, as a beam then holds a whole shard.
    """
    held = staged(fit_vectors(spread(vectors)), "vectors")
    asked = held.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))
    return search(staged(index(held, k + 1), "graph"), asked, k)
