"""What the training-data operators share: reading tables, staging, batch sizes, connected components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch at most: texts can be long, and a worker holds a batch whole.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the Arrow batches that go to Python small enough for long texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def is_scan(df: DataFrame) -> bool:
    """Whether the plan only reads, picks and computes columns of files: run again, it gives the same partitions."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() not in ("Project", "Filter") and not plan.nodeName().startswith("LogicalRelation") and not plan.nodeName().startswith("Relation"):
            return False
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    return True


def spread(df: DataFrame) -> DataFrame:
    """Deal a scan of few large row groups out to all cores; a scan that has a partition for each core stays as it is.

    Only files are asked for their partitions: to ask another plan would run its shuffles.
    """
    sc = df.sparkSession.sparkContext
    if is_scan(df) and df._jdf.queryExecution().toRdd().getNumPartitions() >= min(sc.defaultParallelism, 64):
        return df
    return df.repartition(sc.defaultParallelism) if is_scan(df) else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. It is made here only for a local session that names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        set_before = sc._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lakescreen-"))
        found = sc._jsc.sc().getCheckpointDir().get()
    return found


def open_folder(uri: str) -> tuple[filesystems.FileSystem, str]:
    """The file system of a folder, local or shared, and the folder's path there."""
    return filesystems.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove what was staged when the driver ends; results may be read lazily until then."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM may have ended first
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    atexit.register(remove)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_columns_free(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns whose names an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    return [next(f"_{n}{k or ''}" for k in range(len(taken) + 1) if f"_{n}{k or ''}" not in taken) for n in names]


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b) of any one ordered type: rows (node, root), root the least node.

    Alternating large-star and small-star rounds, each a minimum by key and a join back; a round's edges are written to
    the shared folder. A node of very many edges is pre-aggregated for its minimum; minima are written before they are
    joined back, so that such a node can be split there. Nodes without an edge are not returned.
    """
    now = staged(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = staged(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        moved = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = staged(moved.unionByName(least.withColumnRenamed("m", "b")).distinct(), "stars")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
