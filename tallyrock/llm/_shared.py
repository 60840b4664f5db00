"""Shared tables, running totals and connected components, all as Spark jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    A session that names none gets one of its own where everything runs on this machine (as in
    tests); on a cluster it is an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read again: lineage ends there,
    and a lost executor costs only the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``saved`` that no later step reads."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Columns of ``keyed``.
ROW = ["_row_file", "_row_at"]


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key of their own, ``ROW``: a hash of the file's path, and the row's number in it.

    It is the same each time the table is read, whatever doc_ids repeat or are null. A table that
    does not come straight from Parquet files is written to the shared folder for it."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = saved(docs, "keyed")
    meta = docs.metadataColumn("_metadata")
    return docs.withColumns({ROW[0]: F.xxhash64(meta["file_path"]), ROW[1]: meta["row_index"]})


#: Rows of an Arrow batch of texts, which Spark also keeps to spark.sql.execution.arrow.maxBytesPerBatch;
#: a batch is held by the JVM and by Python at the same time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Keep batches of texts to ``BATCH_ROWS`` rows in this session, if it allows larger ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def running_totals(df: DataFrame, order: list[str], sizes: dict[str, str], name: str) -> DataFrame:
    """Add for each ``{new: size}`` column the total of ``size`` over all rows before a row.

    The order is total over ``order`` (ties are broken arbitrarily but once for all). Rows are
    range-partitioned and sorted, each task sums its own rows while the table is written once,
    and one small row for each partition carries the totals of the partitions before it. No
    task sees more than its range; a hot leading key is split as long as ``order`` ends in an id.
    Null sizes count as 0. The columns of ``df`` should be narrow: no texts."""
    spark = df.sparkSession
    names = list(sizes)
    out = T.StructType(df.schema.fields + [T.StructField(n, T.LongType()) for n in names] + [T.StructField("_part", T.IntegerType()), T.StructField("_last", T.BooleanType())])
    arrow = [(n, sizes[n]) for n in names]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), {n: 0 for n, _ in arrow}
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield held
            columns = list(batch.columns)
            for n, size in arrow:
                values = batch.column(size).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(values) + done[n]
                columns.append(pa.array(ends - values, pa.int64()))
                done[n] = int(ends[-1])
            columns += [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.zeros(batch.num_rows, bool))]
            held = pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *names, "_part", "_last"])
        if held is not None:
            last = np.zeros(held.num_rows, bool)
            last[-1] = True
            yield pa.RecordBatch.from_arrays([*held.columns[:-1], pa.array(last)], names=held.schema.names)

    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = saved(df.repartitionByRange(many, *order).sortWithinPartitions(*order).mapInArrow(add, out), name)
    totals = table.where("_last").select("_part", *((F.col(n) + F.coalesce(F.col(sizes[n]).cast("long"), F.lit(0))).alias(n) for n in names)).collect()  # one row a partition
    before = {n: 0 for n in names}
    starts = []
    for row in sorted(totals, key=lambda r: r["_part"]):
        starts.append((row["_part"], *(before[n] for n in names)))
        before = {n: before[n] + row[n] for n in names}
    starts = spark.createDataFrame(starts, "_part int, " + ", ".join(f"_before_{n} long" for n in names))
    joined = table.drop("_last").join(F.broadcast(starts), "_part")
    return joined.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in names}).drop("_part", *(f"_before_{n}" for n in names))


#: Narrow rows that a task takes up without effort, and tasks that there are at least.
EASY_ROWS, EASY_TASKS = 1 << 20, 8


def few_tasks(count: int) -> int:
    """As many tasks as so many narrow rows ask for: steps that follow a shuffle of them need no more."""
    return max(EASY_TASKS, -(-count // EASY_ROWS))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component) for each id on an edge (a, b); the component is its smallest id. A written table.

    Alternating large-star and small-star rounds: each is an aggregate and a join over the
    edges, the edges never grow, and rounds are logarithmic in a component's size; the last leaves
    every id with one edge, to an id that has none itself. Every step ends in a table in the shared
    folder, written by no more tasks than its rows ask for."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    few = EASY_TASKS
    while count := now.count():
        few = few_tasks(count)
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        if ends.coalesce(few).groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").coalesce(few).isEmpty():
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(few)
        # written, so that the joins have two plain exchanges and Spark can split a hub's edges
        least = saved(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(few), f"{name}-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(few)
        large = saved(large.distinct().coalesce(few), f"{name}-large")
        forget(now, least)
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(few), f"{name}-least")
        met = large.join(least, "u")
        small = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").coalesce(few)
        now = saved(small.distinct().coalesce(few), name)
        forget(large, least)
    found = now.select(F.col("u").alias("id"), F.col("v").alias("component")).coalesce(few).union(now.select("v", "v").distinct().coalesce(few))
    return saved(found, f"{name}-found")


def by_key(batches: Iterator[pa.RecordBatch], key: str, rows: int, size: int = 1 << 62) -> Iterator[pa.Table]:
    """Cut a stream that is sorted by ``key`` into tables of whole groups, of about ``rows`` rows or ``size`` bytes."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows and sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield table.slice(0, cut).combine_chunks()
            held, count = table.slice(cut).to_batches(), table.num_rows - cut
    if count:
        yield pa.Table.from_batches(held).combine_chunks()
