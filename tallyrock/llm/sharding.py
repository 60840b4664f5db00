"""Sharding along a Hilbert curve: several metadata dimensions are quantised, rows are sorted by
their place on the curve, and runs are cut, so that each shard covers a compact box of metadata
and file statistics prune on any of the dimensions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import documents, running_totals

#: Bits of each quantised dimension.
BITS = 4
SHARDS = 16


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (n x dimensions, each below 2**bits).

    The usual construction: from the top bit down, reflect or swap the lower bits by each
    dimension's bit; then a Gray decoding; then the bits are interleaved."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = level - 1
        for k in range(d):
            up = (x[k] & level) != 0
            swap = np.where(up, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(up, low, swap)
            x[k] ^= swap
        level >>= 1
    for k in range(1, d):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn = np.where(x[d - 1] & level, turn ^ (level - 1), turn)
        level >>= 1
    x ^= turn
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(d):
            place = place << 1 | x[k] >> bit & 1
    return place


def cells(rows: DataFrame, name: str, kind: T.DataType, total: int) -> Column:
    """The column quantised to ``2**BITS`` cells of about equally many rows, in the column's order; null is in the first.

    Numbers are cut at approximate quantiles. Strings are compared whole: their values are counted
    and ranked in Spark, and the driver gets the least value of each cell."""
    many = 1 << BITS
    if not isinstance(kind, T.StringType):
        number = F.col(name).cast("double")
        edges = rows.agg(F.percentile_approx(number, [i / many for i in range(1, many)], 100_000).alias("e")).first()["e"] or []
        found = [F.when(number >= e, 1).otherwise(0) for e in edges]
        return reduce(lambda x, y: x + y, found, F.lit(0))
    counts = rows.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_totals(counts, [name], {"_before": "_n"}, "sharding-values")  # nulls come first
    lows = ranked.where(F.col(name).isNotNull()).groupBy(F.expr(f"_before * {many} div {max(1, total)}").alias("cell")).agg(F.min(name).alias("low"))
    return F.greatest(F.lit(0), *(F.when(F.col(name) >= F.lit(r["low"]), int(r["cell"])) for r in lows.collect()), F.lit(0))  # one row a cell


def shard(rows: DataFrame, dimensions: list[str], size: str, key: str = "doc_id", shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """Add curve, shard and slot to narrow rows (no texts).

    ``law`` "rows" makes the shards' row counts at most one apart; "bytes" puts a row where the
    middle of its ``size`` falls in equal parts of the total, so shards differ by a row's size at
    most at each end. Slots run from 0 in each shard without gaps, along the curve, ties by
    ``key``. Rows are cut by count or size alone, so copies and hot values spread over shards."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    total = rows.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    n, volume = max(1, total["rows"]), max(1, total["bytes"])
    quantised = {f"_d{k}": cells(rows, c, kinds[c], n) for k, c in enumerate(dimensions)}
    fields, names = rows.schema.fields, list(quantised)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                box = np.stack([batch.column(k).to_numpy() for k in names], axis=1)
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(hilbert(box, BITS))], names=[*(f.name for f in fields), "curve"])

    schema = T.StructType([*fields, T.StructField("curve", T.LongType())])
    curved = rows.withColumns(quantised).mapInArrow(place, schema).withColumn("_one", F.lit(1))
    ranked = running_totals(curved, ["curve", key], {"_rank": "_one", "_before": size}, "sharding-ranks")
    if law == "rows":
        cut = F.expr(f"_rank * {shards} div {n}")
        first = F.expr(f"(shard * {n} + {shards - 1}) div {shards}")
    else:
        cut = F.expr(f"least({shards - 1}, (2 * _before + coalesce({size}, 0)) * {shards} div {2 * volume})")
        first = None
    ranked = ranked.withColumn("shard", cut.cast("int"))
    if first is None:
        starts = ranked.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row a shard
        ranked = ranked.join(F.broadcast(starts), "shard")
        first = F.col("_first")
    return ranked.withColumn("slot", (F.col("_rank") - first).cast("long")).drop("_one", "_rank", "_before", "_first")


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1; null text: none and 1), text_crc32, law, shard, slot of all documents.

    The dimensions are source, lang, size and doc_id; a null is the least value of its dimension.
    Only narrow rows are sorted, so a very long text weighs no more than another. Repeated rows and
    ties are placed one by one, in any order among themselves; an empty table stays empty. Other
    columns are not returned, whatever their names."""
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    rows = docs.select("doc_id", "source", "lang", size.alias("size"), F.crc32(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("text_crc32"))
    placed = shard(rows, ["source", "lang", "size", "doc_id"], "size", shards=shards, law=law)
    return placed.withColumn("law", F.lit(law))


def shard_ranges(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Least and greatest value of each column in each shard: what file statistics would prune by."""
    return placed.groupBy("shard").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def op6_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(documents(spark, sf_dir))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
