"""Document fingerprints from closed syncmers, with DataFrame functions alone.

A k-mer (``K`` bytes) is a closed syncmer if the least hash among its inner substrings of ``S``
bytes lies at its first or last place. That depends on the k-mer alone, not on its neighbours, so
equal passages give equal anchors wherever they stand. Anchors are found by exploding a text's
places inside one generated stage; a fingerprint is the least anchor hash in each of ``SIZE``
classes (hash modulo ``SIZE``), and two fingerprints estimate the share of anchors in common by
the classes on which they agree."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import ROW, documents, keyed

K, S = 24, 14
#: Classes of hashes, each with one hash in a fingerprint at most.
SIZE = 64
#: Runs of neighbouring documents for each shuffle partition; the first key of each run is on the driver.
RUNS = 4
#: Places of a text that are listed at a time.
PLACES = 1 << 16


def is_anchor(binary: Column, i: Column) -> Column:
    """Whether the k-mer at place i (from 0) is a closed syncmer."""
    inner = lambda k: F.xxhash64(F.substring(binary, i + (k + 1), F.lit(S)))
    wide = K - S
    at_first, at_last = inner(0) <= inner(1), inner(wide) <= inner(wide - 1)
    for k in range(2, wide + 1):  # tests end at the first smaller hash: most k-mers cost two or three
        at_first &= inner(0) <= inner(k)
        at_last &= inner(wide) <= inner(wide - k)
    return at_first | at_last


def anchor_hash(binary: Column, i: Column) -> Column:
    return F.xxhash64(F.substring(binary, i + 1, F.lit(K)))


def spans(first: Column, size: Column) -> Column:
    """First and last place of runs of at most ``PLACES`` k-mers, of those of ``size`` bytes that begin at place ``first``."""
    last = first + size - K
    cut = F.transform(F.sequence(first, last, F.lit(PLACES)), lambda i: F.struct(i.alias("low"), F.least(i + (PLACES - 1), last).alias("high")))
    return F.when(size >= K, cut).otherwise(F.array().cast("array<struct<low:int,high:int>>"))


def at_each_place(rows: DataFrame, spans: Column, name: str) -> DataFrame:
    """A row for each place of the spans; a long text's places are never all listed at once."""
    return rows.withColumn("_span", F.explode(spans)).withColumn(name, F.explode(F.sequence("_span.low", "_span.high"))).drop("_span")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, at (byte place from 0) and hash of every closed syncmer: anchors for positional matching."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("_bytes"))
    rows = at_each_place(rows, spans(F.lit(0), F.octet_length("_bytes")), "at")
    return rows.where(is_anchor(F.col("_bytes"), F.col("at"))).select("doc_id", "at", anchor_hash(F.col("_bytes"), F.col("at")).alias("hash"))


def as_text(least: Column) -> Column:
    return F.array_join(F.transform(least, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated common share (0 to 1) of two fingerprints' anchors; two empty ones are alike."""
    either = F.size(F.array_union(F.transform(a, lambda h: F.pmod(h, F.lit(SIZE))), F.transform(b, lambda h: F.pmod(h, F.lit(SIZE)))))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(either, F.lit(1))).cast("double")


#: What rows are ordered by: null ids first, then by id, then as stored.
ORDER = ["_has_id", "_id", *ROW]


def beside_next(docs: DataFrame) -> DataFrame:
    """Deal ``docs`` to runs of neighbours in ``ORDER``; adds those columns, _run, and _ghost: a copy of the row that follows a run.

    Inside a run, ordered by _ghost and ``ORDER``, every row but the ghost is followed by the next
    document of the whole table, and after the last comes the first. Spark's range partitioning of
    the keys alone cuts the runs, so they are about equally long whatever the ids are, and however
    often one repeats; the driver holds the first key of each run."""
    many = RUNS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = keyed(docs).withColumns({"_has_id": F.col("doc_id").isNotNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    lows = rows.select(*ORDER).repartitionByRange(many, *ORDER).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(*ORDER)).alias("low")).collect()
    firsts = sorted(tuple(r["low"]) for r in lows)
    n, own = max(1, len(firsts)), F.struct(*ORDER)
    known = F.from_json(F.lit(json.dumps([dict(zip(ORDER, f, strict=True)) for f in firsts])), "array<struct<_has_id:boolean,_id:bigint,_row_file:bigint,_row_at:bigint>>")
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    # how many runs begin at or before the row: a binary search
    begun = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(known, at + step - 1) <= own), at + step).otherwise(at))
    rows = rows.withColumn("_at", begun - 1)
    deal = lambda run, ghost: F.struct(run.alias("_run"), F.lit(ghost).alias("_ghost"))
    mine, before = deal(F.col("_at"), False), deal(F.pmod(F.col("_at") - 1, F.lit(n)), True)
    both = F.when(F.get(known, F.col("_at")) == own, F.array(mine, before)).otherwise(F.array(mine))
    return rows.withColumn("_deal", F.explode(both)).select(*docs.columns, *ORDER, "_deal._run", "_deal._ghost")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last quarter (floor) of its code points replaced by the first as many,
    or all, of the document that follows by doc_id; the first follows the last. Null counts as
    empty; empty texts have empty fingerprints. Null ids come first; rows that repeat a doc_id
    follow one another as they are stored. A very long text costs memory for itself and its edited
    form alone. An empty table stays empty. Only doc_id and text are read; other columns are not
    returned, whatever their names."""
    rows = beside_next(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *ORDER, "_run", "_ghost")
    order = Window.partitionBy("_run").orderBy("_ghost", *ORDER)
    quarter = F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumns({"_next": F.lead("text").over(order), "n_chars": F.length("text").cast("long"), "_head": F.substring(F.col("text"), F.lit(1), F.length("text") - quarter)})
    rows = rows.withColumn("_edited", F.concat("_head", F.coalesce(F.substring(F.col("_next"), F.lit(1), quarter), F.lit(""))).cast("binary"))
    # what the edit leaves untouched has its anchors already; only the seam and the tail are new
    size, head, edited = F.octet_length("text"), F.octet_length("_head"), F.octet_length("_edited")
    fresh = F.greatest(head - (K - 1), F.lit(0))
    rows = rows.select(
        "_run", "_ghost", "doc_id", *ORDER, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"),
        F.xxhash64(F.col("text").cast("binary")).alias("_whole"), F.xxhash64("_edited").alias("_edited_whole"), (size > 0).alias("_some"), (edited > 0).alias("_edited_some"),
        size.alias("_size"), head.alias("_kept"), F.concat(F.col("text").cast("binary"), F.substring(F.col("_edited"), fresh + 1, edited)).alias("_bytes"),
        # place -1 keeps documents without a place
        F.concat(F.array(F.struct(F.lit(-1).alias("low"), F.lit(-1).alias("high"))), spans(F.lit(0), size), spans(size, edited - fresh)).alias("_spans"),
    )
    keys = ["_run", "_ghost", "doc_id", *ORDER, "n_chars", "edited_sha256", "_whole", "_edited_whole", "_some", "_edited_some"]
    i = F.col("_at")
    found = at_each_place(rows, F.col("_spans"), "_at").where((i < 0) | is_anchor(F.col("_bytes"), i))
    own, new = (i >= 0) & (i < F.col("_size")), (i >= F.col("_size")) | ((i >= 0) & (i + K <= F.col("_kept")))
    found = found.select(*keys, anchor_hash(F.col("_bytes"), i).alias("_hash"), own.alias("_own"), new.alias("_new"))
    classes = found.groupBy(*keys, F.pmod("_hash", F.lit(SIZE)).alias("_class")).agg(F.min(F.when(F.col("_own"), F.col("_hash"))).alias("a"), F.min(F.when(F.col("_new"), F.col("_hash"))).alias("b"))
    prints = classes.groupBy(*keys).agg(F.sort_array(F.collect_list("a")).alias("a"), F.sort_array(F.collect_list("b")).alias("b"))
    one = lambda c, some, whole: F.when(F.size(c) > 0, F.col(c)).when(F.col(some), F.array(whole)).otherwise(F.col(c))
    prints = prints.withColumns({"_print": one("a", "_some", "_whole"), "_other": one("b", "_edited_some", "_edited_whole")})
    prints = prints.withColumn("_follows", F.lead("_print").over(order)).where("NOT _ghost")
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("_print")).alias("fingerprint"), as_text(F.col("_other")).alias("edited_fingerprint"),
        likeness(F.col("_print"), F.col("_other")).alias("near_edited"), likeness(F.col("_print"), F.coalesce("_follows", F.array().cast("array<bigint>"))).alias("near_next"),
    )


def op5_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
