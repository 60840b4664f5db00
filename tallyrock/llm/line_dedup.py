"""Line dedup: lines that many documents share are dropped from all but one of them.

Lines are exploded as places and 128-bit hashes of their normalised form, documents are counted for
each hash with map-side combining, the places of lines over the threshold go back to their
documents, and the other lines are put together again by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ROW, documents, keyed, saved

BLANK = "\t\n\x0b\x0c\r "
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, SMALL)


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(1), key).alias("b"))


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with ``text`` rebuilt from the lines that stay, plus ``n_lines`` (before) and ``n_dropped``.

    A line whose key (see ``line_key``) has ``min_chars`` code points or more and is found in
    ``min_docs`` documents or more goes, except from the document with the largest doc_id that
    holds it: there all its occurrences stay. A null or empty text is one empty line and becomes
    an empty text. Rows that repeat a doc_id count as one document. Null doc_ids count as one
    document that sorts before all others. A very long text takes memory for its lines and a hash
    of each. An empty table stays empty. Other columns pass through untouched;
    columns named n_lines or n_dropped are replaced."""
    rows = keyed(docs)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    each = rows.select(*ROW, "doc_id", F.posexplode(F.transform(lines, line_key)).alias("at", "k")).where(F.length("k") >= min_chars)
    found = saved(each.select(*ROW, "doc_id", "at", _hash(F.col("k")).alias("h")).select(*ROW, "doc_id", "at", "h.a", "h.b"), "line-hashes")
    # written, so that the join below has two plain exchanges and Spark can split a hot line's rows
    shared = saved(
        found.select("doc_id", "a", "b").distinct().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("a", "b", "keeper"), "line-keepers",
    )
    dropped = found.join(shared, ["a", "b"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper"))).groupBy(*ROW).agg(F.collect_list("at").alias("_gone"))
    joined = rows.drop("n_lines", "n_dropped").join(dropped, ROW, "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get("_lines", i)), "\n"))
    out = joined.withColumn("_lines", lines).withColumns({"n_lines": F.size("_lines").cast("long"), "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), "text": kept})
    return out.select(*(c for c in docs.columns if c not in ("n_lines", "n_dropped")), "n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.*, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
