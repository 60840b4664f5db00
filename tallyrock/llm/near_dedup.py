"""Near duplicates by b-bit MinHash, confirmed on whole shingle sets.

1. One pass over the texts: each document's set of 5-word shingles, its MinHash signature, the
   band keys, and the signature's low bits packed. Documents of equal sets fall together first.
2. Of the documents that share a band key, the one with the most company is the key's hub. Each
   document is compared, on whole sets, with the hub that is estimated to be nearest, where low
   bits are counted and corrected for chance collisions. A group of copies costs one comparison each.
3. Band keys whose documents are not in one component yet: each document is compared in the same
   way with the nearest one of another component. A chain of copies costs one comparison more.
4. Band keys that still have several components: all estimated neighbours of different components
   are families, and a family is compared on whole sets, in blocks, so that no link is lost.

Only links and spanning forests leave a task, never pairs. Components of the links are the result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import by_key, components, documents, few_tasks, saved, small_batches
from ._text import LOWER, STEP, U64, chunks, hashes, mix, shingles, utf8, words

#: Minima of a signature. The first BANDS * ROWS make the bands: at similarity 0.80 a pair shares no band
#: three times in a million, at 0.85 three times in a thousand million.
MINIMA = 256
BANDS, ROWS = 42, 6
#: Low bits that are kept of each minimum.
BITS = 2
#: Estimates this far below the wanted similarity still count as candidates: over 4.5 standard deviations at 0.80.
MARGIN = 0.14
#: Members of a block of a bucket (and of a hub's), and of a family.
BUCKET_BLOCK, FAMILY_BLOCK = 1024, 256
#: Bytes of texts that a task of a family's blocks takes up at a time, or one block if that has more.
CHUNK = 64 << 20

_seeds = np.random.default_rng(7).integers(0, 1 << 32, (2, MINIMA), dtype=np.uint64).astype(np.uint32)
_FACTOR, _SHIFT = (_seeds[0] | np.uint32(1))[:, None], _seeds[1][:, None]


def minima(values: np.ndarray) -> np.ndarray:
    """The MinHash signature of a set of 64-bit hashes."""
    out = np.full(MINIMA, 0xFFFFFFFF, np.uint32)
    x = (values >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), 1024):
        y = x[None, i : i + 1024] * _FACTOR
        y ^= _SHIFT
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(out, y.min(axis=1), out=out)
    return out


def packed(signatures: np.ndarray) -> np.ndarray:
    """The low bits of signatures (n x minima) as n x words of 64 bits."""
    low = (signatures & np.uint32((1 << BITS) - 1)).astype(U64).reshape(len(signatures), -1, 64 // BITS)
    return (low << (np.arange(64 // BITS, dtype=np.uint64) * U64(BITS))).sum(axis=2, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures, all of a against all of b, corrected for chance collisions."""
    unequal = np.zeros((len(a), len(b)), np.int32)
    mask = U64(sum(1 << k for k in range(0, 64, BITS)))
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        for s in range(1, BITS):
            x |= (a[:, k, None] ^ b[None, :, k]) >> U64(s)
        unequal += np.bitwise_count(x & mask)
    same, chance = 1 - unequal / MINIMA, 2.0**-BITS
    return (same - chance) / (1 - chance)


def _sets(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """The distinct shingle hashes of each text."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        some, at = LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        starts, ends, places = words(some, at)
        runs, at = shingles(hashes(some, starts, ends), places)
        yield [np.unique(runs[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, bits binary"


def sketches(docs: DataFrame) -> DataFrame:
    """Size, 128-bit key, band keys and packed signature of each text's shingle set; a written table."""

    small_batches(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = STEP[np.arange(ROWS) % 8]
        for batch in batches:
            sets = [s for some in _sets(batch.column("text")) for s in some]
            if not sets:
                continue
            full = np.array([len(s) for s in sets])
            signatures = np.stack([minima(s) for s in sets])
            with np.errstate(over="ignore"):
                bands = mix((signatures[:, : BANDS * ROWS].reshape(len(sets), BANDS, ROWS).astype(U64) * power).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
                keys = [np.array([mix(s ^ U64(salt)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64) for salt in (11, 23)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
            bits = pa.array([row.tobytes() for row in packed(signatures)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(full, pa.int64()), *map(pa.array, keys), lists, bits], names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "bits"])

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, SKETCH), "near-sketches")


def in_blocks(rows: DataFrame, key: list[str], block: int, least: int = 2) -> DataFrame:
    """Deal the groups of ``key`` that have ``least`` rows or more to tasks; adds _task (long) and _side.

    A group of at most ``block`` rows goes to one task. A larger one is cut by a hash of id into
    blocks, and each two blocks meet in a task of their own: a task never holds more than about
    two blocks. _side tells the block (0 or 1) of the two that a row is in."""
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    many = F.ceil(F.col("_n") / block).cast("long")
    met = rows.join(sizes, key).withColumn("_blocks", many)
    mine = F.pmod(F.xxhash64("id", F.lit(5)), F.col("_blocks"))
    met = met.withColumn("_block", mine)
    small, large = met.where("_blocks = 1"), met.where("_blocks > 1")
    small = small.withColumns({"_task": F.xxhash64(*key), "_side": F.lit(0)})
    large = large.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    low, high = F.least("_block", "_other"), F.greatest("_block", "_other")
    large = large.withColumns({"_task": F.xxhash64(*key, low, high), "_side": (F.col("_block") > F.col("_other")).cast("int")}).drop("_other")
    # blocks i < j hold both sides; the pair (i, i) has its rows once, on side 0
    return small.unionByName(large).drop("_n", "_blocks", "_block")


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def forest(linked: Iterator[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    parent, out = list(range(n)), []
    for a, b in linked:
        x, y = _root(parent, a), _root(parent, b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _groups_of(table: pa.Table, *keys: str) -> Iterator[tuple[int, int]]:
    """Bounds of runs of equal keys in a sorted table; runs of one row are left out."""
    change = np.zeros(table.num_rows + 1, bool)
    change[[0, -1]] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:-1] |= values[1:] != values[:-1]
    at = np.flatnonzero(change)
    keep = np.diff(at) > 1
    yield from zip(at[:-1][keep].tolist(), at[1:][keep].tolist(), strict=True)


def alike(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Estimated similarity of packed signatures, row by row."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(len(c), -1) for c in (a, b))
    unequal, mask = x ^ y, U64(sum(1 << k for k in range(0, 64, BITS)))
    for s in range(1, BITS):
        unequal |= (x ^ y) >> U64(s)
    same, chance = 1 - np.bitwise_count(unequal & mask).sum(axis=1) / MINIMA, 2.0**-BITS
    return (same - chance) / (1 - chance)


def buckets(classes: DataFrame) -> DataFrame:
    """(band, id, company) for the band keys of more than one class; a written table."""
    banded = classes.select("id", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("company")).where("company > 1")
    return saved(banded.join(sizes, "band").select("band", "id", "company"), "near-buckets")


def nearest_hubs(members: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(id, hub): of the hubs of its buckets the one that is nearest to a class by estimate, at ``least`` or more.

    A bucket's hub is the member with most company in all of its buckets."""
    few = few_tasks(members.count())
    weight = members.coalesce(few).groupBy("id").agg(F.sum("company").alias("weight"))
    top = F.max(F.struct("weight", (-F.col("id")).alias("minus"))).alias("top")
    # written, so that the join below has two plain exchanges and Spark can split a hot key's rows
    hubs = saved(members.join(weight, "id").coalesce(few).groupBy("band").agg(top).select("band", (-F.col("top.minus")).alias("hub")).coalesce(few), "near-hubs")
    pairs = members.join(hubs, "band").where("id <> hub").select("id", "hub").coalesce(few).distinct().coalesce(few)
    signed = classes.select("id", "bits")
    both = pairs.join(signed.withColumnRenamed("bits", "own"), "id").join(signed.select(F.col("id").alias("hub"), F.col("bits").alias("other")), "hub")

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("hub"), pa.array(alike(batch.column("own"), batch.column("other")))], names=["id", "other", "near"])

    found = both.select("id", "hub", "own", "other").mapInArrow(estimate, "id long, other long, near double").where(F.col("near") >= least)
    return _best(found)


def _best(found: DataFrame) -> DataFrame:
    top = F.max(F.struct("near", (-F.col("other")).alias("minus"))).alias("top")
    return found.groupBy("id").agg(top).select("id", (-F.col("top.minus")).alias("hub"))


def still_open(members: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """(band, id, component) of the buckets that hold several components; a written table."""
    own = members.select("band", "id").join(found, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    few = few_tasks(members.count())
    labelled = saved(own.coalesce(few), name)
    several = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("band")
    return saved(labelled.join(several.coalesce(few), "band").coalesce(few), name)


def _compared(still: DataFrame, classes: DataFrame, least: float, nearest: bool) -> DataFrame:
    """Classes of a bucket but of different components, compared by their signatures in blocks:
    the nearest other one of each (id, other, near), or a spanning forest of all that are near (a, b)."""
    rows = still.join(classes.select("id", "n", "bits"), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "_task", 20_000):
            ids, n, side, part = (table.column(c).to_numpy() for c in ("id", "n", "_side", "component"))
            bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
            found, best = [], []
            for a, b in _groups_of(table, "_task", "band"):
                size, across = n[a:b], side[a] != side[b - 1]
                for lo in range(a, b, 512):
                    hi = min(lo + 512, b)
                    score = similarity(bits[lo:hi], bits[a:b])
                    near = (score >= least) & (part[lo:hi, None] != part[a:b])
                    near &= np.minimum(n[lo:hi, None], size) >= least * np.maximum(n[lo:hi, None], size)
                    if across:
                        near &= side[lo:hi, None] != side[a:b]
                    if nearest:
                        score[~near] = -1
                        top = score.argmax(axis=1)
                        some = np.flatnonzero(near.any(axis=1))
                        best.append((ids[lo:hi][some], ids[a:b][top[some]], score[some, top[some]]))
                        continue
                    near &= np.arange(a, b)[None, :] > np.arange(lo, hi)[:, None]
                    x, y = np.nonzero(near)
                    some = forest(zip((x + lo - a).tolist(), y.tolist(), strict=True), b - a)
                    if some:
                        i, j = np.array(some).T
                        found.append((ids[a:b][i], ids[a:b][j]))
            if nearest and best:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*best, strict=True)], names=["id", "other", "near"])
            elif not nearest:
                yield _edges(found)

    many = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_blocks(rows, ["band"], BUCKET_BLOCK).select("_task", "band", "_side", "id", "n", "bits", "component")
    dealt = dealt.repartition(many, "_task").sortWithinPartitions("_task", "band", "_side")
    return dealt.mapInArrow(compare, "id long, other long, near double" if nearest else "a long, b long")


def linked(docs: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """(a, b): the pairs (id, hub) that are linked on their whole sets.

    Each id's text goes to one task, and a hub's text to as many as there are blocks of its ids;
    a task holds the set of one hub at a time, and a batch of texts."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    pairs = saved(pairs, "near-chosen")
    few = few_tasks(pairs.count())
    sizes = pairs.coalesce(few).groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BUCKET_BLOCK).cast("long").alias("_blocks")).coalesce(few)
    pairs = saved(pairs.join(sizes, "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("_blocks")).alias("block")).coalesce(few), "near-pairs")
    hubs = pairs.select(F.col("hub").alias("id"), "hub", "block").coalesce(few).distinct().coalesce(few)
    rows = texts.join(pairs.withColumn("role", F.lit(1)).unionByName(hubs.withColumn("role", F.lit(0))), "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []
        for batch in batches:
            out, k = [], 0
            ids, hubs, blocks, role = (batch.column(c).to_pylist() for c in ("id", "hub", "block", "role"))
            for some in _sets(batch.column("text")):
                for own in some:
                    if role[k] == 0:
                        if hub != (hubs[k], blocks[k]):
                            hub, held = (hubs[k], blocks[k]), []
                        held.append(own)  # more than one if the hub's doc_id repeats
                    elif hub == (hubs[k], blocks[k]) and any(_near(own, x, least) for x in held):
                        out.append((ids[k], hubs[k]))
                    k += 1
            if out:
                a, b = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("id", "hub", "block", "role", "text").repartition(many, "hub", "block").sortWithinPartitions("hub", "block", "role")
    return saved(dealt.mapInArrow(compare, "a long, b long"), "near-linked")


def _near(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether two ascending sets have 100 * intersection >= least * union."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= least * (len(a) + len(b) - both)


def _links(sets: list[np.ndarray], side: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= least * union; of two sides, of the pairs across."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    start = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(start) - 1
    shared = np.bincount(column) > 1
    use = shared[column]
    renamed = np.cumsum(shared) - 1
    owner, column = owner[use], renamed[column[use]]
    rows = np.flatnonzero(side == side[0])
    columns = np.flatnonzero(side != side[0]) if side[0] != side[-1] else rows
    both = np.zeros((len(rows), len(columns)), np.float32)
    width = int(shared.sum())
    for lo in range(0, width, 8192):
        hi = min(width, lo + 8192)
        a, b = np.searchsorted(column, [lo, hi])
        matrix = np.zeros((n, hi - lo), np.float32)
        matrix[owner[a:b], column[a:b] - lo] = 1
        both += matrix[rows] @ matrix[columns].T
    both = both.astype(np.int64)
    near = 100 * both >= least * (sizes[rows, None] + sizes[columns] - both)
    if columns is rows:
        near = np.triu(near, 1)
    x, y = np.nonzero(near)
    return forest(zip(rows[x].tolist(), columns[y].tolist(), strict=True), n)


def confirmed(docs: DataFrame, members: DataFrame, least: int) -> DataFrame:
    """(a, b): links between members (id, component) of a family, confirmed on their whole sets."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(members, "id")
    dealt = in_blocks(texts, ["component"], FAMILY_BLOCK).select("_task", "component", "_side", "id", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "_task", 512, CHUNK):
            ids, side = table.column("id").to_numpy(), table.column("_side").to_numpy()
            sets = [s for some in _sets(table.column("text")) for s in some]
            found = []
            for a, b in _groups_of(table, "_task", "component"):
                if some := _links(sets[a:b], side[a:b], least):
                    i, j = np.array(some).T
                    found.append((ids[a:b][i], ids[a:b][j]))
            yield _edges(found)

    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(many, "_task").sortWithinPartitions("_task", "component", "_side").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, least: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |A and B| >= ``least`` * |A or B| for their sets of distinct
    5-word shingles (A-Z in lower case; with fewer words, the whole sequence is the one shingle).
    component_id is the smallest doc_id that links reach. Null, empty and blank texts have an
    empty set and are linked with nothing. Rows that repeat a doc_id count as one document, whose
    sets link all their documents; a null doc_id has a null component and is kept. A very long
    text takes memory for its set, a few at a time. An empty table stays empty. Other columns are
    not read, whatever their names."""
    table = sketches(docs)
    full = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["set_a", "set_b", "n_shingles"]
    heads = saved(full.groupBy(*key).agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "near-classes")
    # sets of one document, if its id repeats, are one class
    classes = heads.select("id", F.col("n_shingles").alias("n"), "bands", "bits")
    found = _components(docs, classes, least)
    named = heads.select("id", *key).join(found, "id", "left").select(*key, F.coalesce("component", "id").alias("component_id"))
    out = table.join(named, key, "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _components(docs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """(id, component) of the classes that are linked with others, by the steps 2 to 4."""
    bound = least / 100 - MARGIN
    members = buckets(classes)
    links = linked(docs, nearest_hubs(members, classes, bound), least)
    found = components(links, "near-stars")
    still = still_open(members, found, "near-open")
    if still.isEmpty():
        return found
    links = links.union(linked(docs, _best(_compared(still, classes, bound, True)), least))
    found = components(links, "near-chains")
    still = still_open(members, found, "near-open")
    if still.isEmpty():
        return found
    near = components(_compared(still, classes, bound, False), "near-families")
    return components(links.union(confirmed(docs, near, least)), "near-links")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


#: All pairs that share a shingle, and all links walked: for small tables.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, ways.y FROM reach JOIN ways ON reach.r = ways.x)
SELECT reach.doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(r) AS component_id, min(r) = reach.doc_id AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = reach.doc_id GROUP BY reach.doc_id
"""
