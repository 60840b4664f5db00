"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gets a block in each window from floor(i / w) to ceil((i + 1) / w); serving
the released block with the earliest deadline keeps every source within one block of its share at
all times. A row's place follows from its rank in its source; Spark ranks the rows. The driver
holds the slots, which are about ``SLOTS`` at most whatever the number of rows: a block has
as many rows as that takes."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import ROW, documents, keyed, running_totals, small_batches

#: Slots of a schedule at most (besides one more for each source); 8 bytes each.
SLOTS = 1 << 20
#: Weights that are not whole are rounded to so many parts in all, each by less than one: over
#: a thousand million blocks, the rounding moves a source by a thousandth of a block.
PARTS = 1 << 40


def period(weights: list[int], blocks: list[int] | None = None) -> list[int]:
    """The source of each slot of one period, by earliest deadline first among released blocks.

    With ``blocks`` it ends sooner, with the slot in which a source has had all its blocks."""
    total = sum(weights)
    left = list(blocks) if blocks is not None else [w + 1 for w in weights]
    waiting = [(0, -(-total // w), s, 0) for s, w in enumerate(weights) if w]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    while len(out) < total:
        while waiting and waiting[0][0] <= len(out):
            _, deadline, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, s, i))
        _, s, i = heapq.heappop(ready)
        out.append(s)
        left[s] -= 1
        if not left[s]:
            break
        if i + 1 < weights[s]:
            heapq.heappush(waiting, ((i + 1) * total // weights[s], -(-(i + 2) * total // weights[s]), s, i + 1))
    return out


def whole_weights(shares: list[float], parts: int = PARTS) -> list[int]:
    """Shares as whole numbers: themselves if they are whole, else of ``parts`` in all by largest remainder, none that is not 0 below 1."""
    if all(x == int(x) for x in shares) and sum(shares) <= parts:
        return [int(x) for x in shares]
    total = math.fsum(shares)
    exact = [x / total * parts if total else 1.0 for x in shares]
    out = [int(x) for x in exact]
    for s in sorted(range(len(shares)), key=lambda s: out[s] - exact[s])[: max(0, parts - sum(out))]:
        out[s] += 1
    return [max(1, w) if x > 0 else 0 for w, x in zip(out, shares, strict=True)]


class Schedule:
    """Slots of all blocks, in phases; a phase ends with the block that empties a source, and the
    sources that remain go on by their weights alone. Sources of weight 0 come, in equal parts, after all others."""

    def __init__(self, weights: list[int], blocks: list[int]):
        self.phases: list[tuple[list[int], int, int, dict[int, np.ndarray]]] = []
        done, base = [0] * len(blocks), 0
        while active := [s for s in range(len(blocks)) if done[s] < blocks[s]]:
            own = {s: weights[s] for s in active if weights[s]} or dict.fromkeys(active, 1)
            active, common = list(own), math.gcd(*own.values())
            turn = np.array(period([own[s] // common for s in active], [blocks[s] - done[s] for s in active]))
            slots = {s: at for k, s in enumerate(active) if len(at := np.flatnonzero(turn == k))}
            self.phases.append((list(done), base, len(turn), slots))
            end = min(self._slot(s, blocks[s] - done[s] - 1, len(turn), slots[s]) for s in slots) + 1
            for s in slots:
                done[s] += end // len(turn) * len(slots[s]) + int(np.searchsorted(slots[s], end % len(turn)))
            base += end

    @staticmethod
    def _slot(source: int, block: int, length: int, slots: np.ndarray) -> int:
        return block // len(slots) * length + int(slots[block % len(slots)])

    def slots(self, source: int, block: np.ndarray) -> np.ndarray:
        """The slot of each of a source's blocks."""
        out = np.full(len(block), -1, np.int64)
        for done, base, length, slots in self.phases:
            if source in slots:
                own = block >= done[source]
                k = block[own] - done[source]
                out[own] = base + k // len(slots[source]) * length + slots[source][k % len(slots[source])]
        return out


class Order:
    """Where every row of ``docs`` goes in the mixed order, by its source and its rank in it. Its arguments are those of ``mix_positions``."""

    def __init__(self, docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None):
        counts = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
        names = sorted(counts, key=lambda s: (s is not None, (s or "").encode()))  # Spark's order
        if weights is None:
            shares = [counts[s] ** 0.5 for s in names]
        else:
            least = min(weights.values(), default=1.0)
            shares = [weights.get(s, least) for s in names]
        self.rows = sum(counts.values())
        self.block = block = block or max(1, -(-self.rows // SLOTS))
        self.plan = Schedule(whole_weights(shares), [-(-counts[s] // block) for s in names])
        self.first = np.cumsum([0, *(counts[s] for s in names)])
        self.index = {s: k for k, s in enumerate(names)}
        short = []  # blocks that are not full, by slot
        for s in names:
            if counts[s] % block:
                short.append((int(self.plan.slots(self.index[s], np.array([counts[s] // block]))[0]), block - counts[s] % block))
        self.short_at = np.array([a for a, _ in sorted(short)], np.int64)
        self.missing = np.concatenate([[0], np.cumsum([m for _, m in sorted(short)])]).astype(np.int64)

    def codes(self, sources: pa.Array) -> np.ndarray:
        """The number of each row's source."""
        return np.array([self.index[s] for s in sources.to_pylist()], np.int64)

    def ranked(self, docs: DataFrame, key: list[str]) -> DataFrame:
        """doc_id, source, ``key`` and _rank, the rows before a row in the order of source, doc_id and ``key``."""
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", *key, F.lit(1).alias("_one"))
        return running_totals(rows, ["source", "doc_id", *key], {"_rank": "_one"}, "mixing-ranks").select("doc_id", "source", *key, "_rank")

    def places(self, codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot and position of the rows with rank ``own`` in their sources."""
        slot = np.zeros(len(own), np.int64)
        for k in np.unique(codes).tolist():
            rows = codes == k
            slot[rows] = self.plan.slots(k, own[rows] // self.block)
        return slot, slot * self.block + own % self.block - self.missing[np.searchsorted(self.short_at, slot, "left")]


def mix_positions(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None, key: list[str] | None = None) -> DataFrame:
    """doc_id, source, block, slot and position (from 0, without gaps) of every row of ``docs``.

    ``weights``: target share of each source, by default the square root of its rows; a source
    that is not listed gets the least listed share. Blocks are ``block`` rows of a source in
    doc_id order (its last may be shorter); by default as many as make ``SLOTS`` slots of the
    table. While the same sources have rows left, each has had
    less than one block more or fewer than its share at any time. Every row is placed once: when
    a source ends, the rest go on. A null source is a source of its own, and null doc_ids come
    first in theirs; repeated rows are placed one by one, in any order among themselves. Texts are
    not read, however long. An empty table has no positions. Other columns are not returned but
    for those of ``key``, long columns that break ties of doc_id. The number of sources is taken
    to be small (one row of each comes to the driver)."""
    key = key or []
    order = Order(docs, weights, block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = order.codes(batch.column("source"))
            own = batch.column("_rank").to_numpy() - order.first[codes]
            slot, position = order.places(codes, own)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), *map(pa.array, (own // order.block, slot, position)), *(batch.column(k) for k in key)], names=["doc_id", "source", "block", "slot", "position", *key])

    return order.ranked(docs, key).mapInArrow(place, "doc_id long, source string, block long, slot long, position long" + "".join(f", {k} long" for k in key))


def row_keys(codes: np.ndarray, doc_id: pa.Array, *more: pa.Array) -> Iterator[tuple]:
    """What rows are sorted by: source, doc_id with nulls first, ``ROW``."""
    ids = doc_id.to_pylist()
    return zip(codes.tolist(), (x is not None for x in ids), (x or 0 for x in ids), *(x.to_pylist() for x in more), strict=True)


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int | None = None) -> DataFrame:
    """All rows and columns of ``docs`` in mixed order: partitions and rows follow the position of ``mix_positions``.

    Texts move once. A partition has a stretch of positions, and so of each source the rows from one
    key (doc_id, and where the row is stored) to the next; the first rows of the stretches come to
    the driver, one for each source and partition, and a text finds its partition by its own key. There
    its rank is that of its stretch's first row and as many more as it stands behind that, and gives its
    position. Rows are told apart by where they are stored, so repeated and null doc_ids are rows
    like others."""
    small_batches(docs.sparkSession)
    rows = keyed(docs)
    order = Order(rows, weights, block)
    many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def part_of(codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        return order.places(codes, own)[1] * many // order.rows

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = order.codes(batch.column("source"))
            own = batch.column("_rank").to_numpy() - order.first[codes]
            part = part_of(codes, own)
            new = (own == 0) | (part != part_of(codes, np.maximum(own - 1, 0)))
            columns = [*map(pa.array, (codes, own, part)), *(batch.column(k) for k in ("doc_id", *ROW))]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "own", "part", "doc_id", *ROW]).filter(pa.array(new))

    found = order.ranked(rows, ROW).mapInArrow(firsts, "code long, own long, part long, doc_id long" + "".join(f", {k} long" for k in ROW))
    edges = found.toArrow().sort_by([("code", "ascending"), ("own", "ascending")]).combine_chunks()
    code, own, part = (edges.column(k).to_numpy() for k in ("code", "own", "part"))
    keys = list(row_keys(code, *(edges.column(k) for k in ("doc_id", *ROW))))

    @F.arrow_udf("int")
    def partition(source: pa.Array, doc_id: pa.Array, file: pa.Array, at: pa.Array) -> pa.Array:
        stretch = [bisect_right(keys, k) - 1 for k in row_keys(order.codes(source), doc_id, file, at)]
        return pa.array(part[np.array(stretch, np.int64)], pa.int32())

    @F.arrow_udf("long")
    def position(source: pa.Array, at: pa.Array, place: pa.Array) -> pa.Array:
        codes = order.codes(source)
        stretch = np.searchsorted(code * many + part, codes * many + at.to_numpy())
        return pa.array(order.places(codes, own[stretch] + place.to_numpy() - 1)[1])

    doc_id = F.col("doc_id").cast("long")
    dealt = rows.withColumn("_part", partition("source", doc_id, *ROW)).repartitionById(many, "_part")
    placed = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("_part", "source").orderBy(doc_id, *ROW)))
    return placed.withColumn("_position", position("source", "_part", "_place")).sortWithinPartitions("_position").select(*docs.columns)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_positions(documents(spark, sf_dir))
