"""Best-two-fit packing of token sequences.

Pieces of equal length are interchangeable, so the plan is made from the histogram of lengths:
at most ``size`` counts, whatever the corpus. A bin is filled greedily with the longest pieces
that fit; then its smallest piece gives way to two unpacked ones that fill the widened gap more
tightly; and the pattern found is used as often as its lengths last. Spark ranks the pieces
within their length, and the rank finds the slot.

Where the order of the documents matters (a mixed corpus), windows of consecutive pieces are
packed by themselves, one after the other, so that the sequences follow that order."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import by_key, documents, running_totals, saved, small_batches

#: A sequence's tokens.
SIZE = 4096
#: Sequences' worth of tokens in a window of pieces that keep their order.
WINDOW = 256


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a bin) and how often each is used; counts[L] pieces have length L.

    Every pattern is used until one of its lengths runs short, so the number of patterns is
    bounded by ``size`` and not by the number of pieces."""
    left = counts.astype(np.int64).copy()
    found: list[tuple[list[int], int]] = []
    if left[size]:
        found.append(([size], int(left[size])))
        left[size] = 0
    there = np.flatnonzero(left)
    while len(there):
        bin_, gap, used = [], size, Counter()
        k = len(there) - 1
        while True:
            k = min(k, int(np.searchsorted(there, gap, "right")) - 1)
            while k >= 0 and left[there[k]] <= used[int(there[k])]:
                k -= 1
            if k < 0:
                break
            length = int(there[k])
            bin_.append(length)
            used[length] += 1
            gap -= length
        smallest = bin_[-1]
        if gap and len(bin_) > 1:
            room = gap + smallest
            free = left[there] - np.array([used[int(x)] for x in there]) if len(there) < 64 else left[there].copy()
            if len(there) >= 64:
                for x, c in used.items():
                    free[np.searchsorted(there, x)] -= c
            able = there[(free > 0) & (there < room)]
            many = free[(free > 0) & (there < room)]
            if len(able):
                mate = np.searchsorted(able, room - able, "right") - 1
                mate -= (mate == np.arange(len(able))) & (many < 2)  # a length with one piece can't be its own mate
                total = np.where(mate >= 0, able + able[np.maximum(mate, 0)], 0)
                best = int(np.argmax(total))
                if total[best] > smallest:
                    bin_[-1:] = [int(able[best]), int(able[mate[best]])]
        used = Counter(bin_)
        times = min(int(left[x]) // c for x, c in used.items())
        found.append((bin_, times))
        for x, c in used.items():
            left[x] -= c * times
        there = there[left[there] > 0]
    return found


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, piece, length, ...); no piece is longer than ``size``.

    In each sequence the offsets run from 0 without gaps. An empty table stays empty; null
    lengths count as 0 and take no room."""
    ranked = running_totals(pieces.withColumn("_one", F.lit(1)), ["length", "doc_id", "piece"], {"_rank": "_one"}, "packing-ranks").drop("_one")
    counts = np.zeros(size + 1, np.int64)
    for row in pieces.groupBy(F.coalesce("length", F.lit(0)).alias("length")).count().collect():  # one row a length
        counts[row["length"]] = row["count"]
    first = np.concatenate([[0], np.cumsum(counts)])  # rank of the first piece of each length
    taken, entries, base = first[:-1].copy(), [(0, 0, 0)] if counts[0] else [], 0
    nothing, counts[0] = counts[0], 0
    for pattern, times in plan(counts, size):
        offset = 0
        for length in pattern:
            entries.append((int(taken[length]), base, offset))
            taken[length] += times
            offset += length
        base += times
    table = np.array(sorted(entries), np.int64).reshape(-1, 3)  # bounded by ``size``

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(table[:, 0], rank, "right") - 1
            sequence = table[at, 1] + np.where(rank < nothing, 0, rank - table[at, 0])
            keep = [i for i, n in enumerate(batch.schema.names) if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.columns[i] for i in keep), pa.array(sequence), pa.array(table[at, 2])], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*pieces.columns, "_rank").mapInArrow(place, schema)


def fit(lengths: np.ndarray, before: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece of a window; ``before`` is a piece's place in the order.

    Within a length pieces are taken in their order, and the sequences stand in the order of the
    mean place of their tokens."""
    slots, base = [], 0
    for pattern, times in plan(np.bincount(lengths, minlength=size + 1), size):
        at = np.cumsum([0, *pattern[:-1]])
        slots.append((np.tile(pattern, times), np.repeat(np.arange(base, base + times), len(pattern)), np.tile(at, times)))
        base += times
    length, bin_, at = (np.concatenate(x) for x in zip(*slots, strict=True))
    own, slot = np.lexsort((before, lengths)), np.argsort(length, kind="stable")
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    sequence[own], offset[own] = bin_[slot], at[slot]
    mean = np.bincount(sequence, weights=(before - before.min()) * lengths) / np.bincount(sequence, weights=lengths)
    rank = np.empty(base, np.int64)
    rank[np.argsort(mean, kind="stable")] = np.arange(base)
    return rank[sequence], offset


def pack_in_order(pieces: DataFrame, order: list[str], size: int = SIZE) -> DataFrame:
    """As ``pack``, but the sequences follow the order of the pieces by ``order`` and piece; the columns of ``order`` go.

    The pieces are cut into windows of ``WINDOW`` * ``size`` tokens, and no sequence holds pieces
    of two windows: the first k sequences hold the first pieces of the order, to within one
    window, however many there are. Lengths run from 1 to ``size``."""
    ordered = running_totals(pieces, [*order, "piece"], {"_before": "length"}, "packing-order")
    ordered = ordered.withColumn("_window", F.floor(F.col("_before") / F.lit(WINDOW * size)).cast("long")).drop(*order)
    names = [n for n in pieces.columns if n not in order]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "_window", 20_000):
            windows = table.column("_window").to_numpy()
            lengths, before = table.column("length").to_numpy(), table.column("_before").to_numpy()
            bounds = np.flatnonzero(np.diff(windows, prepend=-1, append=-1))
            placed = [fit(lengths[a:b], before[a:b], size) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            local, offset = (np.concatenate(x) for x in zip(*placed, strict=True))
            own = [*(table.column(n).combine_chunks() for n in names), *map(pa.array, (offset, windows, local, (offset == 0).astype(np.int64)))]
            yield from pa.Table.from_arrays(own, names=[*names, "offset", "_window", "_local", "_new"]).to_batches()

    schema = T.StructType([*(pieces.schema[n] for n in names), *(T.StructField(n, T.LongType()) for n in ("offset", "_window", "_local", "_new"))])
    many = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = ordered.select(*names, "_before", "_window").repartitionByRange(many, "_window").sortWithinPartitions("_window", "_before").mapInArrow(place, schema)
    numbered = running_totals(saved(placed, "packing-placed"), ["_window", "_local", "offset"], {"_begun": "_new"}, "packing-sequences")
    return numbered.select(*names, (F.col("_begun") + F.col("_new") - 1).alias("sequence_id"), "offset")


def stored_order(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The rows with columns that tell their order, and these columns' names.

    Of a table read from files of Spark's writers it is the order in which the rows were written:
    by the number of the partition, its file and the row in that. Of any other it is the order of
    its partitions and their rows."""
    order = ["_at_part", "_at_file", "_at_row"]
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        meta = docs.metadataColumn("_metadata")
        number = lambda pattern: F.regexp_extract(meta["file_name"], pattern, 1).try_cast("int")
        found = (number(r"^part-(\d+)"), number(r"[.-]c(\d+)\."), meta["row_index"])
    else:
        found = (F.lit(0), F.lit(0), F.monotonically_increasing_id())
    return docs.withColumns(dict(zip(order, found, strict=True))), order


def token_pieces(docs: DataFrame, tokenizer: str, style: str = "word", end_id: int = 1, size: int = SIZE, carried: list[str] | None = None) -> DataFrame:
    """Encode every text, append ``end_id``, cut what is longer than ``size``; a written table.

    doc_id, piece, start, length, ids_crc32 and the columns of ``docs`` that are ``carried``.
    Null and empty texts are the end id alone."""
    carried = carried or []

    small_batches(docs.sparkSession)

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode = encoder(tokenizer, style)
        for batch in batches:
            rows = []
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                for row, ids in enumerate(encode(some.column("text")), lo):
                    ids = np.append(ids, end_id).astype("<u4")
                    for k in range(0, len(ids), size):
                        cut = ids[k : k + size]
                        rows.append((row, k // size, k, len(cut), zlib.crc32(cut.tobytes())))
            if rows:
                at, piece, start, length, crc = zip(*rows, strict=True)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(at), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())} | {n: batch.column(n).take(at) for n in carried})

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    rows = own.mapInArrow(encode_all, ", ".join([schema, *(f"{n} {own.schema[n].dataType.simpleString()}" for n in carried)]))
    return saved(rows, "packing-pieces")


def pack_documents(docs: DataFrame, tokenizer: str, style: str = "word", end_id: int = 1, size: int = SIZE) -> DataFrame:
    """Whole documents as pieces of at most ``size`` tokens, each with its sequence and offset.

    Rows that repeat a doc_id are packed each; columns other than doc_id and text are not used."""
    return pack(token_pieces(docs, tokenizer, style, end_id, size), size)


def pack_stored(docs: DataFrame, tokenizer: str, style: str = "word", end_id: int = 1, size: int = SIZE) -> DataFrame:
    """As ``pack_documents``, with sequences that follow the stored order of the rows (``stored_order``)."""
    rows, order = stored_order(docs)
    return pack_in_order(token_pieces(rows, tokenizer, style, end_id, size, order), order, size)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
