"""Long repeated strings across a corpus, by common-prefix interval trees of enhanced suffix arrays.

Every string of ``length`` bytes has an anchor: of its substrings of ``ANCHOR`` bytes the one
with the least hash, leftmost on ties. Equal strings have equal anchors, so the starts of a text
are dealt out as runs with one anchor each, and only anchors that occur twice or more matter:

1. count the anchors' hashes; keep the runs whose anchor repeats;
2. runs of equal bytes fall together, with their number (a large group of copies is one entry);
3. where a bucket still holds different runs, their bytes meet in one task: a suffix array with
   common-prefix lengths is built over many buckets at a time, a stack scan walks its interval
   tree, and intervals whose occurrences differ to the left are the maximal repeats;
4. a bucket of more than ``BUCKET`` different runs is split first, by longer anchors: strings with the
   anchor in their left half also share what follows it, the others what stands before it. At the
   last of ``LEVELS`` halvings the anchor is the whole string, so every bucket comes to an array;
5. each run's covered ranges go back to all its occurrences, then to the documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import by_key, documents, saved, small_batches
from ._text import U64, Rolling, chunks, utf8

LENGTH, ANCHOR = 200, 64
#: Different runs of a bucket that meet in one task at most; each has some 270 bytes.
BUCKET = 10_000
#: Bytes that are hashed at a time; longer texts are taken in overlapping parts.
PART = 4 << 20
_PLACE_BITS = U64(24)
#: Halvings after which an anchor is a whole string: enough for strings of 2**LEVELS places for it.
LEVELS = 16


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts that share an anchor: first start, number of starts, anchor hash."""
    hashes = Rolling(data).windows(anchor)
    width = length - anchor + 1
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    key = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    blocks = np.concatenate([key, np.full(-len(key) % width, ~U64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & U64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
    sizes = np.diff(offsets)
    inside = np.zeros(len(data) + 1, np.int32)
    long = sizes >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    valid = np.cumsum(inside[:-1])[:n] > 0
    begin = valid.copy()
    begin[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    first = offsets[:-1][long]
    begin[first] = True
    starts = np.flatnonzero(begin)
    stops = np.append(np.flatnonzero(begin | ~valid), n)
    count = stops[np.searchsorted(stops, starts, "right")] - starts
    return starts, count, hashes[place[starts]]


def _pieces(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, row of each text, its shift) for some megabytes at a time."""
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        size = int(offsets[j] - offsets[i])
        if size <= PART:
            yield data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.arange(i, j), np.zeros(j - i, np.int64)
            continue
        for shift in range(0, size, PART):  # one long text
            some = data[offsets[i] + shift : min(offsets[i] + shift + PART + length - 1, offsets[j])]
            yield some, np.array([0, len(some)]), np.array([i]), np.array([shift])


#: What tells texts apart: rows of one doc_id and one text lose the same bytes.
TEXT = ["doc_id", "own"]
RUN = "doc_id long, own long, anchor long, seg long, start long, n int"


def digest(raw: bytes | memoryview, salt: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(raw, salt) - (1 << 63)


def runs(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """One row for each run of starts with one anchor; ``seg`` is a hash of all bytes of its strings."""

    small_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for data, offsets, rows, shift in _pieces(batch.column("text"), length):
                starts, count, hashes = anchors(data, offsets, length, anchor)
                own = np.searchsorted(offsets, starts, "right") - 1
                view = memoryview(np.ascontiguousarray(data))
                seg = [digest(view[a:b]) for a, b in zip(starts.tolist(), (starts + count + length - 1).tolist(), strict=True)]
                at = pa.array(rows[own])
                yield pa.RecordBatch.from_arrays([ids.take(at), batch.column("own").take(at), pa.array(hashes.view(np.int64)), pa.array(seg, pa.int64()), pa.array(starts - offsets[own] + shift[own]), pa.array(count.astype(np.int32))], names=["doc_id", "own", "anchor", "seg", "start", "n"])

    return docs.mapInArrow(find, RUN)


class SuffixArray:
    """Suffixes of several byte strings at their owned starts, in order, with common-prefix lengths.

    ``at``: places of the owned suffixes in the concatenated bytes, sorted; ``lcp[i]``: length of
    the common prefix of suffixes i - 1 and i, inside their strings. Ranks double from 8 bytes on."""

    def __init__(self, strings: list[bytes], owned: np.ndarray):
        sizes = np.array([len(s) for s in strings], np.int64)
        self.base = np.concatenate([[0], np.cumsum(sizes)])
        text = np.frombuffer(b"".join(strings), np.uint8)
        self.end = np.repeat(self.base[1:], sizes)
        index = np.arange(len(text))
        key = np.zeros(len(text), U64)
        for k in range(8):
            key = (key << U64(8)) | np.where(index + k < self.end, text[np.minimum(index + k, len(text) - 1)], 0).astype(U64)
        levels, step = [(8, self._ranks(key))], 8
        while step < sizes.max() and int(levels[-1][1].max()) + 1 < len(text):
            rank = levels[-1][1]
            later = np.where(index + step < self.end, rank[np.minimum(index + step, len(text) - 1)] + 1, 0)
            step *= 2
            levels.append((step, self._ranks(rank.astype(U64) * U64(len(text) + 1) + later.astype(U64))))
        take = np.arange(owned.sum()) - np.repeat(np.cumsum(owned) - owned, owned) + np.repeat(self.base[:-1], owned)
        self.at = take[np.argsort(levels[-1][1][take], kind="stable")]
        self.text, self.owned = text, owned
        self.lcp = self._common(levels)

    @staticmethod
    def _ranks(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        return rank

    def _common(self, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
        a, b = self.at[:-1].copy(), self.at[1:].copy()
        room = np.minimum(self.end[a] - a, self.end[b] - b)
        common, top = np.zeros(len(a), np.int64), len(self.text) - 1
        for step, rank in reversed(levels):
            same = (common < room) & (rank[np.minimum(a + common, top)] == rank[np.minimum(b + common, top)])
            common += np.where(same, step, 0)
        for _ in range(7):
            same = (common < room) & (self.text[np.minimum(a + common, top)] == self.text[np.minimum(b + common, top)])
            common += same
        return np.concatenate([[0], np.minimum(common, room)])


def intervals(array: SuffixArray, least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of the maximal repeats of ``least`` bytes or more: intervals of the
    suffix array whose common prefix can't grow to the right, and whose occurrences differ in the
    byte to their left. An occurrence at the first start of its string counts as different."""
    lcp, at = array.lcp, array.at
    left = np.where(np.isin(at, array.base[:-1]), -1, array.text[np.maximum(at - 1, 0)].astype(np.int64))
    high = np.append(lcp >= least, False)
    first = np.flatnonzero(~high[:-1] & high[1:])  # before the first high entry of each block
    last = np.flatnonzero(high[:-1] & ~high[1:])
    two = last - first == 1  # most blocks hold two suffixes: one interval
    a, b = left[first[two]], left[last[two]]
    diverse = (a != b) | (a < 0)
    yield from zip(first[two][diverse].tolist(), last[two][diverse].tolist(), lcp[last[two][diverse]].tolist(), strict=True)
    for lo, hi in zip(first[~two].tolist(), last[~two].tolist(), strict=True):
        heights, bytes_ = [*lcp[lo + 1 : hi + 1].tolist(), 0], left[lo : hi + 1].tolist()
        stack: list[list[int]] = []  # length, first suffix, the byte to the left or -1 if they differ
        for k, height in enumerate(heights):
            begin, seen = lo + k, bytes_[k]
            while stack and stack[-1][0] > height:
                size, begin, byte = stack.pop()
                seen = byte if byte == seen else -1
                if seen < 0:
                    yield begin, lo + k, size
            if stack and stack[-1][0] == height:
                if stack[-1][2] != seen:
                    stack[-1][2] = -1
            elif height:
                stack.append([height, begin, seen])


def joined(own: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each owner with those that touch or overlap joined, sorted."""
    if not len(own):
        return own, start, stop
    order = np.lexsort((start, own))
    own, start, stop = own[order], start[order], stop[order]
    wide = int(stop.max()) + 1
    reach = np.maximum.accumulate(own * wide + stop)
    opens = np.ones(len(own), bool)
    opens[1:] = own[1:] * wide + start[1:] > reach[:-1]
    first = np.flatnonzero(opens)
    final = np.append(first[1:], len(own)) - 1
    return own[first], start[first], reach[final] - own[final] * wide


STRING = "bucket long, string long, n long, many long, bytes binary"
PIECE = "anchor long, seg long, off long, bucket long, string long, n long, many long, bytes binary"
COVER = "bucket long, string long, begin long, stop long"
GROUP = "bucket long, string long, off long, repeat long, size long"


def _cut(length: int):
    """The bytes of the listed runs of each document, one row a run."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            out: list[tuple] = []
            for k, listed in enumerate(batch.column("listed").to_pylist()):
                text = data[offsets[k] : offsets[k + 1]]
                out += [(r["anchor"], r["seg"], r["n"], r["many"], text[r["start"] : r["start"] + r["n"] + length - 1].tobytes()) for r in listed]
            if out:
                *numbers, raw = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(raw, pa.binary())], names=["bucket", "string", "n", "many", "bytes"])

    return cut


def _split(level: int, length: int, anchor: int):
    """Runs cut into pieces whose strings have the anchor in one of 2**level parts of its places; a
    piece's bucket is all that every string of its part shares."""
    places = length - anchor + 1
    edges = np.unique(np.arange((1 << level) + 1) * places >> level)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                raw, n = row["bytes"], row["n"]
                hashes = Rolling(np.frombuffer(raw, np.uint8)).windows(anchor) >> _PLACE_BITS
                at = n - 1 + int(np.argmin(hashes[n - 1 : places]))  # the anchor's place: the leftmost least, as in ``anchors``
                for k in range(int(np.searchsorted(edges, at - n + 1, "right")) - 1, int(np.searchsorted(edges, at, "right"))):
                    low, high = int(edges[k]), int(edges[k + 1]) - 1  # places of the anchor in a string of this part
                    first, last = at - min(high, at), at - max(low, at - n + 1)  # starts of such strings
                    piece, common = raw[first : last + length], raw[at - low : at + length - high]
                    bucket = digest(common, (level << 32) + k)
                    out.append((row["anchor"], row["seg"], row["off"] + first, bucket, digest(piece), last - first + 1, row["many"], piece))
            if out:
                *numbers, raw = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(raw, pa.binary())], names=["anchor", "seg", "off", "bucket", "string", "n", "many", "bytes"])

    return split


def _by_suffixes(length: int, groups: bool):
    """Ranges of each string that maximal repeats cover; or, with ``groups``, all their occurrences."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in by_key(batches, "bucket", 8_000):
            owned = table.column("n").to_numpy().astype(np.int64)
            bucket, string = table.column("bucket").to_numpy(), table.column("string").to_numpy()
            array = SuffixArray(table.column("bytes").to_pylist(), owned)
            owner = np.searchsorted(array.base, array.at, "right") - 1
            found = list(intervals(array, length))
            if groups:
                raw, at = array.text.tobytes(), array.at
                for a, b, size in found:
                    who, many = owner[a : b + 1], b - a + 1
                    name = digest(raw[at[a] : at[a] + size])
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[who]), pa.array(string[who]), pa.array(at[a : b + 1] - array.base[who]), pa.array(np.full(many, name)), pa.array(np.full(many, size))], names=["bucket", "string", "off", "repeat", "size"])
                continue
            best = np.zeros(len(array.at), np.int64)
            for a, b, size in found:
                np.maximum(best[a : b + 1], size, out=best[a : b + 1])
            hit = np.flatnonzero((best > 0) & (table.column("many").to_numpy()[owner] == 1))
            start = array.at[hit] - array.base[owner[hit]]
            own, begin, stop = joined(owner[hit], start, start + best[hit])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[own]), pa.array(string[own]), pa.array(begin), pa.array(stop)], names=["bucket", "string", "begin", "stop"])

    return scan


class Repeats:
    """The repeats of ``length`` bytes or more in ``docs`` (doc_id, text), in all documents and within one.

    Texts are their UTF-8 bytes; a null is empty. Rows that repeat a doc_id, and rows without one,
    are texts like others. A very long text is taken in overlapping parts of ``PART`` bytes."""

    def __init__(self, docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET):
        self.length, self.bucket, self.anchor = length, bucket, min(ANCHOR, length)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("own"))
        known = self.docs.where("text IS NOT NULL")
        found = runs(known, length, self.anchor)
        # written, so that the join below has two plain exchanges and Spark can split a hot anchor's rows
        twice = saved(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor"), "repeat-anchors")
        self.runs = saved(found.join(twice, "anchor").select(*found.columns), "repeat-runs")
        segs = self.runs.groupBy("anchor", "seg").agg(F.count(F.lit(1)).alias("many"), F.min(F.struct(*TEXT, "start", "n")).alias("first"))
        self.segs = saved(segs.select("anchor", "seg", "many", "first.*"), "repeat-segs")
        kinds = self.segs.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        listed = self.segs.join(kinds, "anchor").groupBy(*TEXT).agg(F.collect_list(F.struct("anchor", "seg", "start", "n", "many")).alias("listed"))
        listed = listed.withColumnsRenamed({c: f"_{c}" for c in TEXT})
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("own") == F.col("_own"))
        self.strings = known.join(listed, same).mapInArrow(_cut(length), STRING)
        self.many = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        large = kinds.where(F.col("kinds") > bucket).select(F.col("anchor").alias("bucket"))
        self.levels = [] if large.isEmpty() else self._levels(large)

    def _levels(self, large: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
        """Split the large buckets until none is: pieces of runs (``PIECE``), and their different strings (``STRING``)."""
        self.strings = saved(self.strings, "repeat-strings")
        rest = self.strings.join(large, "bucket").withColumns({"anchor": F.col("bucket"), "seg": F.col("string"), "off": F.lit(0).cast("long")})
        self.strings = self.strings.join(large, "bucket", "left_anti").select(*self.strings.columns)
        out = []
        for level in range(1, LEVELS + 1):
            pieces = saved(rest.select("anchor", "seg", "off", "n", "many", "bytes").mapInArrow(_split(level, self.length, self.anchor), PIECE), "repeat-pieces")
            strings = saved(pieces.groupBy("bucket", "string").agg(F.first("n").alias("n"), F.sum("many").alias("many"), F.first("bytes").alias("bytes")), "repeat-strings")
            large = saved(strings.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > self.bucket).select("bucket"), "repeat-large")
            if large.isEmpty():
                out.append((pieces, strings))
                break
            out.append((pieces.join(large, "bucket", "left_anti").select(*pieces.columns), strings.join(large, "bucket", "left_anti").select(*strings.columns)))
            rest = pieces.join(large, "bucket")
        return out

    def _scanned(self, strings: DataFrame, groups: bool) -> DataFrame:
        """What the arrays find, and the strings that occur more than once as a whole."""
        dealt = strings.repartition(self.many, "bucket").sortWithinPartitions("bucket")
        return dealt.mapInArrow(_by_suffixes(self.length, groups), GROUP if groups else COVER)

    def _whole(self, strings: DataFrame, groups: bool) -> DataFrame:
        whole, zero = (F.col("n") + self.length - 1).cast("long"), F.lit(0).cast("long")
        rows = strings.where("many > 1")
        if groups:
            return rows.select("bucket", "string", zero.alias("off"), F.col("string").alias("repeat"), whole.alias("size"))  # named as in the arrays
        return rows.select("bucket", "string", zero.alias("begin"), whole.alias("stop"))

    def _found(self, groups: bool) -> DataFrame:
        """By anchor and seg: covered ranges, or occurrences of groups."""
        names = {"bucket": "anchor", "string": "seg"}
        first = self.segs.withColumnsRenamed({v: k for k, v in names.items()})
        out = self._scanned(self.strings, groups).unionByName(self._whole(first, groups)).withColumnsRenamed(names)
        move = ["off"] if groups else ["begin", "stop"]
        for pieces, strings in self.levels:
            found = self._scanned(strings, groups).unionByName(self._whole(strings, groups)).withColumnsRenamed({"off": "_off"})
            back = found.join(pieces.select("anchor", "seg", "bucket", "string", "off"), ["bucket", "string"])
            shifted = {c: F.col("off") + F.col("_off" if c == "off" else c) for c in move}
            out = out.unionByName(back.withColumns(shifted).select(*out.columns))
        return out

    def groups(self) -> DataFrame:
        """Every occurrence (repeat, size, doc_id, own, start) of every group of equal strings; ``own`` is the text's hash.

        A group has all occurrences of its string, and can be extended neither to the left nor to
        the right by bytes that all of them share, but for one case: inside a longer repeat, a
        stretch that occurs elsewhere too is a group of its own and cuts the longer one in two.
        ``repeat`` names the group."""
        found = self.runs.join(self._found(True), ["anchor", "seg"]).select("repeat", "size", *TEXT, (F.col("start") + F.col("off")).alias("start"))
        found = saved(found.distinct(), "repeat-occurrences")
        key = ["repeat", "size"]
        heads = saved(found.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*TEXT, "start")).alias("head")), "repeat-heads")
        # the runs of a longer repeat occur at the same places but for a shift: their places relative to the first are equal
        shape = found.join(heads, key).groupBy(*key, "n", "head").agg(F.sum(F.xxhash64(*TEXT, F.col("start") - F.col("head.start")).cast("decimal(38,0)")).alias("shape"))
        chain = Window.partitionBy("head.doc_id", "head.own", "n", "shape").orderBy("head.start", "size")
        stop = F.col("head.start") + F.col("size")
        before = F.max(stop).over(chain.rowsBetween(Window.unboundedPreceding, -1))
        opens = F.coalesce(F.col("head.start") > before - (self.length - 1), F.lit(True))
        linked = shape.withColumn("_opens", opens.cast("int")).withColumn("_link", F.sum("_opens").over(chain))
        whole = linked.groupBy("head.doc_id", "head.own", "n", "shape", "_link").agg(F.min(F.struct("head.start", *key)).alias("first"), F.max(stop).alias("stop"))
        named = whole.select("first.repeat", "first.size", (F.col("stop") - F.col("first.start")).alias("_size"))
        out = found.join(named, key)
        return out.select(F.xxhash64("repeat", "_size").alias("repeat"), F.col("_size").alias("size"), *TEXT, "start")

    def ranges(self) -> DataFrame:
        """doc_id, own, begin, stop: byte ranges that repeats cover; they may overlap."""
        return self.runs.join(self._found(False), ["anchor", "seg"]).select(*TEXT, (F.col("start") + F.col("begin")).alias("begin"), (F.col("start") + F.col("stop")).alias("stop"))


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept of every row of ``docs`` (doc_id, text).

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in this or
    another document; strings are judged on the input. n_spans counts the maximal removed runs.
    Null and empty texts keep nothing and lose nothing. Rows that repeat a doc_id, and rows without
    one, are texts like others: equal rows lose what they share. A very long text is held whole,
    beside its spans, by one task at a time. An empty table stays empty. Other columns are not
    read, whatever their names."""
    found = Repeats(docs, length, bucket)
    spans = found.ranges().groupBy(*TEXT).agg(F.collect_set(F.struct("begin", "stop")).alias("spans")).withColumnsRenamed({c: f"_{c}" for c in TEXT})
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("own") == F.col("_own"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = batch.column("spans")
            removed, count, kept = [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                if not rows[k].is_valid:
                    removed.append(0)
                    count.append(0)
                    kept.append(text.tobytes())
                    continue
                pairs = rows[k].values
                begin, stop = (pairs.field(i).to_numpy() for i in (0, 1))
                _, begin, stop = joined(np.zeros(len(begin), np.int64), np.minimum(begin, len(text)), np.minimum(stop, len(text)))
                begin, stop = begin[stop > begin], stop[stop > begin]
                edges = np.concatenate([[0], np.stack([begin, stop], axis=1).ravel(), [len(text)]])
                kept.append(b"".join(text[a:b].tobytes() for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
                removed.append(int((stop - begin).sum()))
                count.append(len(begin))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return found.docs.join(spans, same, "left").select("doc_id", "text", "spans").mapInArrow(cut, CUT)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove_repeats(documents(spark, sf_dir))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every string of 200 bytes, counted: for small tables.
ORACLE = r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM texts WHERE n >= 200)),
twice AS (SELECT s FROM strings GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, i FROM strings WHERE s IN (SELECT s FROM twice)),
marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM hits),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked),
spans AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM spans),
cut AS (
  SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k,
         sum(b - a) AS gone, count(*) AS c
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(c, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM texts LEFT JOIN cut USING (doc_id)
"""
