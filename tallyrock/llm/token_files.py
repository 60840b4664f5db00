"""Token ids of documents in files: one concatenated id array a file, document ends in Elias-Fano form.

File: the ids, little-endian, 16 or 32 bits each; then the Elias-Fano form of the document ends
(ascending ids counts) and of the doc_ids; then a JSON footer, its length in 8 bytes and ``MAGIC``.
An Elias-Fano sequence of n values below u keeps floor(log2(u / n)) low bits of each value packed,
and the high bits in unary; every ``SAMPLE``-th set bit has its place stored, so that ``select``
finds any value by reading a few words."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, running_totals, saved, shared_dir, small_batches

MAGIC = b"TRKIDS01"
SAMPLE = 256
#: Documents whose offsets are taken from a file at a time.
READ = 4096
#: A file ends with the document that brings it to so many ids.
FILE_IDS = 16 << 20


class EliasFano:
    """A non-decreasing sequence of values of 0 or more in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
        values = np.asarray(values, np.uint64)
        low = values & np.uint64((1 << bits) - 1)
        packed = ((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        return cls(n, bits, np.packbits(packed.ravel(), bitorder="little"), np.packbits(unary, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def select(self, i: int) -> int:
        """The i-th value, by way of the sampled place before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skip = at >> 3, at & 7
        bits = np.unpackbits(self.high[byte : byte + 2 * SAMPLE // 8 + 1], bitorder="little")
        bits[:skip] = 0
        while int(bits.sum()) <= left:  # a sparse stretch: go on by whole bytes
            left -= int(bits.sum())
            byte += len(bits) >> 3
            bits = np.unpackbits(self.high[byte : byte + 1024], bitorder="little")
        place = (byte << 3) + int(np.flatnonzero(bits)[left])
        first = i * self.low_bits
        few = np.unpackbits(self.low[first >> 3 : ((first + self.low_bits) >> 3) + 1], bitorder="little")[first & 7 :][: self.low_bits]
        return (place - i) << self.low_bits | sum(int(b) << k for k, b in enumerate(few))

    def span(self, i: int, j: int) -> np.ndarray:
        """The values from i to before j, by the sampled place before i and that behind j: nothing outside is read."""
        if i >= j:
            return np.zeros(0, np.int64)
        first = i // SAMPLE
        begin = int(self.samples[first]) >> 3
        last = -(-j // SAMPLE)
        stop = (int(self.samples[last]) >> 3) + 1 if last < len(self.samples) else len(self.high)
        places = np.flatnonzero(np.unpackbits(self.high[begin:stop], bitorder="little")) + (begin << 3)
        skip = int(np.searchsorted(places, int(self.samples[first]))) + i - first * SAMPLE
        places = places[skip : skip + j - i]
        low = np.zeros(j - i, np.int64)
        if self.low_bits:
            at = i * self.low_bits
            bits = np.unpackbits(self.low[at >> 3 : ((j * self.low_bits) >> 3) + 1], bitorder="little")[at & 7 :][: (j - i) * self.low_bits]
            low = (bits.reshape(j - i, self.low_bits).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((places - np.arange(i, j)) << self.low_bits) | low

    def decode(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        low = (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)
        return ((places - np.arange(self.n)) << self.low_bits) | low

    def sections(self) -> list[bytes]:
        return [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]

    @classmethod
    def parse(cls, n: int, low_bits: int, parts: list[bytes]) -> EliasFano:
        return cls(n, low_bits, np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4"))


class TokenFile:
    """A file read back: ``ids``, ``ends`` and ``doc_ids``."""

    def __init__(self, path: str):
        files, name = fs.FileSystem.from_uri(path)
        with files.open_input_file(name) as f:
            size = f.size()
            f.seek(size - 16)
            tail = f.read(16)
            if tail[8:] != MAGIC:
                raise ValueError(f"{path} is no token file")
            length = int.from_bytes(tail[:8], "little")
            f.seek(size - 16 - length)
            self.footer = json.loads(f.read(length))
            f.seek(0)
            raw = f.read(self.footer["id_bytes"])
            parts = [f.read(n) for n in self.footer["sections"]]
        self.ids = np.frombuffer(raw, f"<u{self.footer['width']}")
        self.ends = EliasFano.parse(self.footer["docs"], self.footer["end_bits"], parts[:3])
        self.keys = EliasFano.parse(self.footer["docs"] - self.footer["nulls"], self.footer["key_bits"], parts[3:])

    def doc_ids(self, i: int = 0, j: int | None = None) -> list[int | None]:
        """Of the documents from i to before j."""
        nulls, j = self.footer["nulls"], self.footer["docs"] if j is None else j
        empty = max(0, min(j, nulls) - i)
        return [None] * empty + (self.keys.span(max(i, nulls) - nulls, j - nulls) + self.footer["first"] if j > max(i, nulls) else np.zeros(0, np.int64)).tolist()

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where the documents from i to before j begin, and where the last of them ends: j - i + 1 offsets."""
        return self.ends.span(i - 1, j) if i else np.concatenate([[0], self.ends.span(0, j)])

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, found by ``select`` alone."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


class _Writer:
    """One file; it gets its name only when it is whole, so a lost task leaves nothing that is read."""

    def __init__(self, folder: str, width: int):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.part, self.name = f"{self.folder}/.{uuid.uuid4().hex}", f"ids-{uuid.uuid4().hex}.bin"
        self.out, self.width = self.files.open_output_stream(self.part), width
        self.count, self.ends, self.keys = 0, [], []

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.width}").tobytes())
        self.count += len(ids)
        self.ends.append(self.count)
        self.keys.append(key)

    def close(self) -> tuple[str, int, int]:
        keys = np.array([k for k in self.keys if k is not None], np.int64)
        first = int(keys[0]) if len(keys) else 0
        ends, packed = EliasFano.encode(np.array(self.ends, np.int64)), EliasFano.encode(keys - first)
        parts = ends.sections() + packed.sections()
        footer = json.dumps({"id_bytes": self.count * self.width, "width": self.width, "docs": len(self.ends), "nulls": len(self.keys) - len(keys), "first": first, "end_bits": ends.low_bits, "key_bits": packed.low_bits, "sections": [len(p) for p in parts]}).encode()
        self.out.write(b"".join([*parts, footer, len(footer).to_bytes(8, "little"), MAGIC]))
        self.out.close()
        self.files.move(self.part, f"{self.folder}/{self.name}")
        return self.name, len(self.ends), self.count


def write_token_files(docs: DataFrame, tokenizer: str, style: str = "byte", end_id: int = 0, folder: str | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every text, append ``end_id`` to each, write files in ascending doc_id order.

    Returns the manifest (a written table): part and seq (file order), path, n_docs, n_ids. Null
    and empty texts have the end id alone; null doc_ids come first; rows that repeat a doc_id are
    written each, in any order among themselves. A very long text is encoded and written whole, by
    one task. An empty table has no files. Other columns are not read. Executors write to ``folder``, which must be shared (by default below the
    session's checkpoint folder); a file appears under its name only once it is whole."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import encoder

        encode, writer, rows = encoder(tokenizer, style), None, []
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                for key, ids in zip(some.column("doc_id").to_pylist(), encode(some.column("text")), strict=True):
                    writer = writer or _Writer(folder, width)
                    writer.add(key, np.append(ids, end_id))
                    if writer.count >= file_ids:
                        rows.append(writer.close())
                        writer = None
        if writer:
            rows.append(writer.close())
        if rows:
            names, n_docs, n_ids = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part] * len(rows), pa.int32()), "seq": pa.array(range(len(rows)), pa.int32()), "path": pa.array([f"{folder}/{n}" for n in names]), "n_docs": pa.array(n_docs, pa.int64()), "n_ids": pa.array(n_ids, pa.int64())})

    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(many, "doc_id").sortWithinPartitions("doc_id")
    return saved(ordered.mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files' own bytes.

    Offsets come from the files' select structures, ``READ`` documents at a time; no table of them is made."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                got = TokenFile(path)
                for i in range(0, got.footer["docs"], READ):
                    j = min(i + READ, got.footer["docs"])
                    at = got.bounds(i, j)
                    crc = [zlib.crc32(got.ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(got.doc_ids(i, j), pa.int64()), "start": pa.array(at[:-1] + base), "n_tokens": pa.array(np.diff(at)), "ids_crc32": pa.array(crc, pa.int64())})

    placed = running_totals(manifest, ["part", "seq"], {"base": "n_ids"}, "token-offsets").select("path", "base")
    many = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(many, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "byte", 0))
