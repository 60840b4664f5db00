"""Quality rules: fixed word rules, then a calibrated classifier over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._linear import POINT, Model, Sample, binary, code_points, fit, grams, platt, sampled, sparse_rows
from ._shared import documents, small_batches
from ._text import SPACE, U64, chunks, hashes, mix, shingles, utf8, words

BITS = 14
#: Labelled rows of each class that the classifier learns from at most (all of them if fewer).
SAMPLE_ROWS = 2000
#: A document stays if its probability of being good is at least this. Below one half, since a good document
#: that is dropped costs more here than a bad one that stays: the word rules already take the worst.
THRESHOLD = 0.3
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))


def _groups(data: np.ndarray, offsets: np.ndarray, word_hashes: np.ndarray, places: np.ndarray) -> list:
    points, at = code_points(data.tobytes(), offsets)
    values = POINT[points & 0xFFFF] + (points >> 16)
    return [grams(values, at, 3, BITS, 1), grams(word_hashes, places, 1, BITS, 2), grams(word_hashes, places, 2, BITS, 3)]


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        some, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, places = words(some, at)
        yield some, at, hashes(some, starts, ends), starts, ends, places


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _repeats(word_hashes: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words of each text that stand in a 5-word window found twice or more in it."""
    runs, at = shingles(word_hashes, places)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = runs ^ mix(doc.astype(U64) + U64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(word_hashes) + 1, np.int32)
    start = (places[:-1][doc] + np.arange(len(doc)) - at[:-1][doc])[twice]
    np.add.at(covered, start, 1)
    np.add.at(covered, start + 5, -1)
    return _per_text(np.cumsum(covered[:-1]) > 0, places)


def _dup_lines(data: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines of each text that have a word and are equal to an earlier line of it; ``starts`` are its words'."""
    breaks = np.flatnonzero(data == 10)
    n = len(at) - 1
    start = np.concatenate([at[:-1], breaks + 1])
    doc = np.concatenate([np.arange(n), np.searchsorted(at, breaks, "right") - 1])
    end = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, start)], at[doc + 1])
    full = np.searchsorted(starts, start) < np.searchsorted(starts, end)
    start, end, doc = start[full], end[full], doc[full]
    lines = hashes(data, start, end)
    order = np.lexsort((lines, doc))
    again = (lines[order][1:] == lines[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][1:][again], minlength=n)


@dataclass
class QualityModel:
    """Probability of a good text: a sigmoid of the linear margin; without both classes, always 1."""

    model: Model
    slope: float = 0.0
    shift: float = 50.0

    def probability(self, groups: list) -> np.ndarray:
        margin = self.model.margins(groups, BITS)[:, 0]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """Learn from labelled documents: at most ``sample_rows`` of each class, taken by a hash of doc_id.

    Labels with a null quality or doc_id are not used; rows that repeat a doc_id are learnt from once. One in five of the sample is held out of
    the regression to calibrate its probabilities; the classes are weighed as they are labelled."""
    small_batches(docs.sparkSession)
    labels = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.max("quality") > 0).alias("good"))
    counts = {r["good"]: r["count"] for r in labels.groupBy("good").count().collect()}
    size = 3 << BITS
    nothing = QualityModel(Model(np.zeros((1, size), np.float32), np.zeros(1)))
    if len(counts) < 2:
        return nothing
    chosen = sampled(labels, "good", counts, sample_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for some, at, found, _, _, places in _parts(batch.column("text")) for r in sparse_rows(_groups(some, at, found, places), BITS)]
            if rows:
                yield binary(rows, {"doc_id": batch.column("doc_id").cast(pa.int64()), "good": batch.column("good")})

    # 2 * sample_rows rows at most, of 8 + 1 bytes
    met = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    once = met.groupBy("doc_id", "good").agg(F.min("text").alias("text"))
    rows = once.mapInArrow(features, "doc_id long, good boolean, places binary, values binary").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["places"]))
    y = np.array([1.0 if r["good"] else -1.0 for r in rows])
    if len(set(y.tolist())) < 2:
        return nothing
    sample = Sample([(r["places"], r["values"]) for r in rows], size)
    del rows
    weight = np.where(y > 0, counts[True] / max(1, (y > 0).sum()), counts[False] / max(1, (y < 0).sum()))
    fold = np.arange(len(y)) % 5
    if len(y) < 50 or len(set(y[fold == 0].tolist())) < 2:
        fold = np.ones(len(y), int)
    learn, rest = np.flatnonzero(fold != 0), np.flatnonzero(fold == 0) if (fold == 0).any() else np.arange(len(y))
    w, b = fit(sample.rows(learn), y[learn], "log")
    slope, shift = platt(sample.rows(rest).times(w) + b, y[rest], weight[rest] / weight.mean())
    return QualityModel(Model(w.astype(np.float32)[None], np.array([b])), slope, shift)


RULES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("probability", T.DoubleType()), ("kept", T.BooleanType())]


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the counts of each whole text, base_failed, probability and kept.

    A null text counts as empty and fails the base rules (under 10 words). Columns that have the
    names of these results are replaced; all others pass through, nulls and repeated rows too."""
    small_batches(docs.sparkSession)
    names = {n for n, _ in RULES}
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType(kept + [T.StructField(n, t) for n, t in RULES])
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            if not batch.num_rows:
                continue
            found: dict[str, list[np.ndarray]] = {n: [] for n in names}
            for some, at, word_hashes, starts, _, places in _parts(batch.column("text")):
                n_words = np.diff(places)
                repeat = _repeats(word_hashes, places)
                failed = (n_words < 10) | (100 * repeat > 20 * n_words)
                p = model.probability(_groups(some, at, word_hashes, places))
                solid = ~SPACE[some] & ((some & 0xC0) != 0x80)
                for n, v in (("n_words", n_words), ("word_chars", _per_text(solid, at)), ("n_symbols", _per_text(SYMBOL[some], at)), ("n_dup_lines", _dup_lines(some, at, starts)), ("n_repeat_words", repeat), ("base_failed", failed), ("probability", p), ("kept", ~failed & (p >= threshold))):
                    found[n].append(v)
            columns = [batch.column(f.name) for f in kept]
            columns += [pa.array(np.concatenate(found[n]), pa.bool_() if t == T.BooleanType() else pa.float64() if t == T.DoubleType() else pa.int64()) for n, t in RULES]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    return docs.mapInArrow(score, schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model).drop("text")
