"""Hierarchical language identification: the family first, then one-versus-one linear support
vector machines between the languages of that family. Both levels read hashed letter n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._linear import POINT, Model, Sample, binary, code_points, fit, grams, of_rows, sampled, sparse_rows
from ._shared import documents, small_batches
from ._text import chunks, utf8

BITS = 14
#: Rows of each language that are learnt from at most (all of them if fewer), taken by a hash of doc_id.
SAMPLE_ROWS = 1000
#: Families of closely related languages; a language in none of them is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}


def family(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its small form, and whether it is a letter; beyond the first plane by the letter test alone."""
    small = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    for c in np.flatnonzero(letter[:0x10000]).tolist():
        if len(x := chr(c).lower()) == 1:
            small[c] = ord(x)
    return small, letter


def _groups(column: pa.Array) -> Iterator[tuple[list, np.ndarray]]:
    """N-gram groups of some texts, and whether each text has a letter."""
    small, letter = _letters()
    data, offsets = utf8(column)
    for i, j in chunks(offsets):
        points, at = code_points(data[offsets[i] : offsets[j]].tobytes(), offsets[i : j + 1] - offsets[i])
        is_letter = letter[points]
        keep = is_letter.copy()  # letters, and one blank between runs of them
        keep[1:] |= is_letter[:-1]
        points = np.where(is_letter, small[points], 32)[keep]
        total = np.concatenate([[0], np.cumsum(keep)])
        count = np.concatenate([[0], np.cumsum(is_letter)])
        values = POINT[points & 0xFFFF] + (points >> 16)
        places = total[at]
        yield [grams(values, places, n, BITS, n) for n in (1, 2, 3, 4)], count[at[1:]] > count[at[:-1]]


@dataclass
class LanguageModel:
    """One linear model for each pair of families, and in each family one for each pair of its languages."""

    families: list[str]
    languages: dict[str, list[str]]
    duels: dict[str, tuple[list[tuple[str, str]], Model]]  # by level: "" for the families, or a family

    def predict(self, groups: list, has_letter: np.ndarray) -> tuple[list[str], np.ndarray]:
        """A text meets the duels of the families, then those of its family alone."""
        langs, score = np.full(len(has_letter), "und", object), np.zeros(len(has_letter))
        rows = np.flatnonzero(has_letter)
        if not len(rows) or not self.families:
            return langs.tolist(), score
        groups = of_rows(groups, rows)
        chosen, score[rows] = self._winner("", self.families, groups)
        for k, f in enumerate(self.families):
            own = np.flatnonzero(chosen == k)
            if len(own):
                winner, sure = self._winner(f, self.languages[f], of_rows(groups, own))
                langs[rows[own]] = np.array(self.languages[f], object)[winner]
                score[rows[own]] *= sure
        return langs.tolist(), score

    def _winner(self, level: str, names: list[str], groups: list) -> tuple[np.ndarray, np.ndarray]:
        """Most won duels, ties by the sum of margins; the score is the least sure of the winner's duels."""
        n = len(groups[0][1]) - 1
        votes, least = np.zeros((n, len(names))), np.full((n, len(names)), 50.0)
        if level in self.duels:
            pairs, model = self.duels[level]
            margins = model.margins(groups, BITS)
            for k, (a, b) in enumerate(pairs):
                for name, m in ((a, margins[:, k]), (b, -margins[:, k])):
                    c = names.index(name)
                    votes[:, c] += (m > 0) + 1e-3 * np.tanh(m)
                    least[:, c] = np.minimum(least[:, c], m)
        won = votes.argmax(axis=1)
        return won, 1 / (1 + np.exp(-np.clip(2 * least[np.arange(n), won], -50, 50)))

    @property
    def pairs(self) -> list[tuple[str, str, str]]:
        """Level, first and second of every duel."""
        return [(level, a, b) for level, (pairs, _) in self.duels.items() for a, b in pairs]


def fit_languages(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Learn from ``docs`` (doc_id, text, lang): at most ``sample_rows`` of each language.

    Rows with a null doc_id, text or lang are not used; of rows that repeat a doc_id, one is. The
    number of languages is taken to be small (the model has 256 KB for each duel)."""
    small_batches(docs.sparkSession)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    languages: dict[str, list[str]] = {}
    for lang in sorted(counts):
        languages.setdefault(family(lang), []).append(lang)
    families, size = sorted(languages), 4 << BITS
    levels = {"": families} | languages
    levels = {level: list(combinations(names, 2)) for level, names in levels.items() if len(names) > 1}
    if not levels:
        return LanguageModel(families, languages, {})
    chosen = sampled(known.select("doc_id", "lang", "text"), "lang", counts, sample_rows)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for groups, _ in _groups(batch.column("text")) for r in sparse_rows(groups, BITS)]
            if rows:
                yield binary(rows, {"doc_id": batch.column("doc_id").cast(pa.int64()), "lang": batch.column("lang")})

    rows = sorted(chosen.mapInArrow(features, "doc_id long, lang string, places binary, values binary").collect(), key=lambda r: (r["doc_id"] or 0, r["places"]))
    lang = np.array([r["lang"] for r in rows], object)
    group = np.array([family(x) for x in lang], object)
    sample = Sample([(r["places"], r["values"]) for r in rows], size)
    del rows
    duels = {}
    for level, pairs in levels.items():
        names, fitted = group if level == "" else lang, []
        for a, b in pairs:
            some = np.flatnonzero((names == a) | (names == b))
            y = np.where(names[some] == a, 1.0, -1.0)
            weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum()))
            fitted.append(fit(sample.rows(some), y, "hinge", weight, rounds=40) if len(some) else (np.zeros(size), 0.0))
        duels[level] = pairs, Model(np.stack([w.astype(np.float32) for w, _ in fitted]), np.array([b for _, b in fitted]))
    return LanguageModel(families, languages, duels)


def predict_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) from the whole text alone.

    A null text, or one without a letter, is ``und`` with score 0; so is every text where nothing
    could be learnt. Columns named lang_pred or score are replaced, all others pass through."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for groups, has_letter in _groups(batch.column("text")):
                a, b = spread.value.predict(groups, has_letter)
                langs += a
                scores.append(b)
            if langs:
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], names=[f.name for f in schema.fields])

    return docs.mapInArrow(predict, schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_languages(docs.where(~held_out).select("doc_id", "text", "lang"))
    found = predict_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
