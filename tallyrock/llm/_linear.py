"""Linear models over hashed n-grams: features of texts in numpy, fitting on a bounded sample.

A feature group holds the n-grams of one kind, hashed to ``2**bits`` places; its value at a place
is the share of the text's n-grams that fall there. A model's margin is therefore its bias plus,
for each group, the mean weight of the text's n-grams: scoring needs no counting."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._text import STEP, U64, mix

POINT = mix(np.arange(1 << 16, dtype=np.uint64) + U64(77))


def code_points(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the texts' offsets among them."""
    lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32), lead[offsets]


def grams(values: np.ndarray, places: np.ndarray, n: int, bits: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table of all n-grams inside each text, and the n + 1 places of the texts."""
    counts = np.maximum(np.diff(places) - n + 1, 0)
    total = max(len(values) - n + 1, 0)
    h = np.full(total, STEP[salt])
    for j in range(n):
        h += values[j : j + total] * STEP[j]
    h = (mix(h) >> U64(64 - bits)).astype(np.int32)
    at = np.concatenate([[0], np.cumsum(counts)])
    if at[-1] != total:
        inside = np.zeros(total + 1, np.int32)
        some = counts > 0
        np.add.at(inside, places[:-1][some], 1)
        np.add.at(inside, places[:-1][some] + counts[some], -1)
        h = h[np.cumsum(inside[:-1]) > 0]
    return h, at


@dataclass
class Model:
    """Weights (models x features) over all groups, end to end, and biases."""

    weights: np.ndarray
    bias: np.ndarray

    def margins(self, groups: list[tuple[np.ndarray, np.ndarray]], bits: int) -> np.ndarray:
        """Texts x models. The models are taken one after the other: beside the n-grams' places, memory
        holds the weights of one of them."""
        out = np.tile(self.bias, (len(groups[0][1]) - 1, 1)).astype(np.float64)
        for g, (h, at) in enumerate(groups):
            some = np.flatnonzero(np.diff(at))
            if not len(some):
                continue
            first, count = at[some], np.diff(at)[some]
            for m, row in enumerate(self.weights):
                table = row[g << bits : (g + 1) << bits]
                out[some, m] += np.add.reduceat(table[h], first, dtype=np.float64) / count
        return out


def of_rows(groups: list[tuple[np.ndarray, np.ndarray]], rows: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams of some texts (ascending) alone."""
    if len(rows) == len(groups[0][1]) - 1:
        return groups
    out = []
    for h, at in groups:
        lengths = np.diff(at)[rows]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out.append((h[np.repeat(at[:-1][rows] - ends[:-1], lengths) + np.arange(ends[-1])], ends))
    return out


def sampled(rows: DataFrame, label: str, counts: dict, most: int) -> DataFrame:
    """At most ``most`` rows of each label (``counts``: rows of each), whatever the table's size.

    Taken are the doc_ids with the least hashes, each once (of rows that repeat it, the least). A
    first cut by the hash alone leaves somewhat more than that to sort."""
    hashed, span = F.xxhash64("doc_id"), 1 << 62
    cut = F.element_at(F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, min(span, int(span * (1.2 * most + 50) / n))))), F.col(label))
    rest = [c for c in rows.columns if c not in ("doc_id", label)]
    near = rows.where(F.pmod(hashed, F.lit(span)) < cut).groupBy("doc_id").agg(F.min(F.struct(label, *rest)).alias("_row")).select("doc_id", "_row.*")
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).drop("_place")


def sparse_rows(groups: list[tuple[np.ndarray, np.ndarray]], bits: int) -> list[tuple[bytes, bytes]]:
    """Each text's features as (places int32, values float32) bytes."""
    out = []
    for d in range(len(groups[0][1]) - 1):
        places, values = [], []
        for g, (h, at) in enumerate(groups):
            unique, count = np.unique(h[at[d] : at[d + 1]], return_counts=True)
            places.append(unique + (g << bits))
            values.append(count / max(1, at[d + 1] - at[d]))
        out.append((np.concatenate(places).astype("<i4").tobytes(), np.concatenate(values).astype("<f4").tobytes()))
    return out


class Sample:
    """A bounded sample's features on the driver, in compressed rows."""

    def __init__(self, rows: list[tuple[bytes, bytes]], size: int):
        self.size = size
        places = [np.frombuffer(a, "<i4") for a, _ in rows]
        self.at = np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)
        self.places = np.concatenate(places) if rows else np.zeros(0, np.int32)
        self.values = np.concatenate([np.frombuffer(b, "<f4") for _, b in rows]) if rows else np.zeros(0, np.float32)

    def rows(self, some: np.ndarray) -> Sample:
        out = Sample([], self.size)
        lengths = np.diff(self.at)[some]
        out.at = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        index = np.repeat(self.at[:-1][some] - out.at[:-1], lengths) + np.arange(out.at[-1])
        out.places, out.values = self.places[index], self.values[index]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        """Each row's product with w, some rows at a time."""
        out = np.zeros(len(self.at) - 1)
        for a in range(0, len(out), 256):
            at = self.at[a : a + 257]
            part = slice(at[0], at[-1])
            total = np.concatenate([[0.0], np.cumsum(self.values[part] * w[self.places[part]], dtype=np.float64)])
            out[a : a + 256] = total[at[1:] - at[0]] - total[at[:-1] - at[0]]
        return out

    def gather(self, g: np.ndarray) -> np.ndarray:
        """The sum of all rows, each times its g, some rows at a time."""
        out = np.zeros(self.size)
        for a in range(0, len(g), 256):
            at = self.at[a : a + 257]
            part = slice(at[0], at[-1])
            out += np.bincount(self.places[part], weights=self.values[part] * np.repeat(g[a : a + 256], np.diff(at)), minlength=self.size)
        return out


def fit(x: Sample, y: np.ndarray, loss: str, weight: np.ndarray | None = None, rounds: int = 60, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear model of y (+1, -1): "hinge" (squared, a linear support vector
    machine) or "log" (logistic regression), by Adam over the whole sample."""
    weight = np.ones(len(y)) if weight is None else weight
    weight = weight / weight.sum()
    mean = x.gather(np.ones(len(y))) / max(1, len(y))
    scale = np.where(mean > 0, 1 / np.sqrt(mean + 1e-6), 0)  # rare n-grams get larger steps
    squares = Sample([], x.size)
    squares.at, squares.places, squares.values = x.at, x.places, x.values**2
    norm = np.sqrt(squares.times(scale**2).mean()) if len(y) else 1.0
    del squares
    scale = scale / max(norm, 1e-9)  # rows have about unit length
    values = Sample([], x.size)
    values.at, values.places, values.values = x.at, x.places, x.values * scale.astype(np.float32)[x.places]
    w, b = np.zeros(x.size), 0.0
    m, v, mb, vb = np.zeros(x.size), np.zeros(x.size), 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = y * (values.times(w) + b)
        slope = -y * weight * (2 * np.maximum(1 - margin, 0) if loss == "hinge" else 1 / (1 + np.exp(np.clip(margin, -50, 50))))
        grad = values.gather(slope) + decay * w
        gb = slope.sum()
        m, mb = 0.9 * m + 0.1 * grad, 0.9 * mb + 0.1 * gb
        v, vb = 0.99 * v + 0.01 * grad**2, 0.99 * vb + 0.01 * gb**2
        rate = 0.02 / (1 + 0.02 * t)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w * scale, float(b)


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid that turns margins into probabilities (weighted, smoothed targets)."""
    up, down = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(g * margin).sum() + 1e-3 * (a - 1), g.sum()])
        curve = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(curve, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def binary(rows: list[tuple[bytes, bytes]], keys: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(keys | {"places": pa.array([r[0] for r in rows], pa.binary()), "values": pa.array([r[1] for r in rows], pa.binary())})
