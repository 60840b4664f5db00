"""Token ids of whole texts by a public tokenizer, with each distinct piece encoded once.

Both vocabularies cut a text into runs of letters, digits or other signs before they merge
inside each run, so the ids of a text are those of its runs, one after the other. In texts of
Latin letters the runs are found with numpy and looked up, by a hash and then by all their bytes,
in a bounded table of each worker; any other text, and any that holds the literal of an added token, goes to the tokenizer as it is."""

from __future__ import annotations

import os
import unicodedata
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa

from ._text import U64, chunks, equal, hashes, utf8

#: Runs that a worker remembers at most; beyond it the table begins anew. About 70 bytes each.
REMEMBERED = 1_000_000
#: Code points that the fast way knows: below it every text is in normal form C.
KNOWN = 0x250


def _kinds() -> np.ndarray:
    """1 letter, 2 number, 3 white space, 4 other, 0 left to the tokenizer."""
    kinds = np.zeros(KNOWN, np.uint8)
    for c in range(KNOWN):
        category = unicodedata.category(chr(c))[0]
        kinds[c] = {"L": 1, "N": 2, "Z": 3}.get(category, 4)
    kinds[[*range(0x09, 0x0E), 0x85]] = 3
    kinds[0x130] = 0  # its small form has two code points
    kinds[ord("'")] = 0  # begins contractions: handled beside its neighbours
    return kinds


def _append(ends: np.ndarray, flat: np.ndarray, known: int, sizes: list[int], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Add lists of ``sizes``, given end to end, behind the ``known`` ones; the arrays double as they fill."""
    at = int(ends[known])
    while known + len(sizes) + 1 > len(ends):
        ends = np.concatenate([ends, np.zeros_like(ends)])
    while at + len(values) > len(flat):
        flat = np.concatenate([flat, np.zeros_like(flat)])
    ends[known + 1 : known + len(sizes) + 1] = at + np.cumsum(sizes)
    flat[at : at + len(values)] = values
    return ends, flat


class Encoder:
    """ids(texts) by a tokenizers file; ``style`` is "byte" (white space kept) or "word" (dropped, small letters)."""

    def __init__(self, path: str, style: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.style, self.kinds = style, _kinds()
        self.small = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(KNOWN)], np.uint32)
        self._forget()

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)  # of the runs known, sorted
        self.slots = np.zeros(0, np.int32)  # where each run's ids lie: flat[ends[slot] : ends[slot + 1]]
        self.ends = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.raw_ends, self.raw = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint8)  # the runs themselves, likewise

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys among the known ones, and whether they are there."""
        at = np.searchsorted(self.keys, keys)
        there = at < len(self.keys)
        there[there] = self.keys[at[there]] == keys[there]
        return at, there

    def _learn(self, keys: np.ndarray, runs: list[str], raw: list[np.ndarray]) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        known = len(self.keys)
        self.ends, self.flat = _append(self.ends, self.flat, known, [len(i) for i in ids], np.fromiter(chain.from_iterable(ids), np.uint32))
        self.raw_ends, self.raw = _append(self.raw_ends, self.raw, known, [len(r) for r in raw], np.concatenate(raw))
        places = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, places, keys)
        self.slots = np.insert(self.slots, places, np.arange(known, known + len(ids), dtype=np.int32))

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null has none."""
        data, offsets = utf8(column)
        out: list[np.ndarray] = []
        for i, j in chunks(offsets):
            out += self._some(data[offsets[i] : offsets[j]].tobytes(), offsets[i : j + 1] - offsets[i])
        return out

    def _some(self, raw: bytes, offsets: np.ndarray) -> list[np.ndarray]:
        text = raw.decode("utf-8")
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(points) == len(raw):
            starts = offsets
        else:
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            starts = lead[offsets]
        known = np.minimum(points, KNOWN - 1)
        kinds = np.where(points < KNOWN, self.kinds[known], 0).astype(np.uint8)
        n = len(offsets) - 1
        odd = np.concatenate([[0], np.cumsum(kinds == 0)])
        plain = odd[starts[1:]] == odd[starts[:-1]]
        if self.style == "byte":
            space = (kinds == 3).astype(np.int8)
            bad = np.zeros(len(points) + 1, np.int64)  # white space that does not stand alone, or is no blank
            if len(points):
                twice = np.zeros(len(points), bool)
                twice[1:] = (space[1:] & space[:-1]).astype(bool)
                bad[1:] = np.cumsum(twice)
            plain &= bad[starts[1:]] == bad[np.minimum(starts[:-1] + 1, len(points))]
        plain[self._holders(text, starts)] = False
        result: list[np.ndarray | None] = [None] * n
        rest = np.flatnonzero(~plain)
        if len(rest):
            for d, ids in zip(rest, self._whole([text[starts[d] : starts[d + 1]] for d in rest]), strict=True):
                result[d] = ids
        if plain.any() and len(points):
            self._runs(text, points, kinds, starts, plain, result)
        return [np.zeros(0, np.uint32) if r is None else r for r in result]

    def _holders(self, text: str, starts: np.ndarray) -> list[int]:
        """The texts in which an added token begins; a find that runs over a text's end does no harm."""
        found = []
        for token in self.added:
            literal, inside = token.content, text
            if token.normalized:  # compared after the normalizer, which leaves the length of plain texts
                literal, inside = literal.lower(), "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            at = inside.find(literal)
            while at >= 0:
                found.append(int(np.searchsorted(starts, at, "right")) - 1)
                at = inside.find(literal, at + 1)
        return found

    def _runs(self, text: str, points: np.ndarray, kinds: np.ndarray, starts: np.ndarray, plain: np.ndarray, result: list) -> None:
        lengths = np.diff(starts)
        use = np.repeat(plain, lengths)
        begin = np.ones(len(points), bool)
        begin[1:] = kinds[1:] != kinds[:-1]
        begin[starts[:-1][lengths > 0]] = True
        if self.style == "byte":  # a blank goes with the run that follows it in the same text
            before = np.zeros(len(points), bool)
            before[1:] = points[:-1] == 32
            before[starts[:-1][lengths > 0]] = False
            begin &= ~(before & (kinds != 3))
            begin |= kinds == 3
        else:
            begin |= kinds == 2  # digits stand alone
            points = np.where(points < KNOWN, self.small[np.minimum(points, KNOWN - 1)], points)
        first = np.flatnonzero(begin)
        last = np.append(first[1:], len(points))
        good = use[first] if self.style == "byte" else use[first] & (kinds[first] != 3)
        first, last = first[good], last[good]
        wide = points.astype(np.uint16).view(np.uint8)  # all known points have two bytes
        first, size = first * 2, (last - first) * 2
        keys = hashes(wide, first, first + size)
        unique, at, back = np.unique(keys, return_index=True, return_inverse=True)
        _, there = self._find(unique)
        if len(self.keys) + int((~there).sum()) > REMEMBERED:
            self._forget()
            there[:] = False
        fresh = np.flatnonzero(~there)
        for lo in range(0, len(fresh), 20_000):
            some = fresh[lo : lo + 20_000]
            bounds = list(zip(first[at[some]].tolist(), size[at[some]].tolist(), strict=True))
            self._learn(unique[some], [text[i // 2 : (i + n) // 2] for i, n in bounds], [wide[i : i + n] for i, n in bounds])
        known = self.slots[self._find(unique)[0]]
        slot = known[back]
        # of two runs with one hash, only the one that was learnt may take its ids
        sure = self.raw_ends[slot + 1] - self.raw_ends[slot] == size
        sure[sure] = equal(wide, first[sure], self.raw, self.raw_ends[slot[sure]], size[sure])
        begin = self.ends[slot]
        size = self.ends[slot + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        places = np.searchsorted(first, 2 * starts)
        doubt = np.concatenate([[0], np.cumsum(~sure)])[places]
        places = total[places]
        for d in np.flatnonzero(plain):
            if doubt[d] == doubt[d + 1]:
                result[d] = ids[places[d] : places[d + 1]]
            else:
                result[d] = self._whole([text[starts[d] : starts[d + 1]]])[0]


@cache
def encoder(path: str, style: str) -> Encoder:
    """One for each worker process, so that what it remembers serves all its tasks."""
    return Encoder(path, style)
