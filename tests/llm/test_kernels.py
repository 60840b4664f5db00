"""The numpy helpers against plain Python."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyrock.llm import _text, mixing, near_dedup, packing, repeats, sharding, token_files
from tallyrock.llm.tokens import Encoder

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab cé\n\t日.'1", max_size=40)), max_size=8)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words(texts):
    data, offsets = _text.utf8(pa.array(texts, pa.string()))
    starts, ends, places = _text.words(data, offsets)
    got = [[bytes(data[a:b]) for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(places, places[1:], strict=False)]
    assert got == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_shingles(texts):
    data, offsets = _text.utf8(pa.array(texts, pa.string()))
    starts, ends, places = _text.words(data, offsets)
    runs, at = _text.shingles(_text.hashes(data, starts, ends), places)
    seen = {}
    for t, a, b in zip(texts, at, at[1:], strict=False):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] * bool(w)
        assert len(want) == b - a
        for x, h in zip(want, runs[a:b], strict=True):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("name,style", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder(name, style):
    r = random.Random(5)
    texts = [None, "", "it's O'Neil's", "<|endoftext|> a", "日本 é", "İx ǅ", " a  b\n\nc", *("".join(r.choice("abZ 1.\n\té'Ü#") for _ in range(r.randint(1, 40))) for _ in range(500))]
    encode = Encoder(public_tokenizers.path(name), style)
    want = [e.ids for e in encode.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [x.tolist() for x in encode(pa.array(texts))] == want


@pytest.mark.parametrize("name,style", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_added_tokens(name, style):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|startoftext|>a", "a<|endoftext|>", "<|ENDOFTEXT|>", "x <|endof", "text|> <|endoftext|><|endoftext|>", "", "plain", "é <|endoftext|> 日本", None]
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    want = [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in Encoder(public_tokenizers.path(name), style)(pa.array(texts))] == want
    assert any({50256, 49407} & set(ids) for ids in want)


@given(st.lists(st.integers(0, 3000), max_size=900))
@settings(max_examples=60, deadline=None)
def test_elias_fano(steps):
    values = np.cumsum(steps).astype(np.int64)
    coded = token_files.EliasFano.encode(values)
    assert coded.decode().tolist() == values.tolist()
    for i in {0, len(values) // 2, len(values) - 1} & set(range(len(values))):
        assert coded.select(i) == values[i]
    assert len(coded.low) + len(coded.high) <= len(values) * (2 + np.log2(max(2, (values[-1] + 1) / len(values)))) / 8 + 3 if len(values) else True


def test_hilbert_steps():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), axis=-1).reshape(-1, d)
        place = sharding.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours in space


@given(st.lists(st.integers(1, 30), min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_pfair_period(weights):
    turn, total = mixing.period(weights), sum(weights)
    done = [0] * len(weights)
    for slot, s in enumerate(turn, 1):
        done[s] += 1
        assert all(abs(n * total - w * slot) < total for n, w in zip(done, weights, strict=True))  # less than one block
    assert done == weights


@given(st.lists(st.tuples(st.integers(1, 12), st.integers(1, 40)), min_size=1, max_size=6))
@settings(max_examples=60, deadline=None)
def test_pfair_phases(sources):
    plan = mixing.Schedule([w for w, _ in sources], [b for _, b in sources])
    slots = np.concatenate([plan.slots(s, np.arange(b)) for s, (_, b) in enumerate(sources)])
    assert sorted(slots.tolist()) == list(range(len(slots)))
    assert all((np.diff(plan.slots(s, np.arange(b))) > 0).all() for s, (_, b) in enumerate(sources))


@pytest.mark.parametrize("shares", [[9.5**0.5, *[1.0] * 19], [2**0.5, 3**0.5, 5**0.5, 1e-4], [0.9997, 0.0003]])
def test_exact_shares(shares):
    blocks = [int(10_000 * x / sum(shares)) + 2 for x in shares]
    plan = mixing.Schedule(mixing.whole_weights(shares), blocks)
    turn = np.full(sum(blocks), -1)
    for s, n in enumerate(blocks):
        turn[plan.slots(s, np.arange(n))] = s
    assert (turn >= 0).all()
    at = np.arange(1, 9_900)  # all sources have blocks left
    for s, x in enumerate(shares):
        assert (np.abs(np.cumsum(turn[: len(at)] == s) - x / sum(shares) * at) < 1).all()


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=80, deadline=None)
def test_packing_plan(lengths):
    counts = np.bincount(lengths, minlength=65)
    used, bins = np.zeros(65, int), 0
    for pattern, times in packing.plan(counts, 64):
        assert times > 0 and sum(pattern) <= 64
        bins += times
        for x in pattern:
            used[x] += times
    assert used.tolist() == counts.tolist()
    assert bins <= 11 / 9 * -(-sum(lengths) // 64) + 6 or bins <= len(lengths)


def test_best_two_fit():
    # greedy takes 60 and 30 of 100; 25 and 15 fill the gap that 30 leaves
    counts = np.bincount([60, 30, 25, 15], minlength=101)
    pattern, times = packing.plan(counts, 100)[0]
    assert sorted(pattern) == [15, 25, 60] and times == 1


def test_bits_estimate():
    r = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.9):
        a = r.integers(0, 1 << 63, 2000, dtype=np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], r.integers(0, 1 << 63, 2000 - n, dtype=np.uint64)])
        x, y = (near_dedup.packed(near_dedup.minima(v)[None]) for v in (a, b))
        assert abs(near_dedup.similarity(x, y)[0, 0] - share) < 0.13


@given(st.lists(st.binary(min_size=4, max_size=60).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6))
@settings(max_examples=100, deadline=None)
def test_maximal_repeats(strings):
    least = 3
    owned = np.array([max(1, len(s) - least + 1) for s in strings])
    array = repeats.SuffixArray(strings, owned)
    text = b"".join(strings)
    want = {}
    for k, s in enumerate(strings):
        for i in range(owned[k]):
            for n in range(least, len(s) - i + 1):
                want.setdefault(s[i : i + n], []).append((k, i))
    maximal = {}
    for x, at in want.items():
        right = {strings[k][i + len(x) : i + len(x) + 1] or (k, i) for k, i in at}
        left = {strings[k][i - 1] if i else (k, i, "start") for k, i in at}
        if len(at) > 1 and len(right) > 1 and (len(left) > 1 or any(i == 0 for _, i in at)):
            maximal[x] = sorted(at)
    got = {}
    for a, b, n in repeats.intervals(array, least):
        places = array.at[a : b + 1]
        own = np.searchsorted(array.base, places, "right") - 1
        got[text[places[0] : places[0] + n]] = sorted(zip(own.tolist(), (places - array.base[own]).tolist(), strict=True))
    assert got == maximal
