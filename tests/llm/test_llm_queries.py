"""Each opN query by name over the test tables, column by column, against plain Python."""

import hashlib
import heapq
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import base_rules, shingle_set, syncmers
from tallyrock.llm import fingerprints, near_dedup, registry, repeats, sharding
from tallyrock.llm._shared import saved
from tallyrock.llm.tokens import Encoder


@pytest.fixture(scope="module")
def run(spark, sf):
    return lambda name: registry.queries()[name](spark, sf)


@pytest.fixture(scope="module")
def own(sf):
    return {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema.fields}


def test_op1(spark, sf):
    folder = Path(sf).parent / "sf0.01"
    held_out = lambda k: zlib.crc32(str(k).encode()) % 5 == 0
    rows = {r["doc_id"]: r for r in pq.read_table(folder / "documents.parquet").to_pylist()}
    df = registry.queries()["op1_language_id"](spark, str(folder))
    assert types(df) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == rows.keys() and all(got[k]["held_out"] == held_out(k) for k in rows)
    langs = {r["lang"] for r in rows.values() if r["lang"]}
    right = defaultdict(list)
    for k, r in rows.items():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (got[k]["lang_pred"] in langs) if letters else (got[k]["lang_pred"] == "und") and 0 <= got[k]["score"] <= 1
        if letters and held_out(k) and r["lang"]:
            right[r["lang"]].append(got[k]["lang_pred"] == r["lang"])
    assert all(np.mean(v) > 0.95 for v in right.values()) and len(right) == len(langs)


def test_op2(run, own):
    df = run("op2_quality_rules")
    assert {"n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}.items() <= types(df).items()
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == own.keys()
    for k, r in own.items():
        assert tuple(got[k][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base_rules(r["text"])
        assert got[k]["kept"] == (not got[k]["base_failed"] and got[k]["probability"] >= 0.3)


def test_op4_op9(run, own):
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(public_tokenizers.path(p)) for p in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in run("op4_best_fit_packing").collect():
        pieces[r["doc_id"]][r["piece"]] = r
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    files = {r["doc_id"]: r for r in run("op9_token_files").collect()}
    assert pieces.keys() == own.keys() == files.keys()
    at = total = 0
    for k in sorted(own):
        ids = [*word.encode(own[k]["text"] or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        assert {p: (r["start"], r["length"], r["ids_crc32"]) for p, r in pieces[k].items()} == {p: (4096 * p, len(c), crc(c)) for p in range(-(-len(ids) // 4096)) for c in [ids[4096 * p : 4096 * p + 4096]]}
        ids = [*byte.encode(own[k]["text"] or "", add_special_tokens=False).ids, 0]
        assert (files[k]["start"], files[k]["n_tokens"], files[k]["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    for rows in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(rows))])
        assert [a for a, _ in sorted(rows)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(sequences) <= -(-total // 4096) + 2


def test_op5(run, own):
    keys = sorted(own)
    got = {r["doc_id"]: r for r in run("op5_syncmer_fingerprints").collect()}
    assert sorted(got) == keys
    text = lambda xs: "".join(f"{x % (1 << 64):016X}" for x in xs)
    for i, k in enumerate(keys):
        one, following = own[k]["text"] or "", own[keys[(i + 1) % len(keys)]]["text"] or ""
        edited = one[: len(one) - len(one) // 4] + following[: len(one) // 4]
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == (len(one), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
        if len(one) < 3000:
            assert (got[k]["fingerprint"], got[k]["edited_fingerprint"]) == (text(syncmers(one)[1]), text(syncmers(edited)[1]))


def test_op6(run, own):
    got = run("op6_hilbert_sharding").collect()
    assert sorted(r["doc_id"] for r in got) == sorted(own)
    slots = defaultdict(list)
    for r in got:
        raw = (own[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(16)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [(r["curve"], r["doc_id"]) for r in order] == sorted((r["curve"], r["doc_id"]) for r in got)
    # the cells of the two string dimensions, by rank of the whole value
    for name in ("source", "lang"):
        counts, before, cell = Counter(r[name] for r in own.values()), 0, {}
        for v in sorted(counts, key=lambda v: (v is not None, v or "")):
            cell[v] = 0 if v is None else 16 * before // len(own)
            before += counts[v]
        assert len(set(cell.values())) >= min(2, len(counts))


def test_sources_with_a_common_prefix(spark):
    rows = [(k, "text", f"common_crawl_{k % 8}", "en") for k in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    placed = sharding.shard(docs.withColumn("size", F.lit(1).cast("long")).drop("text"), ["source", "doc_id"], "size", shards=16)
    per_shard = defaultdict(set)
    for r in placed.collect():
        per_shard[r["shard"]].add(r["source"])
    assert sum(map(len, per_shard.values())) <= 40  # of 128, were they not told apart


def test_op8(run, own):
    got = run("op8_source_mixing").collect()
    counts = Counter(r["source"] for r in own.values())
    assert sorted(r["position"] for r in got) == list(range(len(own))) and Counter(r["source"] for r in got) == counts
    order = [r["source"] for r in sorted(got, key=lambda r: r["position"])]
    # the schedule by itself, over exact shares: released blocks (of one row) by their deadline
    names = sorted(counts, key=lambda s: (s is not None, s or ""))
    left, want, done = dict(counts), [], 0
    while active := [s for s in names if left[s]]:
        whole = {s: round(counts[s] ** 0.5 * (1 << 30)) for s in active}
        share = {s: Fraction(whole[s], sum(whole.values())) for s in active}
        ready, waiting, slot = [], [(0, -(-1 // share[s]), k, 0) for k, s in enumerate(active)], 0
        heapq.heapify(waiting)
        while True:
            while waiting and waiting[0][0] <= slot:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            _, k, i = heapq.heappop(ready)
            s = active[k]
            want.append(s)
            slot += 1
            left[s] -= 1
            if not left[s]:
                break
            heapq.heappush(waiting, ((i + 1) // share[s], -(-(i + 2) // share[s]), k, i + 1))
    done = next(i for i in range(len(order)) if Counter(order[: i + 1])[order[i]] == counts[order[i]])
    assert order[: done + 1] == want[: done + 1]  # until the first source ends
    root = {s: n**0.5 for s, n in counts.items()}
    for i in range(1, done):
        assert all(abs(n - i * root[s] / sum(root.values())) < 1 for s, n in Counter(order[:i]).items())


def test_oracle_queries_have_their_columns(run, own):
    for name, columns in {"op3_minhash_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"}, "op7_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"}, "op10_suffix_array_dedup": {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}}.items():
        assert columns <= set(run(name).columns)


def thue_morse(n, a, b):
    return "".join(a if bin(i).count("1") % 2 == 0 else b for i in range(n))


@pytest.mark.parametrize("name,style", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_patterned_words(name, style):
    from tokenizers import Tokenizer

    texts = [x for n in (64, 256, 512, 1024, 2048) for x in (thue_morse(n, "a", "b"), thue_morse(n, "b", "a"))]
    texts = [*texts, " ".join(texts), *texts, "<|endoftext|>" + texts[4], texts[5] + " <|startoftext|>"]
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    assert [x.tolist() for x in Encoder(public_tokenizers.path(name), style)(pa.array(texts))] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_patterned_words_are_no_copies(spark):
    words = [x for n in (1024, 2048, 4096) for x in (thue_morse(n, "a", "b"), thue_morse(n, "b", "a"))]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert all(r["kept"] and r["n_shingles"] == 1 for r in got)


def test_runs_of_neighbours_are_even(spark):
    docs = spark.range(20_000).union(spark.createDataFrame([(1 << 60,)], "id long")).union(spark.range(4000).select(F.lit(None).cast("long"))).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"))
    sizes = [r["count"] for r in fingerprints.beside_next(docs).groupBy("_run").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 6 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("bucket", [10_000, 2])
def test_groups_are_whole(spark, bucket):
    r = np.random.default_rng(11)
    some = lambda n: "".join(r.choice(list("abcdefgh "), n))
    one, two, three = some(900), some(260), some(200)
    texts = [some(300) + one + some(50), one + some(500), some(40) + one, two + some(100) + two, some(77) + two, three, some(9) + three + some(9), *(some(400) for _ in range(5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = defaultdict(set)
    for x in repeats.Repeats(docs, bucket=bucket).groups().collect():
        groups[x["repeat"], x["size"]].add((x["doc_id"], x["start"]))
    places = lambda s: {(k, i) for k, t in enumerate(texts) for i in range(len(t)) if t.startswith(s, i)}
    found = {}
    for (_, size), at in groups.items():
        k, i = min(at)
        string = texts[k][i : i + size]
        assert at == places(string)  # all occurrences
        assert len({texts[k][i - 1] if i else None for k, i in at}) > 1 or any(i == 0 for _, i in at)
        assert len({texts[k][i + size : i + size + 1] for k, i in at}) > 1
        found[string] = at
    assert all(any(s in f for f in found) for s in (one, two, three))
    assert len(found) == 3


def test_pipeline_catches_near_copies(spark, sf):
    """Of all groups that links at 0.8 or more make, one document stays; found by brute force."""
    docs = saved(spark.read.parquet(str(Path(sf).parent / "sf0.01" / "documents.parquet")).limit(1000), "test-near")
    rows = {r["doc_id"]: shingle_set(r["text"]) for r in docs.select("doc_id", "text").collect()}
    holders, parent = defaultdict(list), {k: k for k in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in sorted(rows):
        shared = Counter(j for s in rows[k] for j in holders[s])
        for s in rows[k]:
            holders[s].append(k)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(rows[k]) + len(rows[j]) - n):
                a, b = root(j), root(k)
                parent[max(a, b)] = min(a, b)
    left = {r[0] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).select("doc_id").collect()}
    want = {k for k in rows if root(k) == k}
    assert len(rows) - len(want) > 20
    caught = len((set(rows) - want) - left) / len(set(rows) - want)
    assert caught >= 0.99 and want <= left
