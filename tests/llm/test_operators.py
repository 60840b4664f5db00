"""Each operator against a brute-force version on a small corpus with copies, nulls, empty and very
long texts, repeated rows, missing ids and columns whose names clash with results."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyrock.llm import fingerprints, language_id, line_dedup, mixing, near_dedup, packing, quality, repeats, sharding, token_files
from tallyrock.llm._shared import ROW, components, keyed, running_totals, saved

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(df):
    return dict(sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()))


def test_running_totals(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("n"), F.lit(1).alias("one"))
    got = running_totals(rows.repartition(6), ["n", "id"], {"before": "n", "rank": "one"}, "t").orderBy("rank").collect()
    total = 0
    for k, r in enumerate(got):
        assert (r["rank"], r["before"]) == (k, total)
        total += r["n"]
    assert running_totals(rows.limit(0), ["n", "id"], {"before": "n"}, "t").count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 200)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def test_language_id(unique, docs, empty, spark):
    words = {"en": "the and of with", "de": "und der die nicht", "fr": "le les des être", "es": "el los una año"}
    train = spark.createDataFrame([(k, " ".join(np.random.default_rng(k).choice(words[x].split(), 30)), x) for k in range(120) for x in [list(words)[k % 4]]], "doc_id long, text string, lang string")
    model = language_id.fit_languages(train.where("doc_id % 5 <> 0"))
    got = language_id.predict_languages(train, model).collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    assert {p[0] for p in model.pairs} == {"", "germanic", "romance"}
    odd = language_id.predict_languages(docs, model)
    assert odd.count() == docs.count() and set(odd.columns) == {*docs.columns, "lang_pred", "score"}
    assert {r["lang_pred"] for r in odd.where("text IS NULL OR NOT text RLIKE '\\\\p{L}'").collect()} == {"und"}
    assert [r["lang_pred"] for r in language_id.predict_languages(train.limit(3), language_id.fit_languages(empty)).collect()] == ["und"] * 3
    assert language_id.predict_languages(empty, model).count() == 0


def base_rules(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    again = {k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_quality_rules(spark, docs, unique, empty, sf):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 200, 3)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(unique, labels)
    got = by_id(quality.score_quality(unique, model))
    for key, text in texts(unique).items():
        r = got[key]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_rules(text)
        assert not (r["base_failed"] and r["kept"])
    assert quality.score_quality(docs, model).count() == docs.count()
    assert quality.score_quality(empty, quality.fit_quality(empty, labels.limit(0))).count() == 0
    real = spark.read.parquet(f"{sf}/documents.parquet")
    marked = quality.score_quality(real, quality.fit_quality(real, spark.read.parquet(f"{sf}/labels.parquet"))).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    good = marked.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.95


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked(documents):
    sets = {k: shingle_set(t) for k, t in documents.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


@pytest.mark.parametrize("blocks", [(2048, 256), (4, 3)])
def test_near_dedup(unique, docs, empty, blocks, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(near_dedup, "FAMILY_BLOCK", blocks[1])
    got = by_id(near_dedup.near_duplicates(unique))
    want = linked(texts(unique))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())
    assert sum(not r["kept"] for r in got.values()) >= 6
    if blocks[0] > 4:
        again = near_dedup.near_duplicates(docs).collect()
        assert len(again) == docs.count()
        assert {(r["doc_id"], r["component_id"], r["kept"]) for r in again if r["doc_id"] is not None} == {(k, r["component_id"], r["kept"]) for k, r in got.items()}
        assert [r["kept"] for r in again if r["doc_id"] is None] == [True]
        assert near_dedup.near_duplicates(empty).count() == 0


def test_packing(docs, unique, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for key, text in texts(unique).items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[key]})
        assert own == [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    rows = defaultdict(list)
    for r in got:
        rows[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in rows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(rows) <= sum(r["length"] for r in got) / 4096 + 3
    assert packing.pack_documents(empty, path).count() == 0


def syncmers(text):
    import xxhash

    b, k, s = text.encode(), fingerprints.K, fingerprints.S
    h = lambda x: (v := xxhash.xxh64_intdigest(x, 42)) - (1 << 64) * (v >> 63)
    inner = [h(b[i : i + s]) for i in range(len(b) - s + 1)]
    at = [i for i in range(len(b) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    least = {}
    for x in [h(b[i : i + k]) for i in at] or ([h(b)] if b else []):
        least[x % fingerprints.SIZE] = min(x, least.get(x % fingerprints.SIZE, x))
    return at, sorted(least.values())


def test_fingerprints(unique, docs, empty, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUNS", 3)
    got, own = by_id(fingerprints.fingerprints(unique)), texts(unique)
    keys = list(own)
    text = lambda xs: "".join(f"{x % (1 << 64):016X}" for x in xs)
    share = lambda a, b: len({*a} & {*b}) / len({x % 64 for x in [*a, *b]}) if a or b else 1.0
    for k, key in enumerate(keys):
        one, following = own[key] or "", own[keys[(k + 1) % len(keys)]] or ""
        cut = len(one) // 4
        edited = one[: len(one) - cut] + following[:cut]
        a, b, n = syncmers(one)[1], syncmers(edited)[1], syncmers(following)[1]
        r = got[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(one), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text(a), text(b))
        assert (r["near_edited"], r["near_next"]) == pytest.approx((share(a, b), share(a, n)))
    assert fingerprints.fingerprints(docs).count() == docs.count()
    assert fingerprints.fingerprints(empty).count() == 0
    places = defaultdict(list)
    for r in fingerprints.anchors(unique.where("doc_id BETWEEN 30 AND 60")).collect():
        places[r["doc_id"]].append(r["at"])
    assert all(sorted(at) == syncmers(own[k])[0] for k, at in places.items())


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_sharding(docs, unique, empty, law):
    got = sharding.shard_documents(docs, shards=4, law=law).collect()
    assert len(got) == docs.count()
    own = texts(unique)
    slots, bytes_ = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        bytes_[r["shard"]] += r["size"]
        if r["doc_id"] is not None:
            raw = (own[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    assert set(slots) <= set(range(4)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        largest = max(r["size"] for r in got)
        assert all(abs(b - sum(bytes_.values()) / 4) <= largest for b in bytes_.values())
    assert sharding.shard_documents(empty, law=law).count() == 0


def test_line_dedup(docs, unique, empty):
    got, own = by_id(line_dedup.dedup_lines(unique)), texts(unique)
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate({c: c + 32 for c in range(65, 91)})
    holders = defaultdict(set)
    for k, t in own.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(k)
    for k, t in own.items():
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == k]
        assert (got[k]["n_lines"], got[k]["n_dropped"], got[k]["text"]) == (len(lines), len(lines) - len(stay), "\n".join(stay))
    assert sum(r["n_dropped"] for r in got.values()) > 25
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_mixing(docs, empty):
    got = sorted(mixing.mix_positions(docs, {"a": 3, "b": 1, "c": 1}, block=4).collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(docs.count()))
    ranks = defaultdict(list)
    for r in got:
        ranks[r["source"]].append((r["block"], r["doc_id"] is not None, r["doc_id"] or 0))
    assert all(x == sorted(x) for x in ranks.values())
    full = sorted({(r["slot"], r["source"]) for r in got})
    assert [s for s, _ in full] == list(range(len(full)))
    ordered = mixing.mix(docs, {"a": 3, "b": 1, "c": 1}, block=4)
    assert ordered.columns == docs.columns
    assert Counter(map(tuple, ordered.collect())) == Counter(map(tuple, docs.collect()))
    assert [r["doc_id"] for r in ordered.collect()] == [r["doc_id"] for r in got]
    assert mixing.mix(empty).count() == 0


def test_mix_moves_texts_once(spark):
    ids = [None] * 60 + [7] * 90 + [-5, 0, None, 2**62] + list(range(200))
    rows = [(i, f"text {n}", ["a", "b", "a", "c", None][n % 5] if n < 320 else "c") for n, i in enumerate(ids)]
    stored = saved(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), "test-mix")
    for more in ({}, {"weights": {"a": 3, "b": 0}, "block": 4}):
        placed = mixing.mix_positions(keyed(stored), **more, key=ROW)
        expected = keyed(stored).join(placed.select(*ROW, "position"), ROW).orderBy("position").select(*stored.columns)
        mixed = mixing.mix(stored, **more)
        moves = [x for x in mixed._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange" in x]
        assert len(moves) == 1, moves
        assert mixed.collect() == expected.collect()
        assert sum(n > 0 for n in mixed.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) == 4


def test_token_files(docs, unique, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    manifest = token_files.write_token_files(unique, path, file_ids=20_000)
    assert manifest.count() > 2
    got, at = by_id(token_files.read_token_files(manifest)), 0
    for key, text in texts(unique).items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        assert (got[key]["start"], got[key]["n_tokens"], got[key]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = token_files.TokenFile(manifest.orderBy("part", "seq").first()["path"])
    for i, key in enumerate(one.doc_ids()):
        assert one.document(i).tolist()[:-1] == tokenizer.encode(texts(unique)[key] or "", add_special_tokens=False).ids
    assert token_files.read_token_files(token_files.write_token_files(docs, path)).count() == docs.count()
    assert token_files.read_token_files(token_files.write_token_files(empty, path)).count() == 0


@pytest.mark.parametrize("bucket", [10_000, 1])
def test_repeats(docs, unique, empty, bucket):
    own = {k: (t or "").encode() for k, t in texts(unique).items()}
    seen = Counter(b[i : i + 200] for b in own.values() for i in range(len(b) - 199))
    got = by_id(repeats.remove_repeats(unique, bucket=bucket))
    for k, b in own.items():
        covered = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                covered[i] += 1
                covered[i + 200] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        assert (got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], bytes(got[k]["kept"])) == (len(b), int(gone.sum()), spans, kept)
    groups = defaultdict(set)
    for r in repeats.Repeats(unique, bucket=bucket).groups().collect():
        groups[r["repeat"], r["size"]].add(own[r["doc_id"]][r["start"] : r["start"] + r["size"]])
    assert groups and all(len(x) == 1 and len(next(iter(x))) == size for (_, size), x in groups.items())
    assert repeats.remove_repeats(docs).count() == docs.count()
    assert repeats.remove_repeats(empty).count() == 0
