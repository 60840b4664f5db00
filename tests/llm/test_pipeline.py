"""The pipeline's stages one after the other, on the test tables and on odd rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tallyrock.llm import near_dedup, packing
from tallyrock.llm._shared import saved


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = saved(stage(spark, docs, sf), f"test-{name}")
        assert after.columns == docs.columns
        kept, had = {r[0] for r in after.select("doc_id").collect()}, {r[0] for r in docs.select("doc_id").collect()}
        assert kept <= had
        if name in ("line_dedup", "source_mixing"):
            assert kept == had
        docs = after
    assert 0.5 * before < docs.count() < before
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def test_odd_rows(spark, sf, docs, empty):
    for rows in (docs, empty):
        some = rows is docs
        for name, stage in corpus_pipeline.STAGES:
            rows = saved(stage(spark, rows, sf), f"odd-{name}")
        assert (rows.count() > 0) == some


def test_sequences_follow_the_weights(spark, sf, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW", 2)
    sources = ["a"] * 2500 + ["b"] * 900 + ["c"] * 400  # square roots 50, 30, 20: c ends after 2,000 rows
    rows = [(k, " ".join(["word"] * (20 + (k * 7) % 40 + 30 * (s == "a"))), "en", s, 0) for k, s in enumerate(sources)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    mixed = saved(stages["source_mixing"](spark, docs, sf), "test-mixed")
    packed = stages["best_fit_packing"](spark, mixed, sf).collect()
    assert sorted(r["doc_id"] for r in packed) == list(range(len(rows)))
    used, largest = {}, 0
    for r in packed:
        used.setdefault(r["sequence_id"], []).append(r)
    assert sorted(used) == list(range(len(used)))
    done = dict.fromkeys("abc", 0)
    for k in range(len(used)):
        own = sorted(used[k], key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [sum(r["length"] for r in own[:i]) for i in range(len(own))]
        assert sum(r["length"] for r in own) <= 4096
        largest = max(largest, len(own))
        for r in own:
            done[sources[r["doc_id"]]] += 1
        n = sum(done.values())
        if n <= 1800:  # a block of 64 rows, and a window of two sequences
            assert all(abs(done[s] - n * w) <= 64 + 2 * largest for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert len(used) <= 1.5 * sum(r["length"] for r in packed) / 4096 + 2  # windows of two cost up to half as many again


def test_near_dedup_from_eighty(spark, sf):
    rows = []
    for k in range(40):  # 100 shingles each, of which the second shares 90 and the third 87 with the first
        words = [f"w{k}x{i}" for i in range(104)]
        rows.append((3 * k, " ".join(words)))
        rows.append((3 * k + 1, " ".join([*words[:94], *(f"new{k}x{i}" for i in range(10))])))  # 90 / 110 = 0.818
        rows.append((3 * k + 2, " ".join([*(f"old{k}x{i}" for i in range(13)), *words[13:]])))  # 87 / 113 = 0.770
    docs = spark.createDataFrame([(k, t, "en", "a", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf).collect()}
    assert left == {3 * k + j for k in range(40) for j in (0, 2)}
    assert (1 - 0.8**near_dedup.ROWS) ** near_dedup.BANDS < 1e-5
    assert near_dedup.near_duplicates(docs, 85).where("kept").count() == len(rows)


def test_near_dedup_keeps_one_row_of_an_id(spark, sf, docs):
    stored = saved(docs, "test-repeated")
    left = dict(corpus_pipeline.STAGES)["near_dedup"](spark, stored, sf).select("doc_id").collect()
    ids = [r[0] for r in left if r[0] is not None]
    assert len(ids) == len(set(ids)) and None in {r[0] for r in left}
