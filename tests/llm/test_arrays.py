"""Arrays that models and steps leave in the shared folder: missing ones, wide counts, parts of a benchmark."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitscore.llm import decontaminate, near, ngram, packed, repeats, shared
from tests.llm import brute


@pytest.fixture
def docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(rng.choice(words) for _ in range(60)) for i in range(60)}
    texts |= {i + 100: texts[i] for i in range(20)}
    shared = "".join(rng.choice("abc ") for _ in range(115))
    texts |= {i: texts[i] + f" {i} {shared} {i} " + texts[i - 1] for i in range(40, 50)}
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def fails_without(folder, pattern, job):
    """Removes one file (the maps of workers that are alive already hold it open, so jobs get new names)."""
    path = sorted(glob.glob(f"{folder.removeprefix('file:')}/{pattern}"))[0]
    os.rename(path, path + ".gone")
    with pytest.raises(Exception, match="No such file"):
        job()
    os.rename(path + ".gone", path)


def test_missing_model_arrays_are_errors(spark, docs):
    model = ngram.train(docs)
    assert model.folder.startswith("file:/")
    for pattern in ("pair-0*.npy", "word-0*.npy", "word-counts-*.npy"):
        fails_without(model.folder, pattern, lambda: ngram.score(docs, model).collect())
    lost = ngram.Model(**{**model.__dict__, "folder": model.folder + "-nowhere"})
    with pytest.raises(Exception, match="No such file"):
        ngram.score(docs, lost).collect()
    assert ngram.score(docs, model).where("n_known = n_tokens").count() == 80


def test_missing_key_arrays_are_errors(spark):
    keys = near.KeySet(spark.range(1000))
    rows = spark.range(2000)
    fails_without(keys.folder, "keys-*.npy", lambda: keys.filter(rows, "id").count())
    assert keys.filter(rows, "id").count() == 1000 == keys.filter(rows, "id", inside=False).count()


@pytest.mark.parametrize("pattern", ["block-*.npy", "window-doc-*.npy", "start-mark-*.npy"])
def test_missing_marks_of_repeats_are_errors(docs, monkeypatch, pattern):
    folders = []
    monkeypatch.setattr(repeats, "shared_path", lambda spark, name: folders.append(shared.shared_path(spark, name)) or folders[-1])
    last = {"block": "_sort_windows", "window": "_sort_strings", "start": None}[pattern.split("-")[0]]
    if last is None:
        found = repeats.remove_repeats(docs, with_kept=False)
        fails_without(folders[0], pattern, found.collect)
        assert found.where("n_removed > 0").count() >= 20
        return
    step = getattr(repeats, last)
    monkeypatch.setattr(repeats, last, lambda *a: fails_without(a[1], pattern, lambda: step(*a)) or step(*a))
    assert repeats.remove_repeats(docs, with_kept=False).where("n_removed > 0").count() >= 20


def test_shard_sets(spark):
    numbers = {0, 1, 63, 64, 200, 201}
    there = packed.ShardSet(spark.createDataFrame([(n,) for n in [*numbers, 64]], "shard long"))
    assert {n for n in range(500) if n in there} == numbers
    assert 0 not in packed.ShardSet(spark.createDataFrame([], "shard long"))


def test_shards_are_dealt_out_by_number(spark):
    rows = spark.range(-100, 100).selectExpr("id as shard", "cast('x' as binary) as blob")
    dealt = packed.to_shards(rows, 100).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in dealt}) == 7  # more than the session's four, so that none has over 16 of 100
    assert all(len({r.shard for r in dealt if r.task == t and r.shard >= 0}) <= 16 for t in range(7))


def test_counts_above_32_bits():
    before, after = np.array([5, 5, 9], np.uint64), np.array([1, 2, 1], np.uint64)
    for big in (3, 1 << 32, (1 << 40) + 7):
        a, b, c = ngram._unpack_pairs(ngram._pack_pairs(before, after, np.array([1, big, 2], np.int64)))
        assert (a.tolist(), b.tolist(), c.tolist()) == ([5, 5, 9], [1, 2, 1], [1, big, 2])
        columns = [np.array([k, big + k], np.int64) for k in range(5)]
        keys, found = ngram._unpack_words(ngram._pack_words(np.array([1, 2], np.uint64), columns))
        assert keys.tolist() == [1, 2] and [f.tolist() for f in found] == [c.tolist() for c in columns]


def test_scores_with_counts_above_32_bits(spark, docs, monkeypatch):
    """Counts multiplied by 2**33 leave a model of shares alone, but for discounts and smoothing."""
    plain = {r.doc_id: r.base_score for r in ngram.score(docs, ngram.train(docs)).collect()}
    ngram_tokens, unpack = ngram.train(docs).tokens, ngram._unpack_pairs
    monkeypatch.setattr(ngram, "_unpack_pairs", lambda blob: (*unpack(blob)[:2], unpack(blob)[2].astype(np.int64) << 33))
    model = ngram.train(docs)
    assert model.tokens == ngram_tokens << 33
    got = {r.doc_id: r.base_score for r in ngram.score(docs, model).collect()}
    assert all(abs(got[i] - plain[i]) < 3 for i in plain)


def test_window_sets_are_bounded(monkeypatch):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    texts = [" ".join(rng.choice(words) for _ in range(1000)) for _ in range(300)]
    size = sum(map(len, texts))
    found = decontaminate.WindowSet([str(i) for i in range(300)], texts)
    filters = sum(parts[3].nbytes for parts in found.widths.values())
    assert found.nbytes - filters <= 4.5 * size and filters <= 1 << 20


@pytest.mark.parametrize("set_bytes", [40, 200])
def test_parts_of_a_benchmark_equal_one(spark, set_bytes):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), i) for i in range(80)]
    docs += [(1000, None, 1), (None, "w1 w2 w3", 2), (5, docs[5][1], 3), (5, docs[5][1], 3), (6, docs[7][1], 4)]
    bench = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(40)]
    bench += [(100 + i, " ".join(docs[i][1].split()[j : j + 12])) for i in range(0, 80, 4) for j in (0, 6)]
    bench += [(300, None), (301, bench[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string, _key int").repartition(3)
    items = spark.createDataFrame(bench, "item_id long, text string")
    assert decontaminate._window_sets(items, "item_id", "text", 10, set_bytes)[0] > 1

    def rows(x):
        return sorted(map(repr, x.collect()))

    assert rows(decontaminate.report(df, items, set_bytes=set_bytes)) == rows(decontaminate.report(df, items))
    for action in ("document", "span"):
        one = decontaminate.decontaminate(df, items, action)
        many = decontaminate.decontaminate(df, items, action, set_bytes=set_bytes)
        assert many.columns == one.columns and rows(many) == rows(one)


def test_items_of_shared_windows(spark):
    docs = spark.createDataFrame([(1, "x a b c y"), (2, "a b c a b c d")], "doc_id long, text string")
    bench = spark.createDataFrame([(3, "a b c"), (1, "A, b: c"), (2, "b c d"), (1, "c d")], "item_id long, text string")
    got = {r.doc_id: r.items for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: ["1", "3"], 2: ["1", "2", "3"]}


def test_repeats_of_one_text_above_a_block(spark):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef ") for _ in range(700_000))
    docs = {1: long, 2: "x" * 50 + long[1000:1500], 3: long[:300]}
    got = repeats.remove_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    want = brute.repeats(docs)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got.collect()} == {i: w[:3] for i, w in want.items()}
