"""Near words against all pairs, and word counts against a plain version."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pitscore.llm import variants


def edits(word, letters):
    """Every string one edit away."""
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def plain_forms(counts, ratio=10):
    letters = {c for w in counts for c in w}
    near = {w: [v for v in edits(w, letters) if v in counts] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    root = {}
    for w in counts:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return {(w, form[w], root[w], counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def random_words(seed, n, letters="abé", low=2, high=9):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n)}
    return {w: rng.choice([1, 2, 3, 30, 400, 5000]) for w in words}


def frame(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)


@pytest.mark.parametrize("seed, shard_words", [(1, 10_000), (2, 40), (3, 7)])
def test_variants_equal_all_pairs(spark, seed, shard_words):
    counts = random_words(seed, 600)
    got = {tuple(r) for r in variants.variants(frame(spark, counts), shard_words=shard_words).collect()}
    assert got == plain_forms(counts)


def test_near_words_come_once_per_order(spark):
    counts = random_words(5, 500, "ab", 1, 10)
    counts |= {"a" * 3000: 1, "a" * 2999: 2, "b" + "a" * 2999: 3, "a" * 1500 + "b" + "a" * 1499: 4, "one": 1}
    rows = [tuple(r) for r in variants.near_words(frame(spark, counts), 60).collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(w, v, counts[v]) for w in counts for v in edits(w, {*"ab"}) if v in counts}


def test_wide_intervals(spark):
    """Half of all words share their first letters, so that searches branch from wide intervals."""
    rng = random.Random(9)
    words = {"prefix" + "".join(rng.choice("abcd") for _ in range(4)) for _ in range(200)}
    words |= {"".join(rng.choice("abcd") for _ in range(5)) + "suffix" for _ in range(200)}
    counts = {w: 1 + i for i, w in enumerate(sorted(words))}
    got = {tuple(r)[:2] for r in variants.near_words(frame(spark, counts), 50).collect()}
    assert got == {(w, v) for w in counts for v in edits(w, {c for w in counts for c in w}) if v in counts}


def plain_words(docs, min_length, min_count, spoil):
    out = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if spoil and i is not None and h % spoil == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


@pytest.mark.parametrize("spoil", [None, 2, 31])
def test_word_counts(spark, spoil):
    docs = [
        (1, "Straße STRASSE École école ÉCOLE x×y÷z naïve, naïve-ly"), (2, None), (3, ""), (None, "anything anything goes"),
        (4, "wordnumber " * 30_000), (5, "漢字 anythingĀanything éÿþ"), (5, "漢字 anythingĀanything éÿþ"), (6, "q" * 700_000 + " " + "q" * 700_000),
        (-7, "anything " * 40 + "x" * 64 + " " + "y" * 65 + " " + "é" * 40),
    ]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n long").repartition(3)
    for low, count in ((1, 1), (7, 2)):
        got = {r.word: r.n for r in variants.word_counts(df, min_length=low, min_count=count, spoil=spoil).collect()}
        assert got == plain_words(docs, low, count, spoil)


def test_variants_edges(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.variants(empty).count() == 0 and variants.near_words(empty).count() == 0
    one = variants.variants(spark.createDataFrame([("alone", 3, "x")], "word string, n long, root string")).collect()
    assert [tuple(r) for r in one] == [("alone", None, "alone", 3, 0, None)]
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert variants.word_counts(nothing).count() == 0
    with pytest.raises(ValueError):
        variants.variants(empty, ratio=1)


def test_chain_of_forms(spark):
    counts = {"a" * k: 10**k for k in range(1, 9)}
    got = {r.word: r.root for r in variants.variants(frame(spark, counts)).collect()}
    assert set(got.values()) == {"a" * 8}


def test_suffix_order_of_an_index():
    words = sorted({w for w in random_words(4, 80, "ab", 1, 40)})
    index = variants.Index(words)
    suffixes = sorted((w[j:], i, j) for i, w in enumerate(words) for j in range(len(w) + 1))
    want = [words[i][j - 1] if j else "" for _, i, j in suffixes]
    assert [chr(index.symbols[c]) if c else "" for c in index.bwt] == want
    assert index.word(np.arange(len(words))).tolist() == list(range(len(words)))
