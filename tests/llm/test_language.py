"""Language identification against sums over written-out segmentations, and on held-out documents."""

import math
import zlib

import numpy as np
import pytest

from pitscore.llm import langid, queries
from pitscore.llm.wordcache import WordNumbers


@pytest.fixture(scope="module")
def path():
    return queries.piece_vocabulary()


@pytest.fixture(scope="module")
def pieces(path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    voc = langid._vocabulary(path)
    out = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i)):
            raw = np.frombuffer(model.id_to_piece(i).encode(), np.uint8)
            out[model.id_to_piece(i)] = int(voc.find(langid.Prefix(raw).ranges(np.array([0]), np.array([len(raw)])))[0])
    assert len(out) == voc.n == len(set(out.values()))
    return out


def segmentations(word, pieces, unknown):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        piece = pieces.get(word[:n], unknown if n == 1 else None)
        if piece is not None:
            for rest in segmentations(word[n:], pieces, unknown):
                yield [piece, *rest]


def model_of(path, languages, seed=0):
    rng = np.random.default_rng(seed)
    share = rng.gamma(0.3, size=(langid._vocabulary(path).n + 1, len(languages)))
    share = np.maximum(share / share.sum(axis=0), langid.LEAST)
    share[-1] = langid.LEAST
    return langid.Model(f"test{seed}", path, languages, share)


def plain_log(word, model, pieces):
    unknown = len(model.share) - 1
    runs = langid.letter_words(word)
    total = np.zeros(len(model.languages))
    for run in runs:
        total += np.log(sum(np.prod(model.share[s], axis=0) for s in segmentations(run, pieces, unknown)))
    return total


def test_words_sum_over_all_segmentations(path, pieces):
    model = model_of(path, ("a", "b", "c"))
    words = ["the", "Straße", "éanment", "x", "onenerth", "漢字", "a“b”c", "ÉCOLE", "…"]
    log, letters = langid.Scorer(model).of_words(words)
    for w, got in zip(words, log, strict=True):
        assert np.allclose(got, plain_log(w, model, pieces)), w
    assert letters.tolist() == [True] * 8 + [False]


def test_long_words_do_not_underflow(path):
    log, _ = langid.Scorer(model_of(path, ("a", "b"))).of_words(["漢" * 500, "qx" * 20_000])
    assert np.isfinite(log).all() and (log < -1000).all()


def test_expected_uses_equal_plain_ones(spark, path, pieces):
    model = model_of(path, ("a", "b"), 1)
    rows = [(0, "the", 3), (0, "thing", 1), (1, "the", 2), (1, "漢字", 1), (0, "—", 5)]
    got = langid._expected(spark.createDataFrame(rows, "lang int, word string, n long"), path, model.share, 2)
    want = np.zeros(got.shape)
    for lang, word, n in rows:
        for run in langid.letter_words(word):
            ways = list(segmentations(run, pieces, len(want) - 1))
            p = [math.prod(model.share[i, lang] for i in s) for s in ways]
            for s, x in zip(ways, p, strict=True):
                for i in s:
                    want[i, lang] += n * x / sum(p)
    assert np.allclose(got, want)


def test_training_is_the_same_for_any_partitioning(spark, path, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one, many = (langid.train(docs.repartition(n), path, sample=20) for n in (1, 7))
    assert one.languages == many.languages == ("de", "en", "es", "fr")
    assert np.allclose(one.share, many.share) and np.allclose(one.share.sum(axis=0), 1, atol=1e-4)


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op11_language(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 4 == 2]
    assert {d.doc_id for d in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[d.doc_id].lang_pred == d.lang for d in held]) > 0.99
    assert all(0 <= r.score <= 1 for r in got.values())


def test_documents_equal_plain_scores(spark, path, pieces):
    model = model_of(path, ("a", "b", "c"), 2)
    texts = ["The cat, the CAT!", "une école", "a", "12 + 7", "", None, "漢字 … a", "— … 12", "the cat", "word " * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    for i, t in enumerate(texts):
        low = "".join(c if ord(c) > 127 or (c.isascii() and c.isalpha()) else " " for c in (t or ""))
        if not any(c.isalpha() for c in low):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        known: dict[str, np.ndarray] = {}
        total = np.zeros(3)
        for w in low.split(" "):
            if w:
                total += known.setdefault(w, plain_log(w, model, pieces))
        assert got[i].lang_pred == "abc"[total.argmax()]
        assert abs(got[i].score - 1 / np.exp(total - total.max()).sum()) < 1e-6


def test_language_edges(spark, path):
    rows = [
        (1, None, "en", 0.5), (2, "", "en", 0.5), (3, "one two three", "en", 1.0), (3, "one two three", "en", 1.0),
        (None, "un deux trois", None, 2.0), (4, "un deux trois", "fr", 2.0), (5, "x" * 50_000, None, 1.0),
        (6, "word number " * 200_000, "en", 1.0), (7, "123 --", "fr", 0.0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").withColumnRenamed("lang", "lang_pred")
    model = langid.train(df, path, lang="lang_pred")
    assert model.languages == ("en", "fr")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(df, model).collect()]
    assert len(got) == len(rows)
    assert {(1, "und"), (2, "und"), (3, "en"), (4, "fr"), (None, "fr"), (6, "en"), (7, "und")} <= set(got)
    none = langid.train(df.limit(0), path, lang="lang_pred")
    assert none.languages == () and {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0
    with pytest.raises(ValueError):
        many = spark.range(3000).selectExpr("id as doc_id", "'x' as text", "cast(id as string) as lang")
        langid.train(many, path)


def test_word_numbers():
    rng, known, want = np.random.default_rng(0), WordNumbers(), {}
    known.LEAST = 50
    for _ in range(40):
        keys = np.unique(rng.integers(0, 3000, 100).astype(np.uint64))
        number = known.find(keys)
        assert number.tolist() == [want.get(int(k), -1) for k in keys]
        new = keys[number < 0]
        want |= {int(k): known.n + i for i, k in enumerate(new)}
        known.add(new)
