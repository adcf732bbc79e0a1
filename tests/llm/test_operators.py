"""Operators on training data against plain versions, and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitscore.llm import chat, decontaminate, near, ngram, pack, pii, quality, queries, repeats, rules, urls
from pitscore.llm.text import Prefix
from tests.llm import brute

LONG = "word number " * 30_000
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"), (6, "é 漢字 😀 ﬁ\u00a0x"), (None, "no id here at all"),
    (7, LONG), (8, LONG), (9, "x" * 50_000),
]


@pytest.fixture(scope="module")
def texts(spark, small):
    return dict(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect())


@pytest.fixture(scope="module")
def edges(spark):
    """Null, empty, blank, long, tied and repeated rows, with columns named like the operators' own."""
    rows = [(i, t, "en" if (i or 0) % 2 else None, 1, 2.0, "c") for i, t in EDGES]
    names = "doc_id long, text string, lang string, n_words int, score double, component_id string"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def none(edges):
    return edges.limit(0)


def edited(seed, bases=3, copies=60, vocabulary=4000):
    """Groups of copies with a varying number of edits, around the similarity threshold."""
    rng, out = random.Random(seed), {}
    names = [f"w{i}" for i in range(vocabulary)]
    for base in range(bases):
        text = [rng.choice(names) for _ in range((60, 120, 300)[base % 3])]
        for _ in range(copies):
            own = list(text)
            for _ in range(rng.randint(0, len(text) // 40)):
                own[rng.randrange(len(own))] = rng.choice(names)
            out[len(out) * 7 % 1000] = " ".join(own)
    return out


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)


# 1: n-gram model


def test_ngram_equals_plain_model(spark, small, texts):
    got = queries.op1_ngram(spark, small).toPandas().set_index("doc_id").sort_index()
    held = {i for i in texts if zlib.crc32(str(i).encode()) % 5 == 1}
    assert set(got.index[got.held_out]) == held
    order = sorted(texts)
    want, p, words = brute.kneser_ney([texts[i] for i in order if i not in held], [texts[i] for i in order])
    columns = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert np.allclose(got.loc[order, columns].astype(float), np.array(want))
    for before in ("<s>", "the", "never"):
        assert abs(sum(p(before, w) for w in words) + p(before, "unseen word") - 1) < 1e-9


def test_ngram_edges(edges, none):
    model = ngram.train(edges)
    want, _, _ = brute.kneser_ney([t for _, t in EDGES], [t for _, t in EDGES])
    got = sorted((r.n_tokens, round(r.score, 6)) for r in ngram.score(edges, model).collect())
    assert got == sorted((w[0], round(w[4], 6)) for w in want)
    assert ngram.score(none, model).count() == 0
    empty = ngram.train(none)
    assert empty.tokens == 0 and all(r.n_known == 0 and np.isfinite(r.score) for r in ngram.score(edges, empty).collect())


# 2: quality classifier


def test_quality_separates_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op2_quality(spark, sf).where("held_out")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = scored.join(labels, "doc_id").toPandas()
    good, bad = rows[rows.quality == 1].score.values, rows[rows.quality == 0].score.values
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert (rows.predicted == rows.quality).mean() > 0.95


def test_quality_edges(spark, edges, none):
    stats = quality.document_statistics(edges)
    labels = spark.createDataFrame([(4, 1), (4, 1), (7, 0), (6, 1), (6, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = quality.fit(stats, quality.usable_labels(labels))
    rows = quality.score(stats, model).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    unlabelled = quality.fit(stats, quality.usable_labels(labels.limit(0)))
    assert {r.score for r in quality.score(stats, unlabelled).collect()} == {0.5}
    kept = quality.keep_good(edges, unlabelled)
    assert kept.columns == edges.columns and kept.count() == len(EDGES)
    assert quality.score(quality.document_statistics(none), model).count() == 0


def test_discriminant_recovers_classes():
    rng = np.random.default_rng(0)
    x = [rng.normal(0, 1, (4000, 3)), rng.normal(1, [0.5, 2, 1], (4000, 3))]
    n = np.array([4000.0, 4000.0])
    model = quality.discriminant(n, np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), 0.0, 0.0)
    t = rng.normal(0.5, 1, (50, 3))
    density = [-0.5 * (((t - m) / s) ** 2).sum(1) - np.log(s).sum() for m, s in ((0, np.ones(3)), (1, np.array([0.5, 2, 1])))]
    assert np.allclose(model.log_odds(t), density[1] - density[0], atol=0.5)


# 3: repeats


def test_repeats_equal_plain_version(spark, small, texts):
    check_repeats(queries.op3_repeats(spark, small), brute.repeats(texts))


def check_repeats(df, want):
    for r in df.collect():
        n, gone, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (n, gone, spans), r.doc_id
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_random_overlaps(spark, seed):
    rng = random.Random(seed)
    source = "".join(rng.choice("ab é") for _ in range(2000))
    docs = {}
    for i in range(40):
        cuts = [rng.randrange(1900) for _ in range(rng.randint(0, 9))]
        docs[i * (-1) ** i] = "".join(source[a : a + rng.choice([40, 99, 100, 101, 130, 250])] for a in cuts)
    docs[100], docs[101], docs[102], docs[103] = "z" * 400, None, "", docs[3 * -1]
    got = repeats.remove_repeats(table(spark, docs))
    check_repeats(got, brute.repeats(docs))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())


def test_repeats_edges(edges, none):
    rows = repeats.remove_repeats(edges).collect()
    assert len(rows) == len(EDGES)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans))
    assert by[1] == by[2] == [(0, 0, 0)] and by[5] == [(3, 0, 0)] * 2
    assert by[7] == [(len(LONG), len(LONG) - 12, 1)] and by[8] == [(len(LONG), len(LONG), 1)]
    assert by[9] == [(50_000, 49_999, 1)]
    assert repeats.remove_repeats(none).count() == 0


# 4: URL filter


def test_urls_equal_plain_rules(spark):
    rng = random.Random(4)
    hosts = ["a.com", "example.com", "www.example.com", "WWW.Example.COM", "b.net", "x.b.net", "bad.org", "com", "net", "acom"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/2.html", "/en/x?utm_source=a", "/en/x#t", "?q=/en/"]
    pages = [(i, f"{rng.choice(['http://', 'https://', '', 'x://y://'])}{rng.choice(hosts)}{rng.choice(paths)}") for i in range(300)]
    pages += [(1000, None), (1001, ""), (1002, "://"), (None, "http://bad.org/"), (0, pages[0][1])]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("verdict", F.lit("x"))
    listed = df.where("url LIKE '%bad.org/es%'")
    got = urls.judge(df, listed, queries.URL_RULES)
    assert got.count() == len(pages)
    for r in got.join(df.select("page_id", "url").distinct(), "page_id").collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = rest.replace("?", "/").replace("#", "/").split("/")[0].translate(brute.LOWER)
        path = rest[len(host) :].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host, path)
        fits = [
            (len(h + p), h + p, v) for v, h, p in queries.URL_RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        if fits:
            assert (r.rule, r.verdict) == max(fits)[1:]
        else:
            assert r.rule is None and r.verdict == ("block" if r.listed else "allow")
            assert r.listed == (host == "bad.org" and path.rstrip("/").startswith("/es")) or r.host != "bad.org"
    shuffled = urls.judge(df, listed, queries.URL_RULES, broadcast_bytes=0)
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, got.collect()))
    assert urls.judge(df.limit(0), listed, []).count() == 0
    assert {r.verdict for r in urls.judge(df, listed.limit(0), []).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negative(spark):
    listed = spark.range(3000).select(F.concat(F.lit("h.org/"), "id").alias("canonical"))
    pages = spark.range(30_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), "id").alias("url"))
    got = urls.judge(pages, listed.select(F.concat(F.lit("http://"), "canonical").alias("url")), []).toPandas()
    assert (got.listed == (got.page_id < 3000)).all() and (got.possible | ~got.listed).all()
    assert (got.possible & ~got.listed).sum() < 0.05 * 27_000


# 5: near duplicates


def test_near_duplicates_equal_plain_version(spark, small, texts):
    check_components(queries.op5_near_duplicates(spark, small), brute.components(texts))


def check_components(df, want):
    for r in df.collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r.doc_id


def test_near_duplicates_in_large_groups(spark):
    docs = edited(3) | {2000: None, 2001: "", 2002: "a b", 2003: "A  b"}
    want = brute.components(docs)
    assert 1 < len({c for _, c in want.values()}) < len(want)
    check_components(near.near_duplicates(table(spark, docs)), want)


def test_near_duplicate_blocks_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_TEXTS", 16)
    docs = edited(5, bases=2)
    check_components(near.near_duplicates(table(spark, docs)), brute.components(docs))


def test_near_duplicates_edges(edges, none):
    rows = near.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    found = {(r.doc_id, r.n_shingles, r.component_id) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (None, 1, None), (7, 2, 7), (8, 2, 7)} <= found
    assert near.near_duplicates(none).count() == 0
    kept = near.keep_first(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 9]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    common, own = rng.integers(0, 2**63, 800).astype(np.uint64), rng.integers(0, 2**63, (2, 100)).astype(np.uint64)
    key = np.concatenate([common, own[0], common, own[1]])
    s = near.sketches(key, np.repeat([0, 1], 900), 2, 252)
    assert abs((s[0] == s[1]).mean() - 0.8) < 0.12
    one = near.sketches(np.array([5], np.uint64), np.array([0]), 1, 252)
    assert (one != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


# 6: quality rules


def test_rules_equal_plain_counts(spark, small, texts):
    got = {r.doc_id: r for r in queries.op6_rules(spark, small).collect()}
    check_rules(got, texts)


def check_rules(got, docs):
    for i, text in docs.items():
        w, r = brute.words(text), got[i]
        lines = [x for x in (text or "").split("\n") if brute.words(x)]
        seen = {}
        for k in range(len(w) - 7):
            seen.setdefault(tuple(w[k : k + 8]), []).append(k)
        again = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(8)}
        symbols = sum(c in "#*$%&|<>" for c in text or "")
        want = (len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def test_rules_edges(edges, none):
    rows = rules.quality_rules(edges).collect()
    assert len(rows) == len(EDGES)
    check_rules({r.doc_id: r for r in rows}, dict(EDGES))
    assert rules.quality_rules(none).count() == 0


def test_rules_keep_prose_and_drop_junk(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = queries.op6_rules(spark, sf).where("NOT base_failed").join(labels, "doc_id").toPandas()
    assert rows[rows.quality == 1].kept.mean() > 0.995 and rows[rows.quality == 0].kept.mean() < 0.7


def plain_references(docs, least_texts, least_words):
    """{doc_id: (text, lang)} -> {lang: (class shares, {common word: share})}, in plain Python."""
    counts, chars, n_texts = {}, {}, {}
    for text, lang in docs.values():
        if lang is None or text is None or plain_base_failed(text):
            continue
        counts.setdefault(lang, Counter()).update(plain_words(text))
        chars.setdefault(lang, Counter()).update(plain_classes(text))
        n_texts[lang] = n_texts.get(lang, 0) + 1
    out = {}
    for lang, c in counts.items():
        total = sum(c.values())
        if n_texts[lang] >= least_texts and total >= least_words:
            top = sorted(c, key=lambda w: (-c[w], plain_hash(w)))[: rules.COMMON_WORDS]
            size = sum(chars[lang].values())
            out[lang] = ({k: n / size for k, n in chars[lang].items()}, {w: c[w] / total for w in top})
    return out


def plain_base_failed(text):
    w = brute.words(text)
    places = {}
    for k in range(len(w) - 7):
        places.setdefault(tuple(w[k : k + 8]), []).append(k)
    again = {k + j for ks in places.values() if len(ks) > 1 for k in ks for j in range(8)}
    return len(w) < 20 or 100 * len(again) > 30 * len(w)


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def plain_hash(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Prefix(raw).ranges(np.array([0]), np.array([len(raw)])).view(np.int64)[0])


def plain_classes(text):
    kinds = ["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[.,;:!?'\"()-]", r"[#*$%&|<>]"]
    for c in text:
        known = [k for k, p in enumerate(kinds) if re.fullmatch(p, c)]
        yield known[0] if known else 6 if c < "\x80" else 5 + len(c.encode())


def plain_distance(counts, shares):
    total = sum(counts.values())
    if not total:
        return 1.0
    found = 0.0
    for k in set(counts) | set(shares):
        p, q = counts.get(k, 0) / total, shares.get(k, 0)
        m = (p + q) / 2
        found += sum(x * math.log2(x / m) for x in (p, q) if x > 0) / 2
    return math.sqrt(min(max(found, 0), 1))


def check_verdicts(rows, docs, references):
    for r in rows:
        text = docs[r.doc_id][0] or ""
        low, classes = Counter(plain_words(text)), Counter(plain_classes(text))
        char = min((plain_distance(classes, c) for c, _ in references.values()), default=1.0)
        word = 1.0
        for _, shares in references.values():
            counts = Counter({w: low[w] for w in shares if low[w]})
            counts[None] = sum(low.values()) - sum(counts.values())
            word = min(word, plain_distance(counts, shares | {None: 1 - sum(shares.values())}))
        assert abs(r.char_distance - char) < 1e-6 and abs(r.word_distance - word) < 1e-6, r.doc_id
        far = r.word_chars >= rules.MIN_CHARS and char > rules.MAX_CHAR_DISTANCE
        far = far or (r.n_words >= rules.MIN_WORDS and word > rules.MAX_WORD_DISTANCE)
        assert r.kept == (not r.base_failed and not (far and bool(references))), r.doc_id


def test_rule_verdicts_equal_plain_distances(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    docs = {r.doc_id: (r.text, r.lang) for r in df.collect()}
    references = plain_references(docs, rules.MIN_REFERENCE_TEXTS, rules.MIN_REFERENCE_WORDS)
    assert len(references) == 4
    check_verdicts(rules.quality_rules(df).collect(), docs, references)


def test_rule_references_come_from_enough_clean_texts(spark):
    rng = np.random.default_rng(3)
    common = [f"word{k}" for k in range(60)]
    docs = {k: (" ".join(rng.choice(common, 150)), "en") for k in range(30)}
    docs[100] = (" ".join(f"#{k}$%|" for k in rng.integers(0, 9**9, 400)), "xx")  # alone under its own code
    docs[101] = (docs[100][0], None)
    docs[102] = ("buy now " * 5000, "yy")  # fails the base rules, however long
    for k in range(30):
        docs[200 + k] = (docs[102][0], "en")  # more words than all clean texts, none counted
    df = spark.createDataFrame([(i, *d) for i, d in docs.items()], "doc_id bigint, text string, lang string")
    references = plain_references(docs, rules.MIN_REFERENCE_TEXTS, rules.MIN_REFERENCE_WORDS)
    assert set(references) == {"en"} == set(rules.language_references(df))
    rows = rules.quality_rules(df).collect()
    check_verdicts(rows, docs, references)
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == set(range(30))
    assert rules.language_references(df.where("doc_id = 100"), min_texts=1, min_words=1).keys() == {"xx"}


def test_divergence_is_a_distance():
    p = np.array([[1.0, 0, 0], [1, 1, 2], [0, 0, 0]])
    d = rules.distance(p, np.array([0.25, 0.25, 0.5]))
    assert d[1] == 0 and 0 < d[0] < 1 and d[2] == 1
    assert rules.distance(np.array([[3.0, 0]]), np.array([0.0, 1.0]))[0] == 1


# 7: packing


def check_packing(df, docs):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(queries.word_tokenizer())
    rows = df.toPandas()
    for i, part in rows.sort_values("start").groupby("doc_id"):
        ids = [*coder.encode(docs[i] or "", add_special_tokens=False).ids, 1]
        assert list(part.start) == [0, *np.cumsum(part.length)[:-1]] and part.length.sum() == len(ids)
        for r in part.itertuples():
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) and r.doc_tokens == len(ids)
            assert not hasattr(r, "ids") or bytes(r.ids) == raw
    assert set(rows.doc_id) == set(docs)
    padding = 0
    for _, part in rows.sort_values("offset").groupby("sequence_id"):
        assert list(part.offset) == [0, *np.cumsum(part.length)[:-1]]
        n = int(part.length.sum())
        assert n <= 2048
        padding += 0 if n & (n - 1) == 0 else 2048 - n
    return padding / max(1, rows.length.sum())


def test_packing_keeps_every_id(spark, small, texts):
    assert check_packing(queries.op7_pack(spark, small), texts) < 0.01


def test_packing_edges(spark, edges, none):
    docs = {i: t for i, t in EDGES if i not in (None, 5)}
    df = edges.where("doc_id <> 5").repartition(2)
    check_packing(pack.pack(df, queries.word_tokenizer()), docs)
    assert pack.pack(edges, queries.word_tokenizer()).select("doc_id").distinct().count() == 10
    assert pack.pack(none, queries.word_tokenizer()).count() == 0


def test_word_tokenizer_equals_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pitscore.llm.text import blocks

    path = queries.word_tokenizer()
    ours, coder, rng = pack.WordTokenizer(path), Tokenizer.from_file(path), random.Random(1)
    letters = [*"aAbZ09.,;:!?#$%&*'|<> \n\té ßΣ", "<|startoftext|>", "<|endoftext|>", "'s", "'LL", "<|STARTOFTEXT|>"]
    for _ in range(500):
        s = "".join(rng.choice(letters) for _ in range(rng.randint(0, 25)))
        ids, _ = ours.encode(next(blocks(pa.array([s]))), 1)
        assert ids[:-1].tolist() == coder.encode(s, add_special_tokens=False).ids, s


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 2047, 2048, 2049, 5000])
def test_parts_add_up(n):
    found = list(pack.parts(n, 2048, 64))
    assert sum(found) == n and all(0 < x <= 2048 for x in found)
    assert sum(2048 % x > 0 for x in found) <= 1


# 8: personal data


def spans(rows):
    return {r.doc_id: [tuple(s) for s in r.base] for r in rows}


def test_personal_data_equals_patterns(spark, small, texts):
    got = pii.find(spark.read.parquet(f"{small}/documents.parquet")).collect()
    assert spans(got) == {i: brute.personal(t) for i, t in texts.items()}


def test_personal_data_random_strings(spark):
    rng = random.Random(2)
    letters = [*"ab9@..+-( )15é😀,x%", "1.2.3.4", "a@b.co", "+1 (743) 555-3824", "4111 1111 1111 1111", "256.1.1.1", "\n"]
    docs = {i: "".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for i in range(800)}
    docs |= {900: None, 901: "1" * 20_000, 902: "a" * 50_000, 903: "1." * 5000, 904: "a@b" + ".c" * 20_000, 905: "+" + "1 " * 9000}
    docs[906] = "a@b.co " * 2000
    rows = pii.find(table(spark, docs)).collect()
    assert spans(rows) == {i: brute.personal(t) for i, t in docs.items()}
    for r in rows:
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))


def test_query_counts_spans_of_each_kind(spark, tmp_path):
    docs = {
        1: "4111 1111 1111 1111", 2: "+1 (743) 555-3824 and a@b.co", 3: "1.2.3.4 5.6.7.8 a@b.co", 4: None, 5: "",
        6: "a@b.co, 4111 1111 1111 1111, +1 743 555 3824, 0.0.0.1, x@y.zz",
    }
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op8_pii(spark, str(tmp_path)).collect():
        want = brute.personal(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, k, _ in want) for kind in range(4)], r
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()


def test_addresses_with_parts_of_zeros(spark):
    values = ["10.0.0.1", "192.168.0.20", "127.0.0.0", "0.0.0.0", "1.2.3.00", "01.002.3.4", "000.0000.00.0255", "1.2.3.4"]
    values += ["256.0.0.1", "0.0.0.256", "0.0.0300.0", "0.0.0", "00.1000.0.0", "0.0.0.0.0", "0" * 4000 + ".0.0.1", "0.0.0." + "0" * 4000 + "999"]
    docs = {i: f"from {v}, then" for i, v in enumerate(values)}
    want = {i: brute.personal(t) for i, t in docs.items()}
    assert [len(want[i]) for i in range(16)] == [1] * 8 + [0] * 5 + [1, 1, 0]
    assert spans(pii.find(table(spark, docs)).collect()) == want
    texts = {r.doc_id: r.text for r in pii.redact(table(spark, docs)).collect()}
    assert all("[IP]" in texts[i] for i, found in want.items() if found)


def test_classifier_adds_probable_spans(spark):
    docs = {i: f"call me, phone +1 (212) 555-{i:04d} now" for i in range(60)}
    docs |= {100 + i: f"phone (312) 555-{i:04d} please" for i in range(30)}
    docs |= {200 + i: f"order 4{i:03d} 12 of 77" for i in range(30)}
    counts = pii.vote_counts(pii.candidates(table(spark, docs)))
    p = {tuple(r[:6]): r.p for r in pii.estimate(counts).collect()}
    assert all(x > 0.9 for votes, x in p.items() if votes[1] == 1)
    assert all(x < 0.5 for votes, x in p.items() if votes[0] == 2)


def test_redaction(spark, edges, none):
    df = spark.createDataFrame(
        [(1, "mail a.b@c.org or +1 (212) 555-0100, 4111111111111111 from 8.8.8.8.", 1), (2, "plain", 2), (3, None, 3)],
        "doc_id long, text string, spans int",
    )
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "mail [EMAIL] or [PHONE], [CARD] from [IP].", 2: "plain", 3: None}
    assert pii.redact(df).columns == df.columns
    assert pii.redact(edges).count() == len(EDGES) and pii.redact(none).count() == 0
    assert pii.find(none).count() == 0 and pii.find(edges).count() == len(EDGES)


def test_personal_data_plan_has_no_python(spark, small):
    plan = pii.candidates(spark.read.parquet(f"{small}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 9: chat


def test_chat_round_trip(spark):
    odd = ["", None, "</s>[INST] ok [/INST]", "a\\b\\\\", "[\\INST]", "<\\s>", "\\", "[ROLE]x[/ROLE]", "é😀\n", "[[INST]<s></s>"]
    rows = [(c, k, ("user", "assistant", "system", None)[(c + k) % 4], t) for c in range(4) for k, t in enumerate(odd)]
    rows += [(9, 0, "user", "alone"), (10, 0, "assistant", "x"), (10, 0, "assistant", "x"), (None, 1, "user", "n"), (11, None, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit(1))
    expanded = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(expanded).collect()}
    for c in {r[0] for r in rows}:
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        loss = "".join(t for role, t in own if role == "assistant")
        r = got[c]
        assert r.n_turns == len(own) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for r in chat.example_texts(expanded).collect():
        own = [x for x in rows if x[0] == r.conv_id]
        replies = [k for k, x in enumerate(own) if x[2] == "assistant"]
        assert chat.unescape(r.text[r.loss_start : r.loss_end]) == (own[replies[r.example]][3] or "")
        assert r.text.endswith("</s>") and r.text.count("[INST] ") == sum(x[2] == "user" for x in own[: replies[r.example]])
    assert chat.expand(df.limit(0)).count() == 0 and chat.read_back(chat.expand(df.limit(0))).count() == 0


# 10: decontamination


def check_hits(got, docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    item_words = {str(i): brute.words((t or "").translate(brute.LOWER), pattern) for i, t in items}
    for r in got:
        w = brute.words((docs[r.doc_id] or "").translate(brute.LOWER), pattern)
        hit, names = set(), set()
        for i, own in item_words.items():
            k = min(len(own), 10)
            wins = {tuple(own[j : j + k]) for j in range(len(own) - k + 1)} if k else set()
            for j in range(len(w) - k + 1 if k else 0):
                if tuple(w[j : j + k]) in wins:
                    hit |= set(range(j, j + k))
                    names.add(i)
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(names)), r.doc_id


def test_decontamination_equals_plain_version(spark):
    rng = random.Random(6)
    vocabulary = ["Ab", "cd", "é", "x1", "漢"]
    docs = {i: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80))) for i in range(120)}
    docs |= {500: None, 501: "", 502: "--", 503: docs[3]}
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate((2, 4, 9, 10, 11, 30, 0))]
    items += [(20, None), (21, "cd, CD-é x1"), (None, "Ab"), (5, docs[3])]
    items = [x for x in items if x[0] != 0]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_hit", F.lit(1))
    plain = [(i, t) for i, t in items if i is not None]
    df = table(spark, docs)
    got = decontaminate.report(df, bench).collect()
    pieces = decontaminate.report(df, bench, set_bytes=40).collect()
    key = lambda r: (r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans])
    assert sorted(map(key, got)) == sorted(map(key, pieces))
    single = [x for x in plain if x[0] != 5]
    one = spark.createDataFrame(single, "item_id long, text string")
    check_hits(decontaminate.report(df, one).collect(), docs, single)
    clean = decontaminate.decontaminate(df, one)
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in decontaminate.report(df, one).where("n_hit = 0").collect()}
    cut = decontaminate.decontaminate(df, one, action="span")
    assert cut.count() == len(docs)


def test_decontamination_edges(spark, edges, none):
    bench = spark.createDataFrame([(1, "one"), (2, None), (3, "")], "item_id long, text string")
    rows = decontaminate.report(edges, bench).collect()
    assert len(rows) == len(EDGES) and {r.doc_id for r in rows if r.n_hit} == {4, 5}
    assert decontaminate.decontaminate(edges, bench).columns == edges.columns
    assert decontaminate.report(edges, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.report(none, bench).count() == 0


# pipeline


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = near.materialize(stage(spark, docs, small))
        before = {r.doc_id: r.text for r in docs.collect()} if "text" in docs.columns else {}
        if name != "packing":
            assert out.columns == columns
        if name == "near duplicates":
            want = {i for i, (n, c) in brute.components(before, corpus_pipeline.NEAR_PERCENT).items() if c == i or not n}
            assert {r.doc_id for r in out.collect()} == want
        if name == "personal data":
            for r in out.collect():
                assert not brute.personal(r.text) and (r.text == before[r.doc_id] or "[" in r.text)
        if name == "packing":
            check_packing(out, before)
        docs = out
    assert corpus_pipeline.run(spark, small).count() == docs.count()


def test_pipeline_links_near_copies_from_80_percent(spark):
    docs = edited(3)
    for base in range(20):
        text = [f"b{base}x{k}" for k in range(100)]
        for edits in ((), (30, 60), (30, 60, 90)):  # similarities 1, 86/106 and 81/111
            docs[len(docs) + 1000] = " ".join("new" if k in edits else w for k, w in enumerate(text))
    firsts = [{i for i, (_, c) in brute.components(docs, percent).items() if c == i} for percent in (80, 85)]
    assert len(firsts[1]) >= len(firsts[0]) + 20
    got = dict(corpus_pipeline.STAGES)["near duplicates"](spark, table(spark, docs), "")
    assert {r.doc_id for r in got.collect()} == firsts[0]


def test_pipeline_edges(spark, edges, none, small, tmp_path):
    for df in (edges, none):
        docs = df
        for _, stage in corpus_pipeline.STAGES:
            docs = near.materialize(stage(spark, docs, small))
        assert docs.columns[0] == "doc_id"
