"""Quality rules: plain counts, and the divergence of a text's histograms from language references."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitscore.llm.shared import ship
from pitscore.llm.text import (
    ALNUM, Prefix, Texts, blocks, byte_class, count_by, lower_ascii, mix, scan, windows,
)
from pitscore.sources.io import materialize

SYMBOL = byte_class(r"[#*$%&|<>]")
#: Character classes of the histogram: lower, upper, digit, white space, stops, symbols, other ASCII,
#: and non-ASCII characters by the length of their code.
CLASSES = np.full(256, 6, np.uint8)
for _k, _pattern in enumerate(["[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", "[.,;:!?'\"()-]", r"[#*$%&|<>]"]):
    CLASSES[byte_class(_pattern)] = _k
CLASSES[0x80:0xC0], CLASSES[0xC0:0xE0], CLASSES[0xE0:0xF0], CLASSES[0xF0:] = 255, 7, 8, 9
N_CLASSES = 10
COMMON_WORDS = 64
#: Distance (0 to 1, square root of the divergence in bits) above which a text fails.
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.45
#: Shorter texts are not judged by that histogram.
MIN_CHARS = 200
MIN_WORDS = 100
#: A language with fewer texts, or fewer words in them, that pass the base rules gets no reference.
MIN_REFERENCE_TEXTS = 10
MIN_REFERENCE_WORDS = 1000


def words_and_repeats(t: Texts, prefix: Prefix) -> tuple[np.ndarray, np.ndarray]:
    """Words per text, and how many of them lie in windows of eight words that occur again in it."""
    start, end, owner = t.words()
    found, first = windows(prefix.ranges(start, end), owner, 8)
    keys = mix(found + mix(owner[first].astype(np.uint64) + np.uint64(1)))
    _, which, seen = np.unique(keys, return_inverse=True, return_counts=True)
    again = first[seen[which] > 1]
    cover = np.bincount(again, minlength=len(start) + 8) - np.bincount(again + 8, minlength=len(start) + 8)
    repeated = np.cumsum(cover)[: len(start)] > 0
    return count_by(owner, len(t)), count_by(owner[repeated], len(t))


def fails_base(n_words: np.ndarray, n_repeat_words: np.ndarray) -> np.ndarray:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def base_counts(t: Texts) -> dict[str, np.ndarray]:
    start, end, owner = t.words()
    n = len(t)
    prefix = Prefix(t.data)
    n_words, n_repeat_words = words_and_repeats(t, prefix)
    character = (t.data & 0xC0) != 0x80
    running = np.concatenate([[0], np.cumsum(character)])
    chars = count_by(owner, n, (running[end] - running[start]).astype(float))
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[t.data])])
    line_start, line_end, line_owner = t.lines()
    full = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line = prefix.ranges(line_start[full], line_end[full])
    line_owner = line_owner[full]
    keys = mix(line + mix(line_owner.astype(np.uint64) + np.uint64(1)))
    firsts = np.unique(keys, return_index=True)[1]
    n_lines, distinct = count_by(line_owner, n), count_by(line_owner[firsts], n)
    return {
        "n_words": n_words,
        "word_chars": chars,
        "n_symbols": symbols[t.bounds[1:]] - symbols[t.bounds[:-1]],
        "n_dup_lines": n_lines - distinct,
        "n_repeat_words": n_repeat_words,
    }


def class_histogram(t: Texts) -> np.ndarray:
    kinds = CLASSES[t.data]
    owner = np.repeat(np.arange(len(t)), np.diff(t.bounds))
    use = kinds != 255
    flat = np.bincount(owner[use] * N_CLASSES + kinds[use], minlength=len(t) * N_CLASSES)
    return flat.reshape(len(t), N_CLASSES)


def _words(t: Texts):
    low = lower_ascii(t.data)
    start, end, owner = Texts(low, t.bounds).words(ALNUM)
    return Prefix(low).ranges(start, end), owner


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts to a distribution; 1 for a row without counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(reference > 0, reference * np.log2(reference / m), 0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((left + right) / 2, 0, 1)), 1.0)


def language_code():
    """Rows are grouped by the two or three letters a language tag starts with, so that the number of
    references is bounded whatever the column holds."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower("lang"), "^([a-z]{2,3})([-_].*)?$", 1), F.lit("")), F.lit("other"))


def language_references(
    docs: DataFrame, common_words: int = COMMON_WORDS, min_texts: int = MIN_REFERENCE_TEXTS, min_words: int = MIN_REFERENCE_WORDS
) -> dict[str, tuple]:
    """Per language: its character-class distribution, and its most common words with their shares.

    Counted over all texts that pass the base rules and whose tag starts with a language code; each task
    sums its own counts before the shuffle. A code with fewer than ``min_texts`` such texts or ``min_words``
    words has no reference, so a few odd texts under a code of their own are no measure for themselves.
    What comes back is ``common_words`` rows per language left.
    """
    rows = docs.select(language_code().alias("lang"), F.col("text").alias("text")).where("lang <> 'other' and text is not null")
    ship(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        # the last slot counts texts
        chars, words = defaultdict(lambda: np.zeros(N_CLASSES + 1, np.int64)), defaultdict(list)

        def flush(lang):
            parts = words.pop(lang)
            keys = np.concatenate([k for k, _ in parts])
            unique, which = np.unique(keys, return_inverse=True)
            n = np.bincount(which, weights=np.concatenate([c for _, c in parts])).astype(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(unique), pa.string()), pa.array(unique.view(np.int64)), pa.array(n)], ["lang", "word", "n"]
            )

        held = defaultdict(int)
        for batch in batches:
            names, codes = np.unique(np.array(batch.column(0).to_pylist(), str), return_inverse=True)
            for t in blocks(batch.column(1)):
                own = np.where(fails_base(*words_and_repeats(t, Prefix(t.data))), -1, codes[t.first : t.first + len(t)])
                hist = class_histogram(t)
                hashes, owner = _words(t)
                for k in np.unique(own[own >= 0]):
                    lang = str(names[k])
                    chars[lang] += np.append(hist[own == k].sum(axis=0), np.count_nonzero(own == k))
                    words[lang].append(np.unique(hashes[own[owner] == k], return_counts=True))
                    held[lang] += len(words[lang][-1][0])
                    if held[lang] > 1 << 21:
                        yield flush(lang)
                        held[lang] = 0
        for lang in list(words):
            yield flush(lang)
        for lang, h in chars.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang + "#"] * len(h), pa.string()), pa.array(np.arange(len(h))), pa.array(h)], ["lang", "word", "n"]
            )

    counts = materialize(
        rows.mapInArrow(run, "lang string, word bigint, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    )
    texts = counts.where(F.endswith("lang", F.lit("#")) & (F.col("word") == N_CLASSES))
    texts = texts.select(F.regexp_replace("lang", "#$", "").alias("lang"), F.col("n").alias("texts"))
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n")).where(F.col("n") >= max(min_words, 1))
    sums = {r.lang: r.n for r in sizes.join(texts.where(F.col("texts") >= min_texts), "lang").collect()}
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counts.where(F.col("lang").isin([*sums])).withColumn("rank", F.row_number().over(by_count))
    classes = counts.where(F.col("lang").isin([lang + "#" for lang in sums]) & (F.col("word") < N_CLASSES))
    found = defaultdict(dict)
    for r in common.where(F.col("rank") <= common_words).drop("rank").union(classes).collect():
        found[r.lang][r.word] = r.n
    out = {}
    for lang in sorted(sums):
        chars = np.array([found[lang + "#"].get(k, 0) for k in range(N_CLASSES)], float)
        keys = np.array(sorted(np.array(list(found[lang]), np.int64).view(np.uint64)), np.uint64)
        share = np.array([found[lang][int(k)] for k in keys.view(np.int64)], float) / sums[lang]
        out[lang] = (chars / max(chars.sum(), 1), keys, np.append(share, max(0.0, 1 - share.sum())))
    return out


def distances(t: Texts, references: dict[str, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest distance of each text to a reference, by characters and by common words."""
    hist = class_histogram(t)
    hashes, owner = _words(t)
    n = count_by(owner, len(t))
    char, word = np.ones(len(t)), np.ones(len(t))
    for chars, keys, share in references.values():
        char = np.minimum(char, distance(hist, chars))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        hit = keys[at] == hashes
        counts = np.bincount(owner[hit] * len(share) + at[hit], minlength=len(t) * len(share)).reshape(len(t), -1)
        counts[:, -1] = n - counts.sum(axis=1)
        word = np.minimum(word, distance(counts, share))
    return char, word


def quality_rules(
    docs: DataFrame, references: dict[str, tuple] | None = None, max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
) -> DataFrame:
    """Per row of ``docs`` (``doc_id``, ``text``, ``lang``): the base counts, both distances and the verdict.

    A text fails by the base rules (fewer than 20 words, or over 30 % of its words in repeated windows of
    eight), or if it lies further than a threshold from every language reference; texts under ``min_chars``
    characters or ``min_words`` words are not judged by that histogram. Null and empty texts have no words
    and fail. Without any reference (an empty table, or too few texts of any language) only the base rules
    hold. Repeated rows are judged
    alike. Other columns are not read.
    """
    if references is None:
        references = language_references(docs)
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def work(t: Texts):
        out = base_counts(t)
        char, word = distances(t, shared.value)
        failed = fails_base(out["n_words"], out["n_repeat_words"])
        far = np.zeros(len(t), bool)
        if shared.value:
            far = (out["word_chars"] >= min_chars) & (char > max_char_distance)
            far |= (out["n_words"] >= min_words) & (word > max_word_distance)
        return out | {"char_distance": char, "word_distance": word, "base_failed": failed, "kept": ~failed & ~far}

    counts = ", ".join(f"{c} bigint" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    schema = f"{counts}, char_distance double, word_distance double, base_failed boolean, kept boolean"
    return scan(docs, ["doc_id"], "text", schema, work)
