"""Language identification by unigram pieces, summed over every segmentation of a text's words.

The pieces are those of a fixed public vocabulary. A language is a probability for each piece; the
probability of a word is the sum, over all ways to cut it into pieces, of the product of theirs. A forward
pass over the word's positions gives that sum for all languages at once. A text's log-probability is the sum
over its words, and its language the one that makes it likeliest.

Piece probabilities are learned by expectation-maximisation: the forward and backward passes give each
piece's expected number of uses in the distinct words of a language, weighted by how often they occur.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm.shared import ship
from pitscore.llm.text import Prefix, Texts, blocks, byte_class, count_by, lower_ascii, mix, scan
from pitscore.llm.wordcache import Store, WordNumbers
from pitscore.sources.io import materialize

#: Labelled documents of a language that are learned from, about; taken by the hash of their text.
SAMPLE = 5000
#: Rounds of expectation-maximisation, uses lent to each language from the mean of all, and of that the share
#: spread evenly over the vocabulary.
ROUNDS, LENT, EVEN = 2, 500.0, 0.05
#: Longer runs of letters are cut into words of so many letters.
LONGEST = 32
#: The least probability of a piece; a letter that is no piece has it in every language.
LEAST = 1e-9
#: Per letter, in nats, taken out of the products and put back into the logarithm, so that they stay in range.
PER_LETTER = 2.5
CACHED_VALUES, CELLS = 1 << 22, 1 << 22
#: Languages times pieces of a model that go to each worker.
MOST_CELLS = 1 << 26
UNKNOWN, START = "und", "▁"

_WORD_BYTE = byte_class("[A-Za-z]")
_WORD_BYTE[128:] = True


class Vocabulary:
    """The pieces of a ``sentencepiece`` model, known by hashes of their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        odd = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
        ids = [i for i in range(model.get_piece_size()) if not any(f(i) for f in odd)]
        pieces = [model.id_to_piece(i) for i in ids]
        raw = [p.encode() for p in pieces]
        ends = np.cumsum([len(x) for x in raw])
        hashes = Prefix(np.frombuffer(b"".join(raw), np.uint8)).ranges(ends - [len(x) for x in raw], ends)
        order = np.argsort(hashes)
        self.hashes, self.n = hashes[order], len(pieces)
        self.letters = np.array([len(p) for p in pieces], np.int64)[order]
        self.longest = int(self.letters.max())

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of pieces; ``n`` for what is none."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), self.n - 1)
        return np.where(self.hashes[at] == hashes, at, self.n)


class Lattice:
    """All ways to cut some words into pieces: an edge per piece, from its first letter to past its last."""

    def __init__(self, words: list[str], vocabulary: Vocabulary):
        data = np.frombuffer("".join(words).encode(), np.uint8)
        first = np.flatnonzero((data & 0xC0) != 0x80)
        past = np.append(first[1:], len(data))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), sizes)
        self.first = np.cumsum(sizes + 1) - sizes - 1  # the node before each word's first letter
        self.last = self.first + sizes
        self.sizes = sizes
        node = np.arange(len(first)) + word
        left = self.last[word] - node
        prefix, edges = Prefix(data), []
        for n in range(1, vocabulary.longest + 1):
            a = np.flatnonzero(left >= n)
            if not len(a):
                break
            piece = vocabulary.find(prefix.ranges(first[a], past[a + n - 1]))
            if n > 1:
                a, piece = a[piece < vocabulary.n], piece[piece < vocabulary.n]
            edges.append((node[a], node[a] + n, piece, node[a] - self.first[word[a]]))
        self.start, self.end, self.piece, begin = (np.concatenate(x) for x in zip(*edges, strict=True))
        self._begin, self._stop = begin, begin + self.end - self.start
        self.nodes = int(self.last[-1]) + 1

    def _pass(self, near, far, place, weights, value, forward):
        """Adds up ``value[near] * weights`` at ``far``, place by place along all words at once."""
        order = np.lexsort((far, place if forward else -place))
        cuts = np.flatnonzero(np.diff(place[order])) + 1
        for own in np.split(order, cuts):
            to = far[own]
            heads = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            value[to[heads]] = np.add.reduceat(value[near[own]] * weights[own], heads, axis=0)
        return value

    def forward(self, weights: np.ndarray) -> np.ndarray:
        value = np.zeros((self.nodes, *weights.shape[1:]))
        value[self.first] = 1
        return self._pass(self.start, self.end, self._stop, weights, value, True)

    def backward(self, weights: np.ndarray) -> np.ndarray:
        value = np.zeros((self.nodes, *weights.shape[1:]))
        value[self.last] = 1
        return self._pass(self.end, self.start, self._begin, weights, value, False)


def letter_words(word: str) -> list[str]:
    """The runs of letters in a word, lower-cased, the first of each cut marked as a word's start."""
    low = word.lower()
    runs = [low] if low.isalpha() else ["".join(g) for letter, g in groupby(low, str.isalpha) if letter]
    return [(START if k == 0 else "") + r[k : k + LONGEST] for r in runs for k in range(0, len(r), LONGEST)]


def _words(t: Texts) -> tuple[np.ndarray, ...]:
    data = lower_ascii(t.data)
    start, end, owner = t.segments(_WORD_BYTE[data])
    return data, start, end, owner, Prefix(data).ranges(start, end)


@dataclass(frozen=True)
class Model:
    """Piece probabilities: one row per piece and one for letters that are none, one column per language."""

    name: str
    vocabulary: str
    languages: tuple[str, ...]
    share: np.ndarray


def _scaled(share: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    return share * np.exp(PER_LETTER * np.append(vocabulary.letters, 1))[:, None]


_vocabularies: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:  # a worker serves many tasks
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def train(
    docs: DataFrame, vocabulary: str, text: str = "text", lang: str = "lang", sample: int = SAMPLE, rounds: int = ROUNDS
) -> Model:
    """Piece probabilities of every language named in ``lang``.

    ``vocabulary`` is the path, on driver and workers, of a ``sentencepiece`` model. Rows without text or
    language are passed by. Of a language with more than ``sample`` documents about that many are taken, by
    the hash of their text, so which ones does not depend on the partitioning; repeated rows go in or out together. A table without labels
    gives a model without languages. What reaches the driver is a number per language and piece used;
    a label column with so many values that this passes ``MOST_CELLS`` is no language and an error.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    languages = tuple(sorted(sizes))
    voc = _vocabulary(vocabulary)
    n, m = len(languages), voc.n + 1
    if n * m > MOST_CELLS:
        raise ValueError(f"{n} languages with {m} pieces each are more than a worker should hold")
    if not n:
        return Model(uuid.uuid4().hex, vocabulary, languages, np.zeros((m, 0)))
    large = {k: v for k, v in sizes.items() if v > sample}
    if large:
        limit = F.create_map(*[x for k, v in large.items() for x in (F.lit(k), F.lit(sample / v))])
        draw = F.pmod(F.xxhash64("text"), F.lit(1 << 32)) / float(1 << 32)
        rows = rows.where(F.coalesce(draw < F.try_element_at(limit, F.col("lang")), F.lit(True)))
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        for batch in batches:
            code = np.array([number[x] for x in batch.column(0).to_pylist()], np.int64)
            for t in blocks(batch.column(1)):
                data, start, end, owner, hashes = _words(t)
                own = code[owner + t.first]
                _, first, times = np.unique(hashes ^ mix(own.astype(np.uint64)), return_index=True, return_counts=True)
                raw = data.tobytes()
                words = [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own[first], pa.int32()), pa.array(words, pa.string()), pa.array(times, pa.int64())], ["lang", "word", "n"]
                )

    words = rows.mapInArrow(count, "lang int, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = materialize(words)
    share = np.full((m, n), 1 / voc.n)
    share[-1] = LEAST
    for _ in range(rounds):
        share = _improved(_expected(words, vocabulary, share, n))
    return Model(uuid.uuid4().hex, vocabulary, languages, share)


def _expected(words: DataFrame, vocabulary: str, share: np.ndarray, n: int) -> np.ndarray:
    """Expected uses of every piece in the words of each language."""
    held = words.sparkSession.sparkContext.broadcast(share)

    def uses(batches):
        voc = _vocabulary(vocabulary)
        scaled, total = _scaled(held.value, voc), np.zeros(held.value.shape)
        for batch in batches:
            parts = [letter_words(w) for w in batch.column(1).to_pylist()]
            sizes = [len(p) for p in parts]
            own = np.repeat(batch.column(0).to_numpy(), sizes)
            times = np.repeat(batch.column(2).to_numpy(), sizes)
            runs = [w for p in parts for w in p]
            for k in range(0, len(runs), CELLS // 256):
                lattice = Lattice(runs[k : k + CELLS // 256], voc)
                word = np.searchsorted(lattice.first, lattice.start, side="right") - 1
                mine = own[k : k + CELLS // 256][word]
                weights = scaled[lattice.piece, mine][:, None]
                a, b = lattice.forward(weights), lattice.backward(weights)
                use = (a[lattice.start] * weights * b[lattice.end])[:, 0] / a[lattice.last[word], 0]
                use *= times[k : k + CELLS // 256][word]
                total += np.bincount(lattice.piece * n + mine, use, total.size).reshape(total.shape)
        piece, language = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(piece, pa.int64()), pa.array(language, pa.int64()), pa.array(total[piece, language])], ["piece", "lang", "uses"]
        )

    found = words.mapInArrow(uses, "piece bigint, lang bigint, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses"))
    table = found.toArrow()
    held.destroy()
    out = np.zeros(share.shape)
    out[table["piece"].to_numpy(), table["lang"].to_numpy()] = table["uses"].to_numpy()
    return out


def _improved(uses: np.ndarray) -> np.ndarray:
    """Probabilities from uses, smoothed with the mean of all languages."""
    uses = uses.copy()
    uses[-1] = 0
    total = uses.sum(axis=0)
    mean = (uses / np.maximum(total, 1e-300)).mean(axis=1)
    mean = (1 - EVEN) * mean + EVEN / (len(mean) - 1)
    share = np.maximum((uses + LENT * mean[:, None]) / (total + LENT), LEAST)
    share[-1] = LEAST
    return share


class Scorer:
    """Log-probabilities of texts in all languages; words are kept once scored."""

    def __init__(self, model: Model):
        self.model = model
        self._vocabulary = _vocabulary(model.vocabulary)
        self._scaled = _scaled(model.share, self._vocabulary)
        self._clear()

    def _clear(self):
        self._numbers = WordNumbers()
        self._log, self._letters = Store(np.float64, len(self.model.languages)), Store(bool)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of words, a column per language, and whether each has a letter."""
        parts = [letter_words(w) for w in words]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        runs = [w for p in parts for w in p]
        log = np.zeros((len(runs), len(self.model.languages)))
        step = max(1, CELLS // (64 * max(1, log.shape[1])))
        for k in range(0, len(runs), step):
            lattice = Lattice(runs[k : k + step], self._vocabulary)
            value = lattice.forward(self._scaled[lattice.piece])
            log[k : k + step] = np.log(value[lattice.last]) - PER_LETTER * lattice.sizes[:, None]
        out = np.zeros((len(words), log.shape[1]))
        np.add.at(out, np.repeat(np.arange(len(words)), sizes), log)
        return out, sizes > 0

    def of_texts(self, t: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Log-probabilities of texts, a column per language, and whether each has a letter."""
        data, start, end, owner, hashes = _words(t)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self._log.n * max(1, len(self.model.languages)) > CACHED_VALUES:
            self._clear()
        number = self._numbers.find(unique)
        new = number < 0
        if new.any():
            raw, spots = data.tobytes(), first[new]
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[spots].tolist(), end[spots].tolist(), strict=True)]
            log, letters = self.of_words(words)
            number[new] = np.arange(self._numbers.n, self._numbers.n + len(words))
            self._numbers.add(unique[new])
            self._log.add(log)
            self._letters.add(letters)
        number = number[which]
        log = np.stack([np.bincount(owner, column[number], len(t)) for column in self._log.values.T], axis=1) if self._log.values.shape[1] else np.zeros((len(t), 0))
        return log, count_by(owner[self._letters.values[number]], len(t)) > 0


_scorers: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model, ids: list[str] | None = None, text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``lang_pred`` and ``score``, the chance of that language when all are equally likely.

    Whole texts count, whatever their length. A null or empty text, one without a letter, and any text where
    the model knows no language is ``und`` with a score of 0. Of equally likely languages the first in
    order is taken. Repeated rows are scored alike; an empty table gives no rows. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    name, languages = model.name, np.array([*model.languages, UNKNOWN], object)

    def work(t: Texts):
        if name not in _scorers:
            _scorers.clear()
            _scorers[name] = Scorer(held.value)
        log, letters = _scorers[name].of_texts(t)
        if len(languages) == 1:
            return {"lang_pred": pa.array([UNKNOWN] * len(t), pa.string()), "score": np.zeros(len(t))}
        best = log.argmax(axis=1)
        score = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
        named = languages[np.where(letters, best, len(languages) - 1)]
        return {"lang_pred": pa.array(named.tolist(), pa.string()), "score": np.where(letters, score, 0.0)}

    return scan(docs, ids or ["doc_id"], text, "lang_pred string, score double", work)
