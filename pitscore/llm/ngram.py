"""Interpolated modified Kneser-Ney n-gram model (bigrams), counted in Spark.

Tasks count the word pairs of their texts and send them, packed, to the shard that the pair's hash falls
in. A shard adds the counts up and writes a sorted array of pair hashes with counts to the shared folder;
what its pairs say about single words (occurrences, distinct predecessors, how many successors occur once,
twice or more) goes, packed, to the shard of the word. Workers map the arrays into memory and look the
words and pairs of whole texts up in them. Nothing of a corpus' size passes the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm.packed import ShardSet, to_shards
from pitscore.llm.shared import load, save, shared_path, ship
from pitscore.llm.text import Prefix, Texts, blocks, count_by, lower_ascii, mix, scan
from pitscore.sources.io import materialize

#: Hashes that no word has but by chance: before the first and after the last word of a text.
BEGIN, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Text per shard, and pairs a task holds before it sends them.
SHARD_BYTES, HELD_PAIRS = 16 << 20, 1 << 22


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of each text and its end, and the text each belongs to."""
    low = lower_ascii(t.data)
    start, end, owner = Texts(low, t.bounds).words()
    hashes = Prefix(low).ranges(start, end)
    n = count_by(owner, len(t))
    stops = np.cumsum(n)
    out = np.insert(hashes, stops, END)
    return out, np.insert(owner, stops, np.arange(len(t)))


def _pairs(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The token before each, BEGIN for a text's first."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    first = np.ones(len(hashes), bool)
    first[1:] = owner[1:] != owner[:-1]
    before[first] = BEGIN
    return before


def pair_hash(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + after)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards follow the order of the hashes: shard s holds those from s/shards of the range."""
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def _sum_sorted(keys: np.ndarray, columns: list[np.ndarray]):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    return keys[at], order[at], [np.add.reduceat(c[order], at) if len(at) else c[:0] for c in columns]


def _rows(shard, blobs):
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"]
    )


def _pack_pairs(before, after, count) -> bytes:
    """Pairs grouped by their first word: each first word once, with its number of pairs."""
    order = np.argsort(before, kind="stable")
    before, after, count = before[order], after[order], count[order]
    first, sizes = np.unique(before, return_counts=True)
    head = np.array([len(first), len(after)], np.int64)
    parts = [head, first, sizes.astype(np.uint32), after, narrow(count)]
    return b"".join(p.tobytes() for p in parts)


def _unpack_pairs(blob: bytes):
    n, m = np.frombuffer(blob, np.int64, 2)
    at = 16
    first = np.frombuffer(blob, np.uint64, n, at)
    sizes = np.frombuffer(blob, np.uint32, n, at + 8 * n)
    after = np.frombuffer(blob, np.uint64, m, at + 12 * n)
    count = _counts_at(blob, at + 12 * n + 8 * m)
    return np.repeat(first, sizes), after, count


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all fit, else in 64."""
    return counts.astype(np.uint32 if counts.max(initial=0) <= 0xFFFFFFFF else np.uint64)


def _counts_at(blob: bytes, at: int, n: int | None = None) -> np.ndarray:
    """The counts that end a blob, as wide as they were written."""
    n = n or int(np.frombuffer(blob, np.int64, 2)[1])
    wide = len(blob) - at > 4 * n
    return np.frombuffer(blob, np.uint64 if wide else np.uint32, n, at)


def _pack_words(keys, columns) -> bytes:
    return b"".join([np.int64(len(keys)).tobytes(), keys.tobytes(), narrow(np.stack(columns)).tobytes()])


def _unpack_words(blob: bytes):
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    return np.frombuffer(blob, np.uint64, n, 8), list(_counts_at(blob, 8 + 8 * n, 5 * n).reshape(5, n))


def _grouped(batches):
    """Blobs of one shard after the other; rows are sorted by shard."""
    current, held = None, []
    for batch in batches:
        for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if shard != current and held:
                yield current, held
                held = []
            current = shard
            held.append(blob.as_py())
    if held:
        yield current, held


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers that hold for all of them."""

    folder: str
    shards: int
    written: dict
    tokens: int
    words: int
    pair_types: int
    pair_discount: tuple
    word_discount: tuple
    word_gamma: float


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that occur once to four times; a half
    where they leave a discount undefined."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(d if 0 < d < k else 0.5 for k, d in enumerate(found, 1))


def train(docs: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    """Counts the model over all rows of ``docs`` and writes its arrays to a new shared folder.

    Words are runs without ASCII white space, A-Z lower-cased; each text ends with an end token. A null or
    empty text is an end token alone. Repeated rows count again. An empty table gives a model that knows no
    word.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = folder or shared_path(spark, "ngram")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("bigint")), F.lit(0))).first()[0]
    shards = max(8, -(-size // SHARD_BYTES))

    def count(batches):
        held, n = [], 0

        def flush():
            before, after, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            key, place, (total,) = _sum_sorted(pair_hash(before, after), [counts])
            which = _shard(key, shards)
            cuts = np.searchsorted(which, np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cuts))
            blobs = []
            for s in used:
                at = place[cuts[s] : cuts[s + 1]]
                blobs.append(_pack_pairs(before[at], after[at], total[cuts[s] : cuts[s + 1]]))
            return _rows(used, blobs)

        for batch in batches:
            for t in blocks(batch.column(0)):
                after, owner = tokens(t)
                before = _pairs(after, owner)
                _, place, (total,) = _sum_sorted(pair_hash(before, after), [np.ones(len(after), np.int64)])
                held.append((before[place], after[place], total))
                n += len(place)
                if n >= HELD_PAIRS:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    def merge_pairs(batches):
        for shard, blobs in _grouped(batches):
            before, after, counts = (np.concatenate(x) for x in zip(*map(_unpack_pairs, blobs), strict=True))
            key, place, (total,) = _sum_sorted(pair_hash(before, after), [counts.astype(np.int64)])
            before, after = before[place], after[place]
            save(f"{folder}/pair-{shard:06d}.npy", key)
            save(f"{folder}/pair-count-{shard:06d}.npy", narrow(total))
            kinds = np.bincount(np.minimum(total, 5), minlength=6)
            one = np.ones(len(key), np.int64)
            none = np.zeros(len(key), np.int64)
            names = np.concatenate([after, before])
            columns = [
                np.concatenate([total, none]),  # occurrences
                np.concatenate([one, none]),  # distinct predecessors
                *(np.concatenate([none, (total == k).astype(np.int64)]) for k in (1, 2)),
                np.concatenate([none, (total >= 3).astype(np.int64)]),
            ]
            words, _, sums = _sum_sorted(names, columns)
            cuts = np.searchsorted(_shard(words, shards), np.arange(shards + 1))
            used = np.flatnonzero(np.diff(cuts))
            blobs = [_pack_words(words[cuts[s] : cuts[s + 1]], [c[cuts[s] : cuts[s + 1]] for c in sums]) for s in used]
            yield _rows([*used, -1], [*blobs, np.append(kinds, shard).astype(np.int64).tobytes()])

    def merge_words(batches):
        for shard, blobs in _grouped(batches):
            if shard < 0:  # of every shard of pairs
                for *kinds, own in (np.frombuffer(b, np.int64) for b in blobs):
                    yield _totals(-1 - int(own), [*kinds[1:5], sum(kinds[1:]), 0, 0])
                continue
            keys, columns = zip(*map(_unpack_words, blobs), strict=True)
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*columns, strict=True)]
            words, _, sums = _sum_sorted(np.concatenate(keys), columns)
            save(f"{folder}/word-{shard:06d}.npy", words)
            save(f"{folder}/word-counts-{shard:06d}.npy", narrow(np.stack(sums, axis=1)))
            seen, before = sums[0], sums[1]
            kinds = np.bincount(np.minimum(before[before > 0], 5), minlength=6)
            yield _totals(shard, [*kinds[1:5], before.sum(), seen.sum(), (seen > 0).sum()])

    def _totals(shard, values):
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([[int(v) for v in values]], pa.list_(pa.int64()))], ["shard", "n"]
        )

    packed = "shard int, blob binary"
    pairs = docs.select(text).mapInArrow(count, packed)
    words = to_shards(to_shards(pairs, shards).mapInArrow(merge_pairs, packed), shards)
    found = materialize(words.mapInArrow(merge_words, "shard int, n array<bigint>"))
    written = {
        "pair": ShardSet(found.where("shard < 0").select((-1 - F.col("shard")).alias("shard"))),
        "word": ShardSet(found.where("shard >= 0").select("shard")),
    }
    sums = found.groupBy((F.col("shard") < 0).alias("pairs")).agg(
        *[F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(7)]
    )
    by = {r.pairs: list(r)[1:] for r in sums.collect()}
    pair, word = by.get(True, [0] * 7), by.get(False, [0] * 7)
    d = discounts(word[:4])
    n1, n2 = word[0], word[1]
    n3 = word[6] - n1 - n2
    gamma = (d[0] * n1 + d[1] * n2 + d[2] * n3) / word[4] if word[4] else 1.0
    return Model(folder, shards, written, word[5], word[6], pair[4], discounts(pair[:4]), d, gamma)


class Reader:
    """Looks tokens and pairs up in the mapped arrays."""

    def __init__(self, model: Model):
        self.model = model
        self._pair_discount = np.array([0.0, *model.pair_discount])
        self._word_discount = np.array([0.0, *model.word_discount])

    def _find(self, name: str, values: str, keys: np.ndarray, width: int) -> np.ndarray:
        """Values of sorted distinct keys; zeros where a key is not known."""
        out = np.zeros((len(keys), width) if width else len(keys), np.uint64)
        cuts = np.searchsorted(_shard(keys, self.model.shards), np.arange(self.model.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if int(s) not in self.model.written[name]:
                continue  # a shard without entries
            known = load(f"{self.model.folder}/{name}-{s:06d}.npy")
            own = keys[cuts[s] : cuts[s + 1]]
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            hit = known[at] == own
            out[cuts[s] : cuts[s + 1]][hit] = load(f"{self.model.folder}/{values}-{s:06d}.npy")[at[hit]]
        return out

    def score(self, t: Texts) -> dict[str, np.ndarray]:
        m, n = self.model, len(t)
        after, owner = tokens(t)
        before = _pairs(after, owner)
        words, which = np.unique(np.append(after, BEGIN), return_inverse=True)
        counts = self._find("word", "word-counts", words, 5).astype(float)
        c = counts[which[:-1], 0]
        base = np.log10((c + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        # single words: continuation counts, interpolated with the uniform distribution
        seen = counts[:, 1]
        types = max(m.pair_types, 1)
        single = np.maximum(seen - self._word_discount[np.minimum(seen, 3).astype(int)], 0) / types
        single = single + m.word_gamma / (m.words + 1)
        # pairs
        keys, place = np.unique(pair_hash(before, after), return_inverse=True)
        pair = self._find("pair", "pair-count", keys, 0)[place].astype(float)
        at = np.empty(len(after), np.int64)
        at[1:] = which[:-2]
        first = np.ones(len(after), bool)
        first[1:] = owner[1:] != owner[:-1]
        at[first] = which[-1]
        follow = counts[:, 2:5]
        mass = follow @ self._pair_discount[1:]
        total = np.where(words == BEGIN, 0, counts[:, 0])
        total[which[-1]] = self._begins()
        context = total[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            top = np.maximum(pair - self._pair_discount[np.minimum(pair, 3).astype(int)], 0) / context
            p = np.where(context > 0, top + mass[at] / context * single[which[:-1]], single[which[:-1]])
        n_tokens = count_by(owner, n)
        return {
            "n_tokens": n_tokens,
            "n_known": count_by(owner[c > 0], n),
            "base_score": np.bincount(owner, weights=base, minlength=n),
            "score": np.bincount(owner, weights=np.log10(p), minlength=n),
        }

    def _begins(self) -> float:
        """Texts counted: each has one end."""
        return float(self._find("word", "word-counts", np.array([END]), 5)[0, 0])


SCORES = "n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, model: Model, ids: list[str] | None = None, text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``n_tokens``, ``n_known`` (tokens seen in training), ``base_score`` (smoothed
    single-token log10 probability) and ``score``, the model's log10 probability of the text with its end.
    Perplexity is ``10 ** (-score / n_tokens)``. A null or empty text is an end token alone."""
    readers: list[Reader] = []

    def work(t: Texts):
        if not readers:
            readers.append(Reader(model))
        return readers[0].score(t)

    return scan(docs, ids or ["doc_id"], text, SCORES, work)
