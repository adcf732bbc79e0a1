"""Spelling variants: words one edit apart, and the common form that a rare one stands for.

Two words are one inserted, deleted or replaced code point apart only if they share the first half of either
one, or its second half, with the edit in the other. Each case has its own search: match that half exactly,
starting at the word's border, then go on across the other half allowing one error, up to the other
border. The searches run on an FM-index: an interval of suffix ranks of the delimited words is narrowed
symbol by symbol. Both directions of a bidirectional index are kept: one index reads the words forwards and
serves the first half, one reads them backwards and serves the second. Each search starts at a delimiter and
never turns round, so no interval has to be carried over from one direction to the other.

The vocabulary is cut into ranges of its sorted order (for the other direction, of the order of the words
read backwards), each small enough to index in one task. All words that share a half lie in one range or in
a few neighbouring ones, so a word is looked for there only.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm.shared import ship
from pitscore.llm.text import Prefix, Texts, blocks, byte_class, lower_ascii
from pitscore.sources.io import materialize

#: Words of a range, and words searched at a time.
SHARD_WORDS, CHUNK = 1 << 15, 1 << 13
#: Intervals up to this width are read symbol by symbol; wider ones are asked for each symbol there is.
NARROW = 48
#: Code points of a range's borders that are kept to find the ranges of a word.
BORDER = 32
MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: Of the runs of letters, those whose CRC-32 this divides lose a code point, where a table is spoilt on purpose.
SPOIL = 31

_LETTER = byte_class("[A-Za-z]")


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_CRC = _crc_table()


def crc_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each going on from the CRC-32 in ``before``."""
    out = before.astype(np.uint32)
    size = end - start
    for i in np.flatnonzero(size > 64):
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(out[i]))
    order = np.argsort(np.where(size > 64, 0, -size), kind="stable")
    order = order[: np.count_nonzero((size > 0) & (size <= 64))]
    at, left, c = start[order], size[order], ~out[order]
    for k in range(int(left[0]) if len(left) else 0):
        n = np.searchsorted(-left, -k, side="left")  # runs longer than k
        c[:n] = _CRC[(c[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = ~c
    return out


def letter_runs(t: Texts) -> tuple[np.ndarray, ...]:
    """Runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased: bytes, start, end, text, code points."""
    data = lower_ascii(t.data)
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)  # the two bytes of U+00C0 to U+00FF
    trail = np.zeros(len(data), bool)
    trail[1:] = lead[:-1]
    start, end, owner = t.segments(_LETTER[data] | lead | trail)
    trails = np.concatenate([[0], np.cumsum(trail)])
    return data, start, end, owner, end - start - (trails[end] - trails[start])


def word_counts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, spoil: int | None = None,
) -> DataFrame:
    """``word, n``: the lower-cased runs of letters of all texts, with at least ``min_length`` code points and
    ``min_count`` occurrences.

    With ``spoil``, a run loses a code point if that number divides the CRC-32 h of ``<doc_id>:<run>``: the
    one at h modulo its length. Runs of documents without an id are left as they are. Null and empty texts
    have no words; repeated rows count again; an empty table gives none. Within a block of texts words are
    told apart by 64-bit hashes.
    """
    ship(docs.sparkSession)

    def count(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            states = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            known = np.array([i is not None for i in ids], bool)
            for t in blocks(batch.column(1)):
                data, start, end, owner, size = letter_runs(t)
                long = size >= min_length
                start, end, owner, size = start[long], end[long], owner[long] + t.first, size[long]
                words, counts = [], []
                if spoil:
                    h = crc_of(data, start, end, states[owner])
                    cut = (h % np.uint32(spoil) == 0) & known[owner]
                    for a, b, k in zip(start[cut].tolist(), end[cut].tolist(), (h[cut] % size[cut]).tolist(), strict=True):
                        run = data[a:b].tobytes().decode()
                        if len(run) > min_length:
                            words.append(run[:k] + run[k + 1 :])
                            counts.append(1)
                    start, end = start[~cut], end[~cut]
                _, first, n = np.unique(Prefix(data).ranges(start, end), return_index=True, return_counts=True)
                raw = data.tobytes()
                words += [raw[a:b].decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([*counts, *n.tolist()], pa.int64())], ["word", "n"])

    rows = docs.select(F.col(doc_id).cast("string"), text).mapInArrow(count, "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Index:
    """FM-index of delimited words, read from their last code point to their first.

    Each word ends with a delimiter, the smallest symbol; suffixes are compared up to it and then by the
    order of the words. ``step`` narrows intervals of suffix ranks by one symbol to the left.
    """

    def __init__(self, words: list[str]):
        points = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        self.symbols = np.unique(points)
        code = np.searchsorted(self.symbols, points)
        self.n, self.words = len(code), len(words)
        order = self._suffixes(code)
        self.bwt = code[order - 1]  # the last symbol of all stands before the first word: a delimiter too
        by_symbol = np.argsort(self.bwt, kind="stable")
        self._places = self.bwt[by_symbol] * (self.n + 1) + by_symbol
        number = np.cumsum(code == 0) - (code == 0)
        self._word_at = number[order[self.bwt == 0]]

    @staticmethod
    def _suffixes(code: np.ndarray) -> np.ndarray:
        n = len(code)
        bits = max(1, int(code.max()).bit_length())
        width = 62 // bits
        left = np.flatnonzero(code == 0)[np.cumsum(code == 0) - (code == 0)] - np.arange(n)  # to the delimiter
        key = code.astype(np.int64)
        for k in range(1, min(width, n)):
            after = np.zeros(n, np.int64)
            after[: n - k] = code[k:]
            key = (key << bits) | np.where(left >= k, after, 0)
        order = np.argsort(key, kind="stable")
        longest = int(left.max())
        while True:
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) + 1
            if width > longest:
                return order
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:]
            key = rank * (n + 2) + np.where(left >= width, after, 0)
            order = np.argsort(key, kind="stable")
            width *= 2

    def encode(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; one past the last for those that no word has."""
        at = np.minimum(np.searchsorted(self.symbols, points), len(self.symbols) - 1)
        return np.where(self.symbols[at] == points, at, len(self.symbols))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * (self.n + 1)
        return np.searchsorted(self._places, base + low), np.searchsorted(self._places, base + high)

    def word(self, low: np.ndarray) -> np.ndarray:
        """Numbers of words from the rank that a whole word, delimiters included, is narrowed to."""
        return self._word_at[low]

    def branches(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Every symbol that stands before the suffixes of each interval: interval, symbol, new interval."""
        width = high - low
        narrow = np.flatnonzero(width <= NARROW)
        owner = np.repeat(narrow, width[narrow])
        ranks = np.arange(len(owner)) - np.repeat(np.cumsum(width[narrow]) - width[narrow], width[narrow]) + low[owner]
        pair = np.unique(owner * len(self.symbols) + self.bwt[ranks])
        owner, symbol = pair // len(self.symbols), pair % len(self.symbols)
        wide = np.flatnonzero(width > NARROW)
        owner = np.concatenate([owner, np.repeat(wide, len(self.symbols))])
        symbol = np.concatenate([symbol, np.tile(np.arange(len(self.symbols)), len(wide))])
        owner, symbol = owner[symbol > 0], symbol[symbol > 0]
        a, b = self.step(symbol, low[owner], high[owner])
        some = a < b
        return owner[some], symbol[some], a[some], b[some]


def one_error(index: Index, queries: list[str], split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (number of the query, number of the indexed word) that are one edit apart, the edit lying at or
    after the code point ``split`` of the query; each pair once. ``index`` holds the words backwards."""
    size = np.fromiter(map(len, queries), np.int64, len(queries))
    points = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32)
    code, base = np.append(index.encode(points), 0), np.cumsum(size) - size
    q = np.arange(len(queries))
    low, high = np.zeros(len(q), np.int64), np.full(len(q), index.words, np.int64)
    at = np.zeros(len(q), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def exact(q, at, low, high):
        """Follows states that have had their error to the end."""
        while len(q):
            ended = at == size[q]
            a, b = index.step(np.where(ended, 0, code[base[q] + at]), low, high)
            full = ended & (a < b)
            # the delimiter's ranks come first, so the new rank counts whole words
            found.append((q[full], index.word(a[full])))
            go = ~ended & (a < b)
            q, at, low, high = q[go], at[go] + 1, a[go], b[go]

    while len(q):
        free = at >= split[q]
        fq, fat, flow, fhigh = q[free], at[free], low[free], high[free]
        inside = fat < size[fq]
        here = np.where(inside, code[base[fq] + fat], -1)
        # leave out the query's code point; of equal neighbours only the last
        drop = inside & ~((fat + 1 < size[fq]) & (here == code[np.minimum(base[fq] + fat + 1, len(code) - 1)]))
        exact(fq[drop], fat[drop] + 1, flow[drop], fhigh[drop])
        owner, symbol, a, b = index.branches(flow, fhigh)
        other = symbol != here[owner]  # putting in the same one is putting it in later
        owner, a, b = owner[other], a[other], b[other]
        exact(fq[owner], fat[owner], a, b)
        swap = inside[owner]
        exact(fq[owner[swap]], fat[owner[swap]] + 1, a[swap], b[swap])
        go = at < size[q]
        q, at, low, high = q[go], at[go], low[go], high[go]
        low, high = index.step(code[base[q] + at], low, high)
        go = low < high
        q, at, low, high = q[go], at[go] + 1, low[go], high[go]
    return tuple(np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else ((), ())))


def _directed(words: DataFrame, shards: int, backwards: bool) -> DataFrame:
    """``word, near, n``: near words whose difference lies in the second half, or (backwards) only in the first."""
    key = F.reverse("word") if backwards else F.col("word")
    ranged = words.select(key.alias("key"), "n").repartitionByRange(shards, "key").withColumn("shard", F.spark_partition_id())
    ranged = materialize(ranged)
    short = [F.substring(f("key"), 1, BORDER).alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    borders = sorted(ranged.groupBy("shard").agg(*short).collect(), key=lambda r: r.shard)
    numbers, lows, highs = ([r[k] for r in borders] for k in ("shard", "low", "high"))
    highs = [h + chr(0x10FFFF) if len(h) == BORDER else h for h in highs]

    def route(batches):
        for batch in batches:
            out = ([], [], [])
            for word in batch.column(0).to_pylist():
                split = len(word) - len(word) // 2 if backwards else len(word) // 2
                half = word[:split]
                first = bisect_left(highs, half[:BORDER])
                for k in range(first, bisect_right(lows, half[:BORDER] + chr(0x10FFFF))):
                    for column, value in zip(out, (numbers[k], word, split), strict=True):
                        column.append(value)
            kinds = (pa.int32(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["shard", "key", "value"])

    def search(batches):
        shard, index, held = None, None, ([], [])
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(4)]
            edges = [0, *(i for i in range(1, batch.num_rows) if (columns[0][i], columns[1][i]) != (columns[0][i - 1], columns[1][i - 1])), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if columns[0][a] != shard:
                    shard, index, held = columns[0][a], None, ([], [])
                keys, values = columns[2][a:b], columns[3][a:b]
                if columns[1][a] == 0:
                    held[0].extend(keys)
                    held[1].extend(values)
                    continue
                if index is None:
                    index = Index([w[::-1] for w in held[0]])
                    names, counts = pa.array(held[0], pa.string()), pa.array(held[1], pa.int64())
                for c in range(0, len(keys), CHUNK):
                    own, split = keys[c : c + CHUNK], np.array(values[c : c + CHUNK], np.int64)
                    x, y = one_error(index, own, split)
                    if backwards:  # what also shares the other half is found forwards
                        new = [not held[0][j].endswith(own[i][split[i] :]) for i, j in zip(x.tolist(), y.tolist(), strict=True)]
                        x, y = x[new], y[new]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()).take(pa.array(x)), names.take(pa.array(y)), counts.take(pa.array(y))], ["word", "near", "n"])

    asked = ranged.select("key").mapInArrow(route, "shard int, key string, value bigint")
    rows = ranged.select("shard", F.lit(0).alias("asks"), "key", F.col("n").alias("value")).unionByName(
        asked.select("shard", F.lit(1).alias("asks"), "key", "value")
    )
    rows = rows.repartitionById(max(numbers, default=0) + 1, F.col("shard")).sortWithinPartitions("shard", "asks", "key")
    pairs = rows.mapInArrow(search, "word string, near string, n bigint")
    return pairs.select(F.reverse("word").alias("word"), F.reverse("near").alias("near"), "n") if backwards else pairs


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, near, n``: every ordered pair of words of a table (``word``, distinct and not empty; ``n``) that differ
    by exactly one inserted, deleted or replaced code point, with the second one's ``n``. Each pair comes
    once per order. An empty table gives no pairs.

    Exact for every word: no word or half is left out for being frequent. A task indexes about ``shard_words``
    words, some tens of bytes for each of their code points, and searches its words a few thousand at a time.
    """
    ship(words.sparkSession)
    words = materialize(words.select("word", "n"))
    shards = -(-max(words.count(), 1) // shard_words)
    return _directed(words, shards, False).unionByName(_directed(words, shards, True))


def variants(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per word of a table (``word``, ``n``): ``form``, its near word of largest n (ties: the smallest in
    code-point order) if that is at least ``ratio`` times its own, else null; ``root``, the end of the way
    from form to form; ``n``, ``n_near`` and ``form_n``.

    Counts grow by ``ratio`` from form to form, so ways are short; they are followed by doubling.
    """
    if ratio < 2:
        raise ValueError("ratio must be two or more, else forms can go in circles")
    words = materialize(words.select("word", "n"))
    near = near_words(words, shard_words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("m"), "near")).alias("best")
    )
    close = F.coalesce(-F.col("best.m") >= F.col("n") * ratio, F.lit(False))
    found = materialize(words.join(near, "word", "left").select(
        "word", F.when(close, F.col("best.near")).alias("form"), "n",
        F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(close, -F.col("best.m")).alias("form_n"),
    ))
    most = found.agg(F.max("n")).first()[0] or 1
    hops = 0
    while ratio**hops < most:
        hops += 1
    ways = found.where("form is not null").select("word", F.col("form").alias("root"))
    reached = 1
    while reached < hops:
        ways = materialize(ways)
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ways = ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        reached *= 2
    return found.join(ways, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
