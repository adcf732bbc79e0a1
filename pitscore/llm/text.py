"""Vectorised byte-level text work shared by the operators that run numpy inside Spark tasks.

A batch of texts is one byte buffer with offsets (Arrow's own layout), so no Python string is made.
Words, lines and windows get 64-bit hashes from prefix sums of a polynomial hash. Work goes on in
blocks of texts of bounded size; a text larger than a block is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pitscore.llm.shared import ship

BLOCK_BYTES = 1 << 19
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, seed: int) -> np.ndarray:
    start = np.uint64((seed * 0xD1342543DE82EF95 + 1) & _MASK)
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_BASE) + start)


_BYTE = seeds(256, 1)
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    global _powers, _inverses
    if len(_powers) <= n:
        size = max(n + 1, BLOCK_BYTES + 1)
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = np.uint64(_INVERSE)
        _inverses = np.cumprod(steps)
    return _powers, _inverses


class Prefix:
    """Hash of any byte range of a buffer in constant time."""

    def __init__(self, data: np.ndarray):
        powers, self._inverse = _tables(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers[: len(data)], out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def byte_class(pattern: str) -> np.ndarray:
    """Lookup table of the bytes below 128 that match a one-character pattern; others are False."""
    import re

    table = np.zeros(256, bool)
    table[:128] = [bool(re.fullmatch(pattern, chr(i), re.DOTALL)) for i in range(128)]
    return table


#: Words are runs of ``[^\x20\x09-\x0D]``.
SPACE = byte_class(r"[\x20\x09-\x0D]")
WORD = ~SPACE
#: Words are runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` (after lower-casing).
ALNUM = ~byte_class(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


class Texts:
    """Some whole texts: ``data`` holds their bytes, text i lies in ``bounds[i]:bounds[i + 1]``;
    ``first`` is the row of the batch that text 0 comes from."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int = 0):
        self.data, self.bounds, self.first = data, bounds, first

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def segments(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of ``inside`` bytes that stay within a text: start, end, text index."""
        n = len(self.data)
        if n == 0:
            empty = np.zeros(0, np.int64)
            return empty, empty, empty
        border = np.zeros(n + 1, bool)
        border[self.bounds] = True
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | border[1:n]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | border[1:n]
        start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        return start, end, np.searchsorted(self.bounds, start, side="right") - 1

    def words(self, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.segments(table[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines cut at each newline, empty ones too: start, end, text index."""
        cuts = np.flatnonzero(self.data == 10)
        owner = np.searchsorted(self.bounds, cuts, side="right") - 1
        start = np.concatenate([self.bounds[:-1], cuts + 1])
        end = np.concatenate([cuts, self.bounds[1:]])
        text_of_start = np.concatenate([np.arange(len(self)), owner])
        text_of_end = np.concatenate([owner, np.arange(len(self))])
        by_start = np.lexsort((start, text_of_start))
        by_end = np.lexsort((end, text_of_end))
        return start[by_start], end[by_end], text_of_start[by_start]


def count_by(index: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(index, weights=weights, minlength=n)
    return out if weights is None else out.astype(np.int64)


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words of one text, and the index of its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    rolled = mix(hashes + np.uint64(width))
    out = rolled[:n]
    for k in range(1, width):
        out = mix(out * np.uint64(_BASE) + rolled[k : n + k])
    return out[first], first


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is an empty text."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Texts]:
    """The texts of a column, in order, in blocks of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, at = buffers(column)
    first = 0
    while first < len(at) - 1:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(at) - 1)
        yield Texts(data[at[first] : at[last]], at[first : last + 1] - at[first], first)
        first = last


def scan(df, ids: list[str], text: str, schema: str, work):
    """One row per row of ``df``: its ``ids`` columns and what ``work(texts)`` returns for its text.

    ``work`` maps :class:`Texts` to a dict of arrays, one value per text. Only ``ids`` and ``text`` are
    read, so other columns of ``df`` may have any name.
    """
    names = [part.split()[0] for part in _split_schema(schema)]

    def run(batches):
        for batch in batches:
            parts = [work(t) for t in blocks(batch.column(len(ids)))]
            if parts:
                made = [pa.concat_arrays([_array(p[n]) for p in parts]) for n in names]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(ids)], *made], [*ids, *names])

    kinds = dict(df.select(*ids).dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in ids)
    ship(df.sparkSession)
    return df.select(*ids, text).mapInArrow(run, f"{head}, {schema}" if ids else schema)


def _array(x):
    return x if isinstance(x, pa.Array) else pa.array(x)


def _split_schema(schema: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(current.strip())
            current = ""
        else:
            current += c
    return [*parts, current.strip()]


def keep_texts(df, text: str, wanted):
    """The rows of ``df``, all columns as they are, for whose text ``wanted(texts)`` gives True."""
    place = df.columns.index(text)

    def run(batches):
        for batch in batches:
            parts = [np.asarray(wanted(t), bool) for t in blocks(batch.column(place))]
            if parts:
                yield batch.filter(pa.array(np.concatenate(parts)))

    ship(df.sparkSession)
    return df.mapInArrow(run, df.schema)
