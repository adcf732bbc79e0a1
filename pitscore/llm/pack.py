"""Harmonic packing of tokenized documents into fixed-length training sequences.

A document's tokens are cut into full sequences and, for the rest, parts of halving sizes, so that most
parts are an exact fraction 1/k of the capacity. Class k takes the lengths in (capacity/(k+1),
capacity/k] and fills each of its bins with exactly k parts. Every task packs its own rows, so there is
no shuffle; what its classes leave open at the end is laid end to end, and the last stretch is cut at
powers of two, which need no padding.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pitscore.llm.shared import ship
from pitscore.llm.text import Prefix, Texts, blocks, byte_class, lower_ascii
from pitscore.llm.wordcache import Store, WordNumbers

CAPACITY = 2048
#: The rest of a document is cut down to parts of this size; what is smaller stays in one part.
GRAIN = 64
END_ID = 1
CACHED_WORDS = 1 << 18
#: Words that go to the tokenizer in one string.
LINE_WORDS = 200


_LETTER = byte_class("[A-Za-z0-9]")
_STOP = byte_class(r"[.,;:!?#$%&*]")
_coders: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Token ids of whole texts, for tokenizers that drop white space and never join across it.

    Each distinct word is tokenized once per worker and kept; the ids of a text are put together from
    those of its words.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        special = self._tokenizer.get_added_tokens_decoder()
        self._special = [x.content for x in special.values()]
        self._mark = next((x.content, i) for i, x in sorted(special.items()))
        self._alone = list(self._special)
        control = self._ids_of(["\x01"])[0]
        if len(control) == 1:  # set apart by spaces it costs the tokenizer less than a special token
            self._mark = (" \x01 ", control[0])
            self._alone.append("\x01")
        self._clear()

    def _clear(self):
        self._numbers = WordNumbers()
        self._start, self._ids = Store(np.int64), Store(np.uint32)
        self._start.add(np.zeros(1, np.int64))

    def _learn(self, hashes: np.ndarray, words: list[str], special: bool) -> None:
        """Adds words. They are tokenized many at a time, set apart by a mark; where the texts hold marks or
        special tokens, words with one in them go alone."""
        mark, mark_id = self._mark
        alone = {i for i, w in enumerate(words) if any(s in w for s in self._alone)} if special else ()
        if alone:
            order = [i for i in range(len(words)) if i not in alone]
            self._learn(hashes[order], [words[i] for i in order], False)
            order = sorted(alone)
            hashes, lines = hashes[order], self._ids_of([words[i] for i in order])
            sizes, ids = np.array([len(x) for x in lines]), np.array([i for x in lines for i in x], np.uint32)
        else:
            lines = self._ids_of([mark.join(words[i : i + LINE_WORDS]) for i in range(0, len(words), LINE_WORDS)])
            total = sum(map(len, lines)) + len(lines)
            ids = np.fromiter(chain.from_iterable(chain((mark_id,), x) for x in lines), np.uint32, total)
            marks = np.flatnonzero(ids == mark_id)
            sizes, ids = np.diff(np.append(marks, total)) - 1, np.delete(ids, marks)
        self._start.add(self._start.values[-1] + np.cumsum(sizes))
        self._ids.add(ids)
        self._numbers.add(hashes)

    def _ids_of(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, t: Texts):
        """Words, also cut between a letter or digit and a following stop, where the tokenizer always cuts;
        A-Z lower-cased as the tokenizer does, unless the texts hold a special token's opening."""
        data, raw = t.data, t.data.tobytes()
        if not any(s[:2].encode() in raw for s in self._special):
            data = lower_ascii(data)
        start, end, owner = t.words()
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = _LETTER[data[:-1]] & _STOP[data[1:]]
        cuts = np.flatnonzero(cut)
        where = np.searchsorted(start, cuts, side="right") - 1
        order = np.argsort(np.concatenate([start, cuts]), kind="stable")
        begins = np.concatenate([start, cuts])[order]
        owners = np.concatenate([owner, owner[where]])[order]
        ends = np.sort(np.concatenate([end, cuts]))
        return data, begins, ends, owners

    def encode(self, t: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each closed by ``end_id``, and their bounds."""
        data, start, end, owner = self._pieces(t)
        hashes = Prefix(data).ranges(start, end)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if self._numbers.n > CACHED_WORDS:
            self._clear()
        number = self._numbers.find(unique)
        new = number < 0
        if new.any():
            raw = data.tobytes()
            spots = first[new]
            words = [raw[a:b].decode() for a, b in zip(start[spots].tolist(), end[spots].tolist(), strict=True)]
            self._learn(unique[new], words, any(s.encode() in raw for s in self._alone))
            number = self._numbers.find(unique)
        number, starts = number[which], self._start.values
        sizes = starts[number + 1] - starts[number]
        per_text = np.bincount(owner, weights=sizes, minlength=len(t)).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(per_text)])
        out = np.full(bounds[-1], end_id, np.uint32)
        begins = np.cumsum(sizes) - sizes
        inside = np.arange(sizes.sum()) - np.repeat(begins, sizes)
        out[np.repeat(begins + owner, sizes) + inside] = self._ids.values[np.repeat(starts[number], sizes) + inside]
        return out, bounds


def parts(n: int, capacity: int, grain: int):
    """Lengths that a document of n tokens is cut into: full sequences, halving sizes, a rest."""
    for _ in range(n // capacity):
        yield capacity
    rest, size = n % capacity, capacity // 2
    while rest and size >= grain:
        if rest >= size:
            yield size
            rest -= size
        size //= 2
    if rest:
        yield rest


class _Bins:
    """The open bins of one task; closed ones turn into rows."""

    def __init__(self, base: int, capacity: int, with_ids: bool):
        self.open, self.rows, self.next = defaultdict(list), [], base
        self.capacity, self.with_ids = capacity, with_ids

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        k = self.capacity // len(ids)
        bin_ = self.open[k]
        bin_.append((doc, start, ids, total))
        if len(bin_) == k:
            self._close(self.open.pop(k))

    def _close(self, pieces) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            raw = ids.astype("<u4").tobytes()
            row = (doc, start, len(ids), zlib.crc32(raw), total, self.next, offset)
            self.rows.append((*row, raw) if self.with_ids else row)
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Lays the parts of all open bins end to end and cuts sequences from them."""
        left = [p for k in sorted(self.open) for p in self.open[k]]
        self.open.clear()
        room = sum(len(p[2]) for p in left)
        while left:
            size = self.capacity if room >= self.capacity else 1 << (room.bit_length() - 1)
            taken, room, need = [], room - size, size
            while need:
                doc, start, ids, total = left.pop(0)
                if len(ids) > need:
                    left.insert(0, (doc, start + need, ids[need:], total))
                    ids = ids[:need]
                taken.append((doc, start, ids, total))
                need -= len(ids)
            self._close(taken)


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    grain: int = GRAIN, end_id: int = END_ID, with_ids: bool = True,
) -> DataFrame:
    """One row per part of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``
    and, if wanted, its ``ids`` (little-endian unsigned 32-bit).

    ``tokenizer`` is the path, on every worker, of a ``tokenizers`` file that drops white space. A document
    is its text's ids and then ``end_id``; a null or empty text is that one id. A text of any length is cut
    as often as needed and loses no id. Rows are packed as they come, repeated ids as documents of their
    own, and an empty table gives no rows. Only ``doc_id`` and ``text`` are read. ``sequence_id`` holds the
    task's number in its upper bits. A task holds at most ``capacity`` tokens of open parts per class.
    """
    if capacity & (capacity - 1) or not 0 < grain <= capacity:
        raise ValueError("capacity must be a power of two and grain at most as large")
    ship(docs.sparkSession)
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches):
        if tokenizer not in _coders:  # a worker serves many tasks
            _coders[tokenizer] = WordTokenizer(tokenizer)
        coder = _coders[tokenizer]
        bins = _Bins(TaskContext.get().partitionId() << 40, capacity, with_ids)

        def rows(kind):
            made, bins.rows = bins.rows, []
            columns = list(zip(*made, strict=True)) or [[]] * (len(names) + 1)
            types = [kind] + [pa.int64()] * 6 + [pa.binary()] * with_ids
            arrays = [pa.array(c, k) for c, k in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [doc_id, *names])

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            keys, at = batch.column(0).to_pylist(), 0
            for t in blocks(batch.column(1)):
                ids, bounds = coder.encode(t, end_id)
                bounds = bounds.tolist()
                for i in range(len(t)):
                    total, start = bounds[i + 1] - bounds[i], 0
                    for n in parts(total, capacity, grain):
                        lo = bounds[i] + start
                        bins.add(keys[at], start, ids[lo : lo + n].copy(), total)
                        start += n
                    at += 1
            yield rows(kind)
        bins.finish()
        if bins.rows:
            yield rows(kind)

    type_of = dict(docs.select(doc_id).dtypes)[doc_id]
    schema = f"`{doc_id}` {type_of}, " + ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)
    return docs.select(doc_id, text).mapInArrow(run, schema)
