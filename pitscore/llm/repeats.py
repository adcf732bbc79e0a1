"""Exact removal of repeated byte strings, by blockwise sorting of suffixes with a difference cover.

Only the first ``LENGTH`` bytes of a suffix matter, so two suffixes are equal here when these bytes are.
The positions of a text whose remainder by ``PERIOD`` lies in ``COVER`` are its cover sample. Any two
positions have a common shift below ``PERIOD`` that brings both into the sample, so two equal strings hold
equal sample blocks of ``LENGTH - PERIOD + 1`` bytes at that shift.

1. Sample blocks are sorted, one bucket of hashes at a time, and ranked as repeated or unique. A suffix
   without a repeated sample block is unique and needs no more work; this leaves a small part of the text.
2. Each repeated sample position is sorted by its block and then by its window, all bytes that a string
   reaching over it may hold. Of equal windows only the first can hold a first occurrence: all strings in
   the others start earlier too.
3. Where one block has several windows, the strings in their first occurrences that are still open are
   sorted, again a bucket at a time. All but the first of equal strings start earlier elsewhere.

Every text is scanned four times and never shuffled. Buckets hold packed arrays; a task has one bucket in
memory, and equal entries are merged before they are sent, so a passage found everywhere sends one entry
per task. Ranks and marks lie as sorted arrays in the shared folder and are mapped by the workers. Blocks
and windows are compared by hashes of 70 bits and more, the strings left open by one of 64 bits, not byte by
byte; suffixes are grouped by these hashes, not sorted, as only their first 100 bytes matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm import packed
from pitscore.llm.shared import load, save, shared_path, ship
from pitscore.llm.text import Prefix, Texts, blocks, mix

LENGTH = 100
#: A perfect difference set: each remainder by 31 but 0 is the difference of exactly one pair.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
BLOCK = LENGTH - PERIOD + 1
REACH = PERIOD - 1
#: Text per bucket, entries a task holds before it sends them, and windows of a block it sends at once.
BUCKET_BYTES, HELD, WINDOWS = 16 << 20, 1 << 21, 8

_IN_COVER = np.isin(np.arange(PERIOD), COVER)


class _Documents:
    """The documents of one task that have entries: id, hash of the text, and their order."""

    def __init__(self):
        self.ids, self.tags = [], []
        self.count = 0

    def add(self, ids: np.ndarray, tags: np.ndarray) -> int:
        self.ids.append(ids)
        self.tags.append(tags)
        self.count += len(ids)
        return self.count - len(ids)

    def arrays(self):
        return np.concatenate(self.ids), np.concatenate(self.tags)


def _key(ids: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return mix(mix(ids.view(np.uint64)) + tags)


def _ranks(ids, tags) -> np.ndarray:
    """Place of each document by id, then hash; equal documents share one."""
    order = np.lexsort((tags, ids))
    new = np.ones(len(ids), bool)
    new[1:] = (np.diff(ids[order]) != 0) | (np.diff(tags[order].view(np.int64)) != 0)
    out = np.empty(len(ids), np.uint64)
    out[order] = np.cumsum(new)
    return out


def _tags(t: Texts, prefix: Prefix) -> np.ndarray:
    return prefix.ranges(t.bounds[:-1], t.bounds[1:])


def _cover(t: Texts):
    """Cover positions with a whole block, of texts that hold a string at all, and the text of each."""
    size = np.diff(t.bounds)
    use = np.where(size >= LENGTH, size - BLOCK + 1, 0)
    n = int(use.sum())
    owner = np.repeat(np.arange(len(t)), use)
    inside = np.arange(n) - np.repeat(np.cumsum(use) - use, use)
    at = _IN_COVER[inside % PERIOD]
    owner, inside = owner[at], inside[at]
    return t.bounds[owner] + inside, owner


def _split(h: np.ndarray, bits: int):
    return h >> np.uint64(64 - bits), ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _cuts(shard: np.ndarray, bits: int):
    """Pieces of an array sorted by shard: shard, from, to."""
    used, first = np.unique(shard, return_index=True)
    return zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(shard)], strict=True)


def _pack_marks(keys: np.ndarray, values: np.ndarray, bits: int):
    """Marks (document key, value) as rows to the shards of the documents, numbered below zero."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order].astype(np.uint32)
    for shard, a, b in _cuts(keys >> np.uint64(64 - bits), bits):
        doc, sizes = np.unique(keys[a:b], return_counts=True)
        yield -1 - shard, packed.pack([doc, sizes.astype(np.uint32), values[a:b]])


def _save_marks(folder: str, name: str, shard: int, blobs: list[bytes]) -> None:
    parts = [packed.unpack(b) for b in blobs]
    keys = np.concatenate([np.repeat(doc, sizes) for doc, sizes, _ in parts])
    values = np.concatenate([v for _, _, v in parts])
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
    keys, values = keys[new], values[new]
    doc, first = np.unique(keys, return_index=True)
    save(f"{folder}/{name}-doc-{shard:06d}.npy", doc)
    save(f"{folder}/{name}-at-{shard:06d}.npy", np.append(first, len(keys)).astype(np.int64))
    save(f"{folder}/{name}-mark-{shard:06d}.npy", values)


def _marks(folder: str, name: str, keys: np.ndarray, bits: int, there: packed.ShardSet):
    """Text index and value of every mark of some texts."""
    order = np.argsort(keys, kind="stable")
    texts, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for shard, a, b in _cuts(keys[order] >> np.uint64(64 - bits), bits):
        if shard not in there:
            continue  # no mark in this shard
        doc = load(f"{folder}/{name}-doc-{shard:06d}.npy")
        own = keys[order[a:b]]
        at = np.minimum(np.searchsorted(doc, own), len(doc) - 1)
        hit = np.flatnonzero(doc[at] == own)
        offsets, marks = load(f"{folder}/{name}-at-{shard:06d}.npy"), load(f"{folder}/{name}-mark-{shard:06d}.npy")
        for i in hit:
            found = marks[offsets[at[i]] : offsets[at[i] + 1]].astype(np.int64)
            texts.append(np.full(len(found), order[a + i]))
            values.append(found)
    return np.concatenate(texts), np.concatenate(values)


def _ranges(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any of some ranges."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(end, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def _rank_blocks(docs: DataFrame, folder: str, bits: int) -> packed.ShardSet:
    """Step 1: sorted hashes of the sample blocks that occur twice or more."""

    def send(batches):
        held, n = [], 0

        def flush():
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            keys = np.repeat(keys, np.minimum(times, 2))
            shard, low = _split(keys, bits)
            out = []
            for s, a, b in _cuts(shard, bits):
                step = np.diff(low[a:b], prepend=np.uint32(0))
                parts = [(step & np.uint32(0xFFFF)).astype(np.uint16), (step >> np.uint32(16)).astype(np.uint16)]
                out.append((s, packed.pack(parts)))
            return packed.rows(*zip(*out, strict=True))

        for batch in batches:
            for t in blocks(batch.column(1)):
                at, _ = _cover(t)
                if len(at):
                    held.append(Prefix(t.data).ranges(at, at + BLOCK))
                    n += len(at)
                if n >= 4 * HELD:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    def rank(batches):
        for shard, blobs in packed.gathered(batches):
            parts = [packed.unpack(b) for b in blobs]
            low = [np.cumsum(a.astype(np.uint32) + (b.astype(np.uint32) << np.uint32(16)), dtype=np.uint32) for a, b in parts]
            low = np.sort(np.concatenate(low))
            again = np.unique(low[1:][low[1:] == low[:-1]])
            if len(again):
                save(f"{folder}/block-{shard:06d}.npy", again)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], ["shard"])

    sent = docs.mapInArrow(send, packed.SCHEMA)
    return packed.ShardSet(packed.to_shards(sent, 1 << bits).mapInArrow(rank, "shard bigint"))


def _repeated(h: np.ndarray, folder: str, bits: int, there: packed.ShardSet) -> np.ndarray:
    order = np.argsort(h)
    shard, low = _split(h[order], bits)
    found = np.zeros(len(h), bool)
    for s, a, b in _cuts(shard, bits):
        if s not in there:
            continue  # none repeated in this shard
        known = load(f"{folder}/block-{s:06d}.npy")
        at = np.minimum(np.searchsorted(known, low[a:b]), len(known) - 1)
        found[order[a:b]] = known[at] == low[a:b]
    return found


def _first_of(keys: list[np.ndarray], rank: np.ndarray, pos: np.ndarray):
    """Order by keys, then document and position; where a new value of each key begins."""
    place = (rank << np.uint64(32)) | pos.astype(np.uint64)
    order = np.lexsort((place, *reversed(keys)))
    new, flags = np.zeros(len(order), bool), []
    if len(order):
        new[0] = True
    for k in keys:
        k = k[order]
        new = new.copy()
        new[1:] |= k[1:] != k[:-1]
        flags.append(new)
    return order, flags


def _sort_windows(docs: DataFrame, folder: str, bits: int, ranked: packed.ShardSet) -> packed.ShardSet:
    """Step 2: marks ``2 * position`` (all strings over this sample position start earlier elsewhere) and
    ``2 * position + 1`` (its strings are still open)."""

    def send(batches):
        documents, held, n = _Documents(), [], 0

        def flush():
            ids, tags = documents.arrays()
            h, w, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, (new_h, new_w) = _first_of([h, w], _ranks(ids, tags)[doc], pos)
            h, w, doc, pos = h[order], w[order], doc[order], pos[order]
            nth = np.cumsum(new_w) - np.cumsum(new_w)[np.maximum.accumulate(np.where(new_h, np.arange(len(h)), 0))]
            go = new_w & (nth < WINDOWS)
            out = list(_pack_marks(_key(ids, tags)[doc[~go]], 2 * pos[~go] + new_w[~go], bits)) if not go.all() else []
            h, w, doc, pos = h[go], w[go], doc[go], pos[go]
            shard, low = _split(h, bits)
            for s, a, b in _cuts(shard, bits):
                by_doc = a + np.lexsort((pos[a:b], doc[a:b]))
                own, which = np.unique(doc[by_doc], return_inverse=True)
                part = w[by_doc]
                parts = [ids[own], tags[own], which.astype(np.uint32), pos[by_doc].astype(np.uint32), low[by_doc]]
                parts += [(part >> np.uint64(32)).astype(np.uint32), (part >> np.uint64(24)).astype(np.uint8)]
                out.append((s, packed.pack(parts)))
            return packed.rows(*zip(*out, strict=True))

        for batch in batches:
            every = np.asarray(batch.column(0))
            for t in blocks(batch.column(1)):
                at, owner = _cover(t)
                if not len(at):
                    continue
                prefix = Prefix(t.data)
                h = prefix.ranges(at, at + BLOCK)
                again = _repeated(h, folder, bits, ranked)
                at, owner, h = at[again], owner[again], h[again]
                if not len(at):
                    continue
                start = np.maximum(at - REACH, t.bounds[owner])
                end = np.minimum(at + LENGTH, t.bounds[owner + 1])
                w = prefix.ranges(start, end) + (at - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                w = mix(w + (end - at).astype(np.uint64))
                own, which = np.unique(owner, return_inverse=True)
                base = documents.add(every[t.first + own], _tags(t, prefix)[own])
                held.append((h, w, which + base, at - t.bounds[owner]))
                n += len(at)
                if n >= HELD:
                    yield flush()
                    documents, held, n = _Documents(), [], 0
        if n:
            yield flush()

    def sort(batches):
        for shard, blobs in packed.gathered(batches):
            if shard < 0:
                yield packed.rows([shard] * len(blobs), blobs)
                continue
            parts = [packed.unpack(b) for b in blobs]
            ids, tags = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
            doc = np.concatenate([p[2].astype(np.int64) + b for p, b in zip(parts, base, strict=True)])
            pos, low, high, rest = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5, 6))
            w = (high.astype(np.uint64) << np.uint64(8)) | rest
            order, (new_h, new_w) = _first_of([low, w], _ranks(ids, tags)[doc], pos)
            group = np.cumsum(new_h) - 1
            several = np.bincount(group, weights=new_w) > 1
            send = ~new_w | several[group]
            at = order[send]
            if len(at):
                out = _pack_marks(_key(ids, tags)[doc[at]], 2 * pos[at].astype(np.int64) + new_w[send], bits)
                yield packed.rows(*zip(*out, strict=True))

    sent = packed.to_shards(docs.mapInArrow(send, packed.SCHEMA), 2 << bits)
    return _write_marks(sent.mapInArrow(sort, packed.SCHEMA), folder, "window", bits)


def _write_marks(df: DataFrame, folder: str, name: str, bits: int) -> packed.ShardSet:
    def write(batches):
        for shard, blobs in packed.gathered(batches):
            _save_marks(folder, name, -1 - shard, blobs)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - shard], pa.int64())], ["shard"])

    return packed.ShardSet(packed.to_shards(df, 1 << bits).mapInArrow(write, "shard bigint"))


def _windows_of(t: Texts, keys: np.ndarray, folder: str, bits: int, there: packed.ShardSet):
    """Byte ranges of the windows whose strings start earlier elsewhere, and of those still open."""
    text, mark = _marks(folder, "window", keys, bits, there)
    low, high = t.bounds[text], t.bounds[text + 1]
    at = low + mark // 2
    start, end = np.maximum(at - REACH, low), np.minimum(at + LENGTH, high)
    open_ = (mark & 1).astype(bool)
    return start[~open_], end[~open_], start[open_], end[open_]


def _sort_strings(docs: DataFrame, folder: str, bits: int, windows: packed.ShardSet) -> packed.ShardSet:
    """Step 3: marks the starts of open strings that start earlier elsewhere."""

    def send(batches):
        documents, held, n = _Documents(), [], 0

        def flush():
            ids, tags = documents.arrays()
            h, doc, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            order, (new,) = _first_of([h], _ranks(ids, tags)[doc], pos)
            late = order[~new]
            out = list(_pack_marks(_key(ids, tags)[doc[late]], pos[late], bits)) if len(late) else []
            h, doc, pos = h[order[new]], doc[order[new]], pos[order[new]]
            for s, a, b in _cuts(h >> np.uint64(64 - bits), bits):
                by_doc = a + np.lexsort((pos[a:b], doc[a:b]))
                own, which = np.unique(doc[by_doc], return_inverse=True)
                parts = [ids[own], tags[own], which.astype(np.uint32), pos[by_doc].astype(np.uint32), h[by_doc]]
                out.append((s, packed.pack(parts)))
            return packed.rows(*zip(*out, strict=True))

        for batch in batches:
            every = np.asarray(batch.column(0))
            for t in blocks(batch.column(1)):
                if not (np.diff(t.bounds) >= LENGTH).any():
                    continue
                prefix = Prefix(t.data)
                tags = _tags(t, prefix)
                keys = _key(every[t.first : t.first + len(t)], tags)
                done_a, done_b, open_a, open_b = _windows_of(t, keys, folder, bits, windows)
                last = LENGTH - 1  # a range of bytes holds the starts up to its end less this
                start = np.flatnonzero(
                    _ranges(len(t.data), open_a, open_b - last) & ~_ranges(len(t.data), done_a, done_b - last)
                )
                if not len(start):
                    continue
                owner = np.searchsorted(t.bounds, start, side="right") - 1
                own, which = np.unique(owner, return_inverse=True)
                base = documents.add(every[t.first + own], tags[own])
                held.append((prefix.ranges(start, start + LENGTH), which + base, start - t.bounds[owner]))
                n += len(start)
                if n >= HELD:
                    yield flush()
                    documents, held, n = _Documents(), [], 0
        if n:
            yield flush()

    def sort(batches):
        for shard, blobs in packed.gathered(batches):
            if shard < 0:
                yield packed.rows([shard] * len(blobs), blobs)
                continue
            parts = [packed.unpack(b) for b in blobs]
            ids, tags, pos, h = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 3, 4))
            base = np.cumsum([0, *(len(p[0]) for p in parts[:-1])])
            doc = np.concatenate([p[2].astype(np.int64) + b for p, b in zip(parts, base, strict=True)])
            order, (new,) = _first_of([h], _ranks(ids, tags)[doc], pos)
            late = order[~new]
            if len(late):
                out = _pack_marks(_key(ids, tags)[doc[late]], pos[late].astype(np.int64), bits)
                yield packed.rows(*zip(*out, strict=True))

    sent = packed.to_shards(docs.mapInArrow(send, packed.SCHEMA), 2 << bits)
    return _write_marks(sent.mapInArrow(sort, packed.SCHEMA), folder, "start", bits)


RESULT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_kept: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Per row of ``docs`` (``doc_id`` integer, ``text``): ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs), ``kept_sha256`` and, if wanted, the ``kept`` bytes, without every byte covered by a
    100-byte string that also starts earlier, in a document of smaller id or before in the same one.

    Strings are judged on the input. Texts are UTF-8 bytes; a cut may fall inside a character. A null text
    is empty; texts under 100 bytes are kept whole. Rows repeated with id and text are one document and get
    equal rows; of different texts under one id the order is that of their hashes. A null id comes before
    all others. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_path(spark, "repeats")
    order_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    source = docs.select(order_id.alias("id"), F.col("text").alias("text"))
    size = source.agg(F.coalesce(F.sum(F.octet_length("text").cast("bigint")), F.lit(0))).first()[0]
    bits = max(3, (max(1, size // bucket_bytes)).bit_length())
    ranked = _rank_blocks(source, folder, bits)
    windows = _sort_windows(source, folder, bits, ranked)
    starts = _sort_strings(source, folder, bits, windows)
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            every = np.asarray(batch.column(1))
            out = {name: [] for name in names}
            for t in blocks(batch.column(2)):
                keys = _key(every[t.first : t.first + len(t)], _tags(t, Prefix(t.data)))
                start, end, _, _ = _windows_of(t, keys, folder, bits, windows)
                text, at = _marks(folder, "start", keys, bits, starts)
                at = t.bounds[text] + at
                gone = _ranges(len(t.data), np.concatenate([start, at]), np.concatenate([end, at + LENGTH]))
                running = np.concatenate([[0], np.cumsum(gone)])
                owner = Texts(t.data, t.bounds).segments(gone)[2]
                out["n_bytes"] += np.diff(t.bounds).tolist()
                out["n_removed"] += (running[t.bounds[1:]] - running[t.bounds[:-1]]).tolist()
                out["n_spans"] += np.bincount(owner, minlength=len(t)).tolist()
                for i in range(len(t)):
                    a, b = t.bounds[i], t.bounds[i + 1]
                    kept = t.data[a:b][~gone[a:b]].tobytes()
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if with_kept:
                        out["kept"].append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[c]) for c in names)], ["doc_id", *names])

    rows = docs.select("doc_id", order_id.alias("id"), F.col("text").alias("text"))
    schema = f"doc_id {kind}, {RESULT}" + ", kept binary" * with_kept
    return rows.mapInArrow(cut, schema)

