"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over all texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm.shared import ship
from pitscore.llm.text import ALNUM, Prefix, Texts, blocks, count_by, lower_ascii, scan, windows
from pitscore.sources.io import materialize

WINDOW = 10
#: Benchmark text held by one hash set, which takes about four times as much; a larger benchmark is scanned
#: in several passes.
SET_BYTES = 16 << 20
_FILTER_BITS = 22


class WindowSet:
    """Distinct windows of some benchmark items, as sorted hashes per width with the words to verify.

    A word is kept once, by its bytes; a window by its hash and the number of its first word, from which its
    item follows. Only windows of several items have a list of the others.
    """

    def __init__(self, items: list[str], texts: list[str | None], width: int = WINDOW):
        self.items = np.array(items, object)
        data, words, owners, rows, base, seen_words = [], [], [], {}, 0, 0
        for t in blocks(pa.array(texts, pa.large_string())):
            low = lower_ascii(t.data)
            start, end, owner = Texts(low, t.bounds).words(ALNUM)
            hashes = Prefix(low).ranges(start, end)
            n = count_by(owner, len(t))
            for w in np.unique(np.minimum(n[n > 0], width)):
                at = np.flatnonzero((n[owner] >= width) if w == width else (n[owner] == w))
                found, first = windows(hashes[at], owner[at], int(w))
                rows.setdefault(int(w), []).append((found, (at[first] + seen_words).astype(np.uint32)))
            data.append(low)
            words.append(np.stack([start + base, end + base]).astype(np.uint32))
            owners.append((owner + t.first).astype(np.int64))
            base, seen_words = base + len(low), seen_words + len(start)
        self.data = np.concatenate(data) if data else np.zeros(0, np.uint8)
        self.start, self.end = np.concatenate(words, axis=1) if words else np.zeros((2, 0), np.uint32)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        self._first_word = np.searchsorted(owner, np.arange(len(items) + 1)).astype(np.uint32)
        self.widths = {}
        for w, parts in sorted(rows.items()):
            found, first = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((first, found))
            found, first = found[order], first[order]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            keys, kept = found[new], first[new]
            which = (np.cumsum(new) - 1)[~new]
            more = np.unique(np.stack([which, self._item_of(first[~new])]), axis=1)
            more = more[:, more[1] != self._item_of(kept[more[0]])]
            filled = np.zeros(1 << _FILTER_BITS >> 3, np.uint8)
            spot = np.unique(keys >> np.uint64(64 - _FILTER_BITS))
            np.bitwise_or.at(filled, spot >> np.uint64(3), np.uint8(1) << (spot & np.uint64(7)).astype(np.uint8))
            self.widths[w] = (keys, kept, more, filled)

    @property
    def nbytes(self) -> int:
        """Bytes of all arrays."""
        own = [self.data, self.start, self.end, self._first_word]
        return sum(x.nbytes for x in own) + sum(x.nbytes for parts in self.widths.values() for x in parts)

    def _item_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self._first_word, word, side="right") - 1

    def members(self, w: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of some windows: index into ``places``, item."""
        _, kept, more, _ = self.widths[w]
        low, high = (np.searchsorted(more[0], places, side=side) for side in ("left", "right"))
        n = high - low
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        index = np.concatenate([np.arange(len(places)), np.repeat(np.arange(len(places)), n)])
        return index, np.concatenate([self._item_of(kept[places]), more[1][np.repeat(low, n) + inside]])

    def hits(self, low: np.ndarray, start, end, owner, hashes):
        """Verified occurrences in some texts: yields width, first word and window number."""
        for w, (keys, kept, _, filled) in self.widths.items():
            found, first = windows(hashes, owner, w)
            spot = found >> np.uint64(64 - _FILTER_BITS)
            at = np.flatnonzero(filled[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1)
            place = np.minimum(np.searchsorted(keys, found[at]), len(keys) - 1)
            same = keys[place] == found[at]
            first, place = first[at[same]], place[same]
            words = first[:, None] + np.arange(w)
            its = kept[place].astype(np.int64)[:, None] + np.arange(w)
            true = _same_words(low, start[words], end[words], self.data, self.start[its].astype(np.int64), self.end[its].astype(np.int64))
            yield w, first[true], place[true]


def _same_words(a, a_start, a_end, b, b_start, b_end, limit: int = 1 << 20) -> np.ndarray:
    """Whether each row of words of ``a`` equals, byte for byte, that of ``b``."""
    size = a_end - a_start
    same = (size == b_end - b_start).all(axis=1)
    rows = np.flatnonzero(same)
    for cut in np.array_split(rows, max(1, int(size[rows].sum()) // limit)) if len(rows) else []:
        n = size[cut].ravel()
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        unlike = a[np.repeat(a_start[cut].ravel(), n) + inside] != b[np.repeat(b_start[cut].ravel(), n) + inside]
        row = np.repeat(np.arange(len(cut)), size[cut].sum(axis=1))
        same[cut] = np.bincount(row, weights=unlike, minlength=len(cut)) == 0
    return same


def _spans(n: int, owner, start, end) -> pa.Array:
    offsets = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _work(windowset: WindowSet, t: Texts):
    low = lower_ascii(t.data)
    start, end, owner = Texts(low, t.bounds).words(ALNUM)
    hashes = Prefix(low).ranges(start, end)
    cover = np.zeros(len(start) + 1, np.int64)
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w, first, place in windowset.hits(low, start, end, owner, hashes):
        cover += np.bincount(first, minlength=len(cover)) - np.bincount(first + w, minlength=len(cover))
        pairs = np.unique(np.stack([owner[first], place]), axis=1) if len(first) else np.zeros((2, 0), np.int64)
        index, found = windowset.members(w, pairs[1])
        docs.append(pairs[0][index])
        items.append(found)
    hit = np.cumsum(cover[:-1]) > 0
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
    names = [[] for _ in range(len(t))]
    for d, i in pairs.T.tolist():
        names[d].append(windowset.items[i])
    out = {
        "n_words": count_by(owner, len(t)),
        "n_hit": count_by(owner[hit], len(t)),
        "items": pa.array([sorted(set(x)) for x in names], pa.list_(pa.string())),
    }
    edge = np.flatnonzero(hit)
    new = np.ones(len(edge), bool)
    new[1:] = (np.diff(edge) > 1) | (owner[edge[1:]] != owner[edge[:-1]])
    begins, ends = edge[new], edge[np.append(new[1:], True)] if len(edge) else edge
    zero = np.searchsorted(owner, np.arange(len(t)))
    own = owner[begins]
    out["spans"] = _spans(len(t), own, start[begins] - t.bounds[own], end[ends] - t.bounds[own])
    out["hits"] = _spans(len(t), own, begins - zero[own], ends + 1 - zero[own])
    return out


REPORT = "n_words bigint, n_hit bigint, items array<string>"
SPANS = "spans array<struct<start:bigint,end:bigint>>, hits array<struct<start:bigint,end:bigint>>"


def _window_sets(benchmark: DataFrame, item: str, text: str, width: int, set_bytes: int):
    """How many hash sets the benchmark needs (one, unless its text exceeds ``set_bytes``), and a function
    that broadcasts the k-th."""
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(
        F.col("item").isNotNull() & F.col("text").isNotNull()
    )
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // set_bytes))
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    context = benchmark.sparkSession.sparkContext

    def sent(k: int):
        found = rows.where(part == k).collect()
        return context.broadcast(WindowSet([r.item for r in found], [r.text for r in found], width))

    return parts, sent


def _key(text: str):
    """What tells texts apart: two hashes and the length."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.octet_length(text).alias("n"))


def _united(docs: DataFrame, text: str, parts: int, sent) -> DataFrame:
    """``_key, items, n_hit, spans`` of every text with a hit, united over all parts of the benchmark. One part
    is held at a time: its hits are written before the next is sent."""
    tagged = docs.select(_key(text).alias("_key"), F.col(text).alias("_text"))
    found = []
    for k in range(parts):
        held = sent(k)
        rows = scan(tagged, ["_key"], "_text", f"{REPORT}, {SPANS}", lambda t, b=held: _work(b.value, t))
        both = F.transform(F.arrays_zip("hits", "spans"), lambda z: F.struct(z["hits"]["start"].alias("word"), z["hits"]["end"].alias("past"), z["spans"].alias("span")))
        rows = rows.where("n_hit > 0").select("_key", "items", both.alias("runs"))
        found.append(materialize(rows.dropDuplicates(["_key"])))
        held.destroy()
    rows = reduce(DataFrame.unionByName, found).groupBy("_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        _unite(F.array_sort(F.flatten(F.collect_list("runs")))).alias("runs"),
    )
    n_hit = F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, x: a + x["past"] - x["word"])
    return rows.select("_key", "items", n_hit.alias("n_hit"), F.transform("runs", lambda x: x["span"]).alias("spans"))


def report(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", width: int = WINDOW, set_bytes: int = SET_BYTES,
) -> DataFrame:
    """Per row of ``docs``: ``n_words``, ``n_hit`` (words inside an occurrence of a window), the sorted
    ``items`` and the hit ``spans`` in bytes.

    A window is ``width`` consecutive words of an item, or all words of a shorter one. Words are letters,
    digits and non-ASCII characters, lower-cased A-Z. Null or empty texts have no words. Items with a null
    id or text are ignored; rows of one item count as that item. A benchmark beyond ``set_bytes`` of text
    takes one scan per part, whose hits are united per text. Rows repeated with the same id and text each
    get a row; an empty table gives none. Other columns of both tables are not read.
    """
    parts, sent = _window_sets(benchmark, item, item_text, width, set_bytes)
    if parts == 1:
        held = sent(0)
        return scan(docs, [doc_id], text, f"{REPORT}, {SPANS}", lambda t: _work(held.value, t)).drop("hits")
    found = materialize(_united(docs, text, parts, sent))
    tagged = docs.select(F.struct(F.col(doc_id).alias("id"), _key(text).alias("tag")).alias("_id"), F.col(text).alias("_text"))
    empty = WindowSet([], [], width)
    rows = scan(tagged, ["_id"], "_text", f"{REPORT}, {SPANS}", lambda t: _work(empty, t)).select("_id", "n_words")
    rows = rows.join(found, F.col("_id.tag") == F.col("_key"), "left")
    return rows.select(
        F.col("_id.id").alias(doc_id), "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
    )


def _unite(runs):
    """Merges runs of hit words that overlap or touch, of a sorted array."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        span = F.struct(last["span"]["start"].alias("start"), F.greatest(last["span"]["end"], x["span"]["end"]).alias("end"))
        joined = F.struct(last["word"].alias("word"), F.greatest(last["past"], x["past"]).alias("past"), span.alias("span"))
        touches = x["word"] <= last["past"]
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))
        return F.when(F.size(acc) == 0, F.array(x)).when(touches, merged).otherwise(F.concat(acc, F.array(x)))

    empty = F.array().cast("array<struct<word:bigint,past:bigint,span:struct<start:bigint,end:bigint>>>")
    return F.aggregate(runs, empty, step)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, action: str = "document", text: str = "text", item: str = "item_id",
    item_text: str = "text", width: int = WINDOW, set_bytes: int = SET_BYTES,
) -> DataFrame:
    """``docs`` with all its columns, without what the benchmark holds: ``action="document"`` drops every
    document with a hit, ``"span"`` cuts the hit words out of the text. Cases as in :func:`report`; a null
    text stays null. A benchmark in several parts has its hits united first, so the result is that of one part.
    An empty table stays empty."""
    if action not in ("document", "span"):
        raise ValueError(f"unknown action {action}")
    ship(docs.sparkSession)
    parts, sent = _window_sets(benchmark, item, item_text, width, set_bytes)
    if parts > 1:
        return _without(docs, text, action, materialize(_united(docs, text, parts, sent)))
    place, held = docs.columns.index(text), sent(0)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = batch.column(place)
            parts = [_work(held.value, t) for t in blocks(col)]
            if action == "document":
                hit = np.concatenate([p["n_hit"] for p in parts])
                yield batch.filter(pa.array(hit == 0))
                continue
            spans = [s for p in parts for s in p["spans"].to_pylist()]
            texts = [_cut(x, s) if s else x for x, s in zip(col.to_pylist(), spans, strict=True)]
            yield batch.set_column(place, batch.schema.field(place), pa.array(texts, col.type))

    return docs.mapInArrow(run, docs.schema)


def _without(docs: DataFrame, text: str, action: str, found: DataFrame) -> DataFrame:
    """What :func:`decontaminate` leaves, from the hits of all parts. Texts without a hit are not joined."""
    columns, extra = docs.columns, "_key"
    while extra in columns:
        extra += "_"
    found = found.select(F.col("_key").alias(extra), "spans")
    keyed = docs.withColumn(extra, _key(text))
    if action == "document":
        return keyed.join(found, extra, "left_anti").select(*columns)
    spans = extra + "spans"
    joined = keyed.join(found.withColumnRenamed("spans", spans), extra, "left").select(*columns, spans)
    place = columns.index(text)

    def run(batches):
        for batch in batches:
            col, cuts = batch.column(place), batch.column(len(columns)).to_pylist()
            texts = [_cut(x, s) if s else x for x, s in zip(col.to_pylist(), cuts, strict=True)]
            yield batch.select(columns).set_column(place, batch.schema.field(place), pa.array(texts, col.type))

    return joined.mapInArrow(run, docs.schema)


def _cut(text: str, spans: list[dict]) -> str:
    raw, kept, at = text.encode(), [], 0
    for s in spans:
        kept.append(raw[at : s["start"]])
        at = s["end"]
    return b"".join([*kept, raw[at:]]).decode()
