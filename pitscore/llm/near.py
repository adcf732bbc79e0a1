"""Near-duplicate documents: fast similarity sketches, banding, and verification on full shingle sets.

A sketch has ``rows * bands`` coordinates. Each round hashes every shingle to a coordinate and a value;
values of later rounds are larger, and a coordinate keeps the smallest. After as many rounds as there are
coordinates the rounds that follow fill one coordinate each, so none stays empty. Most texts fill their
sketch in a few rounds.

Documents with the same words are one text. Two texts whose sketches agree on all rows of a band meet in
that band's bucket. A bucket is not expanded into pairs: each of its texts is compared, on whole sets, with
the bucket's head (its smallest id). The comparison also gives what the text lacks of the head's set and
what it adds to it. Where the texts under one head still form several components, these differences give
the exact similarity of any two of them; texts outside the largest component are compared with all others
there, in blocks of bounded size, and a block returns at most one link per pair of components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitscore.llm import packed
from pitscore.llm.shared import load, save, shared_path, ship
from pitscore.llm.text import Prefix, Texts, blocks, count_by, lower_ascii, mix, scan, seeds, windows
from pitscore.sources.io import materialize

WIDTH = 5
ROWS, BANDS = 7, 36
#: Percent of the union that the intersection must reach.
PERCENT = 85
#: Bytes of bit maps that one block of comparisons may hold, and its most texts.
BLOCK_BITS, BLOCK_TEXTS = 1 << 29, 4096


def shingle_sets(t: Texts, width: int = WIDTH):
    """Distinct shingle hashes of each text, ordered by text, and their owners. Fewer words than ``width``
    are one shingle; a text without words has none."""
    low = lower_ascii(t.data)
    start, end, owner = Texts(low, t.bounds).words()
    hashes = Prefix(low).ranges(start, end)
    n = count_by(owner, len(t))
    found, first = windows(hashes, owner, width)
    keys, owners = [found], [owner[first]]
    for w in range(1, width):
        at = np.flatnonzero(n[owner] == w)
        one, first = windows(hashes[at], owner[at], w)
        keys.append(one)
        owners.append(owner[at[first]])
    key, who = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, who))
    key, who = key[order], who[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (who[1:] != who[:-1])
    return key[new], who[new], low, (start, end, owner)


def sketches(key: np.ndarray, who: np.ndarray, n: int, size: int) -> np.ndarray:
    """Fast similarity sketch of each set: an array of n rows; rows of empty sets are not filled."""
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * size, top, np.uint64)
    turn = seeds(2 * size, 7)
    missing = np.full(n, size)
    live, owner = key, who
    for i in range(2 * size):
        if not len(live):
            break
        h = mix(live ^ turn[i])
        place = ((h >> np.uint64(32)) % np.uint64(size)).astype(np.int64) if i < size else i - size
        slot = owner * size + place
        empty = out[slot] == top  # values of this round exceed all of earlier rounds
        slot = slot[empty]
        np.minimum.at(out, slot, (h[empty] & np.uint64(0xFFFFFFFF)) | (np.uint64(i) << np.uint64(32)))
        missing -= np.bincount(np.unique(slot) // size, minlength=n)
        keep = missing[owner] > 0
        live, owner = live[keep], owner[keep]
    return out.reshape(n, size)


def features(
    docs: DataFrame, rows: int = ROWS, bands: int = BANDS, width: int = WIDTH, keep: tuple = ("doc_id",)
) -> DataFrame:
    """Per row: the columns ``keep``, ``n_shingles``, ``words_key`` (digest of the lower-cased words; null without words), the
    ``bands`` (a hash each)."""

    def work(t: Texts):
        key, who, low, (start, end, owner) = shingle_sets(t, width)
        n, size = len(t), rows * bands
        sketch = sketches(key, who, n, size)
        sizes = count_by(who, n)
        h = np.zeros((n, bands), np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, r::rows])
        h = mix(h ^ seeds(bands, 11))
        edge = np.bincount(start, minlength=len(low) + 1) - np.bincount(end, minlength=len(low) + 1)
        space = np.cumsum(edge[:-1]) == 0
        plain = np.where(space, np.uint8(32), low)
        lo = np.searchsorted(owner, np.arange(n + 1))
        digests = []
        keep = ~space
        keep[1:] |= ~space[:-1]  # one space after each word
        for i in range(n):
            if lo[i] == lo[i + 1]:
                digests.append(None)
                continue
            a, b = start[lo[i]], end[lo[i + 1] - 1]
            digests.append(hashlib.md5(plain[a:b][keep[a:b]].tobytes(), usedforsecurity=False).digest())
        full = (sizes > 0).tolist()
        return {
            "n_shingles": sizes,
            "words_key": pa.array(digests, pa.binary()),
            "bands": pa.array([h[i].view(np.int64) if full[i] else None for i in range(n)], pa.list_(pa.int64())),
        }

    return scan(docs, list(keep), "text", "n_shingles bigint, words_key binary, bands array<bigint>", work)


def _fingerprint(pairs: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1 << 30)))).first())


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the smallest id reachable) of every id on an edge, by alternating star steps.

    Each step is two groupings by node; a node's partners are never gathered. The smallest partners are
    written before they are joined: Spark splits a hub's rows in a join of two plain tables, but not in a
    join with a grouping by the same key.
    """
    pairs = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    )
    mark = _fingerprint(pairs)
    while True:
        both = pairs.select("u", "v").union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: larger partners of u move to the smallest partner of u
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller partners of u, and u, move to the smallest of them
        low = materialize(large)
        small_least = materialize(low.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            low.join(small_least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small_least.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        after = materialize(small)
        before, mark, pairs = mark, _fingerprint(after), after
        if mark == before:
            break
    roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _compare(stars: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Per pair of a head and a text: whether they are linked, the sizes of both sets, the places in the
    head's ordered set that the text lacks, and the shingles it adds."""
    left = texts.select(F.col("id").alias("head"), F.col("text").alias("_left"))
    right = texts.select("id", F.col("text").alias("_right"))
    both = stars.join(left, "head").join(right, "id").select("head", "id", "_left", "_right")
    ship(stars.sparkSession)

    def run(batches):
        for batch in batches:
            sides = []
            for c in (2, 3):
                sets = []
                for t in blocks(batch.column(c)):
                    key, who, _, _ = shingle_sets(t, width)
                    cuts = np.searchsorted(who, np.arange(len(t) + 1))
                    sets += [key[cuts[i] : cuts[i + 1]] for i in range(len(t))]
                sides.append(sets)
            rows = []
            for x, y in zip(*sides, strict=True):
                lacks = np.flatnonzero(~np.isin(x, y, assume_unique=True)).astype(np.int32)
                adds = y[~np.isin(y, x, assume_unique=True)].view(np.int64)
                both_n = len(x) - len(lacks)
                linked = both_n > 0 and 100 * both_n >= percent * (len(x) + len(adds))
                mark = int(np.bitwise_xor.reduce(mix(x), initial=0).view(np.int64))
                rows.append((linked, mark, len(x), len(y), lacks, adds))
            if rows:
                columns = zip(*rows, strict=True)
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    names = ["head", "id", "linked", "mark", "n_head", "n", "lacks", "adds"]
    return both.mapInArrow(
        run,
        "head bigint, id bigint, linked boolean, mark bigint, n_head bigint, n bigint, "
        "lacks array<int>, adds array<bigint>",
    )


def _bit_maps(lists: list[np.ndarray], size: int) -> np.ndarray:
    out = np.zeros((len(lists), max(1, -(-size // 64)) * 64), bool)
    for i, x in enumerate(lists):
        out[i, x] = True
    return np.packbits(out, axis=1).view(np.uint64)


def _block_links(table: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links across components between the asking and the other texts of one block, one per pair of
    components."""
    ids, parts = np.asarray(table["id"]), np.asarray(table["component"])
    asks = np.asarray(table["asks"])
    n, h = np.asarray(table["n"]), int(table["n_head"][0].as_py())
    lacks = [np.asarray(x.values if hasattr(x, "values") else x, np.int64) for x in table["lacks"].combine_chunks()]
    adds = [np.asarray(x.values if hasattr(x, "values") else x, np.int64) for x in table["adds"].combine_chunks()]
    flat = np.concatenate(adds) if adds else np.zeros(0, np.int64)
    shared, times = np.unique(flat, return_counts=True)
    shared = shared[times > 1]
    adds = [np.searchsorted(shared, x[np.isin(x, shared)]) for x in adds]
    n_lacks = np.fromiter(map(len, lacks), np.int64, len(lacks))
    lack_bits, add_bits = _bit_maps(lacks, h), _bit_maps(adds, len(shared))
    rows, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    found, out = set(), []
    for i in asking:
        also = np.bitwise_count(lack_bits[rows] & lack_bits[i]).sum(axis=1, dtype=np.int64)
        more = np.bitwise_count(add_bits[rows] & add_bits[i]).sum(axis=1, dtype=np.int64)
        both = h - (n_lacks[rows] + n_lacks[i] - also) + more
        near = (100 * both >= percent * (n[rows] + n[i] - both)) & (both > 0) & (parts[rows] != parts[i])
        for j in rows[near]:
            pair = (min(parts[i], parts[j]), max(parts[i], parts[j]))
            if pair not in found:
                found.add(pair)
                out.append((int(ids[i]), int(ids[j])))
    return out


def _across(compared: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Links between texts under one head that the comparison with the head left in several components."""
    rows = (
        compared.join(labels, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .drop("linked")
    )
    sizes = rows.groupBy("head", "mark", "component").agg(F.count("*").alias("size"), F.max("n_head").alias("h"))
    groups = sizes.groupBy("head", "mark").agg(
        F.sum("size").alias("texts"), F.count("*").alias("parts"), F.max_by("component", F.struct("size", "component")).alias("main"),
        F.max("h").alias("h"),
    ).where("parts > 1")
    room = F.greatest(F.lit(16), F.least(F.lit(BLOCK_TEXTS), F.floor(F.lit(BLOCK_BITS) / (F.col("h") + 1))))
    groups = materialize(groups.select("head", "mark", "main", F.ceil(F.col("texts") / room).cast("int").alias("blocks")))
    active = rows.join(groups, ["head", "mark"])
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    # texts outside the largest component ask every block of the head's texts; each side is split
    others = active.select("*", own.alias("block"), F.lit(False).alias("asks")).select("*", every.alias("turn"))
    asking = active.where("component <> main").select("*", own.alias("turn"), F.lit(True).alias("asks"))
    asking = asking.select("*", every.alias("block"))
    columns = ["head", "mark", "block", "turn", "asks", "id", "component", "n_head", "n", "lacks", "adds"]
    ship(compared.sparkSession)

    def links(table: pa.Table) -> pa.Table:
        found = _block_links(table, percent)
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    both = others.select(*columns).union(asking.select(*columns))
    return both.groupBy("head", "mark", "block", "turn").applyInArrow(links, "a bigint, b bigint")


class KeySet:
    """Distinct 64-bit keys as sorted arrays in the shared folder, mapped by the workers: rows are tested
    against it where they are, without a shuffle."""

    def __init__(self, keys: DataFrame):
        spark = keys.sparkSession
        self.folder, self.bits = shared_path(spark, "keys"), max(2, (keys.count() >> 20).bit_length())
        folder, bits = self.folder, self.bits
        ship(spark)

        def send(batches):
            for batch in batches:
                h = np.sort(mix(np.asarray(batch.column(0)).view(np.uint64)))
                cuts = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1))
                used = np.flatnonzero(np.diff(cuts))
                yield packed.rows(used, [h[cuts[k] : cuts[k + 1]].tobytes() for k in used])

        def write(batches):
            for shard, blobs in packed.gathered(batches):
                h = np.unique(np.frombuffer(b"".join(blobs), np.uint64))
                save(f"{folder}/keys-{shard:06d}.npy", h)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], ["shard"])

        sent = keys.mapInArrow(send, packed.SCHEMA)
        self.there = packed.ShardSet(packed.to_shards(sent, 1 << bits).mapInArrow(write, "shard bigint"))

    def holds(self, keys: np.ndarray) -> np.ndarray:
        h = mix(keys.view(np.uint64))
        shards, found = h >> np.uint64(64 - self.bits), np.zeros(len(h), bool)
        for shard in np.unique(shards).tolist():
            if shard not in self.there:
                continue  # no key in this shard
            known = load(f"{self.folder}/keys-{shard:06d}.npy")
            own = np.flatnonzero(shards == shard)
            at = np.minimum(np.searchsorted(known, h[own]), len(known) - 1)
            found[own] = known[at] == h[own]
        return found

    def filter(self, df: DataFrame, key: str, inside: bool = True) -> DataFrame:
        """The rows whose ``key`` (not null) is in the set, or is not."""
        place, holds = df.columns.index(key), self.holds

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(holds(np.asarray(batch.column(place))) == inside))

        return df.mapInArrow(run, df.schema)


def near_duplicates(
    docs: DataFrame, rows: int = ROWS, bands: int = BANDS, percent: int = PERCENT, width: int = WIDTH,
    keep: tuple = (),
) -> DataFrame:
    """Per row of ``docs`` (``doc_id`` integer, ``text``): ``doc_id, n_shingles, component_id`` and the
    further columns ``keep``.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct word
    shingles; ``component_id`` is the smallest id reachable over links. Texts without words, null ones too,
    are linked with nothing. Rows repeated with one id get a row each; an id repeated with different texts
    is linked if any of them is. A row with a null id is its own component (null). An empty table gives no
    rows. Only ``doc_id`` and ``text`` are read.

    All texts that share a band's bucket are compared exactly, directly or by their differences from a
    common head. With the defaults a pair at exactly 85 % shares no band with probability 1e-6, pairs of
    higher similarity far less often; a lower ``percent`` asks for fewer ``rows`` and more ``bands``.
    """
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), *keep)
    found = materialize(features(source, rows, bands, width, ("doc_id", *keep)))
    known = found.where("words_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("words_key").agg(F.min("doc_id").alias("id")))
    first = classes.select("words_key", F.col("id").alias("doc_id"))
    sketched = known.join(first, ["words_key", "doc_id"], "left_semi")
    buckets = materialize(sketched.select(F.col("doc_id").alias("id"), F.explode("bands").alias("bucket")))
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("head"), F.max("id").alias("_last"))
    heads = materialize(heads.where("head <> _last").drop("_last"))  # so that a hot bucket is split, too
    stars = materialize(buckets.join(heads, "bucket").where("id <> head").select("head", "id").distinct())
    ids = stars.select("id").union(stars.select("head")).distinct()
    texts = source.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL")
    texts = materialize(KeySet(ids).filter(texts, "id").distinct())
    compared = materialize(_compare(stars, texts, percent, width))
    links = compared.where("linked").select(F.col("head").alias("a"), F.col("id").alias("b"))
    labels = connected(links)
    more = materialize(_across(compared, labels, percent))
    merged = more.join(labels.withColumnRenamed("component", "_a"), F.col("a") == F.col("id"), "left").drop("id")
    merged = merged.join(labels.withColumnRenamed("component", "_b"), F.col("b") == F.col("id"), "left")
    roots = connected(merged.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    roots = roots.select(F.col("id").alias("component"), F.col("component").alias("root"))
    nodes = classes.select("id").distinct().join(labels, "id", "left")
    nodes = nodes.select("id", F.coalesce("component", "id").alias("component")).join(roots, "component", "left")
    nodes = nodes.select("id", F.coalesce("root", "component").alias("component_id"))
    by_class = classes.join(nodes, "id").select("words_key", "component_id")
    out = found.drop("bands").join(by_class, "words_key", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *keep)


def keep_first(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all its columns, one row of each near-duplicate component: that of smallest id, and of
    rows repeated with that id one (of different texts the one of smallest hash). Rows without an id or
    without words all stay. Which rows go is looked up by a hash of id and text, so texts are not shuffled.
    Links and their limits as in :func:`near_duplicates`.
    """
    key = "_key"
    while key in docs.columns:
        key += "_"
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = materialize(near_duplicates(keyed, rows, bands, percent, keep=(key,)).where("doc_id IS NOT NULL AND n_shingles > 0"))
    copies = found.where("doc_id <> component_id").select(key)
    firsts = found.where("doc_id = component_id").groupBy("doc_id", key).agg(F.count("*").alias("n"))
    least = firsts.groupBy("doc_id").agg(F.min(key).alias("least"), F.max(key).alias("most")).where("least <> most")
    others = firsts.join(least, "doc_id").where(F.col(key) != F.col("least")).select(key)
    rest = KeySet(copies.union(others).distinct()).filter(keyed, key, inside=False)
    repeated = materialize(firsts.where("n > 1").select(key).distinct())
    if repeated.isEmpty():
        return rest.drop(key)
    again = KeySet(repeated)
    once = again.filter(rest, key).dropDuplicates([key])
    return again.filter(rest, key, inside=False).union(once).drop(key)
