"""The conversation trie against a plain version, with narrow bands, small blocks and long conversations."""

import hashlib
import random
from collections import defaultdict

import pytest

from pitscore.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows, others=()):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    paths = {c: tuple(x[2:] for x in sorted(t)) for c, t in turns.items()} | {c: () for c in others if c not in turns}
    members, children = defaultdict(list), defaultdict(set)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
            if d:
                children[paths[c][: d - 1]].add(paths[c][:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += own
    out = set()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(node))
        out.add((
            convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children.get(node, ())),
            leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def got_of(spark, rows, others=(), parts=3, **options):
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, pos int").repartition(parts)
    more = spark.createDataFrame([(c,) for c in others], "conv_id long") if others else None
    found = trie.trie(trie.numbered(df), more, **options).select(*COLUMNS).collect()
    assert len(found) == len({tuple(r) for r in found})
    return {tuple(r) for r in found}


def forest(seed, convs, length):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for k in range(rng.randint(1, length)):
            rows.append((c * 3 - 20, k, rng.choice(["user", "assistant"][: 1 + (k > 2)]), rng.choice("aé") * rng.choice([1, 1, 2])))
    return rows


@pytest.mark.parametrize("seed, band, block", [(1, 2, 4), (2, 3, 3), (3, 8, 4096)])
def test_trie_equals_plain_version(spark, seed, band, block):
    rows = forest(seed, 60, 14)
    assert got_of(spark, rows, (7777, -20), band=band, block=block) == plain_trie(rows, (7777, -20))


def test_long_and_equal_conversations(spark, monkeypatch):
    """One conversation holds most turns, and most conversations are alike, so one node has most ends."""
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = [(1, k, "user", f"turn {k % 5}") for k in range(150)]
    rows += [(2, k, "user", f"turn {k % 5}") for k in range(70)]
    rows += [(c, k, "user", f"turn {k}") for c in range(10, 60) for k in range(2)]
    assert got_of(spark, rows, band=2, block=4, parts=5) == plain_trie(rows)


def test_trie_edges(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (2, 0, None, "x"), (2, 0, "", "x"), (2, 0, "", "a"),
        (None, 1, "user", "lost"), (3, None, "", ""), (4, -5, "user", "long " * 400_000), (4, -9, "user", "é漢😀"), (5, 1, "a", "b"),
        (6, 1, "ab", ""), (7, 1, "", "ab"),
    ]
    assert got_of(spark, rows) == plain_trie(rows)
    assert got_of(spark, [], (4, 4, 9)) == plain_trie([], (4, 9))
    assert got_of(spark, []) == set()


def test_numbering_goes_on_across_tasks(spark):
    rows = [(1, k, "u", str(k)) for k in range(500)] + [(0, k, "u", "x") for k in range(3)] + [(2, None, "u", "same")] * 40
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = sorted((r.conv_id, r.pos) for r in trie.numbered(df).collect())
    assert got == sorted([(1, k) for k in range(1, 501)] + [(0, k) for k in (1, 2, 3)] + [(2, k) for k in range(1, 41)])


def test_lookup_splits_hot_keys(spark):
    rows = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(3000)], "a long, b long")
    table = spark.createDataFrame([(k, k * 10) for k in range(1, 2000)], "a long, c long")
    got = {tuple(r) for r in trie.lookup(rows, table, ["a"]).collect()}
    assert got == {(a, b, a * 10 if 1 <= a < 2000 else None) for a, b in ((1 if k % 3 else k, k) for k in range(3000))}


def test_bands_must_fit_blocks(spark):
    with pytest.raises(ValueError):
        trie.trie(spark.createDataFrame([], "conv_id long, pos long, t1 long, t2 long, n_bytes long"), band=3, block=4)
