"""The conversation trie against plain Python."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest

from docspark.llm import conversation_trie as trie
from tests.llm.brute import plain

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, shard string, kind int"


def brute(rows):
    """Rows (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of all nodes."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
        ends[tuple(rebuilt[c])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(sums[x][0] for x in below[node]) or 1
        saved = sum(sums[x][1] for x in below[node]) + ((len(members[node]) - 1) * len(plain(node[-1][1])) if node else 0)
        sums[node] = leaves, saved
    return sorted(
        (m[0], len(node), members[node[:-1]][0] if node else -1, len(m), len(below[node]), *sums[node],
         hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest())
        for node, m in members.items())


def found(spark, rows):
    got = trie.conversation_trie(spark.createDataFrame([(*r, None, "x", 1) for r in rows], SCHEMA).repartition(5)).collect()
    return sorted(tuple(-1 if v is None else v for v in r) for r in got)


def planted():
    rows = []
    for c in range(300):  # one conversation that a third has, a first turn that another third shares, and families
        if c % 3 == 0:
            turns = [("user", "the same words in all"), ("assistant", "an answer"), ("user", "bye"), ("assistant", "good bye"), ("user", "again")]
        elif c % 3 == 1:
            turns = [("user", "a first turn"), ("assistant", f"answer {c % 7}"), ("user", f"more {c % 2}"), ("user", f"own {c}"), ("user", "end")]
        else:
            turns = [("user" if i % 2 else "assistant", f"turn {i} of {c % 50}") for i in range(c % 9)]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(1000, i, "user", f"long {i}") for i in range(900)] + [(1020, i, "user", f"long {i}" if i < 450 else "x y") for i in range(800)]
    rows += [(1000000 + k, i, "user", f"long {i}") for k in range(40) for i in range(500)]
    return rows


@pytest.mark.parametrize("shards", ["1", "4", "37"])
def test_planted_conversations(spark, monkeypatch, shards):
    monkeypatch.setattr(trie, "BLOCK", 7)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        assert found(spark, planted()) == brute(planted())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_short_splitters(spark, monkeypatch):
    monkeypatch.setattr(trie, "SAMPLE_TURNS", 1)
    assert found(spark, planted()) == brute(planted())


def test_awkward_rows(spark):
    rows = [
        (None, 0, "user", "nobody's"), (1, None, "user", "null turn"), (1, 0, None, "no role"), (1, 1, "user", None), (1, 1, None, None), (1, 1, "user", ""),
        (2, 5, "user", "only turn"), (3, 0, "us", "erx"), (4, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "x"), (6, 0, "user", "x"), (6, 0, "user", "x"),
        (20, 0, "user", "word " * 50_000), (21, 0, "a", "b"), (21, 1, "user", "own \t words\nhere"), (39, 3, "q", "r"), (39, 2, "q", "s"), (39, 1, "u", "t"), (39, 0, "ü", "日 本"),
        (2**62, 0, "user", "x"), (0, 0, "user", "zero"), (0, 1, "user", "zero one"), (0, 1, "user", "zero one"),
    ]
    assert found(spark, rows) == brute(rows)
    assert any(n == 1 and depth == 0 for _, depth, _, n, *_ in found(spark, [(22, 0, "user", "x")]))
    assert found(spark, []) == [] and found(spark, rows[:1]) == []


def test_skeleton_is_bounded(spark):
    paths = trie.rebuilt_paths(trie.turn_rows(spark.createDataFrame([(*r, None, "x", 1) for r in planted()], SCHEMA)))
    for shards in (1, 3, 50):
        splitters = trie.choose_splitters(paths, shards)
        assert len(splitters) < shards or shards == 1 and not splitters
        assert splitters == sorted(set(splitters))
        sizes = defaultdict(int)
        for r in paths.collect():
            sizes[trie.bisect_right(splitters, (bytes(r["path"]), r["conv_id"]))] += 1 + len(r["sizes"])
        assert max(sizes.values()) <= sum(sizes.values()) / shards + 2 * 901
