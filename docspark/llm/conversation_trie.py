"""Prefix trie of rebuilt conversations by a splitter skeleton.

A conversation is a path of 16-byte turn digests, so paths compare as byte strings. The rows (path, conv_id) are range-partitioned by
splitters taken from a bounded sample; copies of one conversation differ in their id and can be split as well. All members of a node
lie next to one another in that order. Only a node whose path is a prefix of a splitter's path can reach over a splitter: these nodes
are the skeleton, a small trie that is sent to all tasks.

Every shard is sorted by Spark and read once with a stack as deep as the path at hand. Nodes outside the skeleton are finished
there. Nodes of the skeleton give partial aggregates, at most one per shard, which are added up by node; subtree sums then go up the
skeleton, whose size is bounded by ``SAMPLE_TURNS``. A second pass over the shard's nodes in preorder, again sorted by Spark, names the parents.

Nothing is gathered by turn, node or conversation group: a first turn that a third of all conversations share costs
each shard one partial row, and ids of equal conversations are hashed as they come by.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import ship_with_tasks, words
from docspark.session import cut_lineage

ship_with_tasks(__name__)

DIGEST = 16
#: A conversation takes its first turns from the first one of every ``FAMILY`` ids, fewer than ``HEADS``.
FAMILY, HEADS = 20, 4
#: Sampled rows per shard, sampled rows at most, and turns of all sampled paths at most; they bound splitters and skeleton.
PER_SHARD, SAMPLE_ROWS, SAMPLE_TURNS = 32, 1 << 16, 1 << 22
#: Ids of equal conversations that are passed on in one row, where a group reaches over a splitter.
BLOCK = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
LOWEST = -(1 << 63)

NODES = ("kind int, shard int, pre bigint, skeleton int, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, words bigint, ends string")
DONE, PARTIAL, ENDS = 0, 1, 2


def turn_rows(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id, turn, digest, words``: one narrow row per turn; null role and text are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.substring(F.sha2(named, 256), 1, 2 * DIGEST).alias("digest"), F.size(words(text)).alias("words"),
    )


def rebuilt_paths(turns: DataFrame, family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """``conv_id, path, sizes``: every conversation with its first turns taken from its family's first one; written once.

    Turns are taken in order of ``turn``, null first; equal ones in order of their digests. One row holds 20 bytes per turn.
    """
    listed = F.sort_array(F.collect_list(F.struct("turn", "digest", "words")))
    own = cut_lineage(turns.groupBy("conv_id").agg(listed.alias("own")).withColumn("family", F.col("conv_id") - F.col("conv_id") % family))
    first = own.filter(F.col("conv_id") == F.col("family")).select("family", F.slice("own", 1, heads - 1).alias("given"))
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    none = F.slice("own", 1, 0)
    rebuilt = F.concat(F.coalesce(F.slice("given", F.lit(1), taken), none), F.slice("own", taken + 1, F.size("own")))
    rows = own.join(cut_lineage(first), "family", "left").select("conv_id", rebuilt.alias("turns"))
    return cut_lineage(rows.select("conv_id", F.unhex(F.array_join("turns.digest", "")).alias("path"), F.col("turns.words").alias("sizes")))


def choose_splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """At most ``shards - 1`` rows (path, conv_id) that cut all rows into shards of about as many turns, from a bounded sample.

    The sample are the rows with the smallest hash of their id. A splitter is no longer than it takes to tell it from the sampled row before it.
    """
    rows = min(max(PER_SHARD * shards, 1024), SAMPLE_ROWS)
    most = max(4, SAMPLE_TURNS // rows)
    sample = paths.select(F.xxhash64("conv_id").alias("draw"), "conv_id", F.substring("path", 1, DIGEST * most).alias("path"), (F.size("sizes") + 1).alias("weight"))
    drawn = sorted((bytes(r["path"]), r["conv_id"], r["weight"]) for r in sample.orderBy("draw", "conv_id").limit(rows).collect())
    share, at, chosen = sum(w for *_, w in drawn) / shards, 0, []
    for (before, *_), (path, conv, weight) in zip([(b"",), *drawn], drawn):
        if at >= share * (len(chosen) + 1) and len(chosen) < shards - 1:
            if path == before:
                chosen.append((path, conv))
            else:
                chosen.append((path[: DIGEST * (common_turns(before, path) + 1)], LOWEST))
        at += weight
    return sorted(set(chosen))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[: DIGEST * middle] == b[: DIGEST * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def skeleton_of(splitters: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """Numbers of all prefixes of the splitters' paths, the root first; parents before children."""
    prefixes = {path[:end] for path, _ in splitters for end in range(0, len(path) + 1, DIGEST)} | {b""}
    return {p: i for i, p in enumerate(sorted(prefixes, key=lambda p: (len(p), p)))}


def _assign(shared):
    """Task: rows to their shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitters = shared.value["splitters"]
        for batch in batches:
            shards = [bisect_right(splitters, row) for row in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, type=pa.int32())], names=[*batch.schema.names, "shard"])

    return task


class Open:
    """A node on the current path, with what its finished parts add up to."""

    __slots__ = ("depth", "words", "n", "least", "children", "leaves", "saved", "hasher", "ids", "skeleton", "pre", "parent")

    def __init__(self, depth: int, words: int, skeleton: int | None, pre: int, parent: int | None):
        self.depth, self.words, self.skeleton, self.pre, self.parent = depth, words, skeleton, pre, parent
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.hasher = None
        self.ids: list[int] = []


class Shard:
    """One pass over the sorted rows of a shard; ``out`` gathers rows of ``NODES``."""

    def __init__(self, shard: int, skeleton: dict[bytes, int], out: list[tuple]):
        self.shard, self.skeleton, self.out = shard, skeleton, out
        self.path, self.pre = b"", 0
        self.stack = [Open(0, 0, skeleton[b""], 0, None)]

    def add(self, conv: int, path: bytes, sizes: list[int]) -> None:
        shared = common_turns(self.path, path)
        self.close(shared + 1)
        above = self.stack[-1]
        for depth in range(shared + 1, len(path) // DIGEST + 1):
            skeleton = self.skeleton.get(path[: DIGEST * depth]) if above.skeleton is not None else None
            if skeleton is None:
                self.pre += 1
            node = Open(depth, sizes[depth - 1], skeleton, self.pre, above.skeleton)
            self.stack.append(node)
            above = node
        self.path = path
        above.n += 1
        above.least = conv if above.least is None else min(above.least, conv)
        if above.skeleton is not None:
            above.ids.append(conv)
            if len(above.ids) >= BLOCK:
                self.pass_ids(above)
        elif above.hasher is None:
            above.hasher = hashlib.sha256(str(conv).encode())
        else:
            above.hasher.update(f",{conv}".encode())

    def pass_ids(self, node: Open) -> None:
        if node.ids:
            self.out.append((ENDS, self.shard, 0, node.skeleton, node.depth, node.ids[0], None, 0, 0, 0, 0, 0, ",".join(map(str, node.ids))))
            node.ids = []

    def close(self, size: int) -> None:
        """Finish the nodes beyond the first ``size`` of the path."""
        while len(self.stack) > size:
            node = self.stack.pop()
            above = self.stack[-1] if self.stack else None
            if node.skeleton is not None:
                self.pass_ids(node)
                self.out.append((PARTIAL, self.shard, 0, node.skeleton, node.depth, node.least, None, node.n, node.children, node.leaves, node.saved, node.words, None))
            else:
                node.leaves = node.leaves or 1
                node.saved += (node.n - 1) * node.words
                ends = node.hasher.hexdigest() if node.hasher else NO_ENDS
                self.out.append((DONE, self.shard, node.pre, node.parent, node.depth, node.least, None, node.n, node.children, node.leaves, node.saved, node.words, ends))
                above.children += 1
                above.leaves += node.leaves
                above.saved += node.saved
            if above is not None:
                above.n += node.n
                above.least = node.least if above.least is None else min(above.least, node.least)


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in NODES.split(", "))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = _schema()
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _walk(shared):
    """Task: sorted rows of shards to their nodes."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton, out, shard = shared.value["skeleton"], [], None
        for batch in batches:
            for conv, path, sizes, number in zip(*(c.to_pylist() for c in batch.columns)):
                if shard is None or shard.shard != number:
                    if shard is not None:
                        shard.close(0)
                    shard = Shard(number, skeleton, out)
                shard.add(conv, path, sizes)
                if len(out) >= 10_000:
                    yield _batch(out)
                    out.clear()
        if shard is not None:
            shard.close(0)
        if out:
            yield _batch(out)

    return task


def _name_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: nodes of a shard in preorder get the id of the parent where that is finished in the shard."""
    above: dict[int, int] = {}
    for batch in batches:
        kind, skeleton, depth, conv = (batch.column(i).to_pylist() for i in (0, 3, 4, 5))
        parents = []
        for k, s, d, c in zip(kind, skeleton, depth, conv):
            parents.append(above[d - 1] if k == DONE and s is None else None)
            if k == DONE:
                above[d] = c
        columns = batch.columns
        columns[6] = pa.array(parents, type=pa.int64())
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: sorted blocks of ids to one checksum per skeleton node."""
    node, hasher = None, None

    def one():
        return pa.RecordBatch.from_arrays([pa.array([node], type=pa.int32()), pa.array([hasher.hexdigest()])], names=["skeleton", "ends"])

    for batch in batches:
        for number, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if number != node:
                if hasher is not None:
                    yield one()
                node, hasher = number, hashlib.sha256(text.encode())
            else:
                hasher.update(f",{text}".encode())
    if hasher is not None:
        yield one()


def finish_skeleton(skeleton: dict[bytes, int], partial: dict[int, tuple], ends: dict[int, str]) -> list[tuple]:
    """Rows ``skeleton, depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of the skeleton nodes that have members.

    ``partial`` has (least, n, children, leaves, saved, words) by node, without the skeleton nodes below it; these are added from the deepest on.
    """
    parent = {i: skeleton[p[:-DIGEST]] if p else None for p, i in skeleton.items()}
    depth = {i: len(p) // DIGEST for p, i in skeleton.items()}
    total = {i: list(v) for i, v in partial.items()}
    for i in sorted(total, reverse=True):  # numbers grow with the depth
        own = total[i]
        own[3] = own[3] if own[2] else 1
        own[4] += (own[1] - 1) * own[5]
        if parent[i] is not None:
            above = total[parent[i]]
            above[2] += 1
            above[3] += own[3]
            above[4] += own[4]
    return [(i, depth[i], least, None if parent[i] is None else total[parent[i]][0], n, children, leaves, saved, ends.get(i, NO_ENDS))
            for i, (least, n, children, leaves, saved, _) in total.items()]


def trie_nodes(paths: DataFrame) -> DataFrame:
    """The nodes of the trie over ``conv_id, path, sizes``."""
    spark = paths.sparkSession
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = choose_splitters(paths, shards)
    skeleton = skeleton_of(splitters)
    shared = spark.sparkContext.broadcast({"splitters": splitters, "skeleton": skeleton})

    dealt = paths.select("conv_id", "path", "sizes").mapInArrow(_assign(shared), "conv_id bigint, path binary, sizes array<int>, shard int")
    dealt = dealt.repartitionById(len(splitters) + 1, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    walked = dealt.mapInArrow(_walk(shared), NODES).sortWithinPartitions("shard", "pre")
    nodes = cut_lineage(walked.mapInArrow(_name_parents, NODES))

    sums = nodes.filter(F.col("kind") == PARTIAL).groupBy("skeleton").agg(
        F.min("conv_id"), *[F.sum(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("words"))
    blocks = nodes.filter(F.col("kind") == ENDS).select("skeleton", "conv_id", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id")
    ends = blocks.mapInArrow(_hash_ends, "skeleton int, ends string")
    rows = finish_skeleton(skeleton, {r[0]: tuple(r)[1:] for r in sums.collect()}, {r["skeleton"]: r["ends"] for r in ends.collect()})
    upper = spark.createDataFrame(rows, "skeleton int, depth bigint, conv_id bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
                                        "saved_tokens bigint, ends_sha256 string")
    above = F.broadcast(upper.select("skeleton", F.col("conv_id").alias("above")))
    lower = nodes.filter(F.col("kind") == DONE).join(above, "skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    named = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return lower.withColumnRenamed("ends", "ends_sha256").select(*named).unionByName(upper.select(*named))


def conversation_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                      family: int = FAMILY, heads: int = HEADS) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations.

    Columns: ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``. Conversation
    c takes its first h turns, h = crc32(c) mod ``heads``, from conversation c - c mod ``family`` (all if it has fewer, none if
    there is none), and keeps its own turns after its first h. Ids are whole numbers; rows without one belong to no conversation and are left out. A
    null turn comes first; turns of equal number are ordered by a digest of role and text, and repeated rows are repeated turns. Null role
    and text are empty. Equal conversations are members of the same nodes. Without conversations there is no node, not even the root. The
    digests of one conversation (20 bytes per turn) must fit in a row.
    """
    return trie_nodes(rebuilt_paths(turn_rows(conversations, conv_col, turn_col, role_col, text_col), family, heads))
