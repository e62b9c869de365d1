"""Prefix tries of conversations: which opening turns conversations share, and what sharing saves.

A node is a distinct sequence of first turns; the root is the empty one. Turns are known by 128-bit digests, so
texts stay where they are read. Distinct paths (whole conversations) are sorted and dealt to shards by
range. Each shard writes the trie of its paths as balanced parentheses, two bits a node in depth-first order, over which
blocks keep the smallest excess; ``findclose`` climbs these to delimit a subtree, leaves are pairs "()"
counted by rank, members and savings are differences of cumulative arrays.

The paths at a shard's borders are shared with its neighbours: their nodes (the spine) lie in several
shards. A node counts itself only in the first shard that holds it, so the merge of spines is a plain sum.

Defined results: turns of a null conversation are left out; turns are in order of ``turn``, nulls first, ties by
digest; null roles and texts are empty; repeated turns all count; no conversations give no nodes; other columns are not
read. A conversation's digests (20 bytes a turn) are held as one row.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.memory import tidy
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged

DIGEST = 16
BLOCK = 64
# Conversation ids that one piece of a node's list holds.
PIECE = 20_000
# Turns of a shard.
SHARD_TURNS = 100_000


class Parentheses:
    """Balanced parentheses with the smallest excess of each block, and of ever larger groups of blocks."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens.astype(bool)
        self.excess = np.cumsum(np.where(self.opens, 1, -1)).astype(np.int64)
        n = len(opens)
        padded = np.pad(self.excess, (0, -n % BLOCK), constant_values=n + 1)
        self.least = [padded.reshape(-1, BLOCK).min(axis=1)] if n else [np.zeros(0, np.int64)]
        while len(self.least[-1]) > 1:
            low = self.least[-1]
            low = np.pad(low, (0, len(low) % 2), constant_values=n + 1)
            self.least.append(low.reshape(-1, 2).min(axis=1))
        pairs = np.zeros(n + 1, np.int64)
        if n:
            pairs[1:n] = np.cumsum(self.opens[:-1] & ~self.opens[1:])
            pairs[n] = pairs[n - 1]
        self.pairs = pairs
        self.padded = padded

    def rank_open(self) -> np.ndarray:
        """Opening parentheses before each place (one more than places)."""
        return np.concatenate([[0], np.cumsum(self.opens)])

    def leaf_pairs(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pairs "()" that begin at ``begin`` or later and end before ``end``."""
        return self.pairs[np.maximum(end - 1, 0)] - self.pairs[begin]

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The places of the parentheses that close those at ``at``: the first behind with a smaller excess."""
        target = self.excess[at]
        out = np.full(len(at), -1, np.int64)
        # The rest of its own block.
        block = at // BLOCK
        grid = self.padded.reshape(-1, BLOCK)
        column = np.arange(BLOCK)
        for some in np.array_split(np.arange(len(at)), max(len(at) // 8192, 1)):
            below = (grid[block[some]] < target[some, None]) & (column[None, :] > (at[some] % BLOCK)[:, None])
            hit = below.any(axis=1)
            out[some[hit]] = block[some[hit]] * BLOCK + below[hit].argmax(axis=1)
        left = np.flatnonzero(out < 0)
        if not len(left):
            return out
        # Up to the first group on the right whose smallest excess is below, then down to its first such block.
        node, level = block[left], np.zeros(len(left), np.int64)
        going = np.ones(len(left), bool)
        for height, low in enumerate(self.least):
            right = node + 1
            ok = going & (node % 2 == 0) & (right < len(low))
            ok[ok] = low[right[ok]] < target[left[ok]]
            node[ok], level[ok] = right[ok], height
            going &= ~ok
            node[going] //= 2
        for height in range(len(self.least) - 1, 0, -1):
            here = np.flatnonzero(level == height)
            if len(here):
                first = node[here] * 2
                low = self.least[height - 1]
                node[here] = np.where(low[first] < target[left[here]], first, first + 1)
                level[here] = height - 1
        for some in np.array_split(np.arange(len(left)), max(len(left) // 8192, 1)):
            below = grid[node[some]] < target[left[some], None]
            out[left[some]] = node[some] * BLOCK + below.argmax(axis=1)
        return out


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a role and a text; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each a digest and the code points of its text."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"), turn_digest(F.col("role"), F.col("text")).alias("digest"),
            F.char_length(F.coalesce(F.col("text"), F.lit(""))).alias("points"),
        ).alias("turn"),
    )
    turns = F.sort_array(F.collect_list("turn"))
    return rows.groupBy("conv_id").agg(
        F.transform(turns, lambda t: F.struct(t["digest"].alias("digest"), t["points"].alias("points"))).alias("turns")
    )


def _path(turns: Column) -> Column:
    """All digests of a conversation, one behind another."""
    return F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""))


@tidy
def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lists of ids of rows sorted by key and id: whether a piece holds its key's first and last row in this task."""
    task = TaskContext.get().partitionId()
    key, ids, piece, first = None, [], 0, True
    out: list[tuple] = []

    def flush(last: bool) -> None:
        nonlocal ids, piece
        out.append((key, task, piece, ids[0], len(ids), ",".join(map(str, ids)), first, last))
        ids, piece = [], piece + 1

    for batch in batches:
        for k, i in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if k != key:
                if key is not None:
                    flush(False)
                    first = False
                key, piece = k, 0
            elif len(ids) >= PIECE:
                flush(False)
            ids.append(i)
        if len(out) >= 1000:
            yield _piece_batch(out)
            out = []
    if key is not None:
        flush(True)
    yield _piece_batch(out)


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["key", "task", "piece", "conv_id", "n", "ids", "at_first", "at_last"]
    types = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


@tidy
def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's whole list, from pieces sorted by key, task and piece."""
    key = digest = None
    smallest = n = 0
    out: list[tuple] = []

    def batch_of() -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["key", "conv_id", "n", "ends_sha256"]
        )

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("key", "conv_id", "n", "ids"))
        for k, i, m, ids in zip(*columns):
            if k != key:
                if key is not None:
                    out.append((key, smallest, n, digest.hexdigest()))
                key, digest, smallest, n = k, hashlib.sha256(), i, 0
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += m
        if len(out) >= 10_000:
            yield batch_of()
            out = []
    if key is not None:
        out.append((key, smallest, n, digest.hexdigest()))
    yield batch_of()


def distinct_paths(conversations: DataFrame) -> DataFrame:
    """path, points of its turns, conv_id (the smallest), n and ends_sha256 of every distinct whole conversation.

    ``conversations`` has conv_id (one row each) and turns as of ``digested``. Rows are sorted by path and id in even
    ranges, so a path that very many share is worked on by several tasks; only the
    pieces of lists that cross a border between tasks are brought together, and hashed piece by piece.
    """
    rows = conversations.select(
        "conv_id", _path(F.col("turns")).alias("path"), F.col("turns.points").alias("points")
    ).withColumn("key", F.unhex(F.md5("path")))
    rows = staged(rows, "trie-paths")
    laid = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = staged(
        laid.mapInArrow(
            _grouped, "key binary, task long, piece long, conv_id long, n long, ids string, at_first boolean, at_last boolean"
        ),
        "trie-members",
    )
    schema = "key binary, conv_id long, n long, ends_sha256 string"
    several = (F.col("piece") > 0) | F.col("at_first") | F.col("at_last")
    # Pieces behind a key's first one, or at a task's border, name the keys of several pieces.
    crossing = pieces.where(several).select(F.col("key").alias("_key")).distinct()
    marked = pieces.join(broadcast_if_small(crossing), F.col("key") == F.col("_key"), "left")
    alone = marked.where("_key is null").select("key", "conv_id", "n", F.sha2("ids", 256).alias("ends_sha256"))
    joined = (
        marked.where("_key is not null").drop("_key").repartition("key").sortWithinPartitions("key", "task", "piece")
        .select("key", "conv_id", "n", "ids").mapInArrow(_hashed, schema)
    )
    found = alone.unionByName(joined).withColumnsRenamed({"conv_id": "_first", "key": "_found"})
    paths = rows.join(found, (F.col("conv_id") == F.col("_first")) & (F.col("key") == F.col("_found")))
    return paths.select("path", "points", "conv_id", "n", "ends_sha256")


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading digests two paths share."""
    whole = min(len(a), len(b)) // DIGEST * DIGEST
    x, y = np.frombuffer(a[:whole], np.uint64).reshape(-1, 2), np.frombuffer(b[:whole], np.uint64).reshape(-1, 2)
    apart = (x != y).any(axis=1)
    return int(apart.argmax()) if apart.any() else whole // DIGEST


def shard_nodes(
    paths: list[bytes], points: list[list[int]], ids: list[int], members: list[int], before: bytes | None, after: bytes | None
) -> dict[str, np.ndarray]:
    """The trie of ascending distinct paths as arrays over its nodes in depth-first order.

    ``before`` and ``after`` are the neighbouring shards' last and first paths (None at the ends). Counts and sums are
    of this shard alone; ``own`` is false for nodes that an earlier shard holds, ``spine`` true for all
    that another shard holds too.
    """
    depth, weight, path_of, node_of_path, opens = [0], [0], [0], [], [1]
    stack = [0]
    shared = [common_turns(a, b) for a, b in zip(paths, paths[1:])]
    for i, path in enumerate(paths):
        keep = 0 if i == 0 else shared[i - 1]
        while len(stack) - 1 > keep:
            opens.append(0)
            stack.pop()
        for d in range(len(stack), len(path) // DIGEST + 1):
            stack.append(len(depth))
            opens.append(1)
            depth.append(d)
            weight.append(points[i][d - 1])
            path_of.append(i)
        node_of_path.append(stack[-1])
    opens += [0] * len(stack)
    depth, weight, path_of = np.array(depth), np.array(weight, np.int64), np.array(path_of)
    tree = Parentheses(np.array(opens, bool))
    begin = np.flatnonzero(tree.opens)
    end = tree.findclose(begin) + 1
    # Subtrees are ranges of nodes in depth-first order.
    ranks = tree.rank_open()
    low, high = ranks[begin], ranks[end]
    n = len(depth)
    ends = np.zeros(n, np.int64)
    ends[node_of_path] = members
    smallest = np.full(n, np.iinfo(np.int64).max)
    smallest[node_of_path] = ids
    n_convs = _sums(ends, low, high)
    conv_id = _least(smallest, low, high)
    own = np.ones(n, bool)
    spine = np.zeros(n, bool)
    if before is not None:
        held = common_turns(before, paths[0])
        left = (path_of == 0) & (depth <= held)
        own[left], spine[left] = False, True
    leaves = tree.leaf_pairs(begin, end)
    if after is not None:
        held = common_turns(paths[-1], after)
        right = _line(depth, held)
        spine[right] = True
        if held * DIGEST == len(paths[-1]):
            # The next shard goes on from the last node, which is no leaf then.
            leaves[right] -= 1
    # Each member saves a text's code points, but for one copy of the node.
    saved = _sums(n_convs * weight - np.where(own, weight, 0), low, high)
    parent = _parents(depth)
    children = np.zeros(n, np.int64)
    has = parent >= 0
    np.add.at(children, parent[has & own], 1)
    return {
        "depth": depth, "conv_id": conv_id, "n_convs": n_convs, "n_children": children,
        "n_leaves": leaves, "saved_tokens": saved, "parent": parent, "spine": spine,
        "path": path_of, "ends": node_of_path,
    }


def _sums(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(values)])
    return upto[high] - upto[low]


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest value of each range, from tables of ranges of 1, 2, 4 … places."""
    tables = [values]
    while 2 << (len(tables) - 1) <= len(values):
        half = 1 << (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    level = np.frexp((high - low).astype(float))[1] - 1
    out = np.empty(len(low), np.int64)
    for k, table in enumerate(tables):
        some = level == k
        out[some] = np.minimum(table[low[some]], table[high[some] - (1 << k)])
    return out


def _line(depth: np.ndarray, held: int) -> np.ndarray:
    """The nodes of depth up to ``held`` above and on the last path, in depth-first order the last of each depth."""
    last = np.full(held + 1, -1, np.int64)
    some = np.flatnonzero(depth <= held)
    np.maximum.at(last, depth[some], some)
    return last[last >= 0]


def _parents(depth: np.ndarray) -> np.ndarray:
    out, last = np.full(len(depth), -1, np.int64), []
    for i, d in enumerate(depth.tolist()):
        if d:
            out[i] = last[d - 1]
        del last[d:]
        last.append(i)
    return out


NODES = (
    "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, spine boolean, below_spine boolean"
)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _shards(borders: dict[int, tuple[bytes, bytes]]):
    """``borders`` holds the first and last path of every task that has rows."""
    tasks = sorted(borders)
    neighbours = {
        t: (borders[tasks[i - 1]][1] if i else None, borders[tasks[i + 1]][0] if i + 1 < len(tasks) else None)
        for i, t in enumerate(tasks)
    }

    @tidy
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                shard = row["shard"]
                if shards and shard not in shards:
                    (done, rows), = shards.items()
                    yield from _node_batches(rows, *neighbours[done])
                    shards = {}
                shards.setdefault(shard, []).append(row)
        for done, rows in shards.items():
            yield from _node_batches(rows, *neighbours[done])

    return nodes


def _node_batches(rows: list[dict], before: bytes | None, after: bytes | None) -> Iterator[pa.RecordBatch]:
    paths = [r["path"] for r in rows]
    found = shard_nodes(paths, [r["points"] for r in rows], [r["conv_id"] for r in rows], [r["n"] for r in rows], before, after)
    depth, parent, spine, path_of = found["depth"], found["parent"], found["spine"], found["path"]
    n = len(depth)
    below = np.zeros(n, bool)
    inner = parent >= 0
    below[inner] = spine[parent[inner]]
    digests = [NO_ENDS] * n
    for at, r in zip(found["ends"], rows):
        digests[at] = r["ends_sha256"]
    # Only the spine and its children need keys to be brought together.
    key = lambda i: hashlib.md5(paths[path_of[i]][: int(depth[i]) * DIGEST]).digest() + int(depth[i]).to_bytes(8, "big")
    keys = [key(i) if spine[i] else None for i in range(n)]
    parent_keys = [keys[parent[i]] if below[i] else None for i in range(n)]
    parents = np.where(inner, found["conv_id"][np.maximum(parent, 0)], 0)
    columns = [
        pa.array(keys, pa.binary()), pa.array(parent_keys, pa.binary()), pa.array(found["conv_id"]), pa.array(depth),
        pa.array(parents, mask=~inner | below), *(pa.array(found[c]) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
        pa.array(digests, pa.string()), pa.array(spine), pa.array(below),
    ]
    names = [part.split()[0] for part in NODES.split(", ")]
    table = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, n, 10_000):
        yield table.slice(at, 10_000)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    ``conversations`` has conv_id (one row each) and turns as of ``digested``; it is read twice.
    """
    paths = distinct_paths(conversations)
    turns = conversations.agg(F.coalesce(F.sum(F.size("turns") + 1), F.lit(0))).first()[0]
    laid = paths.repartitionByRange(turns // SHARD_TURNS + 1, "path").sortWithinPartitions("path").withColumn("shard", F.spark_partition_id())
    laid = staged(laid, "trie-shards")
    # Two paths a task.
    ends = laid.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).collect()
    borders = {r["shard"]: (bytes(r["first"]), bytes(r["last"])) for r in ends}
    # A file may be read in portions, and portions of several files by one task, so shards are dealt anew.
    dealt = laid.repartitionByRange(max(len(borders), 1), "shard").sortWithinPartitions("shard", "path")
    nodes = staged(dealt.mapInArrow(_shards(borders), NODES), "trie-nodes")
    apart = nodes.where("not spine")
    spine = nodes.where("spine").groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.min("parent_conv_id").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "saved_tokens")],
        F.sum("n_leaves").alias("n_leaves"), F.max(F.when(F.col("ends_sha256") != NO_ENDS, F.col("ends_sha256"))).alias("ends_sha256"),
    )
    spine = staged(spine, "trie-spine")
    side = broadcast_if_small(spine.select(F.col("key").alias("_key"), F.col("conv_id").alias("_conv")))
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = spine.select(*columns, "parent_key", "parent_conv_id", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    both = apart.select(*columns, "parent_key", "parent_conv_id", "ends_sha256").unionByName(merged)
    found = both.join(side, F.col("parent_key") == F.col("_key"), "left")
    return found.select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "_conv").alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
    )
