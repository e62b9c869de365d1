import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.compare import compare, duck
from labelmill.llm import prefixtrie, queries, sql
from labelmill.llm.prefixtrie import Parentheses

SCHEMA = "conv_id long, turn long, role string, text string, key string, shard int, n_convs int"


@given(st.lists(st.integers(0, 6), max_size=400))
@settings(deadline=None)
def test_findclose_equals_a_stack(steps):
    opens, depth = [1], 1
    for s in steps:
        down = min(s % 4, depth - 1)
        opens += [0] * down + [1]
        depth += 1 - down
    opens += [0] * depth
    tree, stack, want = Parentheses(np.array(opens, bool)), [], {}
    for i, o in enumerate(opens):
        if o:
            stack.append(i)
        else:
            want[stack.pop()] = i
    at = np.flatnonzero(tree.opens)
    end = tree.findclose(at)
    assert end.tolist() == [want[i] for i in at.tolist()]
    pairs = ["".join(map(str, opens[a : b + 1])).count("10") for a, b in zip(at.tolist(), end.tolist())]
    assert tree.leaf_pairs(at, end + 1).tolist() == pairs


def test_findclose_over_many_blocks():
    opens = np.array([1] * 5000 + [0] * 5000, bool)
    assert Parentheses(opens).findclose(np.arange(5000)).tolist() == list(range(9999, 4999, -1))


def brute(rows):
    """Nodes by walking every conversation; rows are (conv_id, turn, role, text)."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0, digest, len(text)), role, text))
    paths = {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in convs.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            if d:
                kids[tuple(path[: d - 1])].add(tuple(path[:d]))
        ends[tuple(path)].append(c)
    out = []
    for node, convs_in in members.items():
        below, leaves, saved = [node], 0, 0
        while below:
            v = below.pop()
            below += kids[v]
            leaves += not kids[v]
            saved += (len(members[v]) - 1) * (len(v[-1][1]) if v else 0)
        listed = ",".join(map(str, sorted(ends[node]))).encode()
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs_in), len(node), parent, len(convs_in), len(kids[node]), leaves, saved, hashlib.sha256(listed).hexdigest()))
    return sorted(out, key=repr)


def made(seed, convs, longest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b é", "", None]) if t < 4 else f"{t}{rng.random()}"))
    # Many copies of one conversation, nulls, ties and repeated rows.
    rows += [(10_000 + c, t, "user", "copy") for c in range(300) for t in range(3)]
    rows += [(None, 1, "user", "x"), (20_000, None, "user", "first"), (20_000, 0, None, None), (20_001, 1, "b", "x"), (20_001, 1, "a", "x")]
    rows += [(20_002, 5, "user", "a"), (20_002, 5, "user", "a"), (-7, 0, "user", "w" * 100_000)]
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)


@pytest.mark.parametrize("shard, piece", [(100_000, 20_000), (40, 7)])
def test_nodes_equal_brute_force(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", shard)
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    rows = made(1, 120, 7)
    got = prefixtrie.trie(prefixtrie.digested(table(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_paths_that_go_on_in_the_next_shard(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SHARD_TURNS", 3)
    rows = [(c, t, "u", "same") for c in range(30) for t in range(c + 1)]
    got = prefixtrie.trie(prefixtrie.digested(table(spark, rows)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_empty(spark):
    assert prefixtrie.trie(prefixtrie.digested(table(spark, []))).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    turns = "array<struct<digest: binary, points: int>>"
    rows = spark.createDataFrame([(3, []), (1, []), (2, [(b"x" * 16, 5)])], f"conv_id long, turns {turns}")
    nodes = {tuple(r) for r in prefixtrie.trie(rows).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert nodes == {(1, 0, None, 3, 1, 1, 0, sha(b"1,3")), (2, 1, 1, 1, 0, 1, 0, sha(b"2"))}


def test_query_equals_sql(spark, tmp_path):
    table(spark, made(2, 250, 9)).withColumn("conv_id", F.col("conv_id") - 3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    ok, message = compare(spark, con, str(tmp_path), "op13", queries.QUERIES["op13_prefixtrie"], sql.ORACLES["op13_prefixtrie"])
    assert ok, message
