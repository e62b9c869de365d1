import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from labelmill.llm import hashing, queries, superminhash
from labelmill.llm.components import connected_components
from labelmill.llm.superminhash import Near


@pytest.mark.parametrize("n", [1, 3, 20, 60])
def test_signatures_equal_the_sequential_rule(n):
    slots, elements = 24, np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    want = [float("inf")] * slots
    for e in elements:
        order = list(range(slots))
        for step in range(slots):
            draw = superminhash._draw(np.array([e], np.uint64), step)
            k = int(superminhash._swap(draw, step, slots)[0])
            order[step], order[k] = order[k], order[step]
            want[order[step]] = min(want[order[step]], float(superminhash._offer(draw, step)[0]))
    assert superminhash.signatures(elements, np.zeros(n, np.int32), 1, slots)[0].tolist() == want


def test_word_hashes_split_and_fold_like_bytes(monkeypatch):
    monkeypatch.setattr(hashing, "SLICE", 16)
    random.seed(3)
    texts = [None, "", *["".join(random.choices("aAbB éÉ\t\n\x0b\x1c ", k=random.randint(0, 40))) for _ in range(300)], "z" * 100]
    words = [(i, w) for i, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    hashes, rows = hashing.word_hashes(pa.array(texts))
    assert rows.tolist() == [i for i, _ in words]
    names = {}
    for h, (_, w) in zip(hashes.tolist(), words):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def brute(rows, near):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        k = near.width
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for e in s:
            holders[e].append(i)
    pairs = {(i, j) for h in holders.values() for i in h for j in h if j < i}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= near.percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in least.items()}
    return sorted(((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def test_whole_table_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in queries.table(spark, sf, "documents").collect()]
    got = queries.op10_superminhash(spark, sf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, Near(width=2))


def test_chains_near_the_threshold_and_a_shared_passage(spark):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefgh", k=6))
    passage = [word() for _ in range(50)]
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):
        text = list(base)
        for at in random.sample(range(120), random.randint(1, 9)):
            text[at] = word()
        rows.append((i, " ".join(text)))
    rows += [(100 + i, " ".join(passage + [word() for _ in range(random.randint(5, 90))])) for i in range(80)]
    chain = [word() for _ in range(100)]
    for i in range(12):
        rows.append((300 + i, " ".join(chain)))
        chain[random.randrange(100)] = word()
        chain[random.randrange(100)] = word()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for near in (Near(width=2), Near()):
        got = superminhash.near_duplicates(df, near).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows, near)


def test_awkward_rows(docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = superminhash.near_duplicates(docs).collect()
    # Rows without words are groups of their own; the others are grouped as by hand.
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, Near())
    assert superminhash.near_duplicates(no_docs).collect() == []


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (None, 3), (60, 61), (60, 62), (60, 63)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 50, 50: 50, **{i: 60 for i in range(60, 64)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
