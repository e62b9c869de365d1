import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import periodic, queries


def plain_runs(words, min_exponent=4, min_words=6):
    """Every period alone: stretches that cannot grow, then the smallest period of each."""
    n, found = len(words), {}
    for p in range(1, n // min_exponent + 1):
        x = p
        while x < n:
            if words[x] != words[x - p]:
                x += 1
                continue
            low = x
            while x < n and words[x] == words[x - p]:
                x += 1
            if x - low + p >= max(min_words, min_exponent * p):
                found.setdefault((low - p, x), p)
    return sorted((a, b, p) for (a, b), p in found.items())


def tuples(runs):
    return [tuple(r) for r in runs.tolist()]


@st.composite
def repetitive(draw):
    words = []
    for _ in range(draw(st.integers(0, 4))):
        root = draw(st.lists(st.integers(0, 3), min_size=1, max_size=9))
        words += (root * draw(st.integers(1, 9)))[: draw(st.integers(1, 60))]
    return words


@given(repetitive(), st.sampled_from([(2, 2), (3, 3), (4, 6)]))
@settings(deadline=None, max_examples=300)
def test_runs_equal_every_period(words, limits):
    exponent, least = limits
    got = periodic.runs_of(np.array(words, np.uint64), min_exponent=exponent, min_words=least)
    assert tuples(got) == plain_runs(words, exponent, least)


@given(repetitive(), st.lists(st.integers(1, 40), max_size=8))
@settings(deadline=None, max_examples=200)
def test_portions_do_not_matter(words, portions):
    catchers, at = periodic.Catchers(), 0
    for n in portions:
        catchers.append(np.array(words[at : at + n], np.uint64))
        at += n
    catchers.append(np.array(words[at:], np.uint64))
    assert tuples(catchers.finish()) == plain_runs(words)


def test_word_by_word():
    words = [1, 2, 3] * 7 + [9] * 20 + [5, 6] * 4 + [1]
    catchers = periodic.Catchers()
    for w in words:
        catchers.append(np.array([w], np.uint64))
    assert tuples(catchers.finish()) == plain_runs(words) == [(0, 21, 3), (21, 41, 1), (41, 49, 2)]


def test_long_periods_and_one_word():
    rng = random.Random(3)
    root = [rng.randrange(10**6) for _ in range(777)]
    words = [7, 8] + root * 5 + root[:100] + [1] * 5000
    assert tuples(periodic.runs_of(np.array(words, np.uint64))) == [(2, 2 + 777 * 5 + 100, 777), (2 + 777 * 5 + 100, len(words), 1)]


@given(st.lists(repetitive(), max_size=12))
@settings(deadline=None, max_examples=60)
def test_many_texts_at_once(texts):
    found = periodic.runs_of_all([np.array(t, np.int64) for t in texts])
    assert [tuples(f) for f in found] == [plain_runs(t) for t in texts]


def test_collapsed():
    words = "a b a b a b a b c".split()
    runs = periodic.runs_of(np.array([0, 1] * 4 + [2], np.uint64))
    assert tuples(runs) == [(0, 8, 2)]
    assert [w for w, k in zip(words, periodic.collapsed(9, runs)) if k] == ["a", "b", "c"]


def brute(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words) if n < 3000 else [(0, n, 1)]
    kept = [w for i, w in enumerate(words) if not any(a + q <= i < b for a, b, q in runs)]
    best = min(((a - b, a, q) for a, b, q in runs), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    listed = "".join(f"{a},{b - a},{q}\n" for a, b, q in runs).encode()
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *first, sha(listed), sha(b" ".join(kept)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("columns", [("doc_id", "text")])
def test_query_equals_brute_force(spark, tmp_path, docs, columns):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*columns).where("length(text) < 6000")
    more = docs.select(*columns).where("doc_id is null or doc_id <> 7")
    table.unionByName(more).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["op12_periodic"](spark, str(tmp_path))
    assert tuple(got.columns) == COLUMNS
    rows = table.unionByName(more).collect()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((brute(*r) for r in rows), key=repr)


def test_awkward_documents(spark, docs, no_docs):
    assert periodic.periodic_runs(no_docs).collect() == []
    found = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["collapsed"]) for r in periodic.periodic_runs(docs).collect()}
    assert (7, 1, 0, 40_000, 1, "word") in found
    assert (4, 0, None, None, None, "") in found and (6, 0, None, None, None, "") in found
    assert (8, 0, None, None, None, "one") in found
