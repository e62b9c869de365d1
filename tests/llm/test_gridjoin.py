import numpy as np
import pytest

from labelmill.llm import gridjoin

SCHEMA = "vec_id long, embedding array<float>, label int, copies int, block string"


def brute(rows, cosine):
    usable = [
        r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])
    ]
    out = [(r[0], 0, r[0], True) for r in rows if r not in usable]
    unit = [np.array(r[1], np.float32).astype(float) for r in usable]
    unit = [v / np.abs(v).max() for v in unit]
    unit = [v / np.sqrt(v @ v) for v in unit]
    parent = list(range(len(usable)))
    links = [0] * len(usable)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(usable)):
        for j in range(i):
            if usable[i][2] == usable[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(usable):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    out += [(r[0], links[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(usable)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base, out = rng.normal(size=(12, 16)), []
    for i in range(180):
        v = base[rng.integers(12)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.35])
        out.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 1e-3, 50])], int(rng.integers(2))))
    odd = [None, [0.0] * 16, [float("nan")] * 16, [], [1.0, None] * 8, [float("inf")] + [0.0] * 15]
    out += [(900 + i, v, 1) for i, v in enumerate(odd)]
    out += [(910, out[0][1], None), (911, out[5][1], out[5][2]), (912, out[5][1], out[5][2]), (913, [float(np.float32(1e30))] * 16, 0)]
    out += [(914, [1.0, 2.0], 0), (915, [2.0, 4.0], 0), (916, [-0.0, 1.0], 0), (917, [0.0, 1.0], 0)]
    return out


@pytest.mark.parametrize("grid", [gridjoin.Grid(), gridjoin.Grid(block=16, run=4, fan=2, axes=3)])
def test_same_as_all_pairs(spark, rows, grid):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in gridjoin.similar_vectors(df, grid).collect())
    assert got == brute(rows, grid.cosine)


def test_empty(spark):
    assert gridjoin.similar_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
