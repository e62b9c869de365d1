"""Epsilon grid order join of embeddings.

Unit vectors of cosine ``c`` or more lie within epsilon = sqrt(2 - 2c) of each other, and so do
their projections on any orthonormal axes. Vectors are projected on the leading principal axes,
laid on a grid of epsilon wide cells and sorted by label and cells (the epsilon grid order). The
sorted sequence is cut into blocks; intervals of the sequence are joined recursively from its two
halves' ancestors down to blocks, and a pair of intervals whose bounding boxes are further apart
than epsilon on any axis (or whose labels do not meet) is skipped with all it holds. Within a block
pair the recursion goes on to short runs, whose cosines are one matrix product; those near the
threshold are decided in double precision.

The recursion over intervals is a join of the table of bounding boxes per level, so pairs of blocks
are never listed on the driver. A block pair returns a number of links per vector and, instead of its
links, a spanning forest of them, so a dense group costs products but no rows. Equal vectors are
one member with a count.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components, and rows without a label,
link with nothing; vectors of other lengths than the most common one's are joined among their own
length; repeated ids are separate vectors and their component is named by the id; an empty table gives an empty result; other
columns are not read.
"""

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.components import connected_components
from labelmill.llm.skew import spread_join
from labelmill.operators.numbering import number_rows
from labelmill.staging import staged


@dataclass(frozen=True)
class Grid:
    """Links from ``cosine``; ``axes`` leading principal axes; ``block`` vectors a block, ``run`` in its shortest runs."""

    cosine: float = 0.93
    axes: int = 6
    block: int = 1024
    run: int = 256
    fan: int = 8

    @property
    def epsilon(self) -> float:
        # A little wider, for the rounding of projections.
        return math.sqrt(2 - 2 * self.cosine) + 1e-6


def _unit(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the usable rows, and their vectors in double precision."""
    good, vectors = [], []
    labels = batch.column("label")
    for i, v in enumerate(batch.column("embedding")):
        if not v.is_valid or not labels[i].is_valid or not len(v.values) or v.values.null_count:
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all() and x.any():
            good.append(i)
            vectors.append(x)
    return np.array(good, np.int64), vectors


def _normal(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither huge nor tiny components leave the range of squares.
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


CLEAN = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("vector", pa.binary())])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good, vectors = _unit(batch)
        rows = batch.take(pa.array(good))
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("vec_id"), rows.column("label"), pa.array([len(v) for v in vectors], pa.int32()),
                # Minus zero is zero: equal vectors have equal bytes.
                pa.array([(v + 0.0).tobytes() for v in vectors], pa.binary()),
            ],
            schema=CLEAN,
        )


def _gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        by_length: dict[int, list[bytes]] = {}
        for d, v in zip(batch.column("dims").to_pylist(), batch.column("vector").to_pylist()):
            by_length.setdefault(d, []).append(v)
        for d, raw in by_length.items():
            x = _normal(np.frombuffer(b"".join(raw)).reshape(-1, d))
            sums[d] = sums.get(d, 0) + x.T @ x
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([g.tobytes() for g in sums.values()], pa.binary())], ["dims", "gram"]
    )


def principal_axes(vectors: DataFrame, axes: int) -> dict[int, np.ndarray]:
    """Leading principal axes (dims x axes) per vector length, from the sum of outer products of all vectors."""
    parts = vectors.select("dims", "vector").mapInArrow(_gram, "dims int, gram binary")

    # Sums of sums: a few matrices per task meet, length by length.
    def add(key, frame):
        import pandas as pd

        total = sum(np.frombuffer(g) for g in frame["gram"])
        return pd.DataFrame({"dims": [int(key[0])], "gram": [np.asarray(total).tobytes()]})

    found = {}
    for row in parts.groupBy("dims").applyInPandas(add, "dims int, gram binary").toLocalIterator():
        d = row["dims"]
        # A fixed sign keeps reruns alike.
        _, v = np.linalg.eigh(np.frombuffer(row["gram"]).reshape(d, d))
        found[d] = v[:, ::-1][:, :axes]
    return found


def _cells(axes: dict[int, np.ndarray], grid: Grid):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, grid.axes), np.int64)
            for i, (d, v) in enumerate(zip(batch.column("dims").to_pylist(), batch.column("vector").to_pylist())):
                p = _normal(np.frombuffer(v)) @ axes[d]
                out[i, : len(p)] = np.floor(p / grid.epsilon)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, out.size + 1, grid.axes), pa.int32()), pa.array(out.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "cells"])

    return cells


def _boxes(axes: dict[int, np.ndarray], grid: Grid):
    """A block of the sorted sequence as one row: its vectors and its bounding box."""

    def pack(key, frame):
        import pandas as pd

        frame = frame.sort_values("place")
        out = []
        # A block at the border of two labels or lengths is cut there.
        for (label, d), part in frame.groupby(["label", "dims"], sort=True):
            x = _normal(np.frombuffer(b"".join(part["vector"])).reshape(-1, d))
            p = np.zeros((len(x), grid.axes))
            p[:, : axes[d].shape[1]] = x @ axes[d]
            out.append(
                {
                    "label": label, "dims": d, "block": int(key[0]), "first": int(part["place"].iloc[0]), "n": len(x),
                    "vectors": x.tobytes(), "places": part["place"].to_numpy(np.int64).tobytes(),
                    "copies": part["copies"].to_numpy(np.int64).tobytes(),
                    "lo": p.min(axis=0).tolist(), "hi": p.max(axis=0).tolist(),
                }
            )
        return pd.DataFrame(out)

    return pack


BLOCK_SCHEMA = (
    "label string, dims int, block long, first long, n int, vectors binary, places binary, copies binary, "
    "lo array<double>, hi array<double>"
)


def _near(a: str, b: str, epsilon: float) -> Column:
    """Whether two boxes are within epsilon on every axis."""
    apart = lambda x, y: F.exists(F.zip_with(f"{x}.lo", f"{y}.hi", lambda lo, hi: lo - hi), lambda d: d > epsilon)
    return ~apart(a, b) & ~apart(b, a)


def block_pairs(boxes: DataFrame, grid: Grid) -> DataFrame:
    """Pairs (a <= b) of block numbers whose boxes are within epsilon; by recursion over sequence intervals.

    ``boxes`` has label, dims, at (contiguous from 0 in sequence order), lo, hi. Level k joins intervals
    of fan**k blocks; each pair that is not skipped is opened into the pairs of its parts.
    """
    kind = [F.col("label"), F.col("dims")]
    last = boxes.agg(F.max("at")).first()[0]
    depth = 0
    while last is not None and grid.fan**depth <= last:
        depth += 1
    corners = [F.min(F.col("lo")[i]) for i in range(grid.axes)], [F.max(F.col("hi")[i]) for i in range(grid.axes)]
    pairs = None
    for level in range(depth, -1, -1):
        # Intervals end with a label, so an interval has one label's part of it.
        nodes = staged(
            boxes.groupBy(*kind, F.floor(F.col("at") / grid.fan**level).alias("node")).agg(
                F.array(*corners[0]).alias("lo"), F.array(*corners[1]).alias("hi")
            ),
            "intervals",
        ).withColumn("parent", F.floor(F.col("node") / grid.fan))
        if pairs is None:
            found = nodes.alias("x").join(
                nodes.alias("y"), (F.col("x.label") == F.col("y.label")) & (F.col("x.dims") == F.col("y.dims"))
            )
        else:
            up = pairs.alias("p")
            found = up.join(
                nodes.alias("x"),
                (F.col("p.label") == F.col("x.label")) & (F.col("p.dims") == F.col("x.dims")) & (F.col("p.a") == F.col("x.parent")),
            ).join(
                nodes.alias("y"),
                (F.col("p.label") == F.col("y.label")) & (F.col("p.dims") == F.col("y.dims")) & (F.col("p.b") == F.col("y.parent")),
            )
        found = found.where((F.col("x.node") <= F.col("y.node")) & _near("x", "y", grid.epsilon))
        pairs = staged(
            found.select(F.col("x.label").alias("label"), F.col("x.dims").alias("dims"), F.col("x.node").alias("a"), F.col("y.node").alias("b")),
            "interval-pairs",
        )
    return pairs


def _runs(x: np.ndarray, grid: Grid) -> list[tuple[int, int]]:
    return [(i, min(i + grid.run, len(x))) for i in range(0, len(x), grid.run)]


def links_of(x: np.ndarray, y: np.ndarray, same: bool, axes: np.ndarray, grid: Grid) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of the vectors of two blocks with cosine >= grid.cosine, run by run."""
    p, q = x @ axes, y @ axes
    xf, yf = x.astype(np.float32), y.astype(np.float32)
    for a, b in _runs(x, grid):
        lo, hi = p[a:b].min(axis=0), p[a:b].max(axis=0)
        for c, d in _runs(y, grid):
            if same and d <= a:
                continue
            if (q[c:d].min(axis=0) - hi > grid.epsilon).any() or (lo - q[c:d].max(axis=0) > grid.epsilon).any():
                continue
            i, j = np.nonzero(xf[a:b] @ yf[c:d].T >= grid.cosine - 1e-4)
            i, j = i + a, j + c
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            # Single precision only chooses; double precision decides.
            for at in range(0, len(i), 65_536):
                s, t = i[at : at + 65_536], j[at : at + 65_536]
                sure = np.einsum("ij,ij->i", x[s], y[t]) >= grid.cosine
                yield s[sure], t[sure]


class Forest:
    """Union-find over the members of two blocks; keeps the links that join two parts."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))


JOINED = pa.schema([("place", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])


def _join(axes: dict[int, np.ndarray], grid: Grid):
    """Rows (place, n, null): n links of a member; rows (place, null, other): a link of the forest."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                d, same = r["dims"], r["a"] == r["b"]
                x, y = (np.frombuffer(r[k]).reshape(-1, d) for k in ("xv", "yv"))
                xp, yp = np.frombuffer(r["xp"], np.int64), np.frombuffer(r["yp"], np.int64)
                xc, yc = np.frombuffer(r["xc"], np.int64), np.frombuffer(r["yc"], np.int64)
                nx, ny = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
                forest = Forest(len(x) + (0 if same else len(y)))
                shift = 0 if same else len(x)
                for i, j in links_of(x, y, same, axes[d], grid):
                    np.add.at(nx, i, yc[j])
                    np.add.at(nx if same else ny, j, xc[i])
                    forest.add(i, j + shift)
                places = xp if same else np.concatenate([xp, yp])
                counts = nx if same else np.concatenate([nx, ny])
                some = np.flatnonzero(counts)
                links = np.array(forest.links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([places[some], places[links[:, 0]]])),
                        pa.array([*counts[some].tolist(), *[None] * len(links)], pa.int64()),
                        pa.array([*[None] * len(some), *places[links[:, 1]].tolist()], pa.int64()),
                    ],
                    schema=JOINED,
                )

    return join


def similar_vectors(vectors: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``vectors`` (vec_id, embedding, label)."""
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("embedding")
    )
    clean = staged(rows.mapInArrow(_clean, "vec_id long, label string, dims int, vector binary"), "vectors")
    axes = principal_axes(clean, grid.axes)
    name = ["label", "dims", "vector"]
    classes = clean.groupBy(*name).agg(F.count("*").alias("copies"), F.min("vec_id").alias("smallest"))
    celled = classes.mapInArrow(
        _cells(axes, grid), "label string, dims int, vector binary, copies long, smallest long, cells array<bigint>"
    )
    order = ["label", "dims", *[f"_c{i}" for i in range(grid.axes)], "vector"]
    celled = celled.select("*", *[F.col("cells")[i].alias(f"_c{i}") for i in range(grid.axes)]).drop("cells")
    # The epsilon grid order.
    laid = staged(
        number_rows(celled, [], order, "place", start=0).drop(*[f"_c{i}" for i in range(grid.axes)]), "grid-order"
    )
    cut = laid.withColumn("block", F.floor(F.col("place") / grid.block))
    blocks = cut.groupBy("block").applyInPandas(_boxes(axes, grid), BLOCK_SCHEMA)
    blocks = staged(number_rows(blocks, [], ["first"], "at", start=0), "blocks")
    pairs = block_pairs(blocks.select("label", "dims", "at", "lo", "hi"), grid).select("dims", "a", "b")
    side = lambda p, at: blocks.select(
        F.col("at").alias(at), F.col("vectors").alias(f"{p}v"), F.col("places").alias(f"{p}p"), F.col("copies").alias(f"{p}c")
    )
    met = pairs.join(side("x", "a"), "a").join(side("y", "b"), "b")
    joined = staged(met.mapInArrow(_join(axes, grid), "place long, n long, other long"), "links")
    counts = joined.where(F.col("n").isNotNull()).groupBy("place").agg(F.sum("n").alias("near"))
    roots = connected_components(
        joined.where(F.col("other").isNotNull()).select(F.col("place").alias("a"), F.col("other").alias("b"))
    )
    members = (
        laid.join(counts, "place", "left")
        .join(roots.withColumnRenamed("node", "place"), "place", "left")
        .withColumn("root", F.coalesce("root", "place"))
        .withColumn("n_links", F.coalesce("near", F.lit(0)) + F.col("copies") - 1)
    )
    members = staged(members.select(*name, "root", "smallest", "n_links"), "members")
    least = members.groupBy(F.col("root").alias("_root")).agg(F.min("smallest").alias("component_id"))
    named = spread_join(members, least, "root", "_root", F.col("vector")).select(*name, "n_links", "component_id")
    key = F.xxhash64(*name)
    found = spread_join(
        staged(clean.withColumn("_key", key), "vectors"),
        named.select(*[F.col(c).alias(f"_{c}") for c in name], key.alias("_of"), "n_links", "component_id"),
        "_key", "_of", F.coalesce(F.col("vec_id"), F.lit(0)),
    ).where((F.col("vector") == F.col("_vector")) & (F.col("label") == F.col("_label")))
    found = found.select("vec_id", "n_links", "component_id")
    unusable = rows.mapInArrow(_others, "vec_id long").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return found.unionByName(unusable).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of the rows that ``_clean`` leaves out."""
    for batch in batches:
        out = np.ones(batch.num_rows, bool)
        good, _ = _unit(batch)
        out[good] = False
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(out))], ["vec_id"])
