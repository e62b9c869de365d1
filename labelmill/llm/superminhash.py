"""Near-duplicate documents by SuperMinHash signatures.

Each element of a set draws a random permutation of the signature's slots step by step; step j
offers j + r, with r random below 1, to slot j of the permutation, and a slot keeps its smallest
offer. The offers of one element differ between slots, so equal slots vary less than with
independent hashes. Offers of step j are at least j: a document stops as soon as no slot exceeds j.
All elements of a batch take a step together, in numpy.

Signatures are cut into bands; documents that share a band's values meet in a bucket. Equal sets
are folded first, so a text copied any number of times is one member. A bucket never makes all
pairs: its members are compared with a hub, the member that has the most company over all bands,
by exact Jaccard similarity of full sets, and confirmed links join components. Members of buckets
that still hold two components are then compared across components, with all that an exact prefix filter
over their full sets leaves, so the hubs lose no link.
With 40 bands of 5 a pair of similarity 0.8 misses all buckets with probability 1.3e-7.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing and
is its own component; fewer words than a shingle form one element; repeated ids are separate
documents, which are both kept if the id is its component's smallest; a null id is the smallest of
its component only if there is no other; an empty table gives an empty result.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.llm.components import connected_components
from labelmill.llm.hashing import U, mixed, shingle_hashes, text_buffers, word_hashes
from labelmill.llm.memory import tidy
from labelmill.llm.skew import spread_join
from labelmill.operators.sizes import broadcast_if_small
from labelmill.staging import staged


@dataclass(frozen=True)
class Near:
    """Shingles of ``width`` words; links from ``percent`` / 100 similarity; ``bands`` of ``rows`` slots."""

    width: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5

    @property
    def slots(self) -> int:
        return self.bands * self.rows


# Steps whose permutations are replayed from their draws; later ones belong to small sets and keep them whole.
REPLAYED = 8
# Text worked on at once; a longer document is a block of its own.
BLOCK_BYTES = 2 << 20


def _draw(elements: np.ndarray, step: int) -> np.ndarray:
    return mixed(elements ^ mixed(np.array([step + 1], np.uint64)))


def _swap(draw: np.ndarray, step: int, slots: int) -> np.ndarray:
    return ((draw >> U(40)) % U(slots - step)).astype(np.int64) + step


def _offer(draw: np.ndarray, step: int) -> np.ndarray:
    return (draw & U(0xFFFFFFFFFF)).astype(np.float64) / float(1 << 40) + step


def signatures(elements: np.ndarray, rows: np.ndarray, n: int, slots: int) -> np.ndarray:
    """n x slots signatures of the sets in ``elements``; ``rows`` (ascending) tells each one's set."""
    table = np.full(n * slots, np.inf)
    at, owner = elements, rows.astype(np.int64)
    swaps: list[np.ndarray] = []
    whole = None
    for step in range(slots):
        if step:
            # A set goes on while some slot could still get a smaller offer.
            going = table.reshape(n, slots).max(axis=1) > step
            mask = going[owner]
            if not mask.any():
                break
            if not mask.all():
                at, owner = at[mask], owner[mask]
                swaps = [s[mask] for s in swaps]
                whole = None if whole is None else whole[mask]
        draw = _draw(at, step)
        target = _swap(draw, step, slots)
        if step < REPLAYED:
            place = target.copy()
            for earlier in range(step - 1, -1, -1):
                place = np.where(place == swaps[earlier], earlier, place)
            # Place after undoing the swaps is the slot itself.
            swaps.append(target)
        else:
            lines = np.arange(len(at))
            if whole is None:
                whole = np.tile(np.arange(slots, dtype=np.int16), (len(at), 1))
                for earlier, swap in enumerate(swaps):
                    kept = whole[lines, earlier].copy()
                    whole[:, earlier] = whole[lines, swap]
                    whole[lines, swap] = kept
                swaps = []
            place = whole[lines, target].astype(np.int64)
            whole[lines, target] = whole[:, step]
            whole[:, step] = place
        np.minimum.at(table, owner * slots + place, _offer(draw, step))
    return table.reshape(n, slots)


def _band_keys(table: np.ndarray, near: Near) -> np.ndarray:
    bits = table.view(np.uint64).reshape(len(table), near.bands, near.rows)
    keys = np.broadcast_to(mixed(np.arange(near.bands, dtype=np.uint64)), (len(table), near.bands)).copy()
    for i in range(near.rows):
        keys = mixed(keys ^ bits[:, :, i])
    return keys


def set_blocks(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, sorted distinct elements, row of each) of blocks of whole documents."""
    offsets, _ = text_buffers(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        words, owner = word_hashes(column.slice(first, last - first))
        elements, rows = shingle_hashes(words, owner, width)
        order = np.lexsort((elements, rows))
        elements, rows = elements[order], rows[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (elements[1:] != elements[:-1]) | (rows[1:] != rows[:-1])
        yield first, last - first, elements[fresh], rows[fresh]
        first = last


def _names(elements: np.ndarray, edges: np.ndarray) -> list[bytes | None]:
    """A 128-bit name per set; null for an empty one."""
    import xxhash

    data = elements.tobytes()
    return [xxhash.xxh3_128_digest(data[8 * a : 8 * b]) if b > a else None for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _sketch(near: Near):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("keys", pa.list_(pa.int64()))])

    @tidy
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, n, elements, rows in set_blocks(batch.column("text"), near.width):
                sizes = np.bincount(rows, minlength=n)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                names = _names(elements, edges)
                keys = _band_keys(signatures(elements, rows, n, near.slots), near).view(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, (n + 1) * near.bands, near.bands), pa.int32()), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), lists], schema=schema
                )

    return sketch


def _sets(width: int):
    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, nodes = batch.column("set_id"), batch.column("node")
            for first, n, elements, rows in set_blocks(batch.column("text"), width):
                edges = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(elements.view(np.int64)))
                # A repeated id may bring other texts than the one that is wanted.
                wanted = pa.array([a == b for a, b in zip(_names(elements, edges), ids.slice(first, n).to_pylist())])
                yield pa.RecordBatch.from_arrays([nodes.slice(first, n), lists], ["node", "elements"]).filter(wanted)

    return sets


def _members(classes: DataFrame) -> DataFrame:
    """key, node, size, company: the buckets with two members or more."""
    keyed = classes.select("node", "size", F.explode("keys").alias("key"))
    shared = keyed.groupBy(F.col("key").alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > 1)
    rows = staged(keyed.join(shared, F.col("key") == F.col("_key")).drop("_key"), "buckets")
    company = rows.groupBy(F.col("node").alias("_node")).agg(F.sum("_n").alias("company"))
    return staged(rows.join(company, F.col("node") == F.col("_node")).drop("_node", "_n"), "buckets")


def _fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _full_sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """node and elements of the sets of ``nodes``; ``classes`` has node and doc_id of one document.

    The texts of these documents are read again, which is less than keeping the sets of all.
    """
    name = nodes.select(F.col("node").alias("_node")).distinct()
    wanted = staged(
        classes.join(name, F.col("node") == F.col("_node"), "left_semi").select("node", "set_id", "doc_id"), "wanted"
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))
    texts = docs.alias("d").join(broadcast_if_small(wanted).alias("w"), same).select("w.node", "w.set_id", "d.text")
    sets = texts.mapInArrow(_sets(near.width), "node long, elements array<bigint>")
    return staged(sets.dropDuplicates(["node"]), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    # A hub meets many members: its set is repeated for parts of them, never its pairs gathered in one task.
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(64)))
    hubs = pairs.select("b", "part").distinct().join(sets, F.col("b") == F.col("node")).select(
        F.col("b").alias("_b"), F.col("part").alias("_part"), F.col("elements").alias("of_b")
    )
    rows = pairs.join(sets, F.col("a") == F.col("node")).drop("node")
    rows = rows.join(hubs, (F.col("b") == F.col("_b")) & (F.col("part") == F.col("_part")))
    both = F.size(F.array_intersect("elements", "of_b"))
    union = F.size("elements") + F.size("of_b") - both
    return staged(rows.where(both * 100 >= union * near.percent).select("a", "b"), "similar")


def _star_pairs(members: DataFrame, near: Near) -> DataFrame:
    """Each bucket's members (a) with its hub (b)."""
    hubs = members.groupBy(F.col("key").alias("_key")).agg(F.max(F.struct("company", "node", "size")).alias("hub"))
    met = spread_join(members, hubs, "key", "_key", F.col("node")).where(
        (F.col("node") != F.col("hub.node")) & _fits(F.col("size"), F.col("hub.size"), near.percent)
    )
    return staged(met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), "candidates")


def _open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node and root of the members of buckets that still hold two components."""
    placed = (
        members.select("key", "node")
        .join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
        .select("key", "node", F.coalesce("root", "node").alias("root"))
    )
    placed = staged(placed, "placed")
    both = placed.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"))
    still = both.where(F.col("_lo") != F.col("_hi")).select(F.col("key").alias("_key"))
    return staged(
        placed.join(still, F.col("key") == F.col("_key"), "left_semi").select("node", "root").distinct(), "open-members"
    )


def _prefix_pairs(members: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """All pairs (a, b) of members in different components that can be similar enough, by exact prefix filtering.

    With the elements of every set in one order, rarest first, two sets x and y (x not larger) of
    similarity t share an element among the first n - ceil(2t / (1 + t) n) + 1 of x and the first
    n - ceil(t n) + 1 of y, and enough elements must remain after it in both. No pair is lost, and a
    passage that many texts share stands last in all of them.
    """
    t = near.percent
    rows = staged(sets.select("node", F.explode("elements").alias("e")), "elements")
    counts = rows.groupBy(F.col("e").alias("_e")).agg(F.count("*").alias("n"))
    counted = spread_join(rows, counts, "e", "_e", F.col("node"))
    ordered = counted.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("list"))
    named = ordered.join(members.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"))
    size = F.size("list")
    long = staged(
        named.select("node", "root", size.alias("size"), F.posexplode(F.slice("list", F.lit(1), size - F.ceil(size * t / 100).cast("int") + 1)))
        .select("node", "root", "size", F.col("pos"), F.col("col.e").alias("e")),
        "prefixes",
    )
    short = long.where(F.col("pos") < F.col("size") - F.ceil(F.col("size") * 2 * t / (100 + t)) + 1).select(
        *[F.col(c).alias(f"_{c}") for c in long.columns]
    )
    smaller = (F.col("_size") < F.col("size")) | ((F.col("_size") == F.col("size")) & (F.col("_node") < F.col("node")))
    left = 1 + F.least(F.col("_size") - F.col("_pos"), F.col("size") - F.col("pos")) - 1
    met = spread_join(long, short, "e", "_e", F.col("node")).where(
        (F.col("root") != F.col("_root"))
        & smaller
        & _fits(F.col("_size"), F.col("size"), t)
        & (left * (100 + t) >= (F.col("size") + F.col("_size")) * t)
    )
    return staged(met.select(F.col("node").alias("a"), F.col("_node").alias("b")).distinct(), "candidates")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links) and kept, per row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    sketches = staged(
        docs.mapInArrow(_sketch(near), "doc_id long, n_shingles long, set_id binary, keys array<bigint>"), "sketches"
    )
    # Null ids come last: a group of them alone has a null smallest id.
    first = F.struct(F.col("doc_id").isNull(), "doc_id")
    # Written once, a class has a number of its own, which travels instead of its name.
    classes = staged(
        sketches.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(F.min(first)["doc_id"].alias("doc_id"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    members = _members(classes)
    small = classes.drop("keys")
    stars = _star_pairs(members, near)
    nodes = stars.select(F.explode(F.array("a", "b")).alias("node"))
    links = _confirmed(stars, _full_sets(nodes, small, docs, near), near)
    roots = staged(connected_components(links), "roots")
    left = _open_members(members, roots)
    sets = _full_sets(left, small, docs, near)
    more = _confirmed(_prefix_pairs(left, sets, near), sets, near)
    # The components found so far stand for their links.
    links = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return _labelled(sketches, small, connected_components(links))


def _labelled(sketches: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    named = classes.select("node", "set_id", "doc_id").join(
        roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left"
    )
    named = named.select("node", "set_id", "doc_id", F.coalesce("root", "node").alias("root"))
    named = staged(named, "named")
    smallest = named.groupBy(F.col("root").alias("_root")).agg(F.min("doc_id").alias("component_id"))
    of_class = spread_join(named, smallest, "root", "_root", F.col("node")).select(F.col("set_id").alias("_set"), "component_id")
    found = sketches.where(F.col("set_id").isNotNull()).select("doc_id", "n_shingles", "set_id")
    rows = spread_join(found, of_class, "set_id", "_set", F.coalesce(F.col("doc_id"), F.lit(0)))
    alone = sketches.where(F.col("set_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (
        rows.select("doc_id", "n_shingles", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
