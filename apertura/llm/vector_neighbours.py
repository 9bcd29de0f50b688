"""Near-duplicate embeddings by NN-descent (operator 1).

1. Vectors within half the threshold's angle of a leader form a class; by the triangle inequality all of a
   class link with each other, so dense groups shrink to leaders before any neighbour list exists.
   Leaders are sought in runs of vectors sorted by random-hyperplane codes, anew with other planes each round.
2. NN-descent on the leaders: lists begin with the nearest in a few such runs; then each vector brings
   its neighbours and those it is a neighbour of together, and they improve each other's lists, until the
   lists settle. A list whose last entry still could link is saturated: its length doubles, up to MOST, and
   the descent goes on.
3. Edges of the lists that could hold links become pairs of classes; links are counted on double-precision
   cosines, blocks of members against blocks. Nodes whose lists are saturated at MOST are open: their
   members meet their whole group, blocks against blocks over the tasks, and no list is made of them.
4. An audit compares every vector whose id leaves a remainder by 50 with all vectors and measures which share
   of the true links between classes the lists hold. While it is below RECALL, the missed edges and further
   runs feed the descent, and the next remainder, which nothing has learnt from, is audited. If that fails
   after AUDITS rounds, groups in which the last audit missed links or found none are opened.

Sorted runs are cut from range-partitioned rows whose sort key ends in a hash of the id, so a hot code or
label is spread over the tasks; blocks meet by the keys of both.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apertura.llm.components import components
from apertura.llm.shared import arrow_type, runs, spread, written

#: Length of a neighbour list at first; rows of a run; runs that the lists begin with.
LIST = 10
RUN = 1024
BLOCKINGS = 3
#: Neighbours that a node is one of and that it brings together in a round, and the longest list.
REVERSE = 64
MOST = 160
#: Bytes of the vectors of a block that meets another.
BLOCK_BYTES = 1 << 19
#: One in so many vectors is a query of an audit; least share of the links found; audits at most.
QUERIES = 50
RECALL = 0.999
AUDITS = 6
#: Rounds of contraction at most (what is left over is handled by the lists) and of the descent between two looks at saturation.
CONTRACTIONS = 8
DESCENTS = 12
#: Unit vectors are also kept as 16-bit integers; products of these are exact in doubles.
SCALE = 32767
SLACK = 0.002

LOG = logging.getLogger(__name__)
Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the rows with a finite vector other than zero."""
    for batch in batches:
        keep, vecs, shorts, dims = [], [], [], []
        for k, values in enumerate(batch.column(2).to_pylist()):
            if not values or any(x is None for x in values):
                continue
            v = np.array(values, dtype=np.float64)
            if not np.isfinite(v).all() or not v.any():
                continue
            v /= np.abs(v).max()
            v /= math.sqrt(float(v @ v))
            keep.append(k)
            vecs.append(v.tobytes())
            shorts.append(np.rint(v * SCALE).astype(np.int16).tobytes())
            dims.append(len(v))
        kept = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array(shorts, pa.binary())], ["id", "label", "dim", "vec", "short"])


def _stacked(column: pa.Array, kind: type) -> np.ndarray:
    """The vectors of a binary column as rows of doubles."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64, copy=False)


def _coded(seed: int) -> Run:
    """Adds the first 30 signs of random projections to (grp, id, vector as short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.int64)
            rows: dict[int, list[int]] = {}
            shorts = batch.column(2).to_pylist()
            for k, s in enumerate(shorts):
                rows.setdefault(len(s) // 2, []).append(k)
            for dim, own in rows.items():
                planes = np.random.default_rng((seed, dim)).standard_normal((dim, 30))
                x = np.frombuffer(b"".join(shorts[k] for k in own), np.int16).reshape(len(own), dim)
                codes[own] = ((x @ planes) > 0) @ (1 << np.arange(29, -1, -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], [*batch.schema.names, "code"])

    return run


def _sorted(nodes: DataFrame, seed: int, *more: str) -> DataFrame:
    """``grp, id, short`` and the columns ``more`` of the nodes, sorted by group and code."""
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    names = ["grp", "id", "short", *more]
    coded = nodes.select(*names).mapInArrow(_coded(seed), ", ".join(f"{n} {types[n]}" for n in names) + ", code long")
    return spread(coded, "grp", "code", F.xxhash64(F.lit(seed), "id")).drop("code")


def _leaders(least: float, kind: pa.DataType) -> Run:
    """In each run of (grp, id, short, vec): a node within ``least`` of an earlier leader follows it, another leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes in runs(batches, RUN):
            ids, x = nodes.column(1).to_pylist(), _stacked(nodes.column(3), np.float64)
            cos = x @ x.T
            near, leads = cos >= least, np.zeros(len(ids), bool)
            moved, to, by = [], [], []
            for k in range(len(ids)):
                before = np.flatnonzero(near[k, :k] & leads[:k])
                if len(before):
                    moved.append(ids[k])
                    to.append(ids[before[0]])
                    by.append(float(cos[k, before[0]]))
                else:
                    leads[k] = True
            yield pa.RecordBatch.from_arrays([pa.array(moved, kind), pa.array(to, kind), pa.array(by, pa.float64())], ["leader", "to", "by"])

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        cos = [float(np.frombuffer(x) @ np.frombuffer(y)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cos, pa.float64())], ["id", "to", "cos"])


def contracted(vectors: DataFrame, least: float) -> DataFrame:
    """``id, leader, cos`` for every vector; the cosine with its leader is at least ``least``."""
    kind, arrow = vectors.schema["id"].dataType.simpleString(), arrow_type(vectors, "id")
    members = None
    for turn in range(CONTRACTIONS):
        nodes = vectors if members is None else vectors.join(members.where("id = leader").select("id"), "id", "left_semi")
        moved = written(_sorted(nodes, 1000 + turn, "vec").mapInArrow(_leaders(least, arrow), f"leader {kind}, to {kind}, by double"), "moved")
        if members is None:
            led = vectors.select("id").join(moved, F.col("id") == F.col("leader"), "left")
            members = written(led.select("id", F.coalesce("to", "id").alias("leader"), F.coalesce("by", F.lit(1.0)).alias("cos")), "members")
        else:
            # Members of a leader that now follows another do so too where they are near enough, else they lead.
            vec = vectors.select("id", "vec")
            asked = members.join(moved, "leader").select("id", "to")
            both = asked.join(vec, "id").join(vec.withColumnsRenamed({"id": "to", "vec": "other"}), "to").select("id", "to", "vec", "other")
            tried = both.mapInArrow(_cosines, f"id {kind}, to {kind}, cos double")
            good = F.col("cos") >= least
            tried = tried.select("id", F.when(good, F.col("to")).otherwise(F.col("id")).alias("leader"), F.when(good, F.col("cos")).otherwise(1.0).alias("cos"))
            members = written(members.join(moved.select("leader"), "leader", "left_anti").select("id", "leader", "cos").unionByName(tried), "members")
        # The next round would find less than this one did; the lists handle the rest.
        if moved.count() <= 0.005 * members.count():
            break
    return members


def _nearest(k: int, kind: pa.DataType) -> Run:
    """The ``k`` nearest of each node in its run of (grp, id, short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes in runs(batches, RUN):
            n, take = nodes.num_rows, min(k, nodes.num_rows - 1)
            if not take:
                continue
            x = _stacked(nodes.column(2), np.int16)
            dots = x @ x.T
            np.fill_diagonal(dots, -np.inf)
            best = np.argpartition(-dots, take - 1, axis=1)[:, :take]
            of = np.repeat(np.arange(n), take)
            ids = nodes.column(1)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(of)), ids.take(pa.array(best.ravel())), pa.array(dots[of, best.ravel()].astype(np.int64))], ["id", "other", "dot"]
            )

    return run


def _met(kind: pa.DataType) -> Run:
    """Candidates among the neighbours of one node that beat the last entry of each other's lists, as many as a list takes.

    A pair of which neither is a fresh neighbour has met before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others, cosines = [], [], []
            for nodes in batch.column(0).to_pylist():
                own = [n["id"] for n in nodes]
                x = np.frombuffer(b"".join(n["short"] for n in nodes), np.int16).reshape(len(nodes), -1).astype(np.float64)
                dots = (x @ x.T).astype(np.int64)
                fresh = np.array([n["fresh"] for n in nodes])
                good = (fresh[:, None] | fresh[None]) & (dots > np.array([n["last"] for n in nodes])[:, None])
                np.fill_diagonal(good, False)
                for row in np.flatnonzero(good.any(axis=1)):
                    cols, k = np.flatnonzero(good[row]), nodes[row]["cap"]
                    cols = cols[np.argsort(-dots[row, cols], kind="stable")[:k]] if len(cols) > k else cols
                    ids += [own[row]] * len(cols)
                    others += [own[c] for c in cols]
                    cosines += dots[row, cols].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(others, kind), pa.array(cosines, pa.int64())], ["id", "other", "dot"])

    return run


def _merged(graph: DataFrame, candidates: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Lists (id, cap, near: dot and other, fresh) after taking in candidates; a list keeps its ``cap`` nearest."""
    new = candidates.groupBy("id").agg(F.collect_set(F.struct("dot", "other")).alias("new"))
    near = F.slice(F.sort_array(F.array_union("near", F.coalesce("new", F.array().cast(new.schema["new"].dataType))), asc=False), F.lit(1), F.col("cap"))
    out = graph.join(new, "id", "left").withColumn("all", near)
    fresh = F.filter("all", lambda x: ~F.array_contains("near", x))
    return written(out.select("id", "cap", F.col("all").alias("near"), F.transform(F.array_union(F.filter("all", lambda x: F.array_contains("fresh", x["other"])), fresh), lambda x: x["other"]).alias("fresh")), "graph", instead=replaced)


def descended(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rounds of neighbours-of-neighbours joins until hardly a list changes; a neighbour is fresh until it has met from both ends."""
    kind, arrow = nodes.schema["id"].dataType.simpleString(), arrow_type(nodes, "id")
    total = graph.count()
    for turn in range(DESCENTS):
        edges = graph.select("id", F.explode("near").alias("e"), "fresh").select("id", F.col("e.other").alias("other"), F.array_contains("fresh", F.col("e.other")).alias("fresh"))
        back = edges.select(F.col("other").alias("id"), F.col("id").alias("other"), "fresh")
        order = Window.partitionBy("id").orderBy(F.desc("fresh"), F.xxhash64(F.lit(turn), "other"), "other")
        # A limit on a row number is applied before the shuffle, too: no task sorts all that a hub is a neighbour of.
        back = back.withColumn("n", F.row_number().over(order)).where(F.col("n") <= REVERSE).drop("n")
        waits = edges.where("fresh").join(back.select(F.col("other").alias("id"), F.col("id").alias("other")), ["id", "other"], "left_anti")
        waits = waits.groupBy("id").agg(F.collect_set("other").alias("waits"))
        pairs = edges.unionByName(back).groupBy("id", "other").agg(F.bool_or("fresh").alias("fresh"))
        last = F.when(F.size("near") >= F.col("cap"), F.element_at("near", -1)["dot"]).otherwise(-SCALE * SCALE)
        of = graph.select("id", last.alias("last"), "cap").join(nodes.select("id", "short"), "id").withColumnRenamed("id", "other")
        lists = (
            pairs.join(of, "other")
            .groupBy("id").agg(F.collect_list(F.struct(F.col("other").alias("id"), "short", "fresh", "last", "cap")).alias("nodes"), F.bool_or("fresh").alias("any"))
            .where("any").select("nodes")
        )
        candidates = lists.mapInArrow(_met(arrow), f"id {kind}, other {kind}, dot long")
        settled = graph.join(waits, "id", "left").withColumn("fresh", F.array_intersect("fresh", F.coalesce("waits", F.array().cast(f"array<{kind}>")))).drop("waits")
        graph = _merged(settled, candidates, graph)
        if (graph.agg(F.sum(F.size("fresh"))).first()[0] or 0) <= 0.001 * LIST * total:
            break
    return graph


def _packed(rows: int, kind: pa.DataType) -> Run:
    """Runs of (key, id, leader, vec) as one row each, of at most ``rows`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for block in runs(batches, rows):
            whole = pa.array([0, block.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, block.column(k)) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([block.column(0).slice(0, 1), pa.array([part]), *lists, pa.array([b"".join(block.column(3).to_pylist())], pa.binary())], ["key", "part", "ids", "leaders", "vecs"])
            part += 1

    return run


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """``key, part, ids, leaders, vecs``: the rows (key, id, leader, vec) in blocks of at most BLOCK_BYTES, ``width`` numbers a vector."""
    key, kind = rows.schema["key"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    packed = _packed(max(64, BLOCK_BYTES // (8 * max(1, width))), arrow_type(rows, "id"))
    rows = spread(rows.select("key", "id", "leader", "vec"), "key", F.xxhash64("id"))
    return written(rows.mapInArrow(packed, f"key {key}, part long, ids array<{kind}>, leaders array<{kind}>, vecs binary"), "blocks")


def meetings(a: DataFrame, b: DataFrame, which: Column | None = None) -> DataFrame:
    """Every block of ``a`` beside every block of ``b`` of the same key (``which``: a condition on their parts p and q).

    Their numbers meet first, so that the blocks of a hot key are spread over the tasks by key and number.
    """
    pairs = a.select("key", F.col("part").alias("p")).join(b.select("key", F.col("part").alias("q")), "key")
    pairs = pairs if which is None else pairs.where(which)
    sides = [t.select("key", F.col("part").alias(n), *[F.col(c).alias(f"{c}_{n}") for c in ("ids", "leaders", "vecs")]) for t, n in ((a, "p"), (b, "q"))]
    met = pairs.join(sides[0], ["key", "p"]).join(sides[1], ["key", "q"])
    return met.select(*[f"{c}_{n}" for n in "pq" for c in ("ids", "leaders", "vecs")])


def _across(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[tuple[list, list, list, list, np.ndarray]]:
    """For each pair of blocks: ids and leaders of both and the matrix of links between different classes."""
    for batch in batches:
        for row in range(batch.num_rows):
            ids_a, of_a, vecs_a, ids_b, of_b, vecs_b = (batch.column(k)[row].as_py() for k in range(6))
            x, y = (np.frombuffer(v).reshape(len(i), -1) for v, i in ((vecs_a, ids_a), (vecs_b, ids_b)))
            if x.shape[1] != y.shape[1]:
                continue
            number = {leader: n for n, leader in enumerate(dict.fromkeys(of_a + of_b))}
            u, v = (np.array([number[leader] for leader in of]) for of in (of_a, of_b))
            yield ids_a, of_a, ids_b, of_b, ((x @ y.T) >= threshold) & (u[:, None] != v)


def _links(threshold: float, kind: pa.DataType, both: bool) -> Run:
    """Rows (id, n) with the links of members, and (id, other) with the edges of a forest over the classes that link.

    Links count for the members of the first block and, with ``both``, for those of the second.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids_a, of_a, ids_b, of_b, linked in _across(batches, threshold):
            ids, others, counts = [], [], []
            for members, n in ((ids_a, linked.sum(axis=1)), *(((ids_b, linked.sum(axis=0)),) if both else ())):
                for k in np.flatnonzero(n):
                    ids.append(members[k])
                    others.append(None)
                    counts.append(int(n[k]))
            left = linked.any(axis=1)
            while left.any():
                root = int(left.argmax())
                cols, rows = np.zeros(len(ids_b), bool), np.zeros(len(ids_a), bool)
                rows[root] = True
                front = rows.copy()
                while front.any():
                    cols |= linked[front].any(axis=0)
                    front = linked[:, cols].any(axis=1) & ~rows
                    rows |= front
                left &= ~rows
                for other in {of_a[k] for k in np.flatnonzero(rows)} | {of_b[k] for k in np.flatnonzero(cols)}:
                    if other != of_a[root]:
                        ids.append(of_a[root])
                        others.append(other)
                        counts.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(others, kind), pa.array(counts, pa.int64())], ["id", "other", "n"])

    return run


def _true_edges(threshold: float, kind: pa.DataType) -> Run:
    """The pairs of classes that link through a member of the first block, and by how many links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of_a, _, of_b, linked in _across(batches, threshold):
            found: dict = {}
            for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                pair = (min(of_a[i], of_b[j]), max(of_a[i], of_b[j]))
                found[pair] = found.get(pair, 0) + 1
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind), pa.array(found.values(), pa.int64())], ["u", "v", "n"])

    return run


@dataclass
class Found:
    """The result and what the audits said: the share of true links that the lists held, links audited, queries."""

    rows: DataFrame
    recall: float
    audited: int
    opened: int


def near_vectors(df: DataFrame, threshold: float = 0.93) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``df``.

    Vectors of equal label (not null) and length link from a cosine of ``threshold``. Rows whose vector is
    null, empty or zero or has null or non-finite components, or whose label or id is null, link with
    nothing; without an id, component_id is null and the row is kept. Rows with the same id are one vector
    (that with the largest bytes) in the graph and rows of their own in the result. An empty table gives an
    empty result. Long vectors make smaller blocks. Ids may have any type that can be ordered. Other
    columns are ignored, whatever their names.
    """
    return near_vectors_audited(df, threshold).rows


def near_vectors_audited(df: DataFrame, threshold: float = 0.93) -> Found:
    """As near_vectors, with the recall measured on the last audit's queries before what they missed was added."""
    kind, arrow = df.schema["vec_id"].dataType.simpleString(), arrow_type(df, "vec_id")
    asked = df.where("vec_id is not null and label is not null").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = asked.mapInArrow(_unit, f"id {kind}, label string, dim int, vec binary, short binary")
    unit = unit.groupBy("id").agg(F.max(F.struct("vec", "label", "dim", "short")).alias("x"))
    vectors = written(unit.select("id", F.concat_ws(":", "x.dim", "x.label").alias("grp"), "x.vec", "x.short"), "vectors")
    width = (vectors.agg(F.max(F.octet_length("vec"))).first()[0] or 8) // 8
    angle = math.acos(threshold)
    members = contracted(vectors, math.cos(angle / 2) + 1e-4)
    classes = written(members.groupBy("leader").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.acos(F.least(F.min("cos"), F.lit(1.0))).alias("radius")), "classes")
    nodes = vectors.join(classes.select(F.col("leader").alias("id"), "radius", "n"), "id").select("id", "grp", "short", "radius", "n")
    nodes = written(nodes.join(nodes.groupBy("grp").agg(F.max("radius").alias("widest")), "grp"), "nodes")
    placed = written(members.join(vectors.select("id", "grp", "vec"), "id").select("id", "leader", "grp", "vec"), "placed")
    everything = blocks(placed.withColumnRenamed("grp", "key"), width)

    def bound(*radii: str) -> Column:
        """The least product of the shorts of two leaders whose classes may link."""
        wide = F.lit(angle)
        for radius in radii:
            wide = wide + F.col(radius)
        return (F.cos(F.least(F.lit(math.pi), wide)) - SLACK) * SCALE * SCALE

    near = F.array().cast(f"array<struct<dot:bigint,other:{kind}>>")
    graph = nodes.select("id", F.lit(LIST).alias("cap"), near.alias("near"), F.array().cast(f"array<{kind}>").alias("fresh"))
    seeds = range(BLOCKINGS)
    missed: list[DataFrame] = []
    for turn in range(AUDITS):
        candidates = None
        for k in seeds:
            found = _sorted(nodes, k).mapInArrow(_nearest(LIST, arrow), f"id {kind}, other {kind}, dot long")
            candidates = found if candidates is None else candidates.unionByName(found)
        for edges in missed[-1:]:
            both = edges.select(F.col("u").alias("id"), F.col("v").alias("other"), "dot").unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("other"), "dot"))
            candidates = candidates.unionByName(both)
        graph = descended(_merged(graph, candidates), nodes)
        while True:
            # A list is saturated if its last entry could still link, given the radius of its own class and the widest of its group.
            looked = graph.join(nodes.select("id", bound("widest", "radius").alias("bound")), "id").withColumn("full", F.coalesce((F.try_element_at("near", F.lit(-1))["dot"] >= F.col("bound")) & (F.size("near") >= F.col("cap")), F.lit(False)))
            grows = F.col("full") & (F.col("cap") < MOST)
            if looked.where(grows).isEmpty():
                break
            longer = looked.select("id", F.when(grows, F.least(2 * F.col("cap"), F.lit(MOST))).otherwise(F.col("cap")).alias("cap"), "near", F.when(grows, F.transform("near", lambda x: x["other"])).otherwise(F.col("fresh")).alias("fresh"))
            graph = descended(written(longer, "graph"), nodes)
        opened = written(looked.where("full").select("id"), "opened")
        n_open = opened.count()

        # Pairs of classes that the lists hold and that may link; those of open nodes are left to the blocks of whole groups.
        edge = graph.select("id", F.explode("near").alias("e")).select(F.least("id", "e.other").alias("u"), F.greatest("id", "e.other").alias("v"), "e.dot").distinct()
        for end in "uv":
            edge = edge.join(nodes.select(F.col("id").alias(end), F.col("radius").alias(f"r{end}"), F.col("n").alias(f"n{end}")), end)
        edge = edge.where(F.col("dot") >= bound("ru", "rv")).select("u", "v", "nu", "nv")
        held = written(_without(edge, opened), "held")

        number = F.col("id") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64("id")
        queries = blocks(placed.where(F.pmod(number, F.lit(QUERIES)) == turn).withColumnRenamed("grp", "key"), width)
        true = meetings(queries, everything).mapInArrow(_true_edges(threshold, arrow), f"u {kind}, v {kind}, n long").groupBy("u", "v").agg(F.sum("n").alias("n"))
        true = true.join(held.select("u", "v", F.lit(True).alias("held")), ["u", "v"], "left")
        true = written(_without(true, opened), "audit")
        links, lost = true.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("held").isNull(), F.col("n"))), F.lit(0))).first()
        recall = 1 - lost / links if links else 1.0
        LOG.info("audit %d: recall %.5f of %d links, %d open nodes", turn, recall, links, n_open)
        if lost:
            new = true.where("held is null").select("u", "v")
            shorts = nodes.select("id", "short")
            both = new.join(shorts.withColumnsRenamed({"id": "u", "short": "a"}), "u").join(shorts.withColumnsRenamed({"id": "v", "short": "b"}), "v")
            missed.append(written(both.select("u", "v", "a", "b").mapInArrow(_dots, f"u {kind}, v {kind}, dot long"), "missed"))
        if recall >= RECALL:
            break
        seeds = [100 + turn]
    for edges in missed:  # what the audits found counts, whether or not the lists took it up
        for end in "uv":
            edges = edges.join(nodes.select(F.col("id").alias(end), F.col("n").alias(f"n{end}")), end)
        held = _without(edges, opened).select("u", "v", "nu", "nv").unionByName(held)
    if recall < RECALL:
        grp = nodes.select("id", "grp")
        by_group = true.join(grp.withColumnRenamed("id", "u"), "u").groupBy("grp").agg((F.count_if(F.col("held").isNull()) == 0).alias("good"))
        vouched = by_group.where("good").select("grp")
        opened = written(opened.unionByName(grp.join(vouched, "grp", "left_anti").select("id")).distinct(), "opened")
        n_open = opened.count()
        held = _without(held, opened)

    # The members of the larger class of a pair meet those of all smaller ones beside it, in blocks.
    turned = F.col("nu") >= F.col("nv")
    pairs = written(held.select(F.when(turned, F.col("u")).otherwise(F.col("v")).alias("key"), F.when(turned, F.col("v")).otherwise(F.col("u")).alias("leader")).distinct(), "pairs")
    centre = placed.join(pairs.select(F.col("key").alias("leader")).distinct(), "leader", "left_semi").select(F.col("leader").alias("key"), "id", "leader", "vec")
    beside = pairs.join(placed, "leader").select("key", "id", "leader", "vec")
    shape = f"id {kind}, other {kind}, n long"
    linked = meetings(blocks(centre, width), blocks(beside, width)).mapInArrow(_links(threshold, arrow, True), shape)
    if n_open:
        flag = placed.join(opened.select(F.col("id").alias("leader"), F.lit(True).alias("open")), "leader", "left")
        flag = flag.join(nodes.join(opened, "id", "left_semi").select("grp").distinct(), "grp", "left_semi")
        side = [blocks(flag.where(which).withColumnRenamed("grp", "key"), width) for which in ("open", "open is null")]
        linked = linked.unionByName(meetings(side[0], side[1]).mapInArrow(_links(threshold, arrow, True), shape))
        linked = linked.unionByName(meetings(side[0], side[0], F.col("p") < F.col("q")).mapInArrow(_links(threshold, arrow, True), shape))
        linked = linked.unionByName(meetings(side[0], side[0], F.col("p") == F.col("q")).mapInArrow(_links(threshold, arrow, False), shape))
    linked = written(linked, "linked")
    counts = linked.where("other is null").groupBy("id").agg(F.sum("n").alias("n_other"))
    found = components(linked.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")), "vectors")
    rooted = classes.join(found, F.col("leader") == F.col("node"), "left").select("leader", "n", "least", F.coalesce("component", "leader").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = members.join(rooted.join(smallest, "root"), "leader").join(counts, "id", "left").select("id", (F.col("n") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"), "component_id")
    out = df.select("vec_id").join(known, F.col("vec_id") == F.col("id"), "left")
    component = F.coalesce("component_id", "vec_id")
    rows = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
    return Found(rows, recall, links, n_open)


def _without(edges: DataFrame, opened: DataFrame) -> DataFrame:
    """The edges (u, v) neither end of which is open."""
    for end in "uv":
        edges = edges.join(opened.select(F.col("id").alias(end)), end, "left_anti")
    return edges


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(k).to_pylist() for k in (2, 3))
        dots = [int(np.frombuffer(x, np.int16).astype(np.int64) @ np.frombuffer(y, np.int16).astype(np.int64)) for x, y in zip(a, b, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dots, pa.int64())], ["u", "v", "dot"])


NEIGHBOURS_SQL = """
with recursive ok as materialized (
  select vec_id, label, case when len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 then cast(embedding as double[]) end as v
  from embeddings where label is not null and len(embedding) > 0),
good as materialized (
  select vec_id, label, len(v) as dim, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) as norm from ok where v is not null),
links as materialized (
  select a.vec_id as u, b.vec_id as v
  from (select * from good where norm > 0) a join (select * from good where norm > 0) b
    on a.label = b.label and a.dim = b.dim and a.vec_id != b.vec_id
  where list_dot_product(a.v, b.v) / a.norm / b.norm >= 0.93),
reached(node, seen) as (
  select u, v from links
  union
  select r.node, l.v from reached r join links l on r.seen = l.u),
least as (select node, min(seen) as m from reached group by node),
counts as (select u, count(*) as n from links group by u)
select e.vec_id, coalesce(c.n, 0) as n_links, least(e.vec_id, coalesce(l.m, e.vec_id)) as component_id,
       e.vec_id = least(e.vec_id, coalesce(l.m, e.vec_id)) as kept
from embeddings e left join counts c on e.vec_id = c.u left join least l on e.vec_id = l.node
"""
