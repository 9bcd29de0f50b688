"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and components (operator 5).

SuperMinHash (Ertl, 2017) gives every shingle a random permutation of the registers, and at its j-th place
the value j plus a fraction; a register keeps its least value. Values of one shingle are thus spread over
the ranks, which lowers the variance for small sets, and a document is finished at the first rank where
each of its registers is filled, as later ranks are larger: long documents need one value a shingle. Here
all shingles of a batch take a rank together.

Documents with the same words are one class. Classes that share a band are a bucket; its centre is the
class with the most company over all its buckets, and all others are verified against it on full shingle
sets, so that a group of thousands costs one comparison a document and centre; the company of a centre is
spread over the tasks by salts, each with one copy of its text. The classes around a centre that still are
in another component than it are then compared with all classes around it, in blocks of full shingle sets
of like size; a pair of blocks reports which components it joins, not the pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apertura.llm.components import components
from apertura.llm.shared import arrow_type, runs, spread, written
from apertura.llm.tokens import grams, mix, words

#: A pair at a similarity of 0.8 shares no band once in 150,000 pairs.
BANDS, ROWS = 30, 5
REGISTERS = BANDS * ROWS
#: Shingles that take a rank together.
CHUNK = 100_000
#: The company of a centre is spread over so many keys.
SALTS = 256
#: Shingles of a block of classes that meets another, and columns of the matrices in which they meet.
BLOCK = 1 << 16
COLUMNS = 1 << 13


def shingle_sets(texts: list[bytes | None], n: int) -> tuple[list[np.ndarray], list[bytes | None]]:
    """The sorted distinct shingles of each text, and a digest of its words; no shingles and None without words."""
    w = words(texts)
    hashes, place = grams(w, n)
    cuts = np.searchsorted(w.text[place], np.arange(len(texts) + 1))
    sets, digests = [], []
    for i in range(len(texts)):
        own = w.hashes[w.starts[i] : w.starts[i + 1]]
        digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None
        found = np.unique(hashes[cuts[i] : cuts[i + 1]])
        if not len(found) and digest:
            found = np.frombuffer(digest[:8], dtype=np.uint64)
        sets.append(found)
        digests.append(digest)
    return sets, digests


def signatures(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """A row of ``m`` registers for each set, rank in the upper 32 bits and fraction in the lower ones."""
    out = np.full((len(sets), m), np.iinfo(np.uint64).max, dtype=np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        _fill(out[at:end], sets[at:end], m)
        at = end
    return out


def _fill(registers: np.ndarray, sets: list[np.ndarray], m: int) -> None:
    flat = registers.reshape(-1)
    item = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    perm: np.ndarray | None = None
    for rank in range(m):
        if not len(item):
            return
        with np.errstate(over="ignore"):
            drawn = mix(item + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        swap = rank + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - rank)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            register = swap
        else:
            rows = np.arange(len(item))
            register = perm[rows, swap].astype(np.int64)
            perm[rows, swap] = perm[rows, rank]
        np.minimum.at(flat, owner * m + register, np.uint64(rank << 32) | (drawn >> np.uint64(32)))
        open_ = registers.max(axis=1) == np.iinfo(np.uint64).max
        keep = open_[owner]
        if not keep.all():
            item, owner, swap = item[keep], owner[keep], swap[keep]
            perm = perm[keep] if perm is not None else None
        if perm is None and len(item):
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(item), 1))
            rows = np.arange(len(item))
            perm[rows, swap] = perm[rows, rank]


def band_keys(registers: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        parts = mix(registers).reshape(len(registers), BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
        for j in range(ROWS):
            key = mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, j])
    return key.view(np.int64)


def _groups(texts: pa.Array, rows: int, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text."""
    lens = [len(t.as_py() or b"") for t in texts] if rows else []
    at = 0
    while at < rows:
        end, total = at, 0
        while end < rows and (end == at or total + lens[end] <= size):
            total += lens[end]
            end += 1
        yield at, end
        at = end


def signed(docs: DataFrame, n: int) -> DataFrame:
    """``doc_id, n_shingles, digest, bands`` for every document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _groups(batch.column(1), batch.num_rows):
                sets, digests = shingle_sets(batch.column(1).slice(at, end - at).to_pylist(), n)
                there = [i for i, s in enumerate(sets) if len(s)]
                keys = band_keys(signatures([sets[i] for i in there]))
                bands: list = [None] * len(sets)
                for row, i in enumerate(there):
                    bands[i] = keys[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, end - at), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, digest binary, bands array<long>"
    return docs.select("doc_id", docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(sign, schema)


def salted(company: DataFrame) -> DataFrame:
    """``centre, rep`` with a ``salt`` by the rep: what concerns a centre goes to each of its salts once, so no task has all its company."""
    return company.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))


def verified(company: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``centre, rep`` of those rows of ``company`` whose shingle sets have 100 * intersection >= percent * union.

    The rows of a centre and salt follow one copy of the centre's text, so that its set is made once.
    """
    asked = salted(company.where("rep != centre"))
    own = asked.join(texts.withColumnRenamed("doc_id", "rep").hint("merge"), "rep").select("centre", "salt", "rep", "text")
    heads = asked.select("centre", "salt").distinct().join(texts.withColumnRenamed("doc_id", "centre").hint("merge"), "centre")
    heads = heads.select("centre", "salt", F.lit(None).cast(own.schema["rep"].dataType).alias("rep"), "text")
    rows = own.unionByName(heads).repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.asc_nulls_first("rep"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for at, end in _groups(batch.column(3), batch.num_rows):
                sets, _ = shingle_sets(batch.column(3).slice(at, end - at).to_pylist(), n)
                for own, first in zip(sets, batch.column(2).slice(at, end - at).is_null().to_pylist(), strict=True):
                    if first:
                        head = own
                    common = 0 if first else len(np.intersect1d(head, own, assume_unique=True))
                    keep.append(common > 0 and 100 * common >= percent * (len(head) + len(own) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2)], ["centre", "rep"]).filter(pa.array(keep, pa.bool_()))

    kind = texts.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(check, f"centre {kind}, rep {kind}")


def shingled(texts: DataFrame, n: int) -> DataFrame:
    """``doc_id, set``: the shingle hashes of each text as bytes."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _groups(batch.column(1), batch.num_rows):
                sets, _ = shingle_sets(batch.column(1).slice(at, end - at).to_pylist(), n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "set"])

    return texts.mapInArrow(read, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, set binary")


def common_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` shares with each of ``b``, by products of 0/1 matrices of bounded width."""
    shared = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.int64)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        sides = []
        for sets in (a, b):
            x = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                place = np.minimum(np.searchsorted(part, s), len(part) - 1)
                x[k, place[part[place] == s]] = 1
            sides.append(x)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    return out


def joined_components(batches: Iterator[pa.RecordBatch], percent: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """For rows of two blocks (components and sets of each), the pairs of components that links between them join, without cycles."""
    for batch in batches:
        u, v = [], []
        for row in range(batch.num_rows):
            of_a, of_b = (batch.column(k)[row].as_py() for k in (0, 2))
            a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k)[row].as_py()] for k in (1, 3))
            common = common_shingles(a, b)
            size_a, size_b = np.array([len(s) for s in a]), np.array([len(s) for s in b])
            linked = (common > 0) & (100 * common >= percent * (size_a[:, None] + size_b[None] - common))
            root: dict = {}

            def find(x, root=root):  # noqa: ANN001, ANN202
                while root.get(x, x) != x:
                    root[x] = root.get(root[x], root[x])
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(linked), strict=True):
                x, y = find(of_a[i]), find(of_b[j])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    u.append(max(x, y))
                    v.append(min(x, y))
        yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])


def _blocks(rows: DataFrame) -> DataFrame:
    """``centre, part, low, high, components, sets``: rows (centre, rep, component, n_shingles, set) of like size in blocks of BLOCK shingles."""
    rows = spread(rows.select("centre", "n_shingles", "component", "set", "rep"), "centre", "n_shingles", F.xxhash64("rep")).drop("rep")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for block in runs(batches, BLOCK, weight=1):
            whole = pa.array([0, block.num_rows], pa.int32())
            size = block.column(1)
            lists = [pa.ListArray.from_arrays(whole, block.column(k)) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([block.column(0).slice(0, 1), pa.array([part]), size.slice(0, 1), size.slice(block.num_rows - 1, 1), *lists], ["centre", "part", "low", "high", "components", "sets"])
            part += 1

    kind = rows.schema["component"].dataType.simpleString()
    return written(rows.mapInArrow(cut, f"centre {kind}, part long, low long, high long, components array<{kind}>, sets array<binary>"), "blocks")


def block_links(around: DataFrame, percent: int) -> DataFrame:
    """Links ``u, v`` between components, found among the classes around each centre.

    ``around``: centre, rep, component, n_shingles, set, astray (whether it is in another component than its
    centre). Classes astray meet all others around their centre, in blocks of classes of like size; blocks
    too unlike in size to hold a link don't meet. The numbers of blocks meet first, so that the blocks of a
    centre are spread over the tasks.
    """
    a, b = _blocks(around.where("astray")), _blocks(around)
    names = lambda t, n: t.select("centre", *[F.col(c).alias(f"{c}_{n}") for c in t.columns if c != "centre"])
    a, b = names(a, "a"), names(b, "b")
    near = (F.col("high_a") * 100 >= F.col("low_b") * percent) & (F.col("high_b") * 100 >= F.col("low_a") * percent)
    pairs = a.select("centre", "part_a", "low_a", "high_a").join(b.select("centre", "part_b", "low_b", "high_b"), "centre").where(near).select("centre", "part_a", "part_b")
    met = pairs.join(a, ["centre", "part_a"]).join(b, ["centre", "part_b"]).select("components_a", "sets_a", "components_b", "sets_b")
    name, kind = around.schema["rep"].dataType.simpleString(), arrow_type(around, "rep")
    return met.mapInArrow(lambda batches: joined_components(batches, percent, kind), f"u {name}, v {name}").distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents link where their sets of ``n``-word shingles have at least ``percent`` hundredths in common.
    Shorter texts are one shingle; null, empty and blank texts have none and link with nothing. Rows with
    the same id are one document for the links, also where their texts differ, and stay rows of their own;
    rows without an id link with nothing, have no component and are kept. Very long texts are read whole, by
    themselves. An empty table gives an empty result. Ids may have any type that can be ordered. Other
    columns are ignored, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    sig = written(signed(docs, n), "signatures")
    there = sig.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = written(there.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    firsts = there.join(classes, "digest").where(F.col("doc_id") == F.col("rep"))
    bands = firsts.select("rep", F.explode("bands").alias("band")).distinct()
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    buckets = written(bands.join(sizes, "band"), "buckets")
    company = buckets.groupBy("rep").agg(F.sum("size").alias("company"))
    best = F.max_by("rep", F.struct("company", F.xxhash64("rep"), "rep"))
    centres = buckets.join(company, "rep").groupBy("band").agg(best.alias("centre"))
    around = written(buckets.join(centres, "band").select("centre", "rep").distinct(), "around")
    near = around.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(docs.select("doc_id", docs["text"].cast("string").cast("binary").alias("text")).join(near.hint("merge"), "doc_id", "left_semi"), "texts")
    links = written(verified(around, texts, n, percent).select(F.col("centre").alias("u"), F.col("rep").alias("v")), "links")
    # An id with several texts is one document: its classes are one component.
    several = there.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a != b").select("doc_id")
    same = there.join(several, "doc_id").select("doc_id", "digest").distinct().join(classes, "digest").where("doc_id != rep")
    links = written(links.unionByName(same.select(F.col("rep").alias("u"), F.col("doc_id").alias("v"))), "links")
    found = components(links, "near-1")

    of = around.select("rep").distinct().join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))
    shingles = firsts.groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"))
    company = salted(around)
    heads = company.select("centre", "salt").distinct()
    of_centre = heads.join(of.withColumnsRenamed({"rep": "centre", "component": "of_centre"}), "centre")
    placed = company.join(of.join(shingles, "rep"), "rep").join(of_centre, ["centre", "salt"])
    placed = written(placed.withColumn("astray", F.col("component") != F.col("of_centre")).drop("of_centre"), "placed")
    astray = heads.join(placed.where("astray").select("centre").distinct(), "centre")
    placed = placed.join(astray, ["centre", "salt"], "left_semi")
    sets = shingled(texts.join(placed.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), n)
    full = placed.join(sets.withColumnRenamed("doc_id", "rep").hint("merge"), "rep")
    more = written(block_links(full, percent), "links-2")
    if not more.isEmpty():
        found = components(links.unionByName(more), "near-2")

    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = sig.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: one for each group of near duplicates, and all without an id.

    Of rows with the same id and text one stays; rows that share an id but not the text stay or go together.
    """
    kept = near_duplicates(docs, n, percent).where("kept").select("doc_id").where("doc_id is not null").distinct()
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi")
    once = named.join(repeated, "doc_id", "left_anti")
    more = named.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(more).unionByName(docs.where("doc_id is null")).select(*docs.columns)


#: Over shingles of four words, as the query has it.
NEAR_DUPLICATES_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
s as materialized (
  select distinct doc_id, shingle from (
    select doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 2)), lambda i: array_to_string(words[i:i + 3], ' '))) as shingle
    from w where len(words) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b using (shingle) where a.doc_id != b.doc_id group by all),
links as materialized (
  select u, v from p join n a on u = a.doc_id join n b on v = b.doc_id where 100 * c >= 80 * (a.n + b.n - c)),
reached(node, seen) as (
  select u, v from links
  union
  select r.node, l.v from reached r join links l on r.seen = l.u),
least as (select node, min(seen) as m from reached group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) as component_id,
       d.doc_id = least(d.doc_id, coalesce(l.m, d.doc_id)) as kept
from documents d left join n on d.doc_id = n.doc_id left join least l on d.doc_id = l.node
"""
