"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words (operator 8).

The n-grams are pairs of words with at most one word between them, in the item and in the document. A copy
that reaches the least score spends less than two words on most of the ways from one matched word to the
next, so at least ``needed`` of the item's places begin a pair that the document has too. The places are
ranked by how many documents hold their pairs; of the rarest ones, as many as a copy can do without and
ASKED more are the item's seeds, and a document is asked to hit ASKED of them before the two become a pair.
No copy is missed, however its words were replaced, put in or left out. Items too short for such a pair have
their words as seeds.

Of the pairs that come out, those are left out of which too few places are hit, or too few words and
neighbours are near each other for the least score; the rest is aligned.

Items up to BLOCK_ITEMS and BLOCK_BYTES travel to the tasks, so that the join needs no shuffle: one pass
counts and one joins and aligns. More items stay tables: their pairs are counted over all documents and meet
them in one shuffled join; a bit map of fixed size keeps most other pairs of the documents out of it. Seeds,
and so the rows, are the same either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from apertura.llm.shared import arrow_type, written
from apertura.llm.tokens import Words, mix, words

#: Alignment: a match, a replaced word, a word put in or left out.
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least share of the score that an exact copy of the item has.
LEAST = 0.5
#: What parts two runs of matched words at least.
APART = min(-MISMATCH, -GAP)
#: So many items, and bytes of their texts, travel to the tasks.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are worked on at a time.
BYTES = 1 << 21
#: Seeds that a document is asked to hit, where a copy hits as many for sure.
ASKED = 2
#: Bits of the map that keeps pairs of no item out of the join.
MAP_BITS = 26


@dataclass
class Items:
    """The items' words, one after the other, as numbers of a sorted vocabulary, and the keys of their places.

    A place is a word of an item; its keys are those of the pairs that it begins, as numbers of the sorted
    ``keys``, or of the word itself in a short item.
    """

    ids: list
    starts: np.ndarray
    words: np.ndarray
    vocabulary: np.ndarray
    item: np.ndarray  # of each place
    keys: np.ndarray
    at: np.ndarray  # of each place its two keys; -1 for none
    need: np.ndarray  # of each item the places that a copy hits
    asked: np.ndarray  # and how many seeds
    short: bool  # whether any item's keys are words
    first: np.ndarray  # of each key the first of its seeds
    seeds: np.ndarray  # places
    pairs: np.ndarray  # of each place the hash of its word and the next one; 0 at an item's end

    def of(self, i: int) -> np.ndarray:
        return self.words[self.starts[i] : self.starts[i + 1]]


def matches(length: np.ndarray | int, least: float):  # noqa: ANN201
    """Words that a copy with the least share of the full score matches at least."""
    return np.maximum(np.ceil(least * length - 1e-9), 1).astype(np.int64)


def pairs(own: np.ndarray) -> np.ndarray:
    """Hashes of each word number and the next, other than 0 where both are numbers (not negative); 0 at the end."""
    out = np.zeros(len(own), np.uint64)
    with np.errstate(over="ignore"):
        out[:-1] = mix((own[:-1].astype(np.uint64) << np.uint64(32)) + own[1:].astype(np.uint64)) | np.uint64(1)
    out[:-1][(own[:-1] < 0) | (own[1:] < 0)] = 0
    return out


def reached(matched: np.ndarray, adjacent: np.ndarray, length: np.ndarray | int, least: float):  # noqa: ANN201
    """Whether so many matched words, and places where two follow each other in both texts, may have the least score.

    Runs of matched words are parted by APART at least, and there are as many as words that don't follow another.
    """
    enough = (MATCH - APART) * matched + APART * adjacent >= np.ceil(least * MATCH * length - 1e-9) - APART
    return enough & (matched >= matches(length, least))


def needed(length: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of items of so many words the places that a copy with the least share of the full score hits, and whether they are short.

    With m matched words the score is 2 m less what the m - 1 ways between them cost, which is at least the
    longer of the two ways. At most m - t / 2 of them cost two or more for a score of t, so at least t / 2 - 1 don't.
    """
    score = np.ceil(least * MATCH * length - 1e-9)
    places = np.ceil((score - MATCH) / (2 * APART)).astype(np.int64)
    short = places < 1
    return np.where(short, matches(length, least), places), short


def gapped(own: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Keys of each word with the next one and with the one after it, in two rows; 0 where that is none of the same item."""
    out = np.zeros((2, len(own)), np.uint64)
    left = mix(own)
    for k in (1, 2):
        same = np.flatnonzero(item[:-k] == item[k:])
        with np.errstate(over="ignore"):
            out[k - 1, same] = mix(left[same] + own[same + k]) | np.uint64(1)
    return out


def single(own: np.ndarray) -> np.ndarray:
    """Keys of words by themselves."""
    return mix(~own) | np.uint64(1)


def document_keys(doc: np.ndarray, known: np.ndarray | None, short: bool) -> np.ndarray:
    """The distinct keys of a document's words, those of ``known`` places only where it is given."""
    left, found = mix(doc), []
    for k in (1, 2):
        at = np.arange(max(len(doc) - k, 0)) if known is None else np.flatnonzero(known[:-k] & known[k:])
        with np.errstate(over="ignore"):
            found.append(mix(left[at] + doc[at + k]) | np.uint64(1))
    if short:
        found.append(single(doc if known is None else doc[known]))
    return np.unique(np.concatenate(found))


def item_keys(starts: np.ndarray, own: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Of the words of items (hashes): two keys of each place (0 for none), its item, and of each item the places a copy hits, the seeds asked and those to choose."""
    length = np.diff(starts)
    item = np.repeat(np.arange(len(length)), length)
    need, short = needed(length, least)
    keys = np.where(short[item], np.stack([single(own), np.zeros(len(own), np.uint64)]), gapped(own, item))
    asked = np.minimum(need, np.where(short, 1, ASKED))
    return keys, item, need, asked, np.where(short, length, length - 1) - need + asked


def seeds(keys: np.ndarray, item: np.ndarray, chosen: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rarest places of each item, first ones first among equals, filed by their keys (numbers, -1 for none)."""
    place = np.flatnonzero(keys[0] >= 0)
    rarity = np.where(keys[:, place] >= 0, np.append(counts, 0)[keys[:, place]], 0).sum(axis=0)
    place = place[np.lexsort((place, rarity, item[place]))]
    rank = np.arange(len(place)) - np.searchsorted(item[place], item[place])
    place = place[rank < chosen[item[place]]]
    key, place = keys[:, place].ravel(), np.tile(place, 2)
    order = np.argsort(key, kind="stable")[np.count_nonzero(key < 0) :]
    return np.searchsorted(key[order], np.arange(len(counts) + 1)), place[order]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The best local score of the item in the text, and the word after its end."""
    row, best, at = np.zeros(len(text) + 1, np.int64), 0, 0
    slope = GAP * np.arange(len(text) + 1)
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new - slope) + slope
        if (top := int(row.max())) > best:
            best, at = top, int(row.argmax())
    return best, at


def _spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All numbers of the runs of ``count`` from ``first``."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def known_words(doc: np.ndarray, items: Items) -> np.ndarray:
    """The document's words as numbers of the items' vocabulary; -1 for others."""
    text = np.minimum(np.searchsorted(items.vocabulary, doc), len(items.vocabulary) - 1)
    text[items.vocabulary[text] != doc] = -1
    return text


def known_keys(doc: np.ndarray, text: np.ndarray, items: Items) -> np.ndarray:
    """The numbers of the items' keys that the document has."""
    key = document_keys(doc, text >= 0, items.short)
    at = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
    return at[items.keys[at] == key]


def leaks(doc: np.ndarray, items: Items, least: float = LEAST) -> list[tuple[int, float, int, int, int]]:
    """(item, share of the full score, first word, word after the last, seeds) of the items that the words hold a copy of."""
    if not len(doc) or not len(items.vocabulary):
        return []
    text = known_words(doc, items)
    key = known_keys(doc, text, items)
    place = np.unique(items.seeds[_spans(items.first[key], items.first[key + 1] - items.first[key])])
    hit, n = np.unique(items.item[place], return_counts=True)
    enough = n >= items.asked[hit]
    return confirmed(doc, text, key, items, hit[enough], n[enough], least)


def confirmed(doc: np.ndarray, text: np.ndarray, key: np.ndarray, items: Items, hit: np.ndarray, found_seeds: np.ndarray, least: float) -> list[tuple[int, float, int, int, int]]:
    """The rows of leaks() of the items ``hit`` with so many seeds found, given the document's words and keys as numbers of the items'."""
    there = np.zeros(len(items.keys) + 1, bool)
    there[key] = True
    length = items.starts[hit + 1] - items.starts[hit]
    if len(hit):
        places = there[items.at[:, _spans(items.starts[hit], length)]].any(axis=0)
        enough = np.add.reduceat(places, np.cumsum(length) - length, dtype=np.int64) >= items.need[hit]
        hit, length, found_seeds = hit[enough], length[enough], found_seeds[enough]
    if not len(hit):
        return []
    there = np.zeros(len(items.vocabulary), bool)
    there[text[text >= 0]] = True
    held = np.add.reduceat(there[items.words[_spans(items.starts[hit], length)]], np.cumsum(length) - length, dtype=np.int64)
    may = np.flatnonzero(reached(held, held - 1, length, least))
    if not len(may):
        return []
    follow = pairs(text)
    both = np.isin(items.pairs[_spans(items.starts[hit[may]], length[may])], follow[follow > 0])
    both = np.add.reduceat(both, np.cumsum(length[may]) - length[may], dtype=np.int64)
    found = []
    for j in may[reached(held[may], both, length[may], least)]:
        i, top = int(hit[j]), (0, 0, 0)
        own, full = items.of(i), MATCH * int(length[j])
        # A copy is no longer than the item and the words put in that the score allows; it begins at a word of the item.
        wide = len(own) + int((full - least * full) // APART)
        at = np.flatnonzero(np.isin(text, own))
        after = np.append(0, np.cumsum(np.isin(follow[at], items.pairs[items.starts[i] : items.starts[i + 1] - 1])))
        end = np.searchsorted(at, at + wide)
        begin = at[reached(end - np.arange(len(at)), after[end] - after[:-1], len(own), least)]
        for part in np.split(begin, np.flatnonzero(np.diff(begin) > wide) + 1) if len(begin) else ():
            a, b = int(part[0]), min(len(doc), int(part[-1]) + wide)
            score, end = align(own, text[a:b])
            if score > top[0]:
                _, back_to = align(own[::-1], text[a : a + end][::-1])
                top = (score, a + end - back_to, a + end)
        if (share := top[0] / full) >= least:
            found.append((i, share, top[1], top[2], int(found_seeds[j])))
    return found


def _documents(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    """The words of each row's text."""
    texts, at = batch.column(column), 0
    while at < len(texts):
        part, size = [], 0
        while at + len(part) < len(texts) and (not part or size < BYTES):
            part.append(texts[at + len(part)].as_py())
            size += len(part[-1] or b"")
        w = words(part, letters=True)
        for k in range(len(part)):
            yield at + k, w.hashes[w.starts[k] : w.starts[k + 1]]
        at += len(part)


def _bytes(df: DataFrame):  # noqa: ANN202
    return F.lower(df["text"].cast("string")).cast("binary")


def _items(ids: list, w: Words, counts_of, least: float) -> Items:  # noqa: ANN001
    """Items of the words, given the counts of documents of sorted keys."""
    vocabulary, own = np.unique(w.hashes, return_inverse=True)
    two = pairs(own)
    two[w.starts[1:][np.diff(w.starts) > 0] - 1] = 0
    keys, item, need, asked, chosen = item_keys(w.starts, w.hashes, least)
    known = np.unique(keys[keys > 0])
    at = np.where(keys > 0, np.searchsorted(known, keys), -1)
    short = bool(needed(np.diff(w.starts), least)[1].any())
    return Items(ids, w.starts, own, vocabulary, item, known, at, need, asked, short, *seeds(at, item, chosen, counts_of(known)), two)


def small_items(docs: DataFrame, items: DataFrame, least: float) -> Items:
    """The items, of bounded number and size, with their seeds; one pass over the documents counts their keys."""
    rows = items.collect()
    w = words([bytes(r[1]) for r in rows], letters=True)
    plain = _items([], w, lambda known: np.zeros(len(known), np.int64), least)

    def count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(len(plain.keys), np.int64)
        for batch in batches:
            for _, doc in _documents(batch, 0):
                totals[known_keys(doc, known_words(doc, plain), plain)] += 1
        there = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(totals[there])], ["key", "n"])

    counts = np.zeros(len(plain.keys), np.int64)
    if len(counts):
        for key, n in docs.select(_bytes(docs).alias("text")).mapInArrow(count_keys, "key long, n long").groupBy("key").agg(F.sum("n")).collect():
            counts[key] = n
    return _items([r[0] for r in rows], w, lambda known: counts, least)


def key_map(keys: DataFrame) -> np.ndarray:
    """A map of 2 ** MAP_BITS bits, whatever the number of ``key``, in which the first bits of each key are marked."""
    bit = F.shiftrightunsigned("key", 64 - MAP_BITS)
    marked = keys.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - MAP_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[marked["at"].to_numpy()] = marked["bits"].to_numpy()
    return out.view(np.uint64)


def mapped(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """The keys whose first bits are marked."""
    bit = keys >> np.uint64(64 - MAP_BITS)
    return keys[(marks[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0]


def joined_pairs(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """``doc_id, h, item, n_seeds``: documents (by id and hash of the text) and items of which they hit enough seeds, found by joins."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in _documents(batch, 1):
                keys, _, need, asked, chosen = item_keys(np.array([0, len(own)]), own, least)
                kind, place = np.nonzero(keys)
                same = [pa.array(np.full(len(place), x[0])) for x in (asked, chosen)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(place), k))), pa.array(place), pa.array(keys[kind, place].view(np.int64)), *same], ["item", "place", "key", "asked", "chosen"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    same_text = items.select(F.xxhash64("item_id", "text").alias("item"), "text").distinct()
    of_items = written(same_text.mapInArrow(places, "item long, place long, key long, asked long, chosen long"), "places")
    marks = key_map(of_items)

    def document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mapped(document_keys(doc, None, True), marks) for _, doc in _documents(batch, 0)]
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [mapped(document_keys(doc, None, True), marks) for _, doc in _documents(batch, 2)]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(flat)], ["doc_id", "h", "key"])

    counts = docs.select(_bytes(docs).alias("text")).mapInArrow(document_counts, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rarity = F.sum(F.coalesce("n", F.lit(0))).alias("rarity")
    ranked = of_items.join(counts, "key", "left").groupBy("item", "place", "asked", "chosen").agg(rarity, F.collect_list("key").alias("keys"))
    order = Window.partitionBy("item").orderBy("rarity", "place")
    seed = ranked.withColumn("rank", F.row_number().over(order)).where("rank <= chosen").select("item", "place", "asked", F.explode("keys").alias("key"))
    hits = docs.select("doc_id", _hash(docs).alias("h"), _bytes(docs).alias("text")).mapInArrow(held, f"doc_id {kind}, h long, key long")
    found = hits.join(seed, "key").groupBy("doc_id", "h", "item", "asked").agg(F.count_distinct("place").alias("n_seeds"))
    return found.where("n_seeds >= asked").drop("asked")


def _hash(docs: DataFrame):  # noqa: ANN202
    return F.xxhash64(docs["text"].cast("string"))


def joined_leaks(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    """The rows of contaminated() with the hash ``h`` of the text, for any number of items."""
    found = written(joined_pairs(docs, items, least), "pairs")
    texts = items.select(F.xxhash64("item_id", "text").alias("item"), "item_id", F.col("text").alias("item_text"))
    # The items of a document are at most those of which it hits enough seeds; their texts are short beside the document's.
    per = found.join(texts, "item").groupBy("doc_id", "h").agg(F.collect_list(F.struct("item_id", "item_text", "n_seeds")).alias("items"))
    same = docs.select("doc_id", _hash(docs).alias("h"), _bytes(docs).alias("text"))
    both = same.join(per.withColumnsRenamed({"doc_id": "d", "h": "e"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("e"))).select("doc_id", "h", "text", "items")
    types = (docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString())
    kind = arrow_type(items, "item_id")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, doc in _documents(batch, 2):
                own = batch.column(3)[k].as_py()
                w = words([x["item_text"] for x in own], letters=True)
                here = _items([x["item_id"] for x in own], w, lambda known: np.zeros(len(known), np.int64), least)
                text, count = known_words(doc, here), np.array([x["n_seeds"] for x in own])
                rows = confirmed(doc, text, known_keys(doc, text, here), here, np.arange(len(own)), count, least)
                out += [(k, here.ids[i], *rest) for i, *rest in rows]
            of, ids, share, start, end, n = zip(*out, strict=True) if out else [[]] * 6
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(ids, kind), *map(pa.array, (share, start, end, n), (pa.float64(), *[pa.int64()] * 3))], ["doc_id", "h", *COLUMNS])

    return both.mapInArrow(find, f"doc_id {types[0]}, h long, item_id {types[1]}, score double, start_word long, end_word long, n_seeds long")


COLUMNS = ["item_id", "score", "start_word", "end_word", "n_seeds"]


def few(items: DataFrame) -> bool:
    """Whether the items are few and small enough to travel to the tasks."""
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return count <= BLOCK_ITEMS and size <= BLOCK_BYTES


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word, n_seeds``: a row for each document and item that it holds a copy of.

    The best place counts, the first of equal ones; ``n_seeds`` are the places of the item's seeds that the document hits. Words are runs of letters and digits in lower case. Null
    and wordless texts hold and are nothing; null ids are carried along; rows with the same id, of either
    table, report for themselves. Very long texts are read whole and aligned only around places that may
    hold a copy. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    types = (docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    schema = f"doc_id {types[0]}, item_id {types[1]}, score double, start_word long, end_word long, n_seeds long"
    items = benchmark.where("text is not null").select("item_id", _bytes(benchmark).alias("text"))
    if not few(items):
        return joined_leaks(docs, items, least).drop("h")
    known, kind = small_items(docs, items, least), arrow_type(benchmark, "item_id")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *x) for k, doc in _documents(batch, 1) for x in leaks(doc, known, least)]
            of, i, share, start, end, count = zip(*rows, strict=True) if rows else [[]] * 6
            ids = batch.column(0).take(pa.array(of, pa.int64()))
            kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array([known.ids[x] for x in i], kind), *map(pa.array, (share, start, end, count), kinds)], ["doc_id", *COLUMNS])

    return docs.select("doc_id", _bytes(docs).alias("text")).mapInArrow(find, schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item; ids, texts and columns as for contaminated()."""
    items = benchmark.where("text is not null").select("item_id", _bytes(benchmark).alias("text"))
    if not few(items):
        dirty = joined_leaks(docs, items, least).select(F.col("doc_id").alias("d"), F.col("h").alias("e")).distinct()
        packed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own"), F.coalesce(_hash(docs), F.lit(0)).alias("h"))
        left = packed.join(dirty, F.col("own").eqNullSafe(F.col("d")) & (F.col("h") == F.col("e")), "left_anti")
        return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    known, names = small_items(docs, items, least), docs.columns

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [not leaks(doc, known, least) for _, doc in _documents(batch, 1)]
            rows = batch.filter(pa.array(clean, pa.bool_())).column(0)
            yield pa.RecordBatch.from_arrays(rows.flatten(), names)

    return docs.select(F.struct("*").alias("row"), _bytes(docs).alias("text")).mapInArrow(keep, docs.schema)
