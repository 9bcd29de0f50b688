"""Target-distribution importance resampling (operator 12) by CRC combination algebra.

Features are runs of words, in buckets by the CRC-32 of their bytes. A word's CRC is computed once; that of
a run follows from those of its words, as appending m bytes to a text multiplies its CRC by a matrix over
GF(2) that depends on m alone. No string of a run is ever made. Matrices for lengths that are powers
of two are kept as byte tables, any length is a product of them.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apertura.llm.shared import arrow_type, written
from apertura.operators.sequence import numbered

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
POLYNOMIAL = 0xEDB88320
LONGEST_RUN = 2
BUCKETS = 10_000
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 25, 7
#: Words that are worked on at a time: bounds the arrays of a long text.
PIECE = 1 << 16
SPACE = zlib.crc32(b" ")


@functools.cache
def shift_table(power: int) -> np.ndarray:
    """The matrix that appending 2**power bytes stands for: what each byte of a CRC, by its place, becomes."""
    if power:
        half = shift_table(power - 1)
        return shifted_by(half, half)
    table = np.arange(256, dtype=np.uint32)[None, :] << np.uint32([0, 8, 16, 24])[:, None]
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ np.where(table & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return table


def shifted_by(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    low = np.uint32(255)
    return table[0][crcs & low] ^ table[1][(crcs >> np.uint32(8)) & low] ^ table[2][(crcs >> np.uint32(16)) & low] ^ table[3][crcs >> np.uint32(24)]


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs multiplied by the matrices of as many appended bytes as ``lengths`` has."""
    out = crcs.astype(np.uint32)
    for power in range(int(lengths.max(initial=0)).bit_length()):
        where = (lengths >> power) & 1 == 1
        out[where] = shifted_by(shift_table(power), out[where])
    return out


def run_crcs(crcs: np.ndarray, lengths: np.ndarray, longest: int = LONGEST_RUN) -> list[np.ndarray]:
    """For 1, 2, ... words, the CRCs of all runs of so many consecutive words, joined by a space."""
    found = [crcs]
    spaced = shifted(np.full(len(crcs), SPACE, np.uint32), lengths) ^ crcs
    for k in range(1, min(longest, len(crcs))):
        found.append(shifted(found[-1][:-1], lengths[k:] + 1) ^ spaced[k:])
    return found


def feature_buckets(texts: Iterable[bytes], longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of PIECE words of whole texts: the texts' places by word, and by feature, and the features' buckets.

    A piece has the words of many short texts or part of a long one; each run is given once, in the piece it ends in.
    """
    old = (np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64))

    def piece(words: list[bytes], places: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        nonlocal old
        own = np.repeat(*np.array(places, np.int64).T)
        new = (np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), np.fromiter(map(len, words), np.int64, len(words)), own)
        before = len(old[0])
        crcs, lengths, owner = (np.concatenate(pair) for pair in zip(old, new, strict=True))
        found, owners = [], []
        for k, run in enumerate(run_crcs(crcs, lengths, longest)):
            # The run of k + 1 words from i on ends at i + k: in this piece, and in the same text.
            start = max(0, before - k)
            first, last = owner[start : len(run)], owner[start + k : len(run) + k]
            found.append(run[start:][first == last])
            owners.append(first[first == last])
        keep = max(0, len(crcs) - longest + 1)
        old = (crcs[keep:], lengths[keep:], owner[keep:])
        return own, np.concatenate(owners), np.concatenate(found) % np.uint32(buckets)

    words: list[bytes] = []
    places: list[tuple[int, int]] = []
    for at, text in enumerate(texts):
        folded = text.translate(FOLD)
        rest = iter(WORD.findall(folded)) if len(folded) <= PIECE else (m.group() for m in WORD.finditer(folded))
        while more := list(islice(rest, PIECE - len(words))):
            words += more
            places.append((at, len(more)))
            if len(words) >= PIECE:
                yield piece(words, places)
                words, places = [], []
    if words:
        yield piece(words, places)


def _texts(column: pa.Array) -> Iterator[bytes]:
    return ((text.as_py() or "").encode() for text in column)


def bucket_counts(texts: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all texts fall into each bucket; a task sends a bucket once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in feature_buckets(_texts(batch.column(0)), longest, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    parts = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain in thousandths; as many numbers as buckets, whatever the tables' size."""
    have, want = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for out, texts in ((have, source), (want, target)):
        for bucket, n in bucket_counts(texts, longest, buckets).collect():
            out[bucket] = n
    all_have, all_want = float(have.sum() + buckets), float(want.sum() + buckets)
    return np.array([math.floor(1000 * math.log((t + 1) * all_have / ((s + 1) * all_want))) for s, t in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of a document's gains, 0 without features."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    id_type = arrow_type(docs, "doc_id")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            words, features, total = np.zeros((3, batch.num_rows), np.int64)
            for own, owner, found in feature_buckets(_texts(batch.column(1)), longest, len(table)):
                words += np.bincount(own, minlength=batch.num_rows)
                features += np.bincount(owner, minlength=batch.num_rows)
                np.add.at(total, owner, table[found])
            weight = np.floor_divide(total, np.maximum(features, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(id_type), *map(pa.array, (words, features, weight))], ["doc_id", "n_words", "n_features", "weight"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(weigh, schema)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A Gumbel draw of the id in thousandths, floored; a null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for every document with ``n_features, weight, score`` and ``rank`` in the draw, null if not drawn.

    Of the documents with ``least_words`` words and more the highest ``percent`` of scores are drawn, ties to
    the smaller id, a null id first; rows equal in score and id are ranked in any order. Null and empty
    texts have no features and weight 0 and are not drawn. All rows are sorted by score in ranges, so no
    task ranks the table. Very long texts are read whole, in pieces; an empty table gives an empty result, and an
    empty target leaves all gains to the source; other columns are ignored.
    """
    gain = gains(docs, target)
    scored = weighed(docs, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"))).withColumn("__may", F.col("n_words") >= least_words)
    table = written(scored, "scores")
    eligible = table.filter("__may").count()
    drawn = percent * eligible // 100
    ranked = numbered(table, F.col("__may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), name="rank")
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
