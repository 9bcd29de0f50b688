"""Language identification by a byte convolutional network written in numpy (operator 7).

Bytes are embedded; filters of several widths run over fixed-length windows; each filter's largest
response in a window goes through a ReLU into a softmax over the languages. Because only the largest
response counts, training passes gradients back through one place for each filter and window. Embedding
and filters are multiplied out into tables by byte pair for use on whole texts. A document's distribution
is the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apertura.llm.shared import held_out

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 12
#: The classifier is fitted on at most this many labelled documents, those with the smallest hashes in each
#: language alike, but one of every language at least, and on at most this many windows of each.
SAMPLE_DOCS = 1600
SAMPLE_WINDOWS = 4
SEED = 11
#: Windows that go through the network at once.
CHUNK = 32


@dataclass
class Net:
    """widths' tables by byte: table[w][j] is 256 x FILTERS, the response of byte j of a filter of width w."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]  # (width, EMBED, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def params(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.out_bias]


def windows(data: bytes) -> np.ndarray:
    """The whole text as rows of WINDOW bytes, the last padded with zeros; two rows' texts don't overlap."""
    n = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(n * WINDOW, b"\0"), dtype=np.uint8).reshape(n, WINDOW)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def new_net(langs: list[str], rng: np.random.Generator) -> Net:
    total = FILTERS * len(WIDTHS)
    normal = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    return Net(langs, normal(256, EMBED, by=0.5), [normal(w, EMBED, FILTERS, by=(w * EMBED * 0.25) ** -0.5) for w in WIDTHS], np.zeros(total, np.float32), normal(total, len(langs), by=0.2), np.zeros(len(langs), np.float32))


def gradients(net: Net, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    n, rows = len(x), np.arange(len(x))[:, None]
    pooled, places = [], []
    for w, f in zip(WIDTHS, net.filters, strict=True):
        span = WINDOW - w + 1
        act = sum((net.embed @ f[j])[x[:, j : j + span]] for j in range(w))
        places.append(act.argmax(axis=1))
        pooled.append(np.take_along_axis(act, places[-1][:, None, :], axis=1)[:, 0])
    pre = np.concatenate(pooled, axis=1) + net.bias
    hidden = np.maximum(pre, 0)
    p = softmax(hidden @ net.out + net.out_bias)
    loss = float(-np.log(p[np.arange(n), y] + 1e-9).mean())
    p[np.arange(n), y] -= 1
    p /= n
    d_pre = (p @ net.out.T) * (pre > 0)
    d_embed, d_filters = np.zeros_like(net.embed), []
    for k, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        d = d_pre[:, k * FILTERS : (k + 1) * FILTERS]
        d_filter = np.empty_like(f)
        for j in range(w):
            table = np.zeros((256, FILTERS), np.float32)
            np.add.at(table, (x[rows, places[k] + j], np.arange(FILTERS)[None, :]), d)
            d_filter[j] = net.embed.T @ table
            d_embed += table @ f[j].T
        d_filters.append(d_filter)
    return loss, [d_embed, *d_filters, d_pre.sum(axis=0), hidden.T @ p, p.sum(axis=0)]


def drawn(data: bytes, seed: int) -> np.ndarray:
    """Some of the text's windows, by chance."""
    rows = windows(data)
    return rows[np.random.default_rng(seed & (2**63 - 1)).permutation(len(rows))[:SAMPLE_WINDOWS]]


def train(samples: list[np.ndarray], labels: list[str], epochs: int = 12, batch: int = 64, rate: float = 4e-3, seed: int = SEED) -> Net | None:
    """Fits the network with Adam to the windows of labelled texts; some are cut short, so that short texts are known too. None without labels."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng, number = np.random.default_rng(seed), {lang: k for k, lang in enumerate(langs)}
    x, y = np.concatenate(samples), np.repeat([number[lang] for lang in labels], [len(rows) for rows in samples])
    net = new_net(langs, rng)
    first = [np.zeros_like(p) for p in net.params()]
    second, step = [np.zeros_like(p) for p in net.params()], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = x[order[at : at + batch]].copy()
            for k in np.flatnonzero(rng.random(len(rows)) < 0.3):
                rows[k, rng.integers(8, WINDOW) :] = 0
            _, grads = gradients(net, rows, y[order[at : at + batch]])
            step += 1
            for p, g, m, v in zip(net.params(), grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-7)
    return net


class Reader:
    """A fitted network with its filters as tables by pair of bytes."""

    def __init__(self, net: Net) -> None:
        self.net, self.tables = net, []
        for w, f in zip(WIDTHS, net.filters, strict=True):
            single = [net.embed @ f[j] for j in range(w)]
            pairs = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS)) for j in range(0, w - 1, 2)]
            self.tables.append((w, pairs, (w - 1, single[-1]) if w % 2 else None))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.net.langs)), np.float32)
        for at in range(0, len(x), CHUNK):
            part = x[at : at + CHUNK].astype(np.int32)
            pair = part[:, :-1] * 256 + part[:, 1:]
            pooled = []
            for w, pairs, odd in self.tables:
                span = WINDOW - w + 1
                act = np.take(pairs[0][1], pair[:, :span], axis=0)
                for j, t in pairs[1:]:
                    act += np.take(t, pair[:, j : j + span], axis=0)
                if odd:
                    act += np.take(odd[1], part[:, odd[0] : odd[0] + span], axis=0)
                pooled.append(act.max(axis=1))
            out[at : at + CHUNK] = softmax(np.maximum(np.concatenate(pooled, axis=1) + self.net.bias, 0) @ self.net.out + self.net.out_bias)
        return out


def fitted(docs: DataFrame) -> Net | None:
    """The network for ``docs``, from labelled rows outside the held-out fold.

    Windows of a bounded sample come to the driver, drawn where the texts are; equal rows count once. The
    scans are as many whatever the languages.
    """
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.col("text") != "")).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h"))
    distinct = known.select("lang", "h").distinct()
    counts = distinct.groupBy("lang").count().collect()  # as many rows as the network has languages
    each = max(1, SAMPLE_DOCS // max(1, len(counts)))
    # The smallest hashes of a language lie below a bound under which more are expected, by far, than are taken.
    share = [(r[0], min(1.0, (2 * each + 64) / r[1])) for r in counts]
    bounds = docs.sparkSession.createDataFrame([(lang, min(2**63 - 1, int(part * 2.0**64) - 2**63)) for lang, part in share], "lang string, most long")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    low = distinct.join(F.broadcast(bounds), "lang").where("h <= most")
    few = low.withColumn("n", rank).where(F.col("n") <= each).select("lang", "h")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [drawn(text.encode(), h).tobytes() for h, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["lang", "h", "windows"])

    # The sample has at most SAMPLE_DOCS rows, or one of each language.
    rows = known.join(F.broadcast(few), ["lang", "h"]).select("lang", "h", "text").mapInArrow(draw, "lang string, h long, windows binary")
    got = sorted(map(tuple, rows.groupBy("lang", "h").agg(F.min("windows").alias("windows")).collect()))
    return train([np.frombuffer(bytes(r[2]), np.uint8).reshape(-1, WINDOW) for r in got], [r[0] for r in got])


def identified(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document; the score is its language's mean probability.

    A null text or one without a letter is ``und`` with score 0, as is everything where no row is labelled.
    A null doc_id counts as held out; repeated ids are rows of their own; a tie of languages goes to the
    first by name; very long texts are read whole, window by window; an empty table gives an empty result;
    other columns are ignored.
    """
    net = net or fitted(docs)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            langs, scores = predictions(reader, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double"
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), docs["text"].cast("string").alias("text")).mapInArrow(read, schema)


def with_language(docs: DataFrame, net: Net | None = None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (as ``identified`` gives them), which replace columns of those names."""
    net = net or fitted(docs)
    docs = docs.drop("lang_pred", "lang_score")
    place = docs.columns.index("text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            langs, scores = predictions(reader, batch.column(place).cast(pa.string()))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "lang_pred", "lang_score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    return docs.mapInArrow(read, schema)


def predictions(reader: Reader | None, texts: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores, waiting, size = ["und"] * len(texts), [0.0] * len(texts), [], 0

    def flush() -> None:
        nonlocal size
        if waiting:
            rows = [windows(data) for _, data in waiting]
            probs, at = reader.probabilities(np.concatenate(rows)), 0
            for (k, data), own in zip(waiting, rows, strict=True):
                weight = np.full(len(own), WINDOW, np.float64)
                weight[-1] = len(data) - WINDOW * (len(own) - 1)
                p = (probs[at : at + len(own)] * weight[:, None]).sum(axis=0) / weight.sum()
                langs[k], scores[k] = reader.net.langs[int(p.argmax())], min(1.0, float(p.max()))
                at += len(own)
        waiting.clear()
        size = 0

    for k, text in enumerate(texts):
        text = text.as_py()
        if reader is None or not text or not any(map(str.isalpha, text)):
            continue
        waiting.append((k, text.encode()))
        size += len(waiting[-1][1])
        if size >= 1 << 20:
            flush()
    flush()
    return langs, scores
