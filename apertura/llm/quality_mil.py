"""Quality classifier by attention-based multiple-instance learning (operator 4).

A document is a bag of passages of PASSAGE bytes. A passage is encoded from how often each kind of byte
follows each other kind, its length, and how many of its words repeat the one before; a gated attention
(Ilse et al., 2018) weighs the encodings, and the weighted mean is scored. Only the documents' labels train
it, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apertura.llm.shared import held_out
from apertura.llm.tokens import words

PASSAGE = 512
KINDS = 16
FEATURES = KINDS * KINDS + 3
HIDDEN, GATE = 24, 12
#: The classifier is fitted on at most this many labelled documents, those with the smallest hashes of their
#: ids, one row of each, and on at most this many passages of a document, spread over its length.
SAMPLE_DOCS = 3000
SAMPLE_PASSAGES = 64
THRESHOLD = 0.3
SEED = 5
#: Bytes of text that are encoded at a time.
BYTES = 1 << 20


def _kinds() -> np.ndarray:
    kind = np.full(256, 14, np.uint8)
    groups = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "#$%&*@^~", "\"'`()[]{}", "-_/\\+=<>"]
    for k, chars in enumerate(groups):
        kind[[ord(c) for c in chars]] = k
    kind[0x80:] = 12
    return kind


_KIND = _kinds()


def encoded(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage, and the text it belongs to; every text has a passage, if an empty one."""
    texts = [t or b"" for t in texts]
    lens = np.array([len(t) for t in texts], np.int64)
    per = np.maximum(1, -(-lens // PASSAGE))
    owner, first = np.repeat(np.arange(len(texts)), per), np.cumsum(per) - per
    kind = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
    at = np.cumsum(lens) - lens
    text = np.repeat(np.arange(len(texts)), lens)
    passage = first[text] + (np.arange(len(kind)) - at[text]) // PASSAGE
    rows = len(owner)
    same = passage[1:] == passage[:-1]
    cell = passage[1:] * (KINDS * KINDS) + kind[:-1].astype(np.int64) * KINDS + kind[1:]
    x = np.zeros((rows, FEATURES), np.float32)
    x[:, : KINDS * KINDS] = np.bincount(cell[same], minlength=rows * KINDS * KINDS).reshape(rows, -1)
    size = np.bincount(passage, minlength=rows)
    x[:, : KINDS * KINDS] = np.sqrt(x[:, : KINDS * KINDS] / np.maximum(1, size)[:, None])
    x[:, -3], x[:, -2], x[:, -1] = repeats(texts, at, first, rows), size / PASSAGE, size == 0
    return x, owner


def repeats(texts: list[bytes], at: np.ndarray, first: np.ndarray, rows: int) -> np.ndarray:
    """The share of each passage's words, by their first bytes, that are the same as the word before in the passage."""
    w = words(texts)
    # words() sees the texts with a byte between them.
    passage = first[w.text] + (w.first - at[w.text] - w.text) // PASSAGE
    same = (w.hashes[1:] == w.hashes[:-1]) & (passage[1:] == passage[:-1])
    return np.bincount(passage[1:][same], minlength=rows) / np.maximum(1, np.bincount(passage, minlength=rows))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _shares(e: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Softmax within each owner."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, owner, e)
    e = np.exp(e - top[owner])
    return e / np.bincount(owner, e, n)[owner]


class Model:
    """W, b: the encoder; V, U, w: the gated attention; c: the score."""

    def __init__(self, rng: np.random.Generator) -> None:
        shapes = {"W": (FEATURES, HIDDEN), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,)}
        self.p = {k: rng.standard_normal(s) * s[0] ** -0.5 for k, s in shapes.items()} | {"b": np.zeros(HIDDEN), "c0": np.zeros(1)}

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = _shares((t * s) @ p["w"], owner, n)
        z = np.zeros((n, HIDDEN))
        np.add.at(z, owner, a[:, None] * h)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["c0"])}

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, owner, len(y))
        d = (f["score"] - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (dz[owner] * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.bincount(owner, f["a"] * da, len(y))[owner])
        gate = de[:, None] * p["w"]
        dt, ds = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        dh = f["a"][:, None] * dz[owner] + dt @ p["V"].T + ds @ p["U"].T
        du = dh * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ d, "c0": np.array([d.sum()]), "w": (f["t"] * f["s"]).T @ de, "V": f["h"].T @ dt, "U": f["h"].T @ ds, "W": x.T @ du, "b": du.sum(axis=0)}


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, epochs: int = 30, batch: int = 32, rate: float = 3e-3, decay: float = 1e-4, seed: int = SEED) -> Model:
    """``owner`` is ascending and counts from 0; ``y`` has a label for each document."""
    rng = np.random.default_rng(seed)
    model, starts = Model(rng), np.searchsorted(owner, np.arange(len(y) + 1))
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[d], starts[d + 1]) for d in docs])
            own = np.repeat(np.arange(len(docs)), starts[docs + 1] - starts[docs])
            step += 1
            for k, g in model.gradients(x[rows], own, y[docs]).items():
                g = g + decay * model.p[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bounded(texts: pa.Array) -> Iterator[list[bytes | None]]:
    part: list = []
    size = 0
    for text in texts:
        part.append(text.as_py())
        size += len(part[-1] or b"")
        if size >= BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def fitted(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> Model | None:
    """The model for ``docs``; the sample's features, not its texts, come to the driver. None without labels.

    Rows whose id or label is null are not labels; of several labels of an id the smallest counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").cast("int").alias("quality"))
    # One label of an id, and only ids that have a document: neither repeats nor strangers take places in the sample.
    once = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).join(docs.select("doc_id"), "doc_id", "left_semi")
    few = once.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(SAMPLE_DOCS)
    rows = docs.select("doc_id", docs["text"].cast("string").cast("binary").alias("text")).join(F.broadcast(few), "doc_id").select("doc_id", "quality", "text", F.xxhash64(F.lit(seed), "text").alias("h"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[bytes] = []
            for part in _bounded(batch.column(2)):
                x, owner = encoded(part)
                cuts = np.searchsorted(owner, np.arange(len(part) + 1))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    some = np.unique(np.linspace(a, b - 1, min(b - a, SAMPLE_PASSAGES)).astype(np.int64))
                    packed.append(x[some].astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(packed, pa.binary())], ["doc_id", "quality", "h", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    passages = rows.mapInArrow(encode, f"doc_id {kind}, quality int, h long, x binary")
    # However often an id is repeated, one row of it, by the hash of its text, comes to the driver.
    bags_of = passages.groupBy("doc_id").agg(F.min(F.struct("h", "quality", "x")).alias("s")).select("doc_id", "s.quality", "s.x")
    got = sorted(bags_of.select(F.xxhash64(F.lit(seed), "doc_id"), "quality", "x").collect(), key=lambda r: (r[0], bytes(r[2])))
    if len({r[1] for r in got}) < 2:
        return None
    bags = [np.frombuffer(bytes(r[2]), np.float16).reshape(-1, FEATURES).astype(np.float64) for r in got]
    return train(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([r[1] for r in got], float))


def scored(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    Null and empty texts are one empty passage and get its score; very long texts are read whole, passage by
    passage. Where there are not labels of both kinds, every score is 0.5. Null ids count as held out; rows
    with the same id are scored one by one, and one of them, by hash, is learnt from; an empty table gives
    an empty result; other columns are ignored.
    """
    model = model or fitted(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores: list[float] = []
            for part in _bounded(batch.column(2)):
                if model is None:
                    scores += [0.5] * len(part)
                    continue
                x, owner = encoded(part)
                scores += model.forward(x.astype(np.float64), owner, len(part))["score"].tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), docs["text"].cast("string").cast("binary").alias("text")).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
