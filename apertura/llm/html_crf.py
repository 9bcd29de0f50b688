"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks (operator 2).

Every block is described by the tags, names and roles of its ancestors and by its text; the field scores
sequences of the labels *other* and *main*. It is trained on labelled pages by the gradient of the
log-likelihood (forward-backward over all pages at once) and decoded by Viterbi.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from apertura.llm.html_blocks import Block, blocks
from apertura.llm.labelled_pages import labelled_pages

#: The labelled pages that the default model is trained on, and how.
PAGES = 800
SEED = 3
STEPS, RATE, DECAY = 140, 0.12, 5e-4
#: A feature of fewer training pages is left out.
LEAST_PAGES = 3
CUES = ("©", "cookie", "copyright", "privacy", "advertisement", "sponsored", "subscribe", "newsletter", "sign in", "log in", "comment", "reply", "related", "rights reserved", "read more", "share", "search")
#: Blocks alike in all that is scored keep their score; so many kinds are remembered.
KINDS = 50_000


def text_kind(block: Block) -> tuple[str, str, str, bool]:
    """What of a block's text is scored: its number of words, share of links, ending, and whether it has a cue."""
    text, n = block.text, block.text.count(" ") + 1
    end = "stop" if text[-1] in ".!?…\"'”»" else "colon" if text[-1] in ":;" else "no"
    low = text.lower()
    cue = any(c in low for c in CUES)
    return f"words:{min(6, n.bit_length())}", f"linked:{min(3, int(block.linked * 4))}", f"end:{end}", cue


def bare(page: list[Block]) -> bool:
    """Whether nothing on the page is named or a section."""
    return all("near:none" in block.context.near for block in page)


def features(block: Block, alone: bool) -> list[str]:
    ctx = block.context
    size, link, end, cue = text_kind(block)
    found = [*ctx.names, *ctx.near, f"inner:{ctx.inner}", f"tag:{block.tag}", size, link, end, f"{size},{end}", f"{size},{link}", f"{ctx.inner.rpartition('>')[2]},{block.tag}"]
    return found + [f"cue:{ctx.inner.rpartition('>')[2]}", f"cue,{size}"] * cue + ["bare"] * alone


@dataclass
class Field:
    """``weights``: a row for each feature and a column for each label; ``moves``: from label to label; ``begin``."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray
    begin: np.ndarray
    known: dict = field(default_factory=dict, repr=False)

    def leanings(self, page: list[Block]) -> list[float]:
        """By how much each block's features favour *main*."""
        out, alone = [], bare(page)
        for block in page:
            ctx = block.context
            kind = (alone, ctx.names, ctx.near, ctx.inner, block.tag, text_kind(block))
            if (score := self.known.get(kind)) is None:
                rows = [i for f in features(block, alone) if (i := self.index.get(f)) is not None]
                if len(self.known) >= KINDS:
                    self.known.clear()
                score = self.known[kind] = float((self.weights[rows, 1] - self.weights[rows, 0]).sum())
            out.append(score)
        return out

    def decode(self, page: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        if not page:
            return []
        leanings, ((oo, om), (mo, mm)) = self.leanings(page), self.moves.tolist()
        other, main = float(self.begin[0]), float(self.begin[1]) + leanings[0]
        back = []
        for score in leanings[1:]:
            back.append((mo + main > oo + other, mm + main >= om + other))
            other, main = max(oo + other, mo + main), score + max(om + other, mm + main)
        label = main > other
        path = [label]
        for from_other, from_main in reversed(back):
            label = from_main if label else from_other
            path.append(label)
        return path[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def trained(pages: list[str], steps: int = STEPS) -> Field:
    """Fits the field to pages that mark their main text with ``data-main`` (see labelled_pages)."""
    parsed = [b for b in map(blocks, pages) if b]
    named = [[features(block, alone) for block in page] for page in parsed for alone in [bare(page)]]
    seen = Counter(f for page in named for f in {f for block in page for f in block})
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST_PAGES))}
    length = np.array([len(p) for p in parsed])
    n, longest = len(parsed), int(length.max())
    rows, place = [], []  # of each feature of each block: its number and the block's place in the padded array
    truth = np.zeros((n, longest), np.int64)
    for p, page in enumerate(named):
        for k, found in enumerate(page):
            truth[p, k] = parsed[p][k].context.main
            known = [index[f] for f in found if f in index]
            rows += known
            place += [p * longest + k] * len(known)
    row, at = np.array(rows), np.array(place)
    there = np.arange(longest) < length[:, None]
    both = there[:, 1:]
    one = np.eye(2)[truth] * there[:, :, None]
    model = Field(index, np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros(2))
    params = [model.weights, model.moves, model.begin]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    last = length - 1
    for step in range(1, steps + 1):
        e = np.stack([np.bincount(at, model.weights[row, y], n * longest) for y in (0, 1)], axis=1).reshape(n, longest, 2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + model.begin
        for t in range(1, longest):
            alpha[:, t] = e[:, t] + _log_sum(alpha[:, t - 1, :, None] + model.moves, 1)
        for t in range(longest - 2, -1, -1):
            step_back = _log_sum(model.moves + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where((t < last)[:, None], step_back, 0)
        total = _log_sum(alpha[np.arange(n), last], 1)
        node = np.exp(alpha + beta - total[:, None, None]) * there[:, :, None]
        pair = alpha[:, :-1, :, None] + model.moves + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        pair = np.where(both[:, :, None, None], np.exp(np.minimum(pair, 0)), 0)
        true_pair = one[:, :-1, :, None] * one[:, 1:, None, :]
        rest = (one - node).reshape(-1, 2)
        grads = [
            np.stack([np.bincount(row, rest[at, y], len(index)) for y in (0, 1)], axis=1) / n - DECAY * model.weights,
            (true_pair - pair).sum(axis=(0, 1)) / n - DECAY * model.moves,
            (one[:, 0] - node[:, 0]).sum(axis=0) / n,
        ]
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


@functools.cache
def default_model() -> Field:
    return trained(labelled_pages(PAGES, SEED))


def main_text(model: Field, page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, main in zip(found, model.decode(found), strict=True) if main)


def extracted(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    The main blocks in page order, joined by an empty line; character references are decoded and white
    space inside a block is one space. A null, empty or textless page, or one without main blocks, has the
    empty text and 0 characters. Null or repeated page_ids and null urls are kept; very long pages are read
    whole; an empty table gives an empty result; other columns are ignored.
    """
    model = model or default_model()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(model, page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    return pages.select("page_id", pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")).mapInArrow(read, schema)
