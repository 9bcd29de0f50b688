"""Secret scans: fixed patterns and a token-efficiency test (operator 10).

A byte-pair vocabulary made from ordinary text spends few characters a token on random strings. Runs of
key characters with a low characters-per-token ratio are reported as kind ``token``, unless they are digests
of usual lengths, UUIDs or plain numbers. Where a run as a whole is efficient, what is between its ``=``
signs, then between slashes, then between other marks is tested by itself, and at last overlapping windows
of it, so that words beside a random string don't hide it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("passw", "secret", "token", "api")
#: Strings that the token-efficiency test looks at, and those it leaves out: digests, UUIDs, numbers.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KNOWN = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}|[0-9+/_=-]+)", re.I)
HELD = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})(?![0-9A-Za-z])", re.I)
#: What parts a run, tried one after the other.
MARKS = ("=", "/", "+_-")
SHORTEST = 16
#: Windows of parts that are as long at least.
WINDOW, STEP = 32, 8
KINDS = ("assign", "access", "hex", "token")
#: Characters a token at most: of runs with digits, with both cases, and of letters of one case (words may
#: begin with a capital), which need to be longer, as words come near.
MOST_PER_TOKEN = 2.0
MOST_OF_BOTH_CASES = 1.6
MOST_OF_ONE_CASE, SHORTEST_OF_ONE_CASE = 1.75, 20
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text into pieces that public byte-level vocabularies are used with, for ASCII.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(ranks: bytes):  # noqa: ANN201
    """The tokenizer of a vocabulary file's content."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("secret-scan", pat_str=PIECES, mergeable_ranks=table, special_tokens={})


def known_vocabulary(path: str = VOCABULARY) -> bytes:
    """The content of a vocabulary file; it is read where the query is built and travels to the tasks."""
    return Path(path).read_bytes()


def per_token(run: str, ranks: bytes) -> float:
    return len(run) / max(1, len(encoding(ranks).encode_ordinary(run)))


def inefficient(part: str, ranks: bytes) -> bool:
    """Whether the vocabulary spends more tokens on the part than it would on words."""
    if re.search("[0-9]", part):
        most = MOST_PER_TOKEN
    elif re.search("[a-z]", part) and re.search("[A-Z]", part[1:]):
        most = MOST_OF_BOTH_CASES
    elif len(part) >= SHORTEST_OF_ONE_CASE:
        most = MOST_OF_ONE_CASE
    else:
        return False
    return per_token(part, ranks) <= most


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; a match is its whole extent."""
    found = []
    low = text.lower()
    if any(cue in low for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, ranks: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the inefficient runs or, where a run as a whole isn't one, of its inefficient parts."""
    found: list[tuple[int, int, int]] = []

    def test(start: int, end: int, level: int) -> None:
        part = text[start:end]
        if end - start < SHORTEST or KNOWN.fullmatch(part):
            return
        if not HELD.search(part) and inefficient(part, ranks):
            found.append((start, 3, end))
        elif level < len(MARKS):
            for m in re.finditer(f"[^{MARKS[level]}]+", part):
                test(start + m.start(), start + m.end(), level + 1)
        elif end - start > WINDOW:
            spans: list[list[int]] = []
            for at in [*range(start, end - WINDOW, STEP), end - WINDOW]:
                if inefficient(text[at : at + WINDOW], ranks):
                    if spans and at <= spans[-1][1]:
                        spans[-1][1] = at + WINDOW
                    else:
                        spans.append([at, at + WINDOW])
            found.extend((a, 3, b) for a, b in spans)

    for m in CANDIDATE.finditer(text):
        test(m.start(), m.end(), 0)
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scanned(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for every document with its counts and spans; start and end in code points, end exclusive.

    A null text counts as empty and has no spans. A run of the same string may be reported under several
    kinds. Null or repeated doc_ids are kept; very long texts and runs are read whole; an empty table gives
    an empty result; other columns are ignored. Without a file at ``vocabulary`` the call fails.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(known_vocabulary(vocabulary))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                kinds = [kind for _, kind, _ in base]
                row = (*map(kinds.count, range(3)), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + token_spans(text, ranks.value))))
                for col, value in zip(cols, row, strict=True):
                    col.append(value)
            kind = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, cols, kind)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(scan, schema)
