"""SentencePiece encoding and decoding of merge-type vocabularies (operator 11) with a table of prefixes.

In a vocabulary whose pieces come from ranked merges, the encoding of each prefix of a text ends in exactly one
piece: of the pieces that an automaton finds ending there, the only one that fits behind the last piece of
the prefix before it. Two pieces fit if no merge across their border would have come before the merges
that made them. With each prefix's last piece stored, the ids are recovered from the text's end backwards.
A text is cut where no piece goes across, and short segments are remembered with their ids, digits and text.

Pieces with equal scores below all others (runs of the space mark in public vocabularies) have no rank of their
own. They merge after all others, leftmost first, and are put together from the ids afterwards.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: What a model with the normalization known here makes of ``PROBE``.
PROBE, PROBED = " a  ﬁ \n ", "▁▁a▁▁ﬁ \n▁"
#: Characters of the segments that a task remembers (ENTRY more for each; two generations), the longest of them, and tested pairs; segments that are digested at a time.
REMEMBERED, ENTRY, LONGEST_REMEMBERED, PAIRS, PIECE_IDS = 7_000_000, 8, 64, 1_000_000, 1 << 16
UNKNOWN = -1
CHANGED = "!"
_CHAR = -1


def _replaced(e: UnicodeError) -> tuple[str, int]:
    return "�" * (e.end - e.start), e.end


codecs.register_error("apertura-each-byte", _replaced)


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: plain values that travel to the tasks."""

    pieces: list[str]
    ranks: dict[int, int]  #: of each piece that merges by rank; single characters have rank -1
    parts: dict[int, tuple[int, int]]  #: the two pieces that a piece is merged from last
    late: dict[str, int]  #: pieces of equal score, merged at last
    bytes_of: dict[int, int]
    silent: frozenset[int]
    unknown: int


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _merged(piece: str, rank: dict[str, int]) -> tuple[str, str] | None:
    """The last two parts of a piece when its characters are merged by rank; None if they don't become the piece."""
    parts = list(piece)
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda k: rank.get(parts[k] + parts[k + 1], len(rank)))
        if parts[best] + parts[best + 1] not in rank:
            return None
        if len(parts) == 2:
            return parts[0], parts[1]
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return None


@functools.lru_cache(maxsize=2)
def vocabulary(model: bytes) -> Vocabulary:
    """Reads a model's content; raises ValueError if its pieces aren't of the merge type that this module knows."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    if sp.normalize(PROBE) != PROBED:
        raise ValueError("only models that keep text as it is and put a space mark before it are known")
    ids = range(sp.get_piece_size())
    pieces = [sp.id_to_piece(i) for i in ids]
    plain = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    times = Counter(sp.get_score(i) for i in plain if len(pieces[i]) > 1)
    late = {pieces[i]: i for i in plain if len(pieces[i]) > 1 and times[sp.get_score(i)] > 1}
    own = sorted((i for i in plain if len(pieces[i]) > 1 and pieces[i] not in late), key=lambda i: -sp.get_score(i))
    rank = {pieces[i]: k for k, i in enumerate(own)}
    id_of = {pieces[i]: i for i in plain}
    if late:
        scores = {sp.get_score(i) for i in late.values()}
        if len(scores) > 1 or (own and min(sp.get_score(i) for i in own) <= max(scores)) or any(p.startswith(q) or p.endswith(q) for p in rank for q in late):
            raise ValueError("pieces of equal score must come after all others and be part of none of them")
    ranks, parts = {id_of[p]: _CHAR for p in id_of if len(p) == 1}, {}
    for piece, k in rank.items():
        if (two := _merged(piece, rank)) is None:
            continue  # never made from its characters, so never in an encoding
        if any(p not in id_of or rank.get(p, _CHAR) >= k for p in two):
            raise ValueError(f"{piece!r} isn't merged from pieces of lower rank")
        ranks[id_of[piece]], parts[id_of[piece]] = k, (id_of[two[0]], id_of[two[1]])
    bytes_of = {i: int(pieces[i][3:5], 16) for i in ids if sp.is_byte(i)}
    if len(bytes_of) != 256:
        raise ValueError("only models with a piece for each byte are known")
    return Vocabulary(pieces, ranks, parts, late, bytes_of, frozenset(i for i in ids if sp.is_control(i)), sp.unk_id())


class _Remembered(dict):
    """What is made of short segments or words: those in use and, once they are too many, those of the generation before."""

    def __init__(self, make: Callable[[str], tuple | str]) -> None:
        self.make, self.older, self.size = make, {}, 0

    def __missing__(self, segment: str) -> tuple | str:
        value = self.older.get(segment)
        if value is None:
            value = self.make(segment)
        if len(segment) <= LONGEST_REMEMBERED:
            if self.size >= REMEMBERED:
                self.older, self.size = dict(self), 0
                self.clear()
            self[segment] = value
            self.size += len(segment) + ENTRY
        return value


class _Piece(dict):
    """A piece as the automaton finds it, and whether it fits behind those pieces that it was tested with."""

    __slots__ = ("id", "length", "test")

    def __init__(self, piece: int, length: int, test: Callable[[int, int], bool]) -> None:
        self.id, self.length, self.test = piece, length, test
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[UNKNOWN] = True

    def __missing__(self, left: int) -> bool:
        return self.test(left, self)


def _joined(pieces: list[str]) -> str:
    """Letters of pieces and whatever follows them within a piece: no piece goes on from these characters to others."""
    after: dict[str, set[str]] = {}
    for p in pieces:
        for a, b in itertools.pairwise(p):
            after.setdefault(a, set()).add(b)
    found = new = {c for p in pieces for c in p if c.isalpha()}
    while new:
        new = set().union(*(after.get(c, ()) for c in new)) - found
        found |= new
    return "".join(sorted(found))


class Encoder:
    """Encodes and decodes texts; remembers short segments and pairs, in bounded numbers."""

    def __init__(self, v: Vocabulary) -> None:
        import ahocorasick

        self.v = v
        self.lengths = [len(p) for p in v.pieces]
        self.automaton = ahocorasick.Automaton()
        self.rank_of = {}
        self.tested: list[_Piece] = []
        for i, k in v.ranks.items():
            self.automaton.add_word(v.pieces[i], _Piece(i, self.lengths[i], self._test))
            if k != _CHAR:
                self.rank_of[v.pieces[i]] = k
        self.automaton.make_automaton()
        self.byte_ids = {b: i for i, b in v.bytes_of.items()}
        self.known = _Remembered(self._encoded)
        self.told, self.words = _Remembered(self._told), _Remembered(self._word)
        # No piece goes on from another character into a space mark: segments that begin with marks stand alone. Nor from
        # joined characters to others: a word is a segment without what follows it.
        pieces = [*(v.pieces[i] for i in v.ranks), *v.late]
        joined = re.escape(_joined(pieces))
        self.apart = bool(joined) and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)
        self.segment = re.compile(f"{SPACE}*[^{SPACE}{joined}]*[{joined}]+|{SPACE}*[^{SPACE}{joined}]+|{SPACE}+" if self.apart else "(?s:.+)")
        self.marked = SPACE in pieces
        self.digits = [f",{i}" for i in range(len(v.pieces))]
        self.shown = [p.replace(SPACE, " ") for p in v.pieces]
        for i in v.silent:
            self.shown[i] = ""
        self.shown[v.unknown] = " ⁇ "

    def _test(self, left: int, right: _Piece) -> bool:
        """Whether a piece fits behind another, remembered with the piece."""
        if len(self.tested) >= PAIRS:
            for piece in self.tested:
                piece.forget()
            self.tested.clear()
        known = right[left] = self._fits(left, right.id)
        self.tested.append(right)
        return known

    def _fits(self, left: int, right: int) -> bool:
        """Whether the merges that make the two pieces all come before any merge across their border."""
        pieces, ranks, parts = self.v.pieces, self.v.ranks, self.v.parts
        until = len(ranks) + 1  # merges before this one would come first
        while True:
            if self.rank_of.get(pieces[left] + pieces[right], until) < until:
                return False
            later_left = ranks[left] > ranks[right]
            undone = left if later_left else right
            if ranks[undone] == _CHAR:
                return True
            if later_left:
                until, left = ranks[left], parts[left][1]
            else:  # of equal merges the left one, across the border, comes first
                until, right = ranks[right] + 1, parts[right][0]

    def _by_prefixes(self, segment: str) -> list[int]:
        """The last piece of every prefix, then the ids from the end backwards; UNKNOWN for other characters."""
        last = [UNKNOWN] * (len(segment) + 1)  # the additional one stands before the first
        lengths, done = self.lengths, -1
        for end, piece in self.automaton.iter(segment):  # one piece fits at each end
            if end != done and piece[last[end - piece.length]]:
                last[end], done = piece.id, end
        found, at = [], len(segment) - 1
        while at >= 0:
            found.append(last[at])
            at -= 1 if last[at] == UNKNOWN else lengths[last[at]]
        return found[::-1]

    def _late(self, ids: list[int]) -> list[int]:
        """Merges neighbours into pieces of equal score, always the leftmost two that can."""
        late, pieces = self.v.late, self.v.pieces
        texts: list[str | None] = [None if i == UNKNOWN else pieces[i] for i in ids]
        after, before, out = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1)), list(ids)
        heap: list[tuple[int, int, str]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else len(ids)
            if b < len(ids) and texts[a] and texts[b] and texts[a] + texts[b] in late:
                heapq.heappush(heap, (a, b, texts[a] + texts[b]))

        for a in range(len(ids) - 1):
            offer(a)
        while heap:
            a, b, whole = heapq.heappop(heap)
            if not texts[a] or not texts[b] or after[a] != b or texts[a] + texts[b] != whole:
                continue
            texts[a], out[a], texts[b] = whole, late[whole], ""
            after[a] = after[b]
            if after[a] < len(ids):
                before[after[a]] = a
            offer(before[a])
            offer(a)
        return [i for i, t in zip(out, texts, strict=True) if t != ""]

    def _encoded(self, segment: str) -> tuple[int, ...]:
        ids = self._by_prefixes(segment)
        if self.v.late and SPACE * 2 in segment:
            ids = self._late(ids)
        if UNKNOWN not in ids:
            return tuple(ids)
        out, at = [], 0
        for i in ids:
            if i == UNKNOWN:
                out += [self.byte_ids[b] for b in segment[at].encode()]
                at += 1
            else:
                out.append(i)
                at += self.lengths[i]
        return tuple(out)

    def _told(self, segment: str) -> tuple[str, str]:
        """A segment's ids, each with a comma before it, and what they are decoded to."""
        ids = self._encoded(segment)
        return "".join(map(self.digits.__getitem__, ids)), self.decode(ids, first=False)

    def _word(self, word: str) -> str:
        """The ids, in the same form, of a word with one space mark before it; CHANGED if they aren't decoded to the same word."""
        found = self.segment.findall(SPACE + word)
        if len(found) == 1:
            ids, text = self.told[found[0]]
        else:
            ids, text = map("".join, zip(*[self.told[s] for s in found], strict=True))
        return ids if text == " " + word else CHANGED

    def unchanged(self, text: str) -> str:
        """The ids, in the same form, of a short text of words parted by single spaces, if they are decoded to the same text; else empty."""
        if not self.apart or not 0 < len(text) <= PIECE_IDS or text[0] == " " or "  " in text or SPACE in text:
            return ""
        ids = "".join(map(self.words.__getitem__, text.split(" ")))
        return "" if CHANGED in ids else ids

    def segments(self, text: str) -> Iterable[Iterable[str]]:
        """A text's segments in order, a bounded number at a time; none of an empty text."""
        if not text:
            return ()
        marked = SPACE + text.replace(" ", SPACE)
        if len(marked) <= PIECE_IDS:
            return (self.segment.findall(marked),)
        return itertools.batched((m.group() for m in self.segment.finditer(marked)), PIECE_IDS)

    def encode(self, text: str) -> list[int]:
        return [i for found in self.segments(text) for ids in map(self.known.__getitem__, found) for i in ids]

    def decode(self, ids: Iterable[int], first: bool = True) -> str:
        """The text of ids; a leading space is left out where they are the ``first`` ones of a text."""
        ids, bytes_of = list(ids), self.v.bytes_of
        if bytes_of.keys().isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
        else:
            parts, run = [], bytearray()
            for i in ids:
                if i in bytes_of:
                    run.append(bytes_of[i])
                    continue
                if run:
                    parts.append(run.decode("utf-8", "apertura-each-byte"))
                    run = bytearray()
                parts.append(self.shown[i])
            text = "".join(parts) + run.decode("utf-8", "apertura-each-byte")
        if not first:
            return text
        lead = next((i for i in ids if i not in self.v.silent), None)
        return text[1:] if lead is not None and self.v.pieces[lead].startswith(SPACE) else text


#: The last encoder of this process: a reused Python worker goes on with what the task before it remembered.
_last: dict[str, Encoder] = {}


def _encoder(key: str, v: Vocabulary) -> Encoder:
    if key not in _last:
        _last.clear()
        _last[key] = Encoder(v)
    return _last[key]


def _digest(encoder: Encoder, text: str) -> tuple[int, str, str]:
    """Number of ids, digest of the ids and of the decoded text, a bounded number of segments at a time."""
    if ids := encoder.unchanged(text):
        return ids.count(","), hashlib.sha256(ids[1:].encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    for found in encoder.segments(text):
        ids, texts = map("".join, zip(*map(encoder.told.__getitem__, found), strict=True))
        ids_sha.update(ids[0 if n else 1 :].encode())
        text_sha.update(texts[0 if n else encoder.marked :].encode())
        n += ids.count(",")
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def _mapped(docs: DataFrame, model: str | None, names: list[str], types: list[pa.DataType], schema: str, row) -> DataFrame:  # noqa: ANN001
    content = Path(model or vocabulary_path()).read_bytes()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(content))
    key = hashlib.sha256(content).hexdigest()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value)
        for batch in batches:
            rows = [row(encoder, value.as_py()) for value in batch.column(1)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])

    return docs.mapInArrow(apply, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


def encoded(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and the ``ids`` of its whole text, without begin or end; null and empty texts have none.

    The file of the vocabulary is read where the query is built. Null and repeated doc_ids are kept; texts without spaces,
    however long, are encoded in one table of a number for each character; other columns are ignored;
    an empty table gives an empty result.
    """
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return _mapped(texts, model, ["ids"], [pa.list_(pa.int32())], "ids array<int>", lambda e, text: (e.encode(text or ""),))


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id`` and the ``text`` of its ``ids``; null ids give an empty text."""
    return _mapped(rows.select("doc_id", "ids"), model, ["text"], [pa.string()], "text string", lambda e, ids: (e.decode(ids or []),))


def piece_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, as encoded() and decoded() give them."""
    texts = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(texts, model, ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()], schema, lambda e, text: _digest(e, text or ""))
