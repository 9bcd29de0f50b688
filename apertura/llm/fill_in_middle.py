"""Fill-in-middle transformation (operator 13) with two streaming passes over a text's units.

A unit is what a pattern matches, a code point unless told otherwise. The first pass counts the matches,
the second advances a lazy iterator of matches to the two ranks that a digest of the document's id draws.
No list of units is ever held, so the memory beside a text and its output is constant.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame

SEED = 1
#: Any code point, line ends too.
UNIT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of documents that are cut at all, and percent of those that begin with the suffix.
CUT_PERCENT, SPM_PERCENT = 90, 20


def count_units(unit: re.Pattern[str], text: str) -> int:
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def ends_at(unit: re.Pattern[str], text: str, low: int, high: int) -> tuple[int, int]:
    """Where the units of rank ``low`` and ``high`` end; rank 0 ends at the text's start."""
    matches = unit.finditer(text)

    def advance(steps: int, at: int) -> int:
        last = deque(islice(matches, steps), maxlen=1)
        return last[0].end() if last else at

    first = advance(low, 0)
    return first, advance(high - low, first)


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id; a null id counts as empty text."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))


def rearranged(text: str, doc_id: object, unit: re.Pattern[str], seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), and the output."""
    n = count_units(unit, text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= CUT_PERCENT or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = ends_at(unit, text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, "psm", a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def restored(output: str, form: str) -> str:
    """The text that an output was made of."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    last = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : last], output[last + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def _mapped(docs: DataFrame, unit: str, seed: int, digest: bool) -> DataFrame:
    kept = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long"
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", *(["output_sha256", "restored_sha256"] if digest else ["output"])]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), *([pa.string()] * (len(names) - 5)))

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            found: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                *head, output = rearranged(text.as_py() or "", doc_id.as_py(), pattern, seed)
                found.append((*head, sha(output), sha(restored(output, head[1]))) if digest else (*head, output))
            columns = zip(*found, strict=True) if found else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], names)

    outputs = "output_sha256 string, restored_sha256 string" if digest else "output string"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(transform, f"{kept}, {outputs}")


def fill_in_middle(docs: DataFrame, unit: str = UNIT, seed: int = SEED) -> DataFrame:
    """A row for every document: its units ``n``, ``form``, cut lengths and the rearranged text ``output``.

    A null text counts as empty and, like texts that hold a mark, stays plain. A cut after rank k lies at the
    end of the k-th match; what lies between matches belongs to the piece after the cut. Null and
    repeated ids are kept, equal ids are cut by the same numbers; very long texts are cut whole; an empty
    table gives an empty result; other columns are ignored.
    """
    return _mapped(docs, unit, seed, digest=False)


def fim_digest(docs: DataFrame, unit: str = UNIT, seed: int = SEED) -> DataFrame:
    """As fill_in_middle, with digests of the output and of the text rebuilt from it instead of the output."""
    return _mapped(docs, unit, seed, digest=True)


FIM_SQL = """
with d as (
  select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
r as (
  select *, cast('0x' || h[1:8] as bigint) % (n + 1) as a, cast('0x' || h[9:16] as bigint) % (n + 1) as b,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
                   or cast('0x' || h[17:24] as bigint) % 100 >= 90 then 'plain'
              when cast('0x' || h[25:32] as bigint) % 100 < 20 then 'spm' else 'psm' end as form
  from d),
p as (
  select *, substring(t, 1, least(a, b)) as prefix, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) as middle,
         substring(t, greatest(a, b) + 1) as suffix
  from r)
select doc_id, n, form,
       case when form <> 'plain' then length(prefix) end as prefix_chars,
       case when form <> 'plain' then length(middle) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(t) as restored_sha256
from p
"""
