"""Piece encoding, importance resampling and fill-in-middle against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest

from apertura.llm import fill_in_middle, importance, piece_bpe
from apertura.llm import queries as llm_queries

from .helpers import DOCUMENTS, FOLD

SMALL = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " "), (None, "null id"), (5, "twice twice"), (5, "twice twice"), (6, "x" * 30_000), (7, "Ab ▁ é\x00 日本 🙂" * 400), (8, "  \n\t  "), (9, "has <P> in it"), (10, "a" * 70_000 + " b c")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCUMENTS)


def odd(spark, rows=ODD):
    """The odd rows with columns that clash with working names."""
    clashing = ("n", "ids", "form", "output", "rank", "score", "weight", "seq", "__may", "__place", "__range", "bucket")
    return docs_of(spark, rows).selectExpr("*", *[f"'clash' as `{c}`" for c in clashing]).repartition(5)


def small(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_bpe.vocabulary_path())


@pytest.fixture(scope="module")
def encoder(library):
    return piece_bpe.Encoder(piece_bpe.vocabulary(library.serialized_model_proto()))


def ids_row(library, doc_id, text):
    ids = library.encode(text or "")
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_pieces_equal_the_library_on_all_documents(spark, library):
    _, rows = small(spark)
    got = llm_queries.op11_pieces(spark, SMALL).collect()
    assert Counter(map(tuple, got)) == Counter(ids_row(library, i, t) for i, t in rows)


def test_pieces_of_odd_rows(spark, library):
    docs = odd(spark)
    assert Counter(map(tuple, piece_bpe.piece_digest(docs).collect())) == Counter(ids_row(library, i, t) for i, t in ODD)
    ids = piece_bpe.encoded(docs)
    back = Counter(map(tuple, piece_bpe.decoded(ids).collect()))
    assert back == Counter((i, library.decode(library.encode(t or ""))) for i, t in ODD)
    assert piece_bpe.piece_digest(odd(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_random_texts_and_ids(library, encoder, seed):
    rng = random.Random(seed)
    letters = ["  ▁aabcehtinors", "ab ", " ▁x", "  ▁éö日本語\n\t\x00<s>0x1ﬁ🙂한ゼ", "theinandr", " "][seed]
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.choice([1, 4, 30, 300])))
        ids = library.encode(text)
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == library.decode(ids)
        ids = [rng.randrange(300) if rng.random() < 0.5 else rng.randrange(32_000) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids)


def test_long_texts_are_digested_in_parts(library, encoder, monkeypatch):
    monkeypatch.setattr(piece_bpe, "PIECE_IDS", 7)
    monkeypatch.setattr(piece_bpe, "REMEMBERED", 3)
    text = " ".join(["alpha béta", "日本", "   gamma"] * 50)
    assert piece_bpe._digest(encoder, text) == ids_row(library, 0, text)[1:]


def test_a_word_is_matched_once_whatever_follows_it(library, monkeypatch):
    encoder = piece_bpe.Encoder(piece_bpe.vocabulary(library.serialized_model_proto()))
    matched = []
    monkeypatch.setattr(encoder, "_by_prefixes", lambda segment, f=encoder._by_prefixes: (matched.append(segment), f(segment))[1])
    texts = [f"naïve{sign} and naïve{sign}" for sign in ["", ".", ",", ";", "!?", "***", "&&&", ".\n", " \t", ")"]] * 2
    assert [piece_bpe._digest(encoder, t) for t in texts] == [ids_row(library, 0, t)[1:] for t in texts]
    assert [s for s in matched if "naïve" in s] == [piece_bpe.SPACE + "naïve"]


@pytest.mark.parametrize("most", [3, 40, 400])
def test_random_texts_are_digested_as_by_the_library_whatever_is_remembered(library, monkeypatch, most):
    monkeypatch.setattr(piece_bpe, "REMEMBERED", most)
    monkeypatch.setattr(piece_bpe, "PAIRS", most)
    encoder = piece_bpe.Encoder(piece_bpe.vocabulary(library.serialized_model_proto()))
    rng = random.Random(most)
    words = ["the", "of", "ñrajación", "émentenré***", "word.\nHeen.", "日本語", "ति", "\n\t", "a▁b", "▁", "", "x" * 70, "..", "don't", "🙂", "\x00", "<s>", "<0x41>", "ﬁ", "12,5", " ⁇ "]
    for _ in range(300):
        text = rng.choice([" ", " ", "  ", ""]).join(rng.choice(words) for _ in range(rng.choice([1, 3, 20])))
        assert piece_bpe._digest(encoder, text) == ids_row(library, 0, text)[1:]


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(Exception):  # noqa: B017
        piece_bpe.vocabulary(b"no model")


@pytest.mark.parametrize("longest", [1, 2, 3, 5])
def test_crcs_of_runs_equal_those_of_their_strings(monkeypatch, longest):
    monkeypatch.setattr(importance, "PIECE", 5)
    rng = random.Random(longest)
    words = ["w" * rng.randint(1, 300) if rng.random() < 0.1 else rng.choice(["a", "Bc", "déf", "日本", "x9"]) for _ in range(47)]
    got = Counter()
    n = 0
    cut = "-".join(words[:13]), "", "-".join(words[13:14]), "-".join(words[14:])
    for own, owner, found in importance.feature_buckets([t.encode() for t in cut], longest, 1 << 20):
        n += len(own)
        assert len(owner) == len(found)
        got.update(zip(owner.tolist(), found.tolist(), strict=True))
    low = [w.translate(FOLD) for w in words]
    parts = {0: low[:13], 2: low[13:14], 3: low[14:]}
    want = Counter((at, zlib.crc32(" ".join(w[k : k + m]).encode()) % (1 << 20)) for at, w in parts.items() for m in range(1, longest + 1) for k in range(len(w) - m + 1))
    assert n == len(words)
    assert got == want


def plain_resampling(rows, items):
    def features(text):
        w = [m.decode() for m in importance.WORD.findall((text or "").translate(FOLD).encode())]
        return len(w), [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    found = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for *_, fs in found for b in fs), Counter(b for x in items for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in s}
    out = []
    for i, n, fs in found:
        weight = sum(gain[b] for b in fs) // len(fs) if fs else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    may = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = Counter()
    for k, r in enumerate(may[: 25 * len(may) // 100], 1):
        drawn[*r[:4], k] += 1
        r[4] = None
    drawn.update((*r[:4], None) for r in out if r[4] is not None)
    return drawn


def test_resampling_equals_a_plain_version(spark):
    _, rows = small(spark)
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = Counter(map(tuple, llm_queries.op12_importance(spark, SMALL).collect()))
    assert got == plain_resampling(rows, items)


def test_resampling_of_odd_rows(spark):
    rows = [*ODD, *((100 + k % 7, f"w{k % 5} " * (18 + k % 4)) for k in range(60)), (None, "same " * 25), (None, "same " * 25)]
    items = spark.createDataFrame([(1, "w1 w2 w1"), (2, None), (3, "")], "item_id long, text string")
    got = importance.resampled(odd(spark, rows), items)
    assert Counter(map(tuple, got.collect())) == plain_resampling(rows, ["w1 w2 w1", None, ""])
    assert importance.resampled(odd(spark, []), items).count() == 0
    assert importance.resampled(odd(spark, rows), items.limit(0)).count() == len(rows)


def plain_middle(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    out = f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}" if h[3] % 100 < 20 else f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    return doc_id, n, "spm" if h[3] % 100 < 20 else "psm", a, b - a, sha(out), sha(text)


def test_fill_in_middle_equals_plain_slices(spark):
    _, rows = small(spark)
    got = llm_queries.op13_fill_in_middle(spark, SMALL).collect()
    assert Counter(map(tuple, got)) == Counter(plain_middle(i, t) for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fill_in_middle.fim_digest(odd(spark)).collect())) == Counter(plain_middle(i, t) for i, t in ODD)
    assert fill_in_middle.fim_digest(odd(spark, [])).count() == 0


@pytest.mark.parametrize("unit", [r"\S+", r"[^.]*\.", r"(?s:.)"])
def test_any_unit_can_be_rebuilt(spark, unit):
    rows = [(k, "One. Two <S  < S> three.\nFour <M five. " * (k % 4) + "<P"[: k % 3]) for k in range(80)]
    texts = dict(rows)
    got = fill_in_middle.fill_in_middle(docs_of(spark, rows), unit).collect()
    assert len(got) == len(rows)
    for r in got:
        assert fill_in_middle.restored(r.output, r.form) == texts[r.doc_id]
