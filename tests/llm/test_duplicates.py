import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from apertura.llm import components, shared, superminhash, vector_neighbours

from .helpers import DOCUMENTS, component_of, near_links


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def family(rng, base, n, edits):
    """Copies of a text with some words replaced."""
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rng.sample(range(len(copy)), rng.randint(0, edits)):
            copy[k] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage = words(rng, 60)
    texts = [" ".join(words(rng, rng.randint(1, 200))) for _ in range(60)]
    texts += family(rng, words(rng, 150), 120, 9) + family(rng, words(rng, 60), 60, 4)
    texts += [" ".join(words(rng, 30) + passage + words(rng, 20)) for _ in range(60)]
    texts += [texts[3]] * 40 + ["Same Words HERE", "same\twords\nhere", "same words", "", " \t\n", None, "a b c", "A B C", " ".join(words(rng, 20000))]
    rng.shuffle(texts)
    return dict(enumerate(texts))


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, n):
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in corpus.items()], DOCUMENTS).repartition(5)
    sets, links = near_links(corpus, n, 80)
    want = component_of(corpus, links)
    got = {r["doc_id"]: r for r in superminhash.near_duplicates(docs, n=n).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
    stay = [r["doc_id"] for r in superminhash.first_of_each(docs, n=n).collect()]
    assert sorted(stay) == sorted(i for i in corpus if want[i] == i)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (3, None, "x"), (4, "", "z"), (5, "q r s t u v", "z"), (5, "k l m n o p", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(docs).collect() if r["doc_id"])
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 2, 5, True), (5, 2, 5, True)]
    stay = superminhash.first_of_each(docs)
    assert stay.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in stay.collect()) == [0, 0, 1, 3, 4, 5, 5]
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.5, 0.8, 0.95):
        both = rng.integers(0, 2**63, 400).astype(np.uint64)
        rest = int(400 * (1 / share - 1) / 2)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, rest).astype(np.uint64)])) for _ in range(2)]
        found = np.mean([(lambda s: (s[0] == s[1]).mean())(superminhash.signatures([x + np.uint64(k) for x in sets])) for k in range(20)])
        assert abs(found - 400 / (400 + 2 * rest)) < 0.04
    assert len(np.unique(superminhash.signatures([np.array([7], np.uint64)]) >> np.uint64(32))) == superminhash.REGISTERS


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (5, 5)], "u long, v long")
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, n), 0), 1001: 1000}
    assert components.components(edges.limit(0)).count() == 0


def vectors(rng):
    """Groups around centres, tight and loose, chains, and lone vectors."""
    rows = []
    for g in range(12):
        centre = rng.standard_normal(24)
        for _ in range(25):
            rows.append((g % 3, centre + rng.standard_normal(24) * (0.08 + 0.03 * g)))
    step = rng.standard_normal(24)
    for k in range(40):
        rows.append((1, step + k * 0.15 * np.roll(step, 1)))
    rows += [(2, rng.standard_normal(24)) for _ in range(100)]
    rows += [(0, rows[0][1] * 3.5)] * 30
    return [(i, v.astype(np.float32).tolist(), label) for i, (label, v) in enumerate(rows)]


def brute(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if label is None or not v or any(x is None for x in v):
            continue
        v = np.array(v, dtype=np.float64)
        if np.isfinite(v).all() and v.any():
            good[i] = (label, v / np.linalg.norm(v))
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and float(good[a][1] @ good[b][1]) >= threshold]
    counts = dict.fromkeys((r[0] for r in rows), 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return counts, component_of(counts, links)


def test_near_vectors_equal_brute_force(spark):
    rows = vectors(np.random.default_rng(4))
    n = len(rows)
    rows += [(n, None, 0), (n + 1, [0.0] * 24, 0), (n + 2, [None] + rows[0][1][1:], 0), (n + 3, [float("nan")] + rows[0][1][1:], 0), (n + 4, rows[0][1], None), (n + 5, [float("inf")] * 24, 0), (n + 6, [], 0), (n + 7, [1.0, 2.0], 0), (n + 8, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("n_links", F.lit("clash")).repartition(3)
    counts, component = brute(rows)
    got = vector_neighbours.near_vectors(df).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == counts
    assert {r["vec_id"]: r["component_id"] for r in got} == component
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("limits", [{"MOST": 20, "REVERSE": 10}, {"AUDITS": 1, "RUN": 8, "BLOCKINGS": 1, "DESCENTS": 0, "BLOCK_BYTES": 1 << 14}])
def test_near_vectors_beyond_their_caps_equal_brute_force(spark, monkeypatch, limits):
    """A group too wide to contract: lists that stay saturated, and lists that hold too few links at the last audit."""
    for name, value in limits.items():
        monkeypatch.setattr(vector_neighbours, name, value)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(24)
    rows = [(i, (centre + rng.standard_normal(24) * 0.3).tolist(), i % 2 * (i % 3 == 0)) for i in range(260)]
    counts, component = brute(rows)
    found = vector_neighbours.near_vectors_audited(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = found.rows.collect()
    assert found.opened > 0
    assert {r["vec_id"]: r["n_links"] for r in got} == counts
    assert {r["vec_id"]: r["component_id"] for r in got} == component


def test_near_vectors_recall_is_measured(spark):
    """Many loose pairs and a hot group of near copies: an audit of one vector in fifty holds links, and the lists hold them."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((1200, 32))
    rows = [(2 * i + k, (v + rng.standard_normal(32) * 0.2 * k).tolist(), int(i % 3 == 0)) for i, v in enumerate(base) for k in (0, 1)]
    rows += [(5000 + i, (base[0] + rng.standard_normal(32) * 0.05).tolist(), 1) for i in range(1200)]
    counts, component = brute(rows)
    found = vector_neighbours.near_vectors_audited(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = found.rows.collect()
    assert found.recall >= vector_neighbours.RECALL and found.audited > 10 and found.opened == 0
    assert {r["vec_id"]: r["n_links"] for r in got} == counts
    assert {r["vec_id"]: r["component_id"] for r in got} == component


@pytest.mark.parametrize("kind", ["string", "smallint", "decimal(12,0)"])
def test_other_types_of_ids(spark, kind):
    vectors = spark.sql(f"select cast(id as {kind}) as vec_id, array(1.0D, id / 1000) as embedding, 1 as label from range(5)")
    assert {r["n_links"] for r in vector_neighbours.near_vectors(vectors).collect()} == {4}
    docs = spark.sql(f"select cast(id as {kind}) as doc_id, concat('one two three four five six ', repeat('x', int(id % 2))) as text from range(4)")
    assert superminhash.near_duplicates(docs).where("kept").count() == 2


def test_one_lone_label(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2)]
    got = {r["vec_id"]: r["n_links"] for r in vector_neighbours.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 0}


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_neighbours.near_vectors(empty).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], empty.schema)
    assert sorted((r["vec_id"] or 0, r["n_links"], r["kept"]) for r in vector_neighbours.near_vectors(odd).collect()) == [(0, 0, True), (1, 0, True), (1, 0, True)]


def test_runs_keep_keys_apart_and_sizes_bounded():
    rng = random.Random(3)
    keys = sorted(rng.choices("abcde", k=300))
    weights = [rng.randint(1, 9) for _ in keys]
    table = pa.table({"key": keys, "w": weights, "at": range(300)})
    for size, by in ((7, None), (12, 1), (1, 1)):
        found = list(shared.runs(iter(table.to_batches(max_chunksize=11)), size, by))
        assert [x for r in found for x in r.column(2).to_pylist()] == list(range(300))
        for r in found:
            assert len(set(r.column(0).to_pylist())) == 1
            assert r.num_rows == 1 or (sum(r.column(1).to_pylist()) if by else r.num_rows) <= size


def test_an_id_with_several_texts_is_one_document(spark):
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "k l m n o p"), (3, "a b c d e f"), (7, "k l m n o p"), (8, "z")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in superminhash.near_duplicates(docs).collect())
    assert got == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 8, True)]
    assert sorted(r["doc_id"] for r in superminhash.first_of_each(docs).collect()) == [3, 8]
