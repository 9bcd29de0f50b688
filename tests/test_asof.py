"""The as-of join against a plain search, with ties, nulls and hot keys over many buckets."""

import random

import pytest

from apertura.operators.asof import DIRECTIONS, asof_join


@pytest.mark.parametrize("direction", DIRECTIONS)
@pytest.mark.parametrize("tolerance", [None, 40])
def test_as_a_plain_search(spark, direction, tolerance):
    rng = random.Random(5)
    keys = ["hot"] * 6 + ["b", "c", None]
    left = [(k, rng.choice(keys), rng.choice([None, *range(0, 2000, 3)]) if k % 9 == 0 else rng.randrange(2000)) for k in range(250)]
    right = [(rng.choice(keys), rng.choice([None, *range(0, 2000, 11)]), v) for v in range(200)]
    kind = lambda df: df.selectExpr(*[c for c in df.columns if c != "ts"], "timestamp_seconds(ts) as ts")
    got = asof_join(kind(spark.createDataFrame(left, "k int, u string, ts long")).repartition(5), kind(spark.createDataFrame(right, "u string, ts long, v int")), "u", "ts", direction=direction, tolerance=tolerance, bucket=50)
    rows = got.selectExpr("k", "matched.v as v", "unix_seconds(matched.ts) as at").collect()
    assert len(rows) == len(left)
    found = {r.k: (r.at, r.v) for r in rows}
    for k, u, t in left:
        near = [(abs(t - s), s > t, s, v) for w, s, v in right if u is not None and w == u and t is not None and s is not None]
        near = [n for n in near if (direction == "nearest" or (n[2] <= t if direction == "backward" else n[2] >= t)) and (tolerance is None or n[0] <= tolerance)]
        best = min(near, key=lambda n: n[:2]) if near else None
        assert found[k] == ((best[2], max(v for *_, s, v in near if s == best[2])) if best else (None, None))


def test_empty_sides_and_a_wrong_direction(spark):
    left = spark.sql("select 1 as u, timestamp'2024-01-01' as ts, 'x' as matched")
    assert asof_join(left, left.drop("matched").limit(0), "u", "ts").first().matched is None
    assert asof_join(left.limit(0), left.drop("matched"), "u", "ts").count() == 0
    with pytest.raises(ValueError, match="direction"):
        asof_join(left, left, "u", "ts", direction="sideways")
