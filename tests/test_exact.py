from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest

from millpond.operators import exact, profiling


@pytest.mark.parametrize("seed", range(3))
def test_sums_equal_fractions(spark, seed):
    """Any sizes, signs and orders: the double nearest to the true sum."""
    rng = random.Random(seed)
    rows = []
    for g in range(40):
        spread = rng.choice([0, 3, 30, 300])
        for _ in range(rng.randrange(1, 60)):
            rows.append((g if g else None, rng.uniform(-1, 1) * 10.0 ** rng.randint(-spread, spread), rng.randrange(1, 5)))
        if g % 3 == 0:
            # Large values that cancel leave the small one.
            rows += [(g if g else None, x, 1) for x in (1e25, 1e-7, -1e25)]
    rows += [(100, 0.0, 1), (100, -0.0, 1), (101, None, 1), (102, 5e-324, 3), (103, 1.7e308, 1), (104, 2.0**53, 1), (104, 1.0, 1), (104, 1.0, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g int, x double, n int").repartition(5)
    want: dict = {}
    for g, x, n in rows:
        if x is not None:
            want[g] = want.get(g, 0) + Fraction(x) * n
    got = {r.g: r.x for r in exact.sums(df, ["g"], ["x"], "n").collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[g], float(want[g]), rel_tol=2**-52) for g in want)
    assert got[104] == 2.0**53 + 2 and got[102] == 1.5e-323 and got[100] == 0.0


def test_sums_of_no_numbers(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([(1, inf, 1.0), (1, 2.0, None), (2, inf, 3.0), (2, -inf, 4.0), (3, nan, 1e-7), (3, 1.0, 3e-7)], "g int, x double, y double")
    got = {r.g: (r.x, r.y) for r in exact.sums(df, ["g"], ["x", "y"]).collect()}
    assert got[1] == (inf, 1.0) and math.isnan(got[2][0]) and math.isnan(got[3][0]) and got[3][1] == 4e-7


def test_profile_means_of_tiny_and_huge_values(spark):
    df = spark.createDataFrame([(1e-7, 1e25), (3e-7, 1e25), (None, None)], "small double, huge double")
    found = {r["column_name"]: r["mean_value"] for r in profiling.profile(df, "Public").collect()}
    assert found == {"small": 2e-7, "huge": 1e25}
