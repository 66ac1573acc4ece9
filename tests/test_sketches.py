"""Daily sketches next to exact reports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from careline.operators import sketches as K


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    n = 60_000
    day = rng.integers(1, 29, n)
    user = (rng.zipf(1.3, n) % 9000).astype(int)
    value = np.round(rng.lognormal(3, 2, n), 3)
    data = [(f"2024-02-{d:02d}", "ab"[int(u) % 2], f"u{u}", float(v)) for d, u, v in zip(day, user, value)]
    data += [("2024-02-03", "c", None, None), ("2024-02-04", "c", "x", None), (None, "a", "lost", 1.0), ("2024-02-05", None, "y", 2.5)]
    df = spark.createDataFrame(data, "day string, kind string, user string, value double").repartition(6).cache()
    return data, df


@pytest.mark.parametrize("first, last", [("2024-02-01", "2024-02-28"), ("2024-02-10", "2024-02-10"), ("2024-02-03", "2024-02-17")])
def test_merged_sketches_are_within_their_bounds(rows, first, last):
    data, df = rows
    daily = K.daily_sketches(df, F.col("day"), ["kind"], "user", "value")
    found = {r.kind: r for r in K.estimates(K.merged(daily, ["kind"], F.lit(first), F.lit(last)), (1, 50, 95)).collect()}
    for kind in "ab":
        mine = [r for r in data if r[0] and first <= r[0] <= last and r[1] == kind]
        users, values = len({r[2] for r in mine}), np.sort([r[3] for r in mine])
        r = found[kind]
        assert (r.n, r.least, r.most) == (len(mine), values[0], values[-1]) and abs(r.mean - values.mean()) < 1e-5
        assert abs(r.n_users - users) <= max(1, 3 * 0.0082 * users)
        for p in (1, 50, 95):  # the rank of the estimate
            low, high = (np.searchsorted(values, r[f"p{p}"], side) / len(values) for side in ("left", "right"))
            assert low - 0.03 <= p / 100 <= high + 0.03


def test_groups_without_values(rows):
    _, df = rows
    daily = K.daily_sketches(df, F.col("day"), ["kind"], "user", "value")
    c = K.estimates(K.merged(daily, ["kind"])).filter("kind = 'c'").first()
    assert (c.n, c.n_users, c.p50, c.least, c.mean, c.first_day, c.last_day) == (2, 1, None, None, None, "2024-02-03", "2024-02-04")
    assert K.estimates(K.merged(daily, ["kind"])).filter("kind IS NULL").first().p50 == 2.5
    assert K.merged(daily, ["kind"], F.lit("2030-01-01")).count() == 0


def test_a_range_reads_a_row_per_day_and_group(rows):
    _, df = rows
    daily = K.daily_sketches(df, F.col("day"), ["kind"], "user", "value")
    assert daily.count() == 28 * 2 + 2 + 1 and daily.agg(F.max(F.length("quantiles") + F.length("users"))).first()[0] < 60_000
