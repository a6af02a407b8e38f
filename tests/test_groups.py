"""The best division of values, against all divisions."""

from itertools import combinations

import numpy as np
import pytest

from terrafold.operators import groups


def spread(parts):
    return sum(float(((p - p.mean()) ** 2).sum()) for p in parts)


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_no_division_is_better(k):
    rng = np.random.default_rng(k)
    for _ in range(20):
        v = np.unique(rng.integers(0, 60, rng.integers(k, 12)))
        n = rng.integers(1, 9, len(v))
        k_ = min(k, len(v))
        first = groups._best(v.astype(float), n.astype(float), k_)
        cut = lambda at: spread(np.repeat(v[a:b], n[a:b]) for a, b in zip([0, *at], [*at, len(v)], strict=True))  # noqa: B023, E731
        assert len(first) == k_ and cut(first[1:].tolist()) == pytest.approx(min(cut(c) for c in combinations(range(1, len(v)), k_ - 1)))


def test_groups_by_key_and_odd_values(spark):
    rows = [("a", z) for z in (1.0, 1.1, 5.0, 5.2, 9.0, 9.2)] + [("a", None), ("a", float("nan")), ("a", float("inf")), ("b", 2.0), ("b", 2.001), ("b", -7.0), ("c", None)]
    df = spark.createDataFrame(rows, "tile string, z double")
    got = [(r.tile, r.grp, pytest.approx(r.centre), r.n) for r in groups.value_groups(df, 3, by=("tile",)).orderBy("tile", "grp").collect()]
    assert got == [("a", 0, 1.05, 2), ("a", 1, 5.1, 2), ("a", 2, 9.1, 2), ("b", 0, -7.0, 1), ("b", 1, 2.0, 2)]
    one = groups.value_groups(df.where("tile = 'a'"), 2).orderBy("grp").collect()
    assert [(r.low, r.high, r.n) for r in one] == [(pytest.approx(1.0), pytest.approx(1.1), 2), (pytest.approx(5.0), pytest.approx(9.2), 4)]
    assert groups.value_groups(df.where("tile = 'c'"), 2).count() == 0
    with pytest.raises(ValueError):
        groups.value_groups(df, 0)
