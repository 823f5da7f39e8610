"""Hard negatives against plain Python over exact integers, in one cell and in many."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docketry.llm import negatives
from docketry.llm.negatives import Mining, mine

SCHEMA = "vec_id long, embedding array<double>, label string, row_id long, anchor string, key int, slot int, block int, group int"


def plain(rows, mining=Mining()):
    usable = [
        (key, [math.floor(mining.scale * x) for x in vector], label)
        for key, vector, label in rows
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    ]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for key, vector, label in usable:
        if key is None or key % 50:
            continue
        score = lambda v: min(max(sum(a * b for a, b in zip(vector, v)), -(2**63)), 2**63 - 1)  # noqa: E731, B023
        liked = sorted([(score(v), k) for k, v, own in usable if own == label and k != key], key=order)[: mining.positives]
        for positive, name in liked:
            fits = sorted([(score(v), k) for k, v, own in usable if own != label and 50 * positive <= 100 * score(v) <= 95 * positive], key=order)
            out += [(key, name, i, k, positive, s) for i, (s, k) in enumerate(fits[: mining.negatives], 1)]
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4, 5) for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def made(seed, n, hot=False):
    rnd = random.Random(seed)
    near = [rnd.gauss(0.5, 0.3) for _ in range(6)]
    rows = [(i, [x + rnd.gauss(0, 0.4) for x in near], rnd.choice("abc" if not hot else "aaaaab")) for i in range(n)]
    rows += [(n + i, list(near), rnd.choice("ab")) for i in range(60)]  # ties: one very common vector
    rows += [(50, rows[50][1], "a")] * 2 + [(None, list(near), "a"), (None, None, "b"), (n + 100, None, "a"), (n + 101, [], "b")]
    rows += [(n + 102, [1.0, None], "a"), (n + 103, [float("nan")] * 6, "a"), (n + 104, [float("inf")] * 6, "b"), (n + 105, near[:3], "c"), (n + 106, near + [4.0], None)]
    return rows


@pytest.mark.parametrize("cells", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, cells):
    if cells:  # many groups and blocks, and tiles of a few scores
        monkeypatch.setattr(negatives, "CELL_VALUES", 700)
        monkeypatch.setattr(negatives, "ANCHOR_VALUES", 12)
        monkeypatch.setattr(negatives, "TILE", 64)
    rows = made(1, 400)
    want = plain(rows)
    assert len(want) > 50
    assert found(mine(table(spark, rows), F.pmod("vec_id", F.lit(50)) == 0)) == want


def test_scores_beyond_doubles_are_exact(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.uniform(0.5, 1.2) * rnd.choice([1e6] * 9 + [1e7, 1.0]) for _ in range(3)], rnd.choice("ab")) for i in range(120)]
    want = plain(rows)
    assert want and found(mine(table(spark, rows), F.pmod("vec_id", F.lit(50)) == 0)) == want


def test_windows_hold_the_per_cents_exactly():
    rnd = random.Random(3)
    for value in [0, 1, 2, -1, -100, 2**63 - 1, -(2**63)] + [rnd.randint(-(10**6), 10**6) for _ in range(500)]:
        low, high = negatives.windows(negatives.np.array([value], dtype="int64"), Mining())
        assert int(low[0]) == -((-50 * value) // 100) and int(high[0]) == 95 * value // 100


def test_no_rows_and_no_anchors(spark):
    assert found(mine(table(spark, []), F.pmod("vec_id", F.lit(50)) == 0)) == []
    assert found(mine(table(spark, [(1, [1.0], "a"), (2, [1.0], "b")]), F.pmod("vec_id", F.lit(50)) == 0)) == []
    assert found(mine(table(spark, [(50, [1.0], "a"), (2, [0.9], "b")]), F.pmod("vec_id", F.lit(50)) == 0)) == []
