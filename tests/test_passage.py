"""First passage over chunks: the walk down block extremes, and outcomes beside a plain loop and SQL."""

import datetime as dt
import random

import numpy as np
import pytest

from tests import test_queries
from tests.test_queries import con, plan  # noqa: F401  (a fixture)
from tickloom.operators import passage, risk


def test_first_at_most():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64, 1000):
        v = rng.standard_normal(n)
        v[rng.random(n) < 0.1] = np.nan
        start, bound = rng.integers(0, n + 1, 300), rng.standard_normal(300) - 1
        want = [next((j for j in range(s, n) if v[j] <= b), n) for s, b in zip(start, bound, strict=True)]
        assert passage.first_at_most(v, start, bound).tolist() == want


def bars(n=120, days=2):
    rnd, rows = random.Random(8), []
    for symbol in ("hot", "b", None):
        for d in range(days):
            price = 100.0
            for i in range(n if symbol == "hot" else 9):
                price += rnd.gauss(0, 0.4)
                low, high = price - rnd.random(), price + rnd.random()
                close = None if rnd.random() < 0.03 else price
                rows.append((symbol, dt.datetime(2024, 1, 1 + d, 9) + dt.timedelta(seconds=i), price, high, None if rnd.random() < 0.03 else low, close, rnd.choice([0, 0, 0, 1, -1] if i % 40 < 20 else [0, 1])))
    return rows


def plain(rows, sweep, cost, holding):
    out, by = [], {}
    for r in rows:
        by.setdefault((r[0], r[1].date()), []).append(r)
    for group in by.values():
        group.sort(key=lambda r: r[1])
        for i, (symbol, ts, *_, side) in enumerate(group[:-1]):
            for stop, target in sweep if side else []:
                entry = group[i + 1][2] * (1 + side * cost)
                st, tg = entry * (1 - side * stop), entry * (1 + side * target)
                end = min(len(group) - 1, i + holding) if holding else len(group) - 1
                for j in range(i + 1, end + 1):
                    _, at, _, high, low, close, pos = group[j]
                    hit_stop = (low is not None and low <= st) if side > 0 else high >= st
                    hit_target = high >= tg if side > 0 else (low is not None and low <= tg)
                    reason = "stop" if hit_stop else "target" if hit_target else "opposite" if pos == -side else \
                        "session_end" if j == len(group) - 1 else "holding_limit" if j == end else None
                    if reason:
                        out.append((symbol, ts, side, stop, target, entry, at, reason, st if hit_stop else tg if hit_target else close))
                        break
    return out


@pytest.mark.parametrize("chunk,holding", [(5, None), (5, 17), (16, 3), (None, 30)])
def test_outcomes(spark, chunk, holding):
    """Tiny chunks: trades close chunks later, several from one chunk and many in one; missing prices meet nothing."""
    rows, sweep = bars(), [(0.01, 0.02), (0.004, 0.03), (0.9, 0.9)]
    got = risk.outcomes(spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, position int"), sweep, 0.0005, holding, chunk).collect()
    known = lambda t: tuple("-" if x is None or x != x else x for x in t)
    assert sorted(map(known, (tuple(r)[:9] for r in got)), key=str) == sorted(map(known, plain(rows, sweep, 0.0005, holding)), key=str)


@pytest.mark.parametrize("name", ["k01_barrier_outcomes", "k01_trades_per_day"])
def test_outcome_queries_across_chunk_edges(spark, sf, con, name):  # noqa: F811
    test_queries.test_values_across_chunk_edges(spark, sf, con, name)


def test_no_array_of_bars(spark):
    rows = spark.createDataFrame(bars(20, 1), "symbol string, ts timestamp, open double, high double, low double, close double, position int")
    text = plan(risk.outcomes(rows, [(0.01, 0.02)], 0.0005, None, 64))
    assert "collect_list" not in text and "CartesianProduct" not in text
