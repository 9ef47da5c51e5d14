"""Small deterministic tick fixtures with one key that holds most rows."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd


def ticks(n: int = 300, seed: int = 3, null_key: bool = False) -> pd.DataFrame:
    rnd = random.Random(seed)
    t0 = dt.datetime(2024, 1, 1, 9)
    rows, at = [], t0
    for i in range(n):
        at += dt.timedelta(seconds=rnd.choice([0, 1, 1, 2, 7, 40]))
        key = "hot" if rnd.random() < 0.7 else rnd.choice(["a", "b"])
        if null_key and i % 11 == 0:
            key = None
        rows.append((key, at, i, round(100 + rnd.gauss(0, 5), 2), rnd.randint(1, 60), rnd.choice(["buy", "sell", "auction"]),
                     rnd.randint(1, 9), rnd.randint(1, 9)))
    return pd.DataFrame(rows, columns=["symbol", "ts", "seq", "price", "quantity", "side", "buy_agent", "sell_agent"])
