"""Column expressions: sides, size buckets, calendar, bins, repairs and null handling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of the two sides, and the upper bounds of the trade-size classes.
BUY_WORDS = ["buy", "bid", "b", "c", "compra", "0", "aggressorbuyer"]
SELL_WORDS = ["sell", "ask", "s", "v", "venda", "1", "aggressorseller"]
SIZE_BOUNDS = [(5, "small"), (20, "medium"), (50, "large")]
ACTIVE_PERIODS = [(540, 630), (840, 930), (990, 1050)]


def normal_side(c: Column) -> Column:
    low = F.lower(F.trim(c.cast("string")))
    return F.when(low.isin(BUY_WORDS), "buy").when(low.isin(SELL_WORDS), "sell")


def size_class(q: Column) -> Column:
    out = None
    for bound, name in SIZE_BOUNDS:
        out = F.when(q <= bound, name) if out is None else out.when(q <= bound, name)
    return out.otherwise("whale")


# Trade types of the tick files, and the flag of each.
TRADE_TYPES = {"is_buyer": "AggressorBuyer", "is_seller": "AggressorSeller", "is_auction": "Auction", "is_rlp": "RLP"}


def type_flags(trade_type: Column) -> dict[str, Column]:
    """One 0/1 column per trade type; a missing or unknown type is none of them."""
    return {name: F.coalesce((trade_type == value).cast("int"), F.lit(0)) for name, value in TRADE_TYPES.items()}


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def right_bins(c: Column, edges: list[float]) -> Column:
    """0-based bin of right-closed intervals (edges[i], edges[i+1]]; null outside."""
    out = None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        hit = (c > lo) & (c <= hi)
        out = F.when(hit, i) if out is None else out.when(hit, i)
    return out


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def market_open(ts: Column) -> Column:
    """Weekday between 09:00 and 18:00."""
    return (F.weekday(ts) < 5) & minute_of_day(ts).between(540, 1080)


def calendar(ts: Column) -> dict[str, Column]:
    h, m = F.hour(ts), F.minute(ts)
    flag = lambda c: c.cast("int")
    seconds = F.unix_micros(ts) - F.unix_micros(F.date_trunc("day", ts)) - 9 * 3600 * 1_000_000
    return {
        "hour": h, "minute": m, "weekday": F.weekday(ts),
        "is_opening": flag((h == 9) & (m < 30)), "is_morning": flag((h >= 9) & (h < 12)),
        "is_lunch": flag((h >= 12) & (h < 14)), "is_afternoon": flag((h >= 14) & (h < 16)),
        "is_closing": flag((h >= 16) & (h < 17)),
        "seconds_since_open": seconds / 1e6,
        "minutes_since_open": F.greatest(seconds / 6e7, F.lit(0.0)),
        "session_share": F.least(F.greatest(seconds / 6e7, F.lit(0.0)), F.lit(480.0)) / 480,
    }


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def seasonality(ts: Column) -> Column:
    """Triangular score inside the busy periods of the session, 0.5 elsewhere and at least."""
    m = minute_of_day(ts)
    out = None
    for lo, hi in ACTIVE_PERIODS:
        mid, half = (lo + hi) / 2, (hi - lo) / 2
        score = F.greatest(F.lit(0.5), 1 - F.abs(m - mid) / half)
        out = F.when(m.between(lo, hi), score) if out is None else out.when(m.between(lo, hi), score)
    return out.otherwise(0.5)


def valid_ohlc() -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return ((h >= F.greatest(o, c, l)) & (l <= F.least(o, c, h)) & (l > 0) & (F.col("volume") >= 0))


def repaired_ohlc() -> dict[str, Column]:
    four = [F.col(x) for x in ("open", "high", "low", "close")]
    return {"high": F.greatest(*four), "low": F.least(*four)}
