"""Rolling-frame snippets for the SQL side of the checks."""

PART = "PARTITION BY symbol ORDER BY ts"
W = f"({PART})"


def fr(n: int, part: str = PART) -> str:
    return f"({part} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(fn: str, x: str, n: int, minimum: int | None = None, part: str = PART) -> str:
    m = n if minimum is None else minimum
    return f"(CASE WHEN count({x}) OVER {fr(n, part)} >= {m} THEN {fn}({x}) OVER {fr(n, part)} END)"


def mean(x, n, minimum=None, part=PART):
    return roll("avg", x, n, minimum, part)


def std(x, n, minimum=None, part=PART):
    return roll("stddev_samp", x, n, minimum, part)


def total(x, n, minimum=None, part=PART):
    return roll("sum", x, n, minimum, part)


def high(x, n, minimum=None, part=PART):
    return roll("max", x, n, minimum, part)


def low(x, n, minimum=None, part=PART):
    return roll("min", x, n, minimum, part)


def lag(x: str, k: int = 1, part: str = PART) -> str:
    return f"lag({x}, {k}) OVER ({part})"


def rank(x: str, seen: str, n: int) -> str:
    """Average-rank percentile of x in the list ``seen`` of n values."""
    return (f"(CASE WHEN len({seen}) >= {n} THEN (len(list_filter({seen}, lambda v: v < {x})) + "
            f"(len(list_filter({seen}, lambda v: v = {x})) + 1) / 2.0::DOUBLE) / len({seen}) END)")


def flag(c: str) -> str:
    return f"(CASE WHEN {c} THEN 1 ELSE 0 END)"
