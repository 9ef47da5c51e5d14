"""Closed forms of exponential smoothing, for the SQL side of the checks."""

OVER = "(PARTITION BY symbol ORDER BY ts)"


def ema(x: str, span: float, rn: str = "rn", over: str = OVER, alpha: float | None = None) -> str:
    """EMA without adjustment of ``x``, whose first value sits at row number 1."""
    a = 2.0 / (span + 1) if alpha is None else alpha
    q = 1 - a
    return (f"(pow({q!r}::DOUBLE, {rn}) * sum(CASE WHEN {rn} = 1 THEN {x} WHEN {rn} > 1 THEN {a!r}::DOUBLE * ({x}) END"
            f" * pow({q!r}::DOUBLE, -({rn}))) OVER {over})")


def ema_adjusted(x: str, span: float, rn: str = "rn", over: str = OVER) -> str:
    q = 1 - 2.0 / (span + 1)
    return (f"(sum(({x}) * pow({q!r}::DOUBLE, -({rn}))) OVER {over} / sum(pow({q!r}::DOUBLE, -({rn}))) OVER {over})")


def wilder(x: str, p: int, rn: str, seed: str, over: str = OVER) -> str:
    """Wilder smoothing; ``rn`` counts valid rows, ``seed`` is the mean of the first p of them."""
    q, a = 1 - 1.0 / p, 1.0 / p
    return (f"CASE WHEN {rn} >= {p} THEN pow({q!r}::DOUBLE, {rn}) * sum(CASE WHEN {rn} = {p} THEN {seed} WHEN {rn} > {p} THEN {a!r}::DOUBLE * ({x}) END"
            f" * pow({q!r}::DOUBLE, -({rn}))) OVER {over} END")
