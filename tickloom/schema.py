"""Explicit schemas of the input tables, and the names under which sources deliver their columns."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: str) -> T.StructType:
    kinds = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in fields.items()])


TICK_CSV = T.StructType([
    T.StructField("<date>", T.IntegerType()), T.StructField("<time>", T.IntegerType()), T.StructField("<price>", T.DoubleType()),
    T.StructField("<qty>", T.DoubleType()), T.StructField("<vol>", T.DoubleType()), T.StructField("<buy_agent>", T.StringType()),
    T.StructField("<sell_agent>", T.StringType()), T.StructField("<trade_type>", T.StringType())])
TICK = _struct(symbol="s", ts="t", seq="l", price="d", quantity="l", side="s", buy_agent="l", sell_agent="l")
CANDLE = _struct(symbol="s", ts="t", open="d", high="d", low="d", close="d", volume="d", trades="l", buy_volume="d", sell_volume="d")
#: Book events of all kinds in one wide, sparse table, split by ``type``.
BOOK_EVENT = _struct(type="s", ticker="s", ts="t", side="s", price="d", quantity="d", action="i", position="i", agent="i",
                     offer_id="l", buyer="i", seller="i", volume_total="d", volume_delta="d", trades_total="l", trades_delta="l")
CATALOG = _struct(symbol="s", data_type="s", date="s", records="l", size_bytes="l", quality="d", updated_at="t")

# Column names of other vendors and languages, mapped to ours.
ALIASES = {"preco": "price", "fechamento": "close", "abertura": "open", "maxima": "high", "minima": "low", "qtd": "quantity",
           "datetime": "ts", "timestamp": "ts", "date_time": "ts", "data": "ts", "qty": "quantity", "ticker": "symbol"}
