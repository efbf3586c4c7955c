"""Scalar functions of quotes, returns and costs. A zero denominator gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    return F.try_divide((ask - bid) * 10_000, F.nullif(mid(bid, ask), F.lit(0.0)))


def imbalance(a: Column, b: Column) -> Column:
    """(a - b) / (a + b)."""
    return F.try_divide((a - b).cast("double"), (a + b).cast("double"))


def microprice(bid: Column, bid_sz: Column, ask: Column, ask_sz: Column) -> Column:
    """The mid weighted to the thinner side."""
    return F.try_divide(ask * bid_sz + bid * ask_sz, (bid_sz + ask_sz).cast("double"))


def microprice_deviation(bid: Column, bid_sz: Column, ask: Column, ask_sz: Column) -> Column:
    """(microprice - mid) / mid."""
    return F.try_divide(microprice(bid, bid_sz, ask, ask_sz) - mid(bid, ask), mid(bid, ask))


def epoch_micros(at: Column) -> Column:
    """Microseconds of a time in milliseconds or microseconds: below 10^14 (the year 5138 in the one, 1973 in the other) it is the former."""
    return F.when(F.abs(at) < 100_000_000_000_000, at * 1000).otherwise(at)


def log_return(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.log(a / b))


def direction(ret: Column, threshold_bps: float = 0.5) -> Column:
    bound = threshold_bps / 10_000
    return F.when(ret > bound, "UP").when(ret < -bound, "DOWN").when(ret.isNotNull(), "FLAT")


def elapsed_ms(a: Column, b: Column) -> Column:
    """Milliseconds from a to b (microseconds), half to even."""
    return F.bround((b - a) / 1000).cast("long")


def window_name(us: int) -> str:
    return f"{us // 1_000_000}s" if us % 1_000_000 == 0 else f"{us // 1000}ms"


def side_sign(side: Column) -> Column:
    return F.when(F.lower(side) == "buy", 1).when(F.lower(side) == "sell", -1)


def shortfall(side: Column, price: Column, reference: Column) -> Column:
    """Signed cost of a fill against a reference price, as a ratio."""
    return side_sign(side) * F.try_divide(price - reference, reference)


def fee_quote(price: Column, qty: Column, rate_bps: Column) -> Column:
    return F.abs(price * qty) * rate_bps / 10_000


def unrealized(position: Column, average: Column, mark: Column) -> Column:
    return F.when(position == 0, 0.0).otherwise(position * (mark - average))


def breakeven_bps(gross: Column, turnover: Column) -> Column:
    """The fee at which gross profit is used up; undefined for a loss or without turnover."""
    return F.when((gross >= 0) & (turnover > 0), gross / turnover * 10_000)


def breakeven_status(gross: Column, turnover: Column) -> Column:
    return F.when(turnover <= 0, "NO_TURNOVER").when(gross < 0, "ALREADY_NEGATIVE").otherwise("DEFINED")


def raw_signal(pred: Column, low: Column, high: Column) -> Column:
    """1 at or above high, else -1 at or below low, else 0; not a number is 0."""
    return F.when(pred.isNull() | F.isnan(pred), 0).when(pred >= high, 1).when(pred <= low, -1).otherwise(0)


def sign_signal(pred: Column) -> Column:
    return F.coalesce(F.signum(pred).cast("int"), F.lit(0))


def admissible(limit: Column) -> Column:
    return F.coalesce(limit > 0, F.lit(False))


def marketable(side: Column, limit: Column, bid: Column, ask: Column) -> Column:
    """Whether a limit order takes liquidity at once."""
    return F.when(F.lower(side) == "buy", limit >= ask).when(F.lower(side) == "sell", limit <= bid).otherwise(False)


def decimal_text(x: Column) -> Column:
    """A decimal without trailing zeros or a bare point."""
    text = x.cast("string")
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0*$", "")).otherwise(text)


def safe_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[^\w.\-]", "_")


def fee_name(fee: Column) -> Column:
    """fee_0_25 for 0.25."""
    return F.concat(F.lit("fee_"), F.translate(F.format_string("%.2f", fee), ".", "_"))


def finite(x: Column) -> Column:
    """Null instead of what JSON can't hold."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def stable_seed(*parts: Column) -> Column:
    """The first 32 bits of the parts' digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 8), 16, 10).cast("long")


def short_id(*parts: Column) -> Column:
    """24 hex digits that name the parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 24)
