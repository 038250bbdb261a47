"""Scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Rounded half up at six decimals, the same in any engine; never negative zero."""
    return F.floor(c * 1e6 + 0.5) / 1e6 + F.lit(0.0)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def correlation(a: str, b: str) -> Column:
    """Pearson's correlation over complete pairs, null where either side is constant."""
    x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(x) * F.stddev_pop(y))


def log_return(now: Column, before: Column) -> Column:
    return F.when((now > 0) & (before > 0), F.ln(now / before))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a rational approximation of the error function, to seven decimals."""
    t = 1 / (1 + 0.3275911 * F.abs(x) / 2**0.5)
    # fixed values of the approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1 - poly * F.exp(-x * x / 2)
    return 0.5 * (1 + F.when(x < 0, -1).otherwise(1) * erf)


def commission(shares: Column, price: Column, rate: float = 0.005, least: float = 1.0, cap: float | None = 0.01) -> Column:
    """Per-share commission with a minimum, and unless ``cap`` is None at most that part of the value."""
    fee = F.greatest(F.abs(shares) * rate, F.lit(least))
    return fee if cap is None else F.least(fee, F.abs(shares) * price * cap)


def spread_bps(bid: Column, ask: Column) -> Column:
    """(ask - bid) / mid in basis points; null outside (0, 2000]."""
    bps = ratio(ask - bid, (ask + bid) / 2) * 1e4
    return F.when((bps > 0) & (bps <= 2000), bps)


def probability(c: Column) -> Column:
    return F.when(c.between(0, 1), c)


def half_label(session: Column) -> Column:
    """Like 2025H1."""
    return F.concat(F.year(session).cast("string"), F.when(F.month(session) <= 6, F.lit("H1")).otherwise(F.lit("H2")))


def blume(raw: Column, n: Column, least: int, shrink: Column) -> Column:
    """Two thirds of the raw beta and one third where ``shrink``, else the raw one; null under ``least`` pairs."""
    return F.when(n >= least, F.when(shrink, raw * 2 / 3 + F.lit(1.0) / 3).otherwise(raw))


def order_code(action: Column, quantity: Column, kind: Column, limit: Column, tif: Column) -> Column:
    """First failed rule of an order, in priority order; OK where none fails."""
    kind_ = F.upper(F.trim(kind))
    return (
        F.when(~F.coalesce(F.upper(F.trim(action)).isin("BUY", "SELL"), F.lit(False)), "BAD_ACTION")
        .when(~F.coalesce((quantity > 0) & (quantity == F.floor(quantity)), F.lit(False)), "BAD_QUANTITY")
        .when(~F.coalesce(kind_.isin("MKT", "LMT", "STP", "STP LMT", "TRAIL", "MOC", "MOO", "LOC"), F.lit(False)), "BAD_TYPE")
        .when(kind_.isin("LMT", "STP LMT", "LOC") & ~F.coalesce(limit > 0, F.lit(False)), "NO_LIMIT")
        .when(~F.coalesce(F.upper(F.trim(tif)).isin("DAY", "GTC"), F.lit(False)), "BAD_TIF")
        .otherwise("OK")
    )


def bar_fill(kind: Column, buy: Column, limit: Column, stop: Column, o: Column, h: Column, l: Column, c: Column) -> Column:
    """Price at which an order fills within one bar, null if it does not.

    A gap through a limit or stop fills at the open; a touched limit at its price; a stop
    at its price; a stop-limit only if the limit is reachable after the trigger.
    """
    lim_buy = F.when(o <= limit, o).when(l <= limit, limit)
    lim_sell = F.when(o >= limit, o).when(h >= limit, limit)
    stp_buy = F.when(o >= stop, o).when(h >= stop, stop)
    stp_sell = F.when(o <= stop, o).when(l <= stop, stop)
    # once the stop is hit the order is a limit from the trigger price on
    sl_buy = F.when(stp_buy.isNotNull(), F.when(stp_buy <= limit, stp_buy).when(l <= limit, limit))
    sl_sell = F.when(stp_sell.isNotNull(), F.when(stp_sell >= limit, stp_sell).when(h >= limit, limit))
    return (
        F.when(kind.isin("MKT", "MOO"), o)
        .when(kind == "MOC", c)
        .when(kind == "LOC", F.when(F.when(buy, c <= limit).otherwise(c >= limit), c))
        .when(kind == "LMT", F.when(buy, lim_buy).otherwise(lim_sell))
        .when(kind == "STP", F.when(buy, stp_buy).otherwise(stp_sell))
        .when(kind == "STP LMT", F.when(buy, sl_buy).otherwise(sl_sell))
    )
