"""Rules of the domain as column expressions: clocks, costs, odds, orders and fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import normal_cdf, ratio

# --- clocks ---------------------------------------------------------------------------------

#: Month and day of the days without a session, and of those that end at 13:00.
HOLIDAYS, HALF_DAYS = ((1, 1), (7, 4), (12, 25)), ((7, 3), (12, 24))


def _on(day: Column, dates: Sequence[tuple[int, int]]) -> Column:
    return (F.month(day) * 100 + F.dayofmonth(day)).isin([m * 100 + d for m, d in dates])


def trading_day(day: Column) -> Column:
    return (F.weekday(day) < 5) & ~_on(day, HOLIDAYS)


def close_minute(day: Column) -> Column:
    return F.when(_on(day, HALF_DAYS), 780).otherwise(960)


def goal_day(day: Column) -> Column:
    """That week's Friday; a weekend's day itself."""
    return F.when(F.weekday(day) <= 4, F.date_add(day, 4 - F.weekday(day))).otherwise(day)


def sessions_left(day: Column) -> Column:
    """Sessions from the day through its goal day, both counted."""
    days = F.sequence(day, goal_day(day))
    return F.size(F.filter(days, trading_day))


def next_session(day: Column) -> Column:
    return F.get(F.filter(F.sequence(F.date_add(day, 1), F.date_add(day, 7)), trading_day), F.lit(0))


def previous_session(day: Column) -> Column:
    return F.element_at(F.filter(F.sequence(F.date_sub(day, 7), F.date_sub(day, 1)), trading_day), -1)


def slot(minute: Column) -> Column:
    """The last of the looks, half-hourly from 09:00 to 15:30, not after a minute; before the
    first one the minute itself."""
    return F.when(minute < 540, minute).otherwise(F.least(F.lit(930), (F.floor(minute / 30) * 30).cast("int")))


def session_label(day: Column, minute: Column) -> Column:
    return F.when(~trading_day(day), "closed_day").when(minute < 570, "before_open").when(minute < close_minute(day), "during").otherwise("after_close")


def reacts(day: Column, minute: Column) -> Column:
    """The first session that can trade on news of that minute."""
    return F.when(session_label(day, minute).isin("before_open", "during"), day).otherwise(next_session(day))


# --- costs ----------------------------------------------------------------------------------

# fixed values: tier, least dollar volume a day, widest spread in basis points; share of the
# square-root impact; dollar volume a day of the named classes
TIERS = (("A", 500e6, 3.0), ("B", 50e6, 10.0), ("C", 5e6, 50.0))
IMPACT = {"lo": 0.2, "med": 0.5, "hi": 1.0}
SIZES = ((500e6, "very liquid"), (50e6, "liquid"), (5e6, "moderate"), (0.5e6, "thin"), (0.0, "very thin"))


def tier(volume_usd: Column, spread: Column) -> Column:
    out = F.lit("D")
    for name, least, widest in reversed(TIERS):
        out = F.when((volume_usd >= least) & (spread <= widest), name).otherwise(out)
    return out


def size_class(volume_usd: Column) -> Column:
    out = F.lit("unknown")
    for least, name in reversed(SIZES):
        out = F.when(volume_usd >= least, name).otherwise(out)
    return F.when(volume_usd.isNull() | F.isnan(volume_usd), "unknown").otherwise(out)


def commission_round_trip(quantity: Column, price: Column) -> Column:
    """Half a cent a share, a dollar at least, a hundredth of the value at most; twice."""
    return 2 * F.least(F.greatest(F.lit(1.0), 0.005 * quantity), 0.01 * quantity * price)


def order_cost(price: Column, quantity: Column, spread: dict[str, Column], volume_usd: Column, sigma: Column, move: Column) -> dict[str, Column]:
    """Round trip in basis points: the spread, impact on the way in and out, commissions; at
    the low, middle and high spread and impact. ``sigma`` and ``move`` are of a day."""
    notional = quantity * price
    part = F.when(volume_usd > 0, notional / volume_usd)
    impact = {k: F.when(sigma != 0, 1e4 * v * sigma * F.sqrt(part)) for k, v in IMPACT.items()}
    fee = F.when(notional > 0, commission_round_trip(quantity, price) / notional * 1e4)
    total = {k: spread[k] + 2 * F.coalesce(impact[k], F.lit(0.0)) + fee for k in IMPACT}
    return {f"impact_{k}": v for k, v in impact.items()} | {"fee_bps": fee, "cost_lo": total["lo"], "cost_bps": total["med"], "cost_hi": total["hi"], "cost_usd": total["med"] * notional / 1e4, "break_even": F.when(move != 0, total["med"] / (move * 1e4)), "share_of_volume": 100 * part}


def move_usd(notional: Column, range_pct: Column) -> Column:
    """Half of a usual session's span, in dollars of the order."""
    return notional * range_pct / 200


# --- odds -----------------------------------------------------------------------------------


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


def truncated_share(x: Column) -> Column:
    """The share of the downside's second moment that is left when a stop x deviations away
    cuts the path: 0 from 0 down, 1 as x grows."""
    left = 2 * ((0.5 - normal_cdf(-x)) - x * normal_pdf(x) + x * x * normal_cdf(-x))
    return F.when(x <= 0, 0.0).otherwise(F.least(F.lit(1.0), left))


def touch_probability(annual_vol: Column, drop: Column, sessions: Column) -> Column:
    """Of a random walk that falls by ``drop`` (negative, a share) within the sessions: twice
    the chance to end there; none where it doesn't move."""
    sd = annual_vol / F.sqrt(F.lit(252.0)) * F.sqrt(sessions)
    return F.when(sd == 0, F.when(drop < 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), 2 * normal_cdf(ratio(F.ln(1 + drop), sd))))


def nice(x: Column) -> Column:
    """To a tenth under 5, else to a half; a tenth at least. Ties go up."""
    return F.greatest(F.lit(0.1), F.when(x < 5, F.floor(x * 10 + 0.5) / 10).otherwise(F.floor(x * 2 + 0.5) / 2))


def stop_credit(distance: Column, range1: Column) -> Column:
    """Whole within one usual range, none beyond two, a line between; none without either."""
    return F.when(distance.isNull() | range1.isNull() | (range1 <= 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 - distance / range1)))


# --- orders ---------------------------------------------------------------------------------

STOPS = ("STP", "STP LMT", "TRAIL")
#: How far, in usual ranges, an order may stand from the price from each minute on.
LINE = {540: 1.0, 630: 0.6, 780: 0.4, 930: 0.2}


def near_line(minute: Column) -> Column:
    out = F.lit(1.0)
    for at, v in sorted(LINE.items()):
        out = F.when(minute >= at, v).otherwise(out)
    return out


def working_level(kind: Column, buy: Column, limit: Column, stop: Column, trail_pct: Column, last: Column) -> Column:
    """A stop's trigger (a trailing one's from the last price), a limit, null at the market."""
    trail = F.when((trail_pct != 0) & (last != 0), last * F.when(buy, 1 + trail_pct / 100).otherwise(1 - trail_pct / 100))
    return F.when(kind == "TRAIL", trail).when(kind.isin("STP", "STP LMT"), stop).when(kind.isin("LMT", "LOC"), limit)


def substantive(kind: Column, buy: Column, quantity: Column, limit: Column, stop: Column, trail_pct: Column, held: Column, last: Column, range1: Column, minute: Column) -> tuple[Column, Column]:
    """(whether an order counts as acting, its distance in usual ranges). It does if it is a
    stop within two ranges that covers at least half of the position, and $1,000 of it; or of
    $1,000 and at the market or within the line of the minute. A stop-limit's limit must lie
    on the fill side of its stop, within one range. Nothing counts without a last price."""
    r = F.coalesce(F.when(range1 != 0, range1), F.lit(0.03))
    after = held + F.when(buy, quantity).otherwise(-quantity)
    covered = F.least(quantity, F.abs(held))
    guards = kind.isin(*STOPS) & (F.abs(held) > 0) & (F.abs(after) < F.abs(held)) & (covered >= 0.5 * F.abs(held)) & (covered * last >= 1000)
    level = F.when(kind.isin("LMT", "LOC"), limit).when(kind.isin("STP", "STP LMT"), stop)
    level = F.when(level != 0, level)
    far = F.when(kind == "TRAIL", F.when(trail_pct != 0, trail_pct / 100 / r)).otherwise(F.abs(level - last) / last / r)
    gap = F.when(buy, limit - stop).otherwise(stop - limit)
    split = (kind == "STP LMT") & ~F.coalesce((limit != 0) & (stop != 0) & (gap >= 0) & (gap <= last * r), F.lit(False))
    close = F.coalesce(far <= 2, F.lit(False))
    size = quantity * F.coalesce(level, last) >= 1000
    acts = F.when(kind == "TRAIL", guards & close).when(split, F.lit(False)).when(guards, close).otherwise(size & (far.isNull() | (far <= near_line(minute))))
    return F.when(last.isNull() | (last == 0), F.lit(False)).otherwise(acts), F.when(last != 0, far)


def trigger(kind: Column, buy: Column, stop: Column, trail_pct: Column, reference: Column) -> Column:
    """Where a resting stop triggers now."""
    amount = reference * trail_pct / 100
    return F.when(kind == "TRAIL", F.when(buy, reference + amount).otherwise(reference - amount)).when(kind.isin("STP", "STP LMT"), stop)


# --- fields given as text -------------------------------------------------------------------

MONEY = r"^\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
WHOLE = r"^[1-9][0-9]*$"
TIME = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T ]([01][0-9]|2[0-3])(:[0-5][0-9](:[0-5][0-9]([.,][0-9]{1,6})?)?)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9])$"


def is_money(text: Column) -> Column:
    """A finite decimal number, with an exponent or without."""
    return F.coalesce(text.rlike(MONEY), F.lit(False))


def is_positive_whole(text: Column) -> Column:
    return F.coalesce(text.rlike(WHOLE), F.lit(False))


def is_zoned_time(text: Column) -> Column:
    """An ISO timestamp of a real day with a zone; fractions of a second are fine."""
    return F.coalesce(text.rlike(TIME) & F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd").isNotNull(), F.lit(False))
