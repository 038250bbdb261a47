"""Facts about orders, groups and arms: what a decision did, and whether it differed."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import r6, ratio
from ..sources import views as V
from . import sql as S
from .catalog import query
from .ledger import latest_fills
from .rules import _ORDER
from .stages import apply, over, panel, slots

# --- orders of a look: re-placed, offsetting, admitted -------------------------------------

_LOOK = {**_ORDER, "look": "date_trunc('month', o_orderdate)::DATE", "symbol": "o_custkey % 12", "level": "(50 + o_custkey % 12) * (1 + (o_orderkey % 41 - 20) / 1000e0)", "family": "CASE WHEN o_orderkey % 4 = 0 THEN 'mkt' WHEN o_orderkey % 4 = 1 THEN 'stop' ELSE 'lmt' END", "cancelled": "o_orderkey % 5 < 2", "base": "50 + o_custkey % 12"}
_LOOKS = f"o AS (SELECT o_orderkey, o_custkey, {', '.join(f'{e} AS {n}' for n, e in _LOOK.items())} FROM orders)"
#: A quarter of the usual range.
_NEAR = 0.0025


def _looks(spark, d):
    return apply(V.table(spark, d, "orders"), _LOOK).select("o_orderkey", "look", "symbol", "side", "family", "level", "qty", "cancelled", "base")


def _near_ids(a, b, on):
    """Keys of the orders of ``a`` with one of ``b`` on the same keys, at the market or near
    its level. Levels are cut into cells as wide as near is, so an order meets its own cell
    and the two beside it."""
    cell = F.when(F.col("family") == "mkt", F.lit(0).cast("bigint")).otherwise(F.floor(F.col("level") / F.col("base") / _NEAR))
    asks = a.select("o_orderkey", *on, "base", "level", cell.alias("cell"))
    other = b.select(*on, F.col("level").alias("l2"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    met = asks.join(other, [*on, "cell"])
    return met.filter((F.col("family") == "mkt") | (F.abs(F.col("level") - F.col("l2")) / F.col("base") <= _NEAR)).select("o_orderkey").distinct()


@query(f"""WITH {_LOOKS}, p AS (SELECT * FROM o WHERE NOT cancelled), c AS (SELECT * FROM o WHERE cancelled),
pn AS (SELECT * FROM p WHERE EXISTS (SELECT 1 FROM c WHERE c.look = p.look AND c.symbol = p.symbol AND c.side = p.side AND c.family = p.family AND (p.family = 'mkt' OR abs(p.level - c.level) / p.base <= {_NEAR}))),
cn AS (SELECT * FROM c WHERE EXISTS (SELECT 1 FROM p WHERE c.look = p.look AND c.symbol = p.symbol AND c.side = p.side AND c.family = p.family AND (p.family = 'mkt' OR abs(p.level - c.level) / p.base <= {_NEAR}))),
g AS (SELECT look, symbol, side, family, sum(qty) AS qp, count(*) AS np FROM pn GROUP BY ALL), h AS (SELECT look, symbol, side, family, sum(qty) AS qc, count(*) AS nc FROM cn GROUP BY ALL)
SELECT look, symbol, side, family, qp::BIGINT AS placed, qc::BIGINT AS cancelled, np::BIGINT AS n_placed, nc::BIGINT AS n_cancelled, abs(qp - qc) <= 0.25 * qc AS replaced FROM g JOIN h USING (look, symbol, side, family)""")
def order_replacements(spark, d):
    """Placed orders that only put back what was cancelled: same symbol, side and kind, near
    levels, total quantities within a quarter."""
    o = _looks(spark, d)
    on = ["look", "symbol", "side", "family"]
    p, c = o.filter(~F.col("cancelled")), o.filter("cancelled")
    total = lambda df, ids, q, n: df.join(ids, "o_orderkey").groupBy(*on).agg(F.sum("qty").alias(q), F.count(F.lit(1)).alias(n))
    g = total(p, _near_ids(p, c, on), "placed", "n_placed").join(total(c, _near_ids(c, p, on), "cancelled", "n_cancelled"), on)
    return g.select(*on, "placed", "cancelled", "n_placed", "n_cancelled", (F.abs(F.col("placed") - F.col("cancelled")) <= 0.25 * F.col("cancelled")).alias("replaced"))


_LEG = {**_LOOK, "kind": "CASE WHEN o_orderkey % 6 = 0 THEN 'MKT' WHEN o_orderkey % 6 = 1 THEN 'LMT' WHEN o_orderkey % 6 = 2 THEN 'STP' WHEN o_orderkey % 6 = 3 THEN 'MOO' WHEN o_orderkey % 6 = 4 THEN 'LMT' ELSE 'MOC' END", "side": "CASE WHEN floor(o_orderkey / 6) % 2 = 0 THEN 'BUY' ELSE 'SELL' END", "pre": "month(o_orderdate) % 2 = 0"}


@query(f"""WITH o AS (SELECT o_orderkey, {', '.join(f'{e} AS {n}' for n, e in _LEG.items())} FROM orders), p AS (SELECT * FROM o WHERE NOT cancelled),
m AS (SELECT look, symbol, CASE WHEN pre AND kind IN ('MKT', 'MOO') THEN 'open' ELSE kind END AS pair, sum(qty) FILTER (side = 'BUY') AS a, sum(qty) FILTER (side = 'SELL') AS b FROM p WHERE kind IN ('MKT', 'MOO', 'MOC') GROUP BY ALL),
near AS (SELECT x.o_orderkey AS l, y.o_orderkey AS s, x.look, x.symbol, x.side, x.qty AS lq, y.qty AS sq FROM p x JOIN p y ON x.kind = 'LMT' AND y.kind = 'STP' AND x.look = y.look AND x.symbol = y.symbol AND x.side <> y.side AND abs(x.level - y.level) / x.base <= {_NEAR}),
r AS (SELECT look, symbol, side || ' LMT' AS pair, sum(q) FILTER (leg = 'l') AS a, sum(q) FILTER (leg = 's') AS b FROM (SELECT DISTINCT look, symbol, side, 'l' AS leg, l AS k, lq AS q FROM near UNION ALL SELECT DISTINCT look, symbol, side, 's', s, sq FROM near) GROUP BY ALL)
SELECT look, symbol, pair, a::BIGINT AS first_leg, b::BIGINT AS other_leg, abs(a - b) <= greatest(a, b) / 4e0 AS offset_each_other FROM (SELECT * FROM m UNION ALL SELECT * FROM r) WHERE a IS NOT NULL AND b IS NOT NULL""")
def order_offsets(spark, d):
    """Opposite orders of one look and symbol that trigger together: market legs of one moment
    (before the open MKT and MOO are one), or limits and opposite stops near their level. They
    leave the book as it was where their totals are within a quarter."""
    p = apply(V.table(spark, d, "orders"), _LEG).filter(~F.col("cancelled"))
    moment = F.when(F.col("pre") & F.col("kind").isin("MKT", "MOO"), "open").otherwise(F.col("kind"))
    of = lambda side: F.sum(F.when(F.col("side") == side, F.col("qty")))
    market = p.filter(F.col("kind").isin("MKT", "MOO", "MOC")).groupBy("look", "symbol", moment.alias("pair")).agg(of("BUY").alias("first_leg"), of("SELL").alias("other_leg"))
    # the limit's side names both legs, so a limit and an opposite stop meet on equal keys
    legs = p.filter(F.col("kind").isin("LMT", "STP")).withColumn("with", F.when((F.col("kind") == "LMT") == (F.col("side") == "BUY"), "BUY LMT").otherwise("SELL LMT")).withColumn("family", F.lit("level"))
    on = ["look", "symbol", "with", "family"]
    lim, stp = legs.filter("kind = 'LMT'"), legs.filter("kind = 'STP'")
    total = lambda x, ids, name: x.join(ids, "o_orderkey").groupBy(*on).agg(F.sum("qty").alias(name))
    resting = total(lim, _near_ids(lim, stp, on), "first_leg").join(total(stp, _near_ids(stp, lim, on), "other_leg"), on).drop("family").withColumnRenamed("with", "pair")
    both = market.filter("first_leg is not null and other_leg is not null").unionByName(resting)
    even = F.abs(F.col("first_leg") - F.col("other_leg")) <= 0.25 * F.greatest("first_leg", "other_leg")
    return both.select("look", "symbol", "pair", F.col("first_leg").cast("long").alias("first_leg"), F.col("other_leg").cast("long").alias("other_leg"), even.alias("offset_each_other"))


@query(f"""WITH RECURSIVE {_LOOKS}, n AS (SELECT look, o_orderkey, CASE WHEN side = 'BUY' THEN qty ELSE -qty END * base AS usd, row_number() OVER (PARTITION BY look ORDER BY o_orderkey) AS k FROM o WHERE NOT cancelled),
w AS (SELECT look, 0::BIGINT AS k, NULL::BIGINT AS o_orderkey, 0::BIGINT AS net, NULL::BOOLEAN AS ok FROM n WHERE k = 1 UNION ALL
SELECT n.look, n.k, n.o_orderkey, CASE WHEN abs(w.net + n.usd) <= 5000 OR abs(w.net + n.usd) < abs(w.net) THEN w.net + n.usd ELSE w.net END, abs(w.net + n.usd) <= 5000 OR abs(w.net + n.usd) < abs(w.net) FROM w JOIN n ON n.look = w.look AND n.k = w.k + 1)
SELECT look, max(k) AS orders, count(*) FILTER (ok) AS admitted, arg_max(net, k) AS net FROM w GROUP BY look""")
def admission_walk(spark, d):
    """Orders of a look admitted one after another, each as if those before had filled: an
    order that reduces the exposure always passes, others only within the limit."""
    o = _looks(spark, d).filter(~F.col("cancelled"))
    usd = F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")) * F.col("base")
    g = o.groupBy("look").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", usd.alias("usd")))).alias("s"))

    def step(a, x):
        after = a["net"] + x["usd"]
        ok = (F.abs(after) <= 5000) | (F.abs(after) < F.abs(a["net"]))
        return F.struct(F.when(ok, after).otherwise(a["net"]).alias("net"), (a["n"] + ok.cast("bigint")).alias("n"))

    zero = F.struct(F.lit(0).cast("bigint").alias("net"), F.lit(0).cast("bigint").alias("n"))
    # a look's orders are few, and looks are many
    w = g.select("look", F.size("s").cast("bigint").alias("orders"), F.aggregate("s", zero, step).alias("w"))
    return w.select("look", "orders", F.col("w.n").alias("admitted"), F.col("w.net").alias("net"))


@query(f"""WITH {_LOOKS}, s AS (SELECT *, CASE WHEN side = 'BUY' THEN qty ELSE -qty END AS move FROM o),
r AS (SELECT *, sum(move) OVER (PARTITION BY look, symbol ORDER BY o_orderkey) AS pos FROM s), f AS (SELECT *, pos - move AS before FROM r)
SELECT look, count(*)::BIGINT AS orders, count(DISTINCT symbol)::BIGINT AS symbols, count(*) FILTER (cancelled)::BIGINT AS cancels, count(*) FILTER (family = 'stop')::BIGINT AS stops, sum(qty * base)::BIGINT AS gross, sum(move * base)::BIGINT AS net,
count(*) FILTER (before <> 0 AND (before > 0) <> (move > 0))::BIGINT AS reducing, count(*) FILTER (before <> 0 AND (before > 0) <> (pos > 0) AND pos <> 0)::BIGINT AS flips, {S.r6('avg(abs(level / base - 1))')} AS distance FROM f GROUP BY look""")
def order_facts(spark, d):
    """Per look: orders, symbols, cancels, stops, exposure, and how many orders reduce or flip
    the position that the orders before them leave."""
    o = _looks(spark, d).withColumn("move", F.when(F.col("side") == "BUY", F.col("qty")).otherwise(-F.col("qty")))
    w = W.partitionBy("look", "symbol").orderBy("o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    f = o.withColumn("pos", F.sum("move").over(w)).withColumn("before", F.col("pos") - F.col("move"))
    n = lambda c: F.count(F.when(F.expr(c), 1))
    return f.groupBy("look").agg(
        F.count(F.lit(1)).alias("orders"), F.countDistinct("symbol").alias("symbols"), n("cancelled").alias("cancels"), n("family = 'stop'").alias("stops"), F.sum(F.col("qty") * F.col("base")).alias("gross"), F.sum(F.col("move") * F.col("base")).alias("net"),
        n("before <> 0 AND (before > 0) <> (move > 0)").alias("reducing"), n("before <> 0 AND (before > 0) <> (pos > 0) AND pos <> 0").alias("flips"), r6(F.avg(F.abs(F.col("level") / F.col("base") - 1))).alias("distance"),
    )


# --- arms and drifts -----------------------------------------------------------------------

_ARMS = f"{S.BARS}, arms AS (SELECT a.session, a.c - b.c AS diff FROM bars a JOIN bars b ON a.session = b.session AND a.symbol = 1 AND b.symbol = 2)"


def _arms(spark, d):
    b = V.bars_daily(spark, d).select("symbol", "session", "c")
    return b.filter("symbol = 1").select("session", F.col("c").alias("x")).join(b.filter("symbol = 2").select("session", F.col("c").alias("y")), "session").select("session", (F.col("x") - F.col("y")).alias("diff"))


@query(f"""WITH {_ARMS}, n AS (SELECT count(*) FILTER (diff > 0) AS w, count(*) FILTER (diff < 0) AS l, avg(diff) AS m, stddev_samp(diff) AS sd, count(*) AS k FROM arms),
t AS (SELECT w, l, m, sd, k, unnest(range(0, least(w, l) + 1)) AS i FROM n), u AS (SELECT *, coalesce(sum(CASE WHEN i > 0 THEN ln((w + l - i + 1) / i) END) OVER (ORDER BY i), 0) AS lc FROM t)
SELECT any_value(k)::BIGINT AS pairs, any_value(w)::BIGINT AS wins, any_value(l)::BIGINT AS losses, {S.r6('any_value(m)')} AS mean, {S.r6('any_value(m) / nullif(any_value(sd) / sqrt(any_value(k)), 0)')} AS t, {S.r6('least(1, 2 * sum(exp(lc - (w + l) * ln(2e0))))')} AS p FROM u""")
def paired_sign_test(spark, d):
    """Two arms paired by session: wins, losses, mean, its t, and the exact two-sided sign test."""
    n = _arms(spark, d).agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("diff") > 0, 1)).alias("w"), F.count(F.when(F.col("diff") < 0, 1)).alias("l"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("sd"))
    t = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("w", "l"))))
    size = F.col("w") + F.col("l")
    # one row a term of the tail: at most half the pairs
    lc = F.coalesce(F.sum(F.when(F.col("i") > 0, F.ln(F.try_divide(size - F.col("i") + 1, F.col("i"))))).over(W.partitionBy("w", "l").orderBy("i")), F.lit(0.0))
    u = t.withColumn("term", F.exp(lc - size * F.ln(F.lit(2.0))))
    one = lambda c: F.first(c)
    return u.agg(one("k").alias("pairs"), one("w").alias("wins"), one("l").alias("losses"), r6(one("m")).alias("mean"), r6(ratio(one("m"), one("sd") / F.sqrt(one("k")))).alias("t"), r6(F.least(F.lit(1.0), 2 * F.sum("term"))).alias("p"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS month, o_orderpriority AS arm, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS sd, count(*) AS n FROM orders GROUP BY ALL),
f AS (SELECT *, first_value(mean) OVER w AS m0, first_value(sd) OVER w AS s0, first_value(n) OVER w AS n0 FROM m WINDOW w AS (PARTITION BY arm ORDER BY month))
SELECT month, arm, n::BIGINT AS n, coalesce(abs(mean - m0) > 0.3 * abs(m0) AND abs(mean - m0) > 2 * sqrt(sd * sd / n + s0 * s0 / n0), FALSE) AS drifted, abs(mean - m0) > 0.3 * abs(m0) AS moved FROM f""")
def drift_flags(spark, d):
    """A month has drifted from the arm's first where its mean moved by 30 % and by two standard errors."""
    m = V.table(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.col("o_orderpriority").alias("arm")).agg(F.avg("o_totalprice").alias("mean"), F.stddev_samp("o_totalprice").alias("sd"), F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("arm").orderBy("month")
    f = m.withColumns({c: F.first(x).over(w) for c, x in (("m0", "mean"), ("s0", "sd"), ("n0", "n"))})
    gap, se = F.abs(F.col("mean") - F.col("m0")), F.sqrt(F.col("sd") * F.col("sd") / F.col("n") + F.col("s0") * F.col("s0") / F.col("n0"))
    moved = gap > 0.3 * F.abs("m0")
    return f.select("month", "arm", "n", F.coalesce(moved & (gap > 2 * se), F.lit(False)).alias("drifted"), moved.alias("moved"))


@query(f"""WITH {S.SLOTS}, ends AS (SELECT symbol, session, arg_min(o, slot) AS first, arg_max(c, slot) AS last FROM slots GROUP BY ALL), n AS (SELECT symbol, session, lead(first) OVER (PARTITION BY symbol ORDER BY session) / nullif(last, 0) - 1 AS night FROM ends),
g AS (SELECT s.session, s.slot, s.symbol, c AS x, night, min(s.slot) OVER (PARTITION BY s.session) AS first_look FROM slots s JOIN n ON n.symbol = s.symbol AND n.session = s.session WHERE night IS NOT NULL),
w AS (SELECT *, x - avg(x) OVER k AS adv, count(*) OVER k AS members, night - avg(night) OVER k AS off FROM g WINDOW k AS (PARTITION BY session, slot))
SELECT slot, count(*)::BIGINT AS n, {S.r6('sqrt(avg(adv * adv))')} AS sd, {S.r6('sum(abs(adv))')} AS mass, {S.r6('sum(10000 * off * off) FILTER (slot > first_look) / nullif(sum(adv * adv) FILTER (slot > first_look), 0)')} AS overnight_share FROM w WHERE members >= 2 GROUP BY slot""")
def advantage_noise(spark, d):
    """Per look the pooled deviation of the advantages within groups and their mass, and for
    the looks after a group's first the share of that variance that the members' overnight
    moves (in hundredths) carry."""
    s = slots(spark, d)
    ends = s.groupBy("symbol", "session").agg(F.min_by("o", "slot").alias("first"), F.max_by("c", "slot").alias("last"))
    night = ends.select("symbol", "session", (ratio(F.lead("first").over(W.partitionBy("symbol").orderBy("session")), F.col("last")) - 1).alias("night")).filter("night is not null")
    group = W.partitionBy("session", "slot")
    g = s.select("symbol", "session", "slot", F.col("c").alias("x")).join(night, ["symbol", "session"]).withColumn("first_look", F.min("slot").over(W.partitionBy("session")))
    g = g.withColumns({"adv": F.col("x") - F.avg("x").over(group), "off": 100 * (F.col("night") - F.avg("night").over(group)), "members": F.count(F.lit(1)).over(group)}).filter("members >= 2")
    later = lambda c: F.sum(F.when(F.col("slot") > F.col("first_look"), F.col(c) * F.col(c)))
    return g.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), r6(F.sqrt(F.avg(F.col("adv") * F.col("adv")))).alias("sd"), r6(F.sum(F.abs("adv"))).alias("mass"), r6(ratio(later("off"), later("adv"))).alias("overnight_share"))


panel(
    "eligible_advantages",
    "Reward less its group's mean over eligible members only; void for the whole group where a member is ineligible; the reward to go less its group's at the same look.",
    slots, S.SLOTS, "slots",
    [
        {"ok": "CASE WHEN v >= 2 THEN 1 ELSE 0 END", "togo": "sum(c) OVER (PARTITION BY symbol, session ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"},
        {"okc": "CASE WHEN ok = 1 THEN c END", "whole": "min(ok) OVER (PARTITION BY session, slot)", "k": "count(*) OVER (PARTITION BY session, slot)"},
        {"adv": "CASE WHEN ok = 1 AND count(okc) OVER (PARTITION BY session, slot) >= 2 THEN c - avg(okc) OVER (PARTITION BY session, slot) END", "strict": "CASE WHEN whole = 1 AND k >= 2 THEN c - avg(c) OVER (PARTITION BY session, slot) END", "later": "CASE WHEN k >= 2 THEN togo - avg(togo) OVER (PARTITION BY session, slot) END"},
        {"used": "CASE WHEN later IS NOT NULL AND abs(later) > 0.000001 THEN 1e0 ELSE 0e0 END"},
    ],
    ["symbol", "session", "slot"], ["adv", "strict", "later", "used"],
)

panel(
    "checkpoint_choice",
    "Whether a session and the three after it are clean (volume and no missing value), the latest such session so far, and every fifth start that has a horizon of ten ahead.",
    lambda spark, d: V.aligned(V.weekly(spark, d)), S.GRID, "grid",
    [
        {"clean": "CASE WHEN price IS NOT NULL AND v > 0 THEN 1 ELSE 0 END", "last_ix": "max(ix) OVER (PARTITION BY symbol)"},
        {"run4": f"CASE WHEN count(*) {over(4, 3)} = 4 THEN min(clean) {over(4, 3)} ELSE 0 END"},
        {"candidate": f"max(CASE WHEN run4 = 1 THEN ix END) {over('all')}", "start": "CASE WHEN ix % 5 = 0 AND ix + 10 <= last_ix THEN 1e0 ELSE 0e0 END"},
    ],
    ["symbol", "ix"], ["run4", "candidate", "start"],
)

# --- books ---------------------------------------------------------------------------------

_SPLITS = [("1997-06-02", 2.0), ("1999-03-01", 3.0)]


@query(f"""WITH {S.FILLS}, splits AS (SELECT * FROM (VALUES {', '.join(f"(TIMESTAMP '{t}', {r}::DOUBLE)" for t, r in _SPLITS)}) AS s(split_at, factor)),
f AS (SELECT sleeve, symbol, CASE WHEN side = 'BOT' THEN shares ELSE -shares END * CASE WHEN symbol % 5 = 0 THEN coalesce((SELECT product(factor) FROM splits WHERE split_at > time), 1) ELSE 1 END AS q, time FROM latest)
SELECT sleeve, symbol, sum(q)::BIGINT AS qty, count(*)::BIGINT AS fills FROM f GROUP BY ALL""")
def positions_with_splits(spark, d):
    """Positions in today's shares: each fill times the factors of the splits after it. The
    splits are a short list, so their factors are one expression."""
    later = F.lit(1.0)
    for at, factor in _SPLITS:
        later = later * F.when((F.col("symbol") % 5 == 0) & (F.col("time") < F.lit(at).cast("timestamp_ntz")), factor).otherwise(1.0)
    sign = F.when(F.col("side") == "BOT", 1).otherwise(-1)
    f = latest_fills(spark, d).withColumn("q", sign * F.col("shares") * later)
    return f.groupBy("sleeve", "symbol").agg(F.sum("q").cast("bigint").alias("qty"), F.count(F.lit(1)).alias("fills"))


@query(f"""WITH {S.FILLS}, day AS (SELECT sleeve, symbol, time::DATE AS session, sum(CASE WHEN side = 'BOT' THEN shares ELSE -shares END) AS q FROM latest GROUP BY ALL),
p AS (SELECT sleeve, symbol, session, sum(q) OVER (PARTITION BY sleeve, symbol ORDER BY session) AS pos, lead(session) OVER (PARTITION BY sleeve, symbol ORDER BY session) AS nxt FROM day)
SELECT sleeve, symbol, max(abs(pos))::BIGINT AS most, count(*)::BIGINT AS stretches FROM p WHERE pos <> 0 AND session <= DATE '1998-12-31' AND coalesce(nxt, DATE '2100-01-01') > DATE '1998-01-01' GROUP BY ALL""")
def held_overnight(spark, d):
    """What was held at any close of a year, with its largest position."""
    sign = F.when(F.col("side") == "BOT", 1).otherwise(-1)
    day = latest_fills(spark, d).groupBy("sleeve", "symbol", F.to_date("time").alias("session")).agg(F.sum(sign * F.col("shares")).alias("q"))
    w = W.partitionBy("sleeve", "symbol").orderBy("session")
    p = day.withColumns({"pos": F.sum("q").over(w), "nxt": F.lead("session").over(w)})
    held = p.filter("pos <> 0 and session <= date'1998-12-31' and coalesce(nxt, date'2100-01-01') > date'1998-01-01'")
    return held.groupBy("sleeve", "symbol").agg(F.max(F.abs("pos")).alias("most"), F.count(F.lit(1)).alias("stretches"))


_STOP = {"level": "l_extendedprice / l_quantity * CASE WHEN l_returnflag = 'R' THEN 1 - l_discount ELSE 1 + l_discount END", "cover": "l_quantity"}


@query(f"""WITH {S.FILLS}, p AS (SELECT sleeve, symbol, sum(CASE WHEN side = 'BOT' THEN shares ELSE -shares END) AS q, sum(CASE WHEN side = 'BOT' THEN -cents ELSE cents END) / 100e0 AS cash, arg_max(cents / 100e0 / shares, (time, l_orderkey, l_linenumber)) AS px FROM latest GROUP BY ALL),
stops AS (SELECT o_orderpriority AS sleeve, l_suppkey AS symbol, l_returnflag = 'R' AS sells, {', '.join(f'{e} AS {n}' for n, e in _STOP.items())} FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND l_tax > 0.05),
c AS (SELECT p.sleeve, p.symbol, min((1 - least(1, cover / abs(q)), greatest(0, CASE WHEN q > 0 THEN px - level ELSE level - px END / px))) AS best FROM p JOIN stops s ON s.sleeve = p.sleeve AND s.symbol = p.symbol AND sells = (q > 0) WHERE q <> 0 AND level > 0 GROUP BY ALL),
nav AS (SELECT sleeve, 1e6 + sum(cash + q * px) AS nav FROM p GROUP BY sleeve), w AS (SELECT p.sleeve, p.symbol, CASE WHEN nav > 0 THEN abs(q * px) / nav ELSE 0 END AS weight, coalesce(1 - best[1], 0) AS cov, best[2] AS dist FROM p JOIN nav ON nav.sleeve = p.sleeve LEFT JOIN c ON c.sleeve = p.sleeve AND c.symbol = p.symbol WHERE q <> 0),
t AS (SELECT sleeve, count(*) AS positions, sum(weight) AS gross, sum(weight) FILTER (cov < 0.5) AS bare, max((weight, -symbol)) AS top FROM w GROUP BY sleeve)
SELECT t.sleeve, positions::BIGINT AS positions, {S.r6('gross')} AS gross, {S.r6('coalesce(bare, 0)')} AS unprotected, w.symbol AS top_symbol, {S.r6('weight')} AS top_weight, {S.r6('cov')} AS top_cover, {S.r6('dist')} AS top_distance, cov >= 0.5 AS top_protected, weight >= 0.75 AND cov < 0.5 AS unprotected_75 FROM t JOIN w ON w.sleeve = t.sleeve AND w.symbol = -top[2]""")
def book_summary(spark, d):
    """A book's concentration and protection at its marks: weights of the net asset value, the
    largest position, and how much of it working stops on its exit side cover, at what distance.
    A position's cover is that of the stop that covers most, of several the nearest."""
    sign = F.when(F.col("side") == "BOT", 1).otherwise(-1)
    last = F.struct("time", "l_orderkey", "l_linenumber")
    p = latest_fills(spark, d).groupBy("sleeve", "symbol").agg(F.sum(sign * F.col("shares")).alias("q"), (F.sum(-sign * F.col("cents")) / 100).alias("cash"), F.max_by(F.col("cents") / 100 / F.col("shares"), last).alias("px"))
    nav = p.groupBy("sleeve").agg((F.lit(1e6) + F.sum(F.col("cash") + F.col("q") * F.col("px"))).alias("nav"))
    working = V.table(spark, d, "lineitem").filter("l_linestatus = 'O' and l_tax > 0.05").join(V.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("sleeve")), "l_orderkey")
    stops = apply(working, _STOP).select("sleeve", F.col("l_suppkey").alias("symbol"), (F.col("l_returnflag") == "R").alias("sells"), "level", "cover").filter("level > 0")
    held = p.filter("q <> 0").withColumn("sells", F.col("q") > 0)
    far = F.greatest(F.lit(0.0), F.when(F.col("q") > 0, F.col("px") - F.col("level")).otherwise(F.col("level") - F.col("px")) / F.col("px"))
    best = held.join(stops, ["sleeve", "symbol", "sells"]).groupBy("sleeve", "symbol").agg(F.min(F.struct((1 - F.least(F.lit(1.0), F.col("cover") / F.abs("q"))).alias("open"), far.alias("dist"))).alias("best"))
    w = held.join(nav, "sleeve").join(best, ["sleeve", "symbol"], "left")
    w = w.select("sleeve", "symbol", F.when(F.col("nav") > 0, F.abs(F.col("q") * F.col("px")) / F.col("nav")).otherwise(0.0).alias("weight"), F.coalesce(1 - F.col("best.open"), F.lit(0.0)).alias("cov"), F.col("best.dist").alias("dist"))
    t = w.groupBy("sleeve").agg(F.count(F.lit(1)).alias("positions"), r6(F.sum("weight")).alias("gross"), r6(F.coalesce(F.sum(F.when(F.col("cov") < 0.5, F.col("weight"))), F.lit(0.0))).alias("unprotected"), F.max(F.struct("weight", (-F.col("symbol")).alias("by"), "symbol", "cov", "dist")).alias("top"))
    top, cov = F.col("top.weight"), F.col("top.cov")
    return t.select("sleeve", "positions", "gross", "unprotected", F.col("top.symbol").alias("top_symbol"), r6(top).alias("top_weight"), r6(cov).alias("top_cover"), r6(F.col("top.dist")).alias("top_distance"), (cov >= 0.5).alias("top_protected"), ((top >= 0.75) & (cov < 0.5)).alias("unprotected_75"))


# --- merging and matching ------------------------------------------------------------------


@query(f"""WITH {S.BARS}, cut AS (SELECT min(session) + 20 AS a, min(session) + 15 AS b FROM bars), old AS (SELECT symbol, session, c FROM bars, cut WHERE session <= a), new AS (SELECT symbol, session, c * CASE WHEN symbol % 4 = 0 THEN 1.001 ELSE 1 END AS c FROM bars, cut WHERE session >= b),
j AS (SELECT symbol, session, o.c AS oc, n.c AS nc FROM old o FULL JOIN new n USING (symbol, session)), r AS (SELECT *, coalesce(bool_or(abs(nc / nullif(oc, 0) - 1) > 0.0005) OVER (PARTITION BY symbol), FALSE) AS rebased FROM j)
SELECT symbol, session, {S.r6('coalesce(nc, oc)')} AS c, rebased FROM r WHERE nc IS NOT NULL OR NOT rebased""")
def bars_upsert(spark, d):
    """New bars merged into old ones by date. Where their overlap is off by more than 0.05 %
    the history was re-based, and the symbol's old bars go."""
    b = V.bars_daily(spark, d).select("symbol", "session", "c")
    first = F.broadcast(b.agg(F.min("session").alias("f")))
    at = b.join(first)
    old = at.filter("session <= date_add(f, 20)").select("symbol", "session", F.col("c").alias("oc"))
    new = at.filter("session >= date_add(f, 15)").select("symbol", "session", (F.col("c") * F.when(F.col("symbol") % 4 == 0, 1.001).otherwise(1.0)).alias("nc"))
    j = old.join(new, ["symbol", "session"], "full")
    off = F.abs(ratio(F.col("nc"), F.col("oc")) - 1) > 0.0005
    r = j.withColumn("rebased", F.coalesce(F.bool_or(off).over(W.partitionBy("symbol")), F.lit(False)))
    return r.filter("nc is not null or not rebased").select("symbol", "session", r6(F.coalesce("nc", "oc")).alias("c"), "rebased")


@query("""WITH p AS (SELECT p_partkey, p_brand, p_type, count(*) OVER (PARTITION BY p_brand, p_type) AS a, count(*) OVER (PARTITION BY p_brand) AS b FROM part),
g AS (SELECT p_partkey, CASE WHEN a >= 12 THEN concat(p_brand, '/', p_type) WHEN b >= 40 THEN p_brand END AS name FROM p)
SELECT p_partkey, name, CASE WHEN name IS NULL THEN -1 ELSE (SELECT count(DISTINCT x.name) FROM g x WHERE x.name < g.name) END::BIGINT AS id FROM g""")
def group_ids(spark, d):
    """The narrow group where it has enough members, else the wide one, else none; numbered."""
    p = V.table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    a, b = F.count(F.lit(1)).over(W.partitionBy("p_brand", "p_type")), F.count(F.lit(1)).over(W.partitionBy("p_brand"))
    g = p.withColumns({"a": a, "b": b}).withColumn("name", F.when(F.col("a") >= 12, F.concat("p_brand", F.lit("/"), "p_type")).when(F.col("b") >= 40, F.col("p_brand")))
    # the names are brands by types: a small dimension
    ids = g.filter("name is not null").select("name").distinct().withColumn("id", (F.row_number().over(W.orderBy("name")) - 1).cast("bigint"))
    return g.join(F.broadcast(ids), "name", "left").select("p_partkey", "name", F.coalesce("id", F.lit(-1).cast("bigint")).alias("id"))


@query(f"""WITH {S.TICKS}, a AS (SELECT event_id, symbol, ts::DATE AS d FROM ticks WHERE event_type = 'purchase'), b AS (SELECT event_id AS b_id, symbol, ts::DATE AS d FROM ticks WHERE event_type = 'signup'),
m AS (SELECT a.event_id, b_id, CASE WHEN b.d = a.d THEN 1 WHEN date_trunc('week', b.d) = date_trunc('week', a.d) THEN 2 END AS stage FROM a JOIN b ON a.symbol = b.symbol AND date_trunc('week', b.d) = date_trunc('week', a.d)),
best AS (SELECT event_id, b_id, stage, count(*) OVER (PARTITION BY event_id, stage) AS rivals FROM m QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY stage, b_id) = 1)
SELECT a.event_id, b_id, stage, coalesce(rivals > 1, FALSE) AS conflict FROM a LEFT JOIN best USING (event_id)""")
def two_stage_match(spark, d):
    """A match on the day, else on the week; the first of several, marked as a conflict."""
    t = V.ticks(spark, d).select("event_id", "symbol", "event_type", F.to_date("ts").alias("d"), F.to_date(F.date_trunc("week", "ts")).alias("week"))
    a = t.filter("event_type = 'purchase'").select("event_id", "symbol", "d", "week")
    b = t.filter("event_type = 'signup'").select(F.col("event_id").alias("b_id"), "symbol", F.col("d").alias("bd"), "week")
    m = a.join(b, ["symbol", "week"]).withColumn("stage", F.when(F.col("d") == F.col("bd"), 1).otherwise(2))
    # the smallest of a stage and how many it has: an aggregate, not a sort of all matches
    s = m.groupBy("event_id", "stage").agg(F.min("b_id").alias("b_id"), F.count(F.lit(1)).alias("rivals"))
    best = s.groupBy("event_id").agg(F.min(F.struct("stage", "b_id", "rivals")).alias("x"))
    return a.select("event_id").join(best, "event_id", "left").select("event_id", F.col("x.b_id").alias("b_id"), F.col("x.stage").alias("stage"), F.coalesce(F.col("x.rivals") > 1, F.lit(False)).alias("conflict"))


@query(f"""WITH {S.TICKS}, k AS (SELECT symbol, ts::DATE AS request, count(*) FILTER (event_type = 'signup') AS claims, count(*) FILTER (event_type = 'error') AS usages, min(ts) FILTER (event_type = 'signup') AS claimed, min(ts) FILTER (event_type = 'error') AS used FROM ticks GROUP BY ALL)
SELECT symbol, request, claims::BIGINT AS claims, usages::BIGINT AS usages, claims = 1 AND usages = 1 AND claimed < used AND claimed >= TIMESTAMP '2024-01-03' AS verified,
CASE WHEN claims <> 1 THEN 'claims' WHEN usages <> 1 THEN 'usages' WHEN claimed >= used THEN 'order' WHEN claimed < TIMESTAMP '2024-01-03' THEN 'anchor' END AS reason FROM k WHERE claims + usages > 0""")
def verified_requests(spark, d):
    """Requests with exactly one claim and one usage, the claim first and after the anchor."""
    of = lambda k, x: F.when(F.col("event_type") == k, x)
    k = V.ticks(spark, d).groupBy("symbol", F.to_date("ts").alias("request")).agg(F.count(of("signup", 1)).alias("claims"), F.count(of("error", 1)).alias("usages"), F.min(of("signup", F.col("ts"))).alias("claimed"), F.min(of("error", F.col("ts"))).alias("used"))
    reason = "CASE WHEN claims <> 1 THEN 'claims' WHEN usages <> 1 THEN 'usages' WHEN claimed >= used THEN 'order' WHEN claimed < timestamp_ntz'2024-01-03' THEN 'anchor' END"
    return k.filter("claims + usages > 0").withColumn("reason", F.expr(reason)).select("symbol", "request", "claims", "usages", F.expr("claims = 1 AND usages = 1 AND claimed < used AND claimed >= timestamp_ntz'2024-01-03'").alias("verified"), "reason")


@query(f"""WITH {S.TICKS}, k AS (SELECT symbol, event_id, ts, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS look FROM ticks)
SELECT symbol, coalesce(look, 0)::BIGINT AS look, count(*) FILTER (event_type IN ('error', 'signup'))::BIGINT AS news, max(ts) AS at_time, max(event_id) FILTER (event_type = 'purchase') AS told_at, bool_or(event_type = 'purchase') AS told FROM k GROUP BY ALL""")
def since_last_look(spark, d):
    """What each look has to be told: the events since the look before; the last group waits for its look."""
    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(W.unboundedPreceding, -1)
    k = V.ticks(spark, d).withColumn("look", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("int")).over(w), F.lit(0)).cast("bigint"))
    told = F.col("event_type") == "purchase"
    return k.groupBy("symbol", "look").agg(F.count(F.when(F.col("event_type").isin("error", "signup"), 1)).alias("news"), F.max("ts").alias("at_time"), F.max(F.when(told, F.col("event_id"))).alias("told_at"), F.bool_or(told).alias("told"))


@query("""SELECT l_orderkey, arg_min(l_partkey, (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey)) AS picked, min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END)::INT AS priority, count(*)::BIGINT AS docs FROM lineitem GROUP BY l_orderkey""")
def pick_by_priority(spark, d):
    """Of several documents the one first in a list of preferences; an aggregate, not a sort."""
    first = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    li = V.table(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct(first, "l_linenumber", "l_partkey")).alias("picked"), F.min(first).alias("priority"), F.count(F.lit(1)).alias("docs"))
