"""Sequential admission of an account's orders, as a fold over its session's queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: dollars of an order, a symbol, the book; the cash to keep; orders and names
MAX_ORDER, MAX_SYMBOL, MAX_GROSS, MIN_CASH = 2500.0, 5000.0, 9000.0, 500.0
MAX_ORDERS, MAX_POSITIONS = 4, 4


def _fee(quantity: Column) -> Column:
    return F.greatest(F.lit(1.0), 0.005 * quantity)


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + value(x))


def _code(o: Column, queue: Column, cash: Column, book: Column) -> Column:
    """The first rule against an order, given the orders queued before it."""
    buys = F.filter(queue, lambda x: x["side"] == "BUY")
    notional = o["quantity"] * o["limit"]
    held = F.filter(book, lambda h: h["symbol"] == o["symbol"])
    selling = F.filter(queue, lambda x: (x["side"] == "SELL") & (x["symbol"] == o["symbol"]))
    short = o["quantity"] + _sum(selling, lambda x: x["quantity"]) > _sum(held, lambda h: h["quantity"])
    worth = lambda x: x["quantity"] * x["limit"]
    reserved = _sum(buys, lambda x: worth(x) + _fee(x["quantity"]))
    in_symbol = _sum(held, lambda h: h["quantity"] * h["close"]) + _sum(F.filter(buys, lambda x: x["symbol"] == o["symbol"]), worth)
    gross = _sum(book, lambda h: h["quantity"] * h["close"]) + _sum(buys, worth)
    names = F.array_union(F.transform(book, lambda h: h["symbol"]), F.transform(buys, lambda x: x["symbol"]))
    buy = (
        F.when(notional > MAX_ORDER, "MAX_ORDER_NOTIONAL").when(cash - reserved - notional - _fee(o["quantity"]) < MIN_CASH, "CASH_OR_MINIMUM_CASH").when(in_symbol + notional > MAX_SYMBOL, "MAX_SYMBOL_NOTIONAL")
        .when(gross + notional > MAX_GROSS, "MAX_GROSS_NOTIONAL").when(~F.array_contains(names, o["symbol"]) & (F.size(names) >= MAX_POSITIONS), "MAX_POSITIONS")
    )
    return F.when(F.size(queue) >= MAX_ORDERS, "MAX_ORDER_RATE").when(o["side"] == "SELL", F.when(short, "INSUFFICIENT_UNRESERVED_OWNED_INVENTORY")).otherwise(buy)


def admit(orders: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, place, code): the rule that refuses each order, null where it is queued.

    ``orders`` (account, place, symbol, side, quantity, limit) are one session's, taken by
    ``place``; ``accounts`` (account, cash, book) hold the cash and an array of (symbol,
    quantity, close). A queue has at most MAX_ORDERS orders, so a step costs the same however
    many came before.
    """
    item = F.struct("place", "symbol", "side", "quantity", "limit")
    asked = orders.groupBy("account").agg(F.sort_array(F.collect_list(item)).alias("asked")).join(accounts, "account")
    kind = "array<struct<symbol:bigint,side:string,quantity:bigint,limit:double>>"
    start = F.struct(F.array().cast(kind).alias("queue"), F.array().cast("array<struct<place:int,code:string>>").alias("codes"))

    def step(acc: Column, o: Column) -> Column:
        code = _code(o, acc["queue"], F.col("cash"), F.col("book"))
        own = F.array(F.struct(o["symbol"].cast("long").alias("symbol"), o["side"].alias("side"), o["quantity"].cast("long").alias("quantity"), o["limit"].cast("double").alias("limit")))
        joined = F.when(code.isNull(), F.concat(acc["queue"], own)).otherwise(acc["queue"])
        return F.struct(joined.alias("queue"), F.concat(acc["codes"], F.array(F.struct(o["place"].cast("int").alias("place"), code.alias("code")))).alias("codes"))

    done = asked.select("account", F.explode(F.aggregate("asked", start, step)["codes"]).alias("c"))
    return done.select("account", "c.place", "c.code")


# fixed value: gross exposure allowed, in net asset values
LEVERAGE = 2.0


def walk(orders: DataFrame, accounts: DataFrame, leverage: float = LEVERAGE) -> DataFrame:
    """What each order of a decision would do, taken by ``place``: (account, place, q0, q1, p,
    adds, margin, share, share0, notional).

    q0 and q1 are the position before and after, p the price it is judged at (its limit, stop,
    the quote, else the position's mark). An order that adds to a position and takes gross
    exposure over ``leverage`` net asset values is refused on margin and leaves the book as it
    was. ``orders`` have account, place, symbol, buy, quantity, limit, stop, quote; ``accounts``
    account, cash, value and book, an array of (symbol, quantity, mark). A symbol first bought
    here is marked at the price of that order.
    """
    item = F.struct("place", "symbol", "buy", "quantity", "limit", "stop", "quote")
    asked = orders.groupBy("account").agg(F.sort_array(F.collect_list(item)).alias("asked")).join(accounts, "account")
    nav = F.aggregate("book", F.col("cash").cast("double"), lambda s, h: s + h["quantity"] * h["mark"])
    asked = asked.withColumn("nav", nav)
    held = "array<struct<symbol:bigint,quantity:bigint,mark:double>>"
    done = "array<struct<place:int,q0:bigint,q1:bigint,p:double,adds:boolean,margin:boolean>>"
    start = F.struct(F.transform("book", lambda h: F.struct(h["symbol"].cast("long").alias("symbol"), h["quantity"].cast("long").alias("quantity"), h["mark"].cast("double").alias("mark"))).cast(held).alias("book"), F.array().cast(done).alias("done"))

    def step(acc: Column, o: Column) -> Column:
        own = F.get(F.filter(acc["book"], lambda h: h["symbol"] == o["symbol"]), F.lit(0))
        others = F.filter(acc["book"], lambda h: h["symbol"] != o["symbol"])
        q0 = F.coalesce(own["quantity"], F.lit(0).cast("long"))
        q1 = q0 + F.when(o["buy"], o["quantity"]).otherwise(-o["quantity"])
        some = lambda x: F.when(x != 0, x)  # noqa: E731  a zero price is none
        p = F.coalesce(some(o["limit"]), some(o["stop"]), some(o["quote"]), some(own["mark"]))
        adds = F.abs(q1) > F.abs(q0)
        gross = F.aggregate(others, F.lit(0.0), lambda s, h: s + F.abs(h["quantity"]) * F.coalesce(h["mark"], p)) + F.abs(q1) * p
        margin = p.isNotNull() & adds & (gross > leverage * F.greatest(F.col("nav"), F.lit(0.0)))
        now = F.array(F.struct(o["symbol"].cast("long").alias("symbol"), q1.cast("long").alias("quantity"), F.coalesce(own["mark"], p).cast("double").alias("mark")))
        book = F.when(margin, acc["book"]).otherwise(F.concat(others, now))
        row = F.struct(o["place"].cast("int").alias("place"), q0.cast("long").alias("q0"), q1.cast("long").alias("q1"), p.cast("double").alias("p"), adds.alias("adds"), F.coalesce(margin, F.lit(False)).alias("margin"))
        return F.struct(book.alias("book"), F.concat(acc["done"], F.array(row)).alias("done"))

    each = asked.select("account", "value", F.explode(F.aggregate("asked", start, step)["done"]).alias("o"))
    share = lambda q: F.abs(q) * F.col("o.p") / F.col("value")
    return each.select("account", "o.*", share(F.col("o.q1")).alias("share"), share(F.col("o.q0")).alias("share0"), (F.abs(F.col("o.q1") - F.col("o.q0")) * F.col("o.p")).alias("notional"))
