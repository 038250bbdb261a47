"""Readers of the domain's file layouts and the few ways it writes.

Each reader declares its schema, so a scan parses only the fields a plan uses and a file of
another shape shows as nulls or in ``_corrupt_record`` rather than as a guessed type. One
file a symbol is the usual layout; a folder or glob reads them all at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BAR = "date string, open double, high double, low double, close double, volume double"
HISTORY = "session string, open double, high double, low double, close double, volume double"


def _clean(c: Column) -> Column:
    """NaN and non-positive figures are missing."""
    return F.when(~F.isnan(c) & (c > 0), c)


def daily_bars(spark: SparkSession, path: str, what: str = "TRADES") -> DataFrame:
    """(symbol, session, o, h, l, c, v) from {symbol, what, fetched, bars}; a date that comes
    twice keeps its later bar, and today's unfinished bar (dated as fetched) goes."""
    rows = spark.read.schema(f"symbol string, what string, fetched string, bars array<struct<{BAR.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True)
    b = rows.filter(F.coalesce("what", F.lit("TRADES")) == what).select("symbol", "fetched", F.posexplode("bars").alias("k", "b"))
    b = b.withColumn("session", F.try_to_date("b.date", "yyyyMMdd")).filter(F.col("session").isNotNull() & ~F.col("session").eqNullSafe(F.try_to_date(F.substring("fetched", 1, 10))))
    last = F.max_by(F.struct("b.open", "b.high", "b.low", "b.close", "b.volume"), "k").alias("x")
    return b.groupBy("symbol", "session").agg(last).select("symbol", "session", *[_clean(F.col(f"x.{c}")).alias(c[0]) for c in ("open", "high", "low", "close", "volume")])


def implied_vol(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, session, iv): the close of a volatility file, none outside (0, 5]."""
    b = daily_bars(spark, path, "OPTION_IMPLIED_VOLATILITY")
    return b.select("symbol", "session", F.when(F.col("c") <= 5, F.col("c")).alias("iv")).filter("iv is not null")


def bid_ask(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, session, bid, ask) of a quote file, whose open is the bid and close the ask."""
    return daily_bars(spark, path, "BID_ASK").select("symbol", "session", F.col("o").alias("bid"), F.col("c").alias("ask")).filter("ask >= bid")


def intraday_bars(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, session, slot, o, h, l, c, v) from half-hour bars dated 'YYYYMMDD HH:MM:SS
    zone'; slot counts half hours from 09:30 and is kept from 0 to 12."""
    rows = spark.read.schema(f"symbol string, bars array<struct<{BAR.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True).select("symbol", F.explode("bars").alias("b"))
    minute = F.substring("b.date", 10, 2).try_cast("int") * 60 + F.substring("b.date", 13, 2).try_cast("int")
    b = rows.select("symbol", F.try_to_date(F.substring("b.date", 1, 8), "yyyyMMdd").alias("session"), ((minute - 570) / 30).alias("at"), "b")
    b = b.filter("at between 0 and 12 and at = floor(at)")
    return b.select("symbol", "session", F.col("at").cast("int").alias("slot"), *[_clean(F.col(f"b.{c}")).alias(c[0]) for c in ("open", "high", "low", "close", "volume")])


def industries(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, industry, category, subcategory, stock_type, long_name) from one object by symbol."""
    kind = "map<string,struct<industry:string,category:string,subcategory:string,stock_type:string,long_name:string>>"
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    return text.select(F.explode("m").alias("symbol", "x")).select("symbol", "x.*")


def universe(details: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stocks and the funds of a details table."""
    fund = F.coalesce(F.upper("stock_type").isin("ETF", "ETN", "FUND"), F.lit(False))
    return details.filter(~fund).select("symbol"), details.filter(fund).select("symbol")


def filings(spark: SparkSession, path: str) -> DataFrame:
    """Filings with a symbol a row, item codes as an array and times parsed; rows without an
    acceptance time go."""
    f = spark.read.option("header", True).csv(path)
    t = F.coalesce(F.try_to_timestamp("accepted_utc", F.lit("yyyy-MM-dd'T'HH:mm:ssX")), F.try_to_timestamp("accepted_utc", F.lit("yyyy-MM-dd HH:mm:ss")))
    rows = f.withColumns({"accepted": t, "codes": F.filter(F.split(F.coalesce("items", F.lit("")), ","), lambda x: x != "")}).filter("accepted is not null")
    return rows.select(F.explode(F.split("symbols", "\\|")).alias("symbol"), "accessionNumber", "form", "codes", F.try_to_date("filingDate").alias("filed"), "accepted", "session", F.try_to_date("first_session").alias("first_session"))


def headlines(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, ts, provider, article_id, headline, meta) from one file a symbol, the first of
    rows that share provider and article."""
    kind = "symbol string, headlines array<struct<time:string,provider:string,article_id:string,headline:string,meta:string>>"
    h = spark.read.schema(kind).json(path, multiLine=True).select("symbol", F.explode("headlines").alias("h"))
    rows = h.select("symbol", F.try_to_timestamp("h.time").alias("ts"), "h.provider", "h.article_id", F.regexp_replace("h.headline", "^!+", "").alias("headline"), "h.meta")
    return rows.groupBy("symbol", "provider", "article_id").agg(F.min(F.struct("ts", "headline", "meta")).alias("x")).select("symbol", "x.ts", "provider", "article_id", "x.headline", "x.meta")


def macro_calendar(spark: SparkSession, path: str, overrides: DataFrame | None = None) -> DataFrame:
    """Calendar events; rows of ``overrides`` (id, date, status) replace those of their id."""
    kind = "events array<struct<id:string,key:string,name:string,tier:int,date:string,time_et:string,datetime_et:string,status:string,reference_period:string,kind:string,first_release:map<string,double>>>"
    e = spark.read.schema(kind).json(path, multiLine=True).select(F.explode("events").alias("e")).select("e.*").withColumn("date", F.try_to_date("date"))
    if overrides is None:
        return e
    o = overrides.select("id", F.try_to_date("date").alias("new_date"), F.col("status").alias("new_status"))
    return e.join(F.broadcast(o), "id", "left").withColumns({"date": F.coalesce("new_date", "date"), "status": F.coalesce("new_status", "status")}).drop("new_date", "new_status")


def vintages(spark: SparkSession, path: str) -> DataFrame:
    """(obs_date, value, start, end) of a revised series; an open end is null."""
    v = spark.read.option("header", True).csv(path)
    day = lambda c: F.try_to_date(c)
    return v.select(day("obs_date").alias("obs_date"), F.expr("try_cast(value as double)").alias("value"), day("realtime_start").alias("start"), F.when(F.col("realtime_end") < "9999", day("realtime_end")).alias("end"))


def sleeves(spark: SparkSession, path: str) -> DataFrame:
    """(sleeve, start_cash, start, model, ml, label) from one object by name."""
    kind = "map<string,struct<start_cash:double,start:string,model:string,ml:string,label:string>>"
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("sleeve", "x"))
    return m.select("sleeve", "x.start_cash", F.try_to_date("x.start").alias("start"), "x.model", "x.ml", "x.label")


def json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An append-only log without the lines that don't parse; a half-written last line is
    such a line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    x = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("x"))
    return x.filter(F.col("x").isNotNull() & F.col("x._corrupt_record").isNull()).select("x.*").drop("_corrupt_record")


FILL = "exec_id string, time string, ref string, symbol string, side string, shares double, price double, commission double, sleeve string"
ORDER = "time string, sleeve string, ref string, symbol string, action string, quantity double, order_type string, limit double, aux double, tif string, cancel string, error string"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Fills, the last record of each execution; ``sleeve`` from the reference where absent."""
    f = json_log(spark, path, FILL).withColumn("_k", F.monotonically_increasing_id())
    last = f.groupBy("exec_id").agg(F.max_by(F.struct("time", "ref", "symbol", "side", "shares", "price", "commission", "sleeve"), "_k").alias("x")).select("exec_id", "x.*")
    return last.withColumn("sleeve", F.coalesce("sleeve", F.nullif(F.regexp_extract("ref", "^tt-(.+)-[^-]+$", 1), F.lit(""))))


def looks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Look files as three tables: looks (file, time, sleeve, value, cash, gross), their
    placed orders and their tool calls."""
    kind = "time string, sleeve string, model string, seconds double, state struct<value:double,cash:double,gross:double,net:double>, trace array<struct<step:int,tool:string,error:string,said:string>>, call struct<place:array<struct<symbol:string,action:string,quantity:double,type:string,limit:double,stop:double>>,cancel:array<string>,notes:string>"
    rows = spark.read.schema(kind).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_name"))
    own = rows.select("file", "time", "sleeve", "model", "seconds", "state.*", F.col("call.notes").alias("notes"), F.size(F.coalesce("call.cancel", F.array())).alias("cancels"))
    orders = rows.select("file", "sleeve", F.posexplode("call.place").alias("n", "o")).select("file", "sleeve", "n", "o.*")
    calls = rows.select("file", "sleeve", F.posexplode("trace").alias("n", "t")).select("file", "sleeve", "n", "t.*")
    return own, orders, calls


def histories(spark: SparkSession, path: str) -> DataFrame:
    """Normalized histories by symbol, with what makes a bar invalid: ``error`` names the
    first rule broken (order of dates, positive prices, high and low around the rest)."""
    kind = f"map<string,struct<symbol:string,currency:string,primary_exchange:string,bars:array<struct<{HISTORY.replace(' ', ':').replace(',:', ',')}>>>>"
    m = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("symbol", "x"))
    b = m.select("symbol", F.col("x.currency").alias("currency"), F.posexplode("x.bars").alias("k", "b")).select("symbol", "currency", "k", F.try_to_date("b.session").alias("session"), *[F.col(f"b.{c}").alias(c[0]) for c in ("open", "high", "low", "close", "volume")])
    before = F.lag("session").over(W.partitionBy("symbol").orderBy("k"))
    error = F.when(F.col("session").isNull() | (before >= F.col("session")), "order").when(~F.coalesce(F.least("o", "h", "l", "c") > 0, F.lit(False)), "price").when((F.col("h") < F.greatest("o", "c")) | (F.col("l") > F.least("o", "c")), "range")
    return b.withColumn("error", error)


# --- writing -------------------------------------------------------------------------------


def append(df: DataFrame, path: str) -> None:
    """Rows at the end of a JSON-lines log."""
    df.write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """A table that may never change: an error where there is one already."""
    df.write.mode("errorifexists").parquet(path)
