"""Text, JSON, traces and vectors."""

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.scalars import r6
from ..sources import views as V
from . import sql as S
from .catalog import query

_RULES = {"credential": "(?i)(password|token|secret) *[=:]", "contact": "[a-z0-9.]+@[a-z0-9.]+", "table": " \\| ", "shout": "[A-Z]{4,}!!", "number": "[0-9]{4,}"}


@query(f"""SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in _RULES.items())} ELSE 'plain' END AS class FROM documents""")
def headline_classes(spark, d):
    """First matching class of each text."""
    return V.table(spark, d, "documents").select("doc_id", TX.first_match(F.coalesce("text", F.lit("")), _RULES, "plain").alias("class"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g')) AS body FROM b""")
def html_text(spark, d):
    return V.table(spark, d, "pages").select("page_id", TX.plain(F.col("html")).alias("body"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings) SELECT a.vec_id, floor(coalesce(1 - max(list_dot_product(a.v, b.v)), 1) * 1e4 + 0.5) / 1e4 AS novelty, count(b.vec_id)::BIGINT AS seen
FROM e a LEFT JOIN e b ON a.label = b.label AND b.vec_id < a.vec_id AND b.vec_id >= a.vec_id - 200 GROUP BY a.vec_id""")
def novelty_cosine(spark, d):
    """One less the highest cosine with the 200 ids before it of the same label. The range is
    cut in blocks of 200, so a row meets two blocks and not its whole label."""
    e = V.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"), F.floor(F.col("vec_id") / 200).alias("g"))
    past = e.select("label", F.explode(F.array("g", F.col("g") + 1)).alias("g"), F.col("vec_id").alias("old"), F.col("v").alias("w"))
    dot = F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    met = e.join(past, ["label", "g"]).filter("old < vec_id and old >= vec_id - 200").groupBy("vec_id").agg(F.max(dot).alias("top"), F.count(F.lit(1)).alias("seen"))
    out = e.select("vec_id").join(met, "vec_id", "left")
    return out.select("vec_id", (F.floor(F.coalesce(1 - F.col("top"), F.lit(1.0)) * 1e4 + 0.5) / 1e4).alias("novelty"), F.coalesce("seen", F.lit(0)).alias("seen"))


@query("""SELECT conv_id, count(*)::BIGINT AS turns, count(*) FILTER (role = 'user')::BIGINT AS users, arg_min(role, turn) AS first_role, max(turn)::BIGINT AS last_turn,
sum(length(text))::BIGINT AS chars, string_agg(role, '>' ORDER BY turn) AS path FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id""")
def trace_explode(spark, d):
    """Traces as arrays of steps and back: shape, order and size of each."""
    step = F.struct("turn", "role", "text")
    t = V.table(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct().groupBy("conv_id").agg(F.sort_array(F.collect_list(step)).alias("s"))
    x = t.select("conv_id", F.posexplode("s").alias("k", "e"))
    return x.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count(F.when(F.col("e.role") == "user", 1)).alias("users"), F.min_by("e.role", "k").alias("first_role"), F.max("e.turn").alias("last_turn"),
        F.sum(F.char_length("e.text")).cast("long").alias("chars"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.col("e.role").alias("r")))), lambda z: z["r"]), ">").alias("path"),
    )


@query(f"""WITH {S.TICKS} SELECT json_extract_string(props, '$.k') AS k, count(*)::BIGINT AS n, {S.r6('avg(price)')} AS mean FROM ticks GROUP BY ALL""")
def json_props(spark, d):
    return V.ticks(spark, d).groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("mean"))


@query(f"""WITH {S.FILLS} SELECT sleeve, symbol, sum(CASE WHEN side = 'BOT' THEN shares ELSE -shares END)::BIGINT AS qty, sum(CASE WHEN side = 'BOT' THEN -cents ELSE cents END - coalesce(fee, 0))::BIGINT AS cash_cents,
count(*) FILTER (fee IS NULL)::BIGINT AS missing_fees FROM latest GROUP BY ALL""")
def stream_dedup_ledger(spark, d):
    """The ledger as a stream: late and repeated records, the latest of each execution kept
    in state, positions summed from it. Equal to ``positions_at`` without its date."""
    from ..streaming.ledger import run_positions

    return run_positions(spark, V.fills(spark, d))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*)::BIGINT AS n, max(value) AS top FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def stream_window_looks(spark, d):
    """Hourly counts by type from a stream with a watermark."""
    from ..streaming.ledger import run_windows

    return run_windows(spark, V.table(spark, d, "events"))


@query("""WITH w AS (SELECT event_type, value, date_trunc('day', ts) + INTERVAL 6 HOUR * (hour(ts) // 6 - k) AS start FROM events CROSS JOIN (SELECT unnest(range(0, 4)) AS k) WHERE ts IS NOT NULL)
SELECT start AS hour, event_type, count(*)::BIGINT AS n, max(value) AS top FROM w GROUP BY ALL""")
def stream_sliding_looks(spark, d):
    """The 24 hours before a decision as a stream: windows of a day that start every six hours."""
    from ..streaming.ledger import run_windows

    return run_windows(spark, V.table(spark, d, "events"), width="1 day", step="6 hours")
