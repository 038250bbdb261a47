"""Rules that read text: headlines, references, reports, tables, JSON and pages."""

from pyspark.sql import functions as F

from ..functions import text as TX
from ..sources import views as V
from . import sql as S
from .catalog import query
from .stages import rules

# --- headlines -----------------------------------------------------------------------------

#: The classes of a headline and their patterns.
CLASSES = {
    "earnings": r"\b(earnings|EPS|results?|Q[1-4]|[1-4]Q|quarter(ly)?|beats?|beat-and-raise|miss(es|ed)?|revenue|sales|comps?|same[- ]store|top[- ]and[- ]bottom[- ]line|FY ?\d{2,4}|profit|loss)\b",
    "guidance": r"\b(guidance|guides?|guided|outlook|forecasts?|raises? .{0,20}(view|target|fy|full[- ]year)|lowers? .{0,20}(view|fy|full[- ]year)|cuts? .{0,20}(view|fy|full[- ]year))\b",
    "offering": r"\b(offering|secondary|convertible|dilut\w*|share sale|stock sale|prices? .{0,30}shares)\b",
    "mna": r"\b(acquir\w*|acquisition|merger|merge|buyout|takeover|tender offer|spin[- ]?off|divest\w*|to buy|deal to|bid for|activist)\b",
    "fda": r"\b(FDA|approval|approved|clinical|trials?|phase [123I]+|PDUFA|CRL)\b",
    "lawsuit": r"\b(lawsuit|sues?|sued|settle\w*|probe|investigation|antitrust|DOJ|FTC|verdict|court|subpoena)\b",
    "mgmt": r"\b(CEO|CFO|chief executive|steps? down|resign\w*|appoint\w*|succession|successor|retire\w*)\b",
}
_TEXTS = ["!Alpha Q3 earnings top views, raises FY view", "Beta upgraded to Buy at Bank", "Gamma downgraded on outlook", "Delta initiated with target 30", "Epsilon prices 5M shares in secondary", "Zeta to buy Eta; CEO resigns", "FDA approval for Theta phase 3 drug", "!!Iota sued in antitrust probe", "Kappa reiterated, target raised", "Lambda same-store sales miss", "Mu resumed at Neutral", "Nu coverage reinstated", "Xi opens a plant", "Omicron spin-off approved by court"]
_TEXT = "CASE " + " ".join(f"WHEN k = {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + " END"
_SET = "concat_ws(',', " + ", ".join(f"CASE WHEN rlike(text, '(?i){p}') THEN '{c}' END" for c, p in CLASSES.items()) + ")"

rules(
    "headline_kinds",
    "The classes of a headline: the analyst wire's single action, or the set of seven others; the mapped action, the tone tag, the cleaned text and the key.",
    "orders", ["o_orderkey"],
    {"k": f"(o_orderkey % {len(_TEXTS)})::INT", "provider": "CASE WHEN o_custkey % 2 = 0 THEN 'BRFUPDN' ELSE 'DJ-N' END", "meta": "CASE WHEN o_custkey % 3 = 0 THEN concat('A:1:K:-0.', (o_orderkey % 10)::VARCHAR(2)) WHEN o_custkey % 3 = 1 THEN 'L:en' END"},
    {"text": _TEXT},
    {"word": r"lower(regexp_extract(text, '(?i)\b(upgraded|downgraded|initiated|resumed|reiterated|assumed|reinstated)\b', 1))", "up": r"rlike(text, '(?i)\bupgraded\b')", "down": r"rlike(text, '(?i)\bdowngraded\b')", "init": r"rlike(text, '(?i)\binitiated\b')", "others": _SET, "tag": "regexp_extract(coalesce(meta, ''), 'K:(-?[0-9.]+)', 1)"},
    {"classes": "CASE WHEN provider = 'BRFUPDN' THEN CASE WHEN up THEN 'up' WHEN down THEN 'down' WHEN init THEN 'init' ELSE 'anl_other' END ELSE others END", "action": "CASE WHEN provider = 'BRFUPDN' THEN CASE WHEN word = 'upgraded' THEN 'up' WHEN word = 'downgraded' THEN 'down' WHEN word IN ('initiated', 'resumed', 'reinstated', 'assumed') THEN 'init' ELSE 'other' END END", "clean": "trim(regexp_replace(text, '^!+', ''))", "kstat": "nullif(tag, '')::DOUBLE", "news_key": "concat_ws('|', k::VARCHAR(4), provider, o_orderkey::VARCHAR(20))"},
    plain=("provider", "classes", "action", "clean", "kstat", "news_key"),
)

#: Labels of report item codes.
ITEMS = {"1.01": "material agreement", "2.02": "results", "5.02": "officer/director change", "7.01": "Reg FD release", "8.01": "other event", "9.01": "exhibits"}


def _labels(x: str) -> str:
    for code, label in ITEMS.items():
        x = f"replace({x}, '{code}', '{label}')"
    return f"replace({x}, ',', ', ')"


rules(
    "filing_texts",
    "A filing's item codes as labels, groups by the codes it has, whether its text is wanted, its header-free body, an inferred earnings title, and the reference of a book.",
    "orders", ["o_orderkey"],
    {"items": "CASE WHEN o_orderkey % 5 = 0 THEN '2.02,9.01' WHEN o_orderkey % 5 = 1 THEN '9.01' WHEN o_orderkey % 5 = 2 THEN '5.02,7.01' WHEN o_orderkey % 5 = 3 THEN '8.01' ELSE '1.01,2.02,9.01' END", "body": "concat('<TYPE>8-K', chr(10), '<SEQUENCE>1', chr(10), CASE WHEN o_custkey % 3 = 0 THEN 'Acme Reports Third Quarter Results' WHEN o_custkey % 3 = 1 THEN 'Acme to Report Third Quarter Results on Monday' ELSE 'Acme opens a plant' END)", "ref": "CASE WHEN o_orderkey % 4 = 0 THEN concat('tt-alpha-one-', o_orderkey::VARCHAR(20)) WHEN o_orderkey % 4 = 1 THEN concat('x-beta-', o_orderkey::VARCHAR(20)) ELSE 'tt-solo' END"},
    {"labels": _labels("items"), "earn": "rlike(items, '2[.]02')", "people": "rlike(items, '5[.]02')", "wanted": "rlike(items, '(2[.]02|7[.]01|8[.]01)') AND items <> '9.01'", "only_exhibits": "items = '9.01'", "text": "regexp_replace(body, '^(<[A-Z]+>[^\n]*\n)+', '')", "sleeve": "nullif(regexp_extract(ref, '^tt-(.+)-[^-]+$', 1), '')"},
    {"inferred": r"rlike(text, '(?i)\breports?\b.*\bresults\b') AND NOT rlike(text, '(?i)\bto report\b')", "headline": "concat('8-K: ', labels)"},
    plain=("labels", "earn", "people", "wanted", "only_exhibits", "text", "sleeve", "inferred", "headline"),
)

rules(
    "forecast_texts",
    "The probability on a response's last line that is not empty, as a share or in percent, or none; the exit levels that notes promise; and the change phrase of a figure.",
    "events", ["event_id"],
    {"tail": "CASE WHEN event_id % 5 = 0 THEN '0.37' WHEN event_id % 5 = 1 THEN '62%' WHEN event_id % 5 = 2 THEN 'about 0.4' WHEN event_id % 5 = 3 THEN '140%' ELSE '.8' END", "notes": "CASE WHEN event_id % 3 = 0 THEN 'stop at $41.50, exit below 39' WHEN event_id % 3 = 1 THEN 'target $30,000 profit; stop at 12' ELSE 'no plan' END", "x": "value - 80"},
    {"response": "concat('0.99 first', chr(10), tail, chr(10), '  ', chr(10))", "digits": "floor(abs(x) * 10 + 0.5) / 10"},
    {"final": "trim(regexp_extract(response, '([^\n]*[^ \n][^\n]*)[ \n]*$', 1))", "n_levels": r"rxcount(notes, '(?i)(stop at|exit below) \$?[0-9.]+')", "phrase": "CASE WHEN digits = 0 THEN 'unchanged' WHEN x > 0 THEN concat('rose ', digits::VARCHAR(20)) ELSE concat('fell ', digits::VARCHAR(20)) END"},
    {"number": "nullif(regexp_extract(final, '^([0-9]*[.]?[0-9]+)%?$', 1), '')::DOUBLE"},
    {"p": "CASE WHEN rlike(final, '%$') THEN number / 100 ELSE number END"},
    {"given": "CASE WHEN p BETWEEN 0 AND 1 THEN p END"},
    plain=("final", "n_levels", "phrase"), rounded=("given",),
)

# --- JSON and pages ------------------------------------------------------------------------



@query("""WITH c AS (SELECT conv_id, list({'role': role, 'text': text, 'turn': turn} ORDER BY turn, role, text) AS turns FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id), j AS (SELECT conv_id, to_json({'conv_id': conv_id, 'turns': turns})::VARCHAR AS canonical FROM c)
SELECT conv_id, octet_length(encode(canonical))::BIGINT AS bytes, sha256(canonical) AS digest FROM j""")
def json_canonical(spark, d):
    """Whole conversations as JSON in canonical form (keys sorted at every depth, no spaces),
    and that form's digest, from text whose keys are in another order and spaced."""
    t = V.table(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct()
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["turn"].alias("turn"), x["text"].alias("text"), x["role"].alias("role")))
    raw = t.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.to_json(F.struct("turns", "conv_id"), {"pretty": "true", "ignoreNullFields": "false"}).alias("raw"))
    own = raw.withColumn("canonical", TX.canonical_json("raw"))
    return own.select("conv_id", F.octet_length("canonical").cast("long").alias("bytes"), F.sha2("canonical", 256).alias("digest"))


rules(
    "page_index",
    "Title, first heading and counts of links, rows and paragraphs of a page, and its host.",
    "pages", ["page_id"],
    {"raw": "coalesce(html, '')"},
    {"title": "regexp_extract(raw, '(?is)<title[^>]*>([^<]*)</title>', 1)", "heading": "regexp_extract(raw, '(?is)<h1[^>]*>([^<]*)</h1>', 1)", "links": "rxcount(raw, '(?i)<a [^>]*href=')", "rows": "rxcount(raw, '(?i)<tr')", "paragraphs": "rxcount(raw, '(?i)<p[ >]')", "host": "regexp_extract(coalesce(url, ''), '^[a-z]+://([^/]+)', 1)"},
    plain=("title", "heading", "links", "rows", "paragraphs", "host"),
)

# --- tables and traces ---------------------------------------------------------------------


@query(f"""WITH {S.BARS}, good AS (SELECT session FROM bars GROUP BY session HAVING day(session) % 7 <> 0)
SELECT session, symbol, c AS last, o AS open, h AS high, l AS low, v AS volume, NULL::VARCHAR AS error FROM bars JOIN good USING (session)
UNION ALL SELECT session, -1 AS symbol, NULL, NULL, NULL, NULL, NULL, 'no data' AS error FROM good""")
def quote_tables(spark, d):
    """Quote tables written as text and parsed back: a line a symbol, lines of errors, and
    no rows at all of a table with a malformed line."""
    b = V.bars_daily(spark, d)
    line = F.concat_ws(" ", "symbol", "c", "o", "h", "l", "v")
    odd = F.when(F.dayofmonth("session") % 7 == 0, F.lit("\nbroken line")).otherwise("")
    texts = b.groupBy("session").agg(F.concat(F.lit("symbol last open high low volume\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n-1 error: no data"), F.first(odd)).alias("text"))
    rows = F.slice(F.split("text", "\n"), 2, 1 << 30)
    ok = F.forall(rows, lambda x: x.contains(" error: ") | (F.size(F.split(x, " ")) == 6))
    x = texts.filter(ok & F.startswith("text", F.lit("symbol last"))).select("session", F.explode(rows).alias("x"))
    x = x.select("session", F.split("x", " error: ").alias("e"), F.split("x", " ").alias("f"))
    failed = F.size("e") == 2
    cell = lambda k, kind: F.when(~failed, F.col("f")[k].cast(kind))
    return x.select("session", F.col("f")[0].cast("long").alias("symbol"), cell(1, "double").alias("last"), cell(2, "double").alias("open"), cell(3, "double").alias("high"), cell(4, "double").alias("low"), cell(5, "long").alias("volume"), F.when(failed, F.get("e", F.lit(1))).alias("error"))


@query("""WITH c AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations), a AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS back FROM c WHERE role = 'assistant')
SELECT q.conv_id, CASE WHEN length(trim(regexp_replace(l.text, '[*#]+', '', 'g'))) >= 40 OR p.text IS NULL THEN l.turn ELSE p.turn END AS decided_at, length(trim(regexp_replace(CASE WHEN length(trim(regexp_replace(l.text, '[*#]+', '', 'g'))) >= 40 OR p.text IS NULL THEN l.text ELSE p.text END, '[*#]+', '', 'g')))::INT AS size,
q.users::BIGINT AS users, q.words::BIGINT AS words FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS users, sum(len(string_split(text, ' '))) AS words FROM c GROUP BY conv_id) q
LEFT JOIN a l ON l.conv_id = q.conv_id AND l.back = 1 LEFT JOIN a p ON p.conv_id = q.conv_id AND p.back = 2""")
def decision_texts(spark, d):
    """The text that decides a conversation: the last answer without its markers, or the one
    before where that is short."""
    c = V.table(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct()
    said = F.trim(F.regexp_replace("text", "[*#]+", ""))
    answers = F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text", F.char_length(said).alias("n")))), asc=False)
    g = c.groupBy("conv_id").agg(answers.alias("a"), F.count(F.when(F.col("role") == "user", 1)).alias("users"), F.sum(F.size(F.split("text", " ", -1))).alias("words"))
    last, before = F.get("a", F.lit(0)), F.get("a", F.lit(1))
    use = F.when((last["n"] >= 40) | before.isNull(), last).otherwise(before)
    return g.select("conv_id", use["turn"].alias("decided_at"), use["n"].alias("size"), "users", "words")


@query("""WITH c AS (SELECT DISTINCT conv_id, turn, role, lower(text) AS text FROM conversations), w AS (SELECT conv_id, role, unnest(string_split(text, ' ')) AS w FROM c),
k AS (SELECT conv_id, role, w FROM w WHERE length(w) >= 6 GROUP BY ALL), u AS (SELECT conv_id, w FROM k WHERE role = 'user'), a AS (SELECT conv_id, w FROM k WHERE role = 'assistant')
SELECT q.conv_id, count(DISTINCT u.w)::BIGINT AS asked, count(DISTINCT a.w)::BIGINT AS said, count(DISTINCT CASE WHEN a.w IS NOT NULL AND a.w IN (SELECT x.w FROM u x WHERE x.conv_id = q.conv_id) THEN a.w END)::BIGINT AS grounded
FROM (SELECT DISTINCT conv_id FROM c) q LEFT JOIN u ON u.conv_id = q.conv_id LEFT JOIN a ON a.conv_id = q.conv_id GROUP BY q.conv_id""")
def grounded_terms(spark, d):
    """Per conversation the distinct long words asked, those answered, and those of the answer that were asked."""
    c = V.table(spark, d, "conversations").select("conv_id", "turn", "role", "text").distinct()
    words = F.filter(F.array_distinct(F.split(F.lower("text"), " ", -1)), lambda w: F.char_length(w) >= 6)
    c = c.select("conv_id", "role", words.alias("w"))
    of = lambda role: F.array_distinct(F.flatten(F.collect_list(F.when(F.col("role") == role, F.col("w")))))
    g = c.groupBy("conv_id").agg(of("user").alias("u"), of("assistant").alias("a"))
    n = lambda x: F.size(x).cast("long")
    return g.select("conv_id", n("u").alias("asked"), n("a").alias("said"), n(F.array_intersect("u", "a")).alias("grounded"))
