"""Views of the given tables in the shapes the operators read, in Spark and as SQL text.

``filing`` comes from events, ``universe`` from customer, ``issuer`` from supplier, ``title`` from part,
``finance`` from orders and ``line`` from lineitem. The SQL texts are CTE bodies for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.functions import text as tx
from docketry.functions.actions import ActionVocabulary
from docketry.operators.classify import Category, Glossary, GlossaryEntry


def six(col) -> F.Column:
    """Number as text of at least six digits."""
    text = col.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0"))


def filing(t) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    mark = F.when(F.col("event_type") == "error", "[기재정정]").when(k % 10 == 0, "[첨부추가]").otherwise("")
    noun = F.when(F.col("event_type") == "error", "purchase").otherwise(F.col("event_type"))
    step = F.when(k % 3 == 0, "decision").when(k % 3 == 1, "progress report").otherwise("result")
    return t.events.select(
        six(F.col("user_id")).alias("code"),
        F.concat(F.date_format("ts", "yyyyMMdd"), six(F.col("event_id"))).alias("rcept_no"),
        F.concat(mark, noun, F.lit(" "), step).alias("title"),
        F.col("ts").cast("date").alias("received_on"),
        F.col("ts").alias("detected_at"),
        (F.col("event_type") == "error").alias("is_correction"),
        F.col("event_id").alias("seq"),
    )


FILING = """
filing AS (
  SELECT printf('%06d', user_id) AS code,
         strftime(ts, '%Y%m%d') || printf('%06d', event_id) AS rcept_no,
         (CASE WHEN event_type = 'error' THEN '[기재정정]'
               WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN '[첨부추가]' ELSE '' END)
         || (CASE WHEN event_type = 'error' THEN 'purchase' ELSE event_type END) || ' '
         || (CASE CAST(json_extract_string(props, '$.k') AS INT) % 3
               WHEN 0 THEN 'decision' WHEN 1 THEN 'progress report' ELSE 'result' END) AS title,
         CAST(ts AS DATE) AS received_on, ts AS detected_at, event_type = 'error' AS is_correction,
         event_id AS seq
  FROM events)"""


def universe(t) -> DataFrame:
    return t.customer.where(F.col("c_mktsegment") != "BUILDING").select(
        six(F.col("c_custkey")).alias("code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("sector")
    )


UNIVERSE = """
universe AS (SELECT printf('%06d', c_custkey) AS code, c_name AS name, c_mktsegment AS sector
             FROM customer WHERE c_mktsegment <> 'BUILDING')"""


def tracked_filing(t) -> DataFrame:
    return filing(t).join(universe(t).select("code"), "code", "left_semi")


TRACKED = FILING + "," + UNIVERSE + """,
tracked AS (SELECT * FROM filing WHERE code IN (SELECT code FROM universe))"""


CATEGORIES = (
    Category("purchase", "Purchase", ("purchase",), why="Money moved.", next="Read the amount."),
    Category("signup", "Sign-up", ("signup", "sign up"), why="A member joined.", next="Read the date."),
    Category("traffic", "Traffic", ("click", "view"), why="Someone looked.", next="Read the page."),
)
# Category of a filing title in SQL: each title holds exactly one of the words.
CATEGORY_SQL = """(CASE WHEN contains(title, 'purchase') THEN 'purchase' WHEN contains(title, 'signup') THEN 'signup'
  WHEN contains(title, 'click') OR contains(title, 'view') THEN 'traffic' ELSE 'other' END)"""


def part_title(t) -> DataFrame:
    form = F.col("p_partkey") % 4
    title = (
        F.when(form == 0, F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")))
        .when(form == 1, F.concat("p_type", F.lit(" or "), "p_name"))
        .when(form == 2, F.concat(F.lit("[정정] "), "p_name", F.lit(" report")))
        .otherwise(F.col("p_name"))
    )
    return t.part.select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), title.alias("title")
    )


PART_TITLE = """
part_title AS (
  SELECT p_partkey AS id, p_brand AS brand, p_size AS size,
         CASE p_partkey % 4 WHEN 0 THEN p_name || ' (' || p_type || ')' WHEN 1 THEN p_type || ' or ' || p_name
              WHEN 2 THEN '[정정] ' || p_name || ' report' ELSE p_name END AS title
  FROM part)"""

PART_CATEGORIES = (
    Category("promo", "Promotion", ("PROMO",), why="A campaign.", next="Read the term."),
    Category("size", "Size", ("small", "large", "SMALL", "LARGE"), why="A size.", next="Read the gauge."),
    Category("colour", "Colour", ("red", "blue"), why="A colour.", next="Read the code."),
    Category("tool", "Tool", ("widget", "gizmo", "bolt", "gear"), why="A tool.", next="Read the use."),
    Category("branded", "Branded", ("red widget", "blue gear"), why="A brand.", next="Read the mark."),
    Category("state", "State", ("old", "new", "hot", "cold", "report"), form=True, why="A state.", next="Read the age."),
)
PART_TERMS = [
    (i, c.key, c.form, w.replace(" ", "")) for i, c in enumerate(PART_CATEGORIES) for w in c.terms
]
PART_TERMS_SQL = (
    "term(ord, key, form, word) AS (VALUES "
    + ", ".join(f"({i}, '{k}', {str(f).lower()}, '{w}')" for i, k, f, w in PART_TERMS)
    + ")"
)
# Classification in SQL over distinct titles: hits by position, cover test, rank, "or" rule.
CLASSIFY_SQL = PART_TITLE + ",\n" + PART_TERMS_SQL + r""",
t AS (SELECT DISTINCT title, regexp_replace(regexp_replace(title, '\[[^\]]*\]', '', 'g'), '\s+', '', 'g') AS text FROM part_title),
hit AS (
  SELECT t.title, t.text, m.ord, m.key, m.form, CAST(p.i AS INT) AS b, CAST(p.i + length(m.word) AS INT) AS e
  FROM t JOIN term m ON contains(t.text, m.word), LATERAL (SELECT unnest(generate_series(1, length(t.text))) AS i) p
  WHERE substr(t.text, p.i, length(m.word)) = m.word),
kept AS (
  SELECT h.*, (length(substr(text, 1, b - 1)) - length(replace(substr(text, 1, b - 1), '(', '')))
            - (length(substr(text, 1, b)) - length(replace(substr(text, 1, b), ')', ''))) AS depth
  FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.title = h.title AND o.b <= h.b AND h.e <= o.e AND o.e - o.b > h.e - h.b)),
best AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY title, key ORDER BY form, depth, e DESC, e - b DESC, ord) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY form, depth, e DESC, e - b DESC, ord) AS rn FROM best),
two AS (
  SELECT a.title, a.text, a.form = c.form AND a.depth = c.depth AS lvl,
         a.form = c.form AND a.depth = c.depth AND a.e = c.e AND a.e - a.b = c.e - c.b AS same,
         c.b < a.b AS swap, CASE WHEN c.b < a.b THEN c.e ELSE a.e END AS gf, CASE WHEN c.b < a.b THEN a.b ELSE c.b END AS gt
  FROM ranked a JOIN ranked c ON a.title = c.title AND a.rn = 1 AND c.rn = 2),
rule AS (SELECT title, swap, same, lvl AND gt > gf AND contains(substr(text, gf, gt - gf), 'or') AS either FROM two),
final AS (
  SELECT r.title, r.key, CASE WHEN coalesce(u.either AND u.swap, false) AND r.rn <= 2 THEN 3 - r.rn ELSE r.rn END AS rn,
         coalesce(u.same OR u.either, false) AS tie
  FROM ranked r LEFT JOIN rule u ON r.title = u.title),
cls AS (
  SELECT t.title, coalesce(max(key) FILTER (rn = 1), 'other') AS category,
         coalesce(string_agg(key, ',' ORDER BY rn) FILTER (rn > 1), '') AS tags, coalesce(bool_or(tie), false) AS tie
  FROM t LEFT JOIN final f ON t.title = f.title GROUP BY t.title)"""

GLOSSARY = Glossary(
    entries=(
        GlossaryEntry("widget", "Widget", "a small device", ("widget", "red widget"), "About a widget.", "It moves."),
        GlossaryEntry("rod", "Rod", "a long bar", ("rod", "hot rod"), "About a rod.", "It holds."),
        GlossaryEntry("gear", "Gear", "a toothed wheel", ("gear",), "About a gear.", "It turns."),
        GlossaryEntry("old-thing", "Old thing", "something old", ("old", "cold"), "About age.", "It wears."),
        GlossaryEntry("other-general", "Other", "anything else", (), "No special kind.", "Read the source."),
    ),
    suffix_notes=(("PROMO", "limited time"), ("report", "a report")),
    correction_note="corrected",
)
GLOSSARY_SQL = """pat(ord, key, word) AS (VALUES (0,'widget','widget'),(1,'widget','redwidget'),(2,'rod','rod'),(3,'rod','hotrod'),
  (4,'gear','gear'),(5,'old-thing','old'),(6,'old-thing','cold')),
gloss(key, name, plain, what, why) AS (VALUES ('widget','Widget','a small device','About a widget.','It moves.'),
  ('rod','Rod','a long bar','About a rod.','It holds.'),('gear','Gear','a toothed wheel','About a gear.','It turns.'),
  ('old-thing','Old thing','something old','About age.','It wears.'),
  ('other-general','Other','anything else','No special kind.','Read the source.')),
bare AS (SELECT DISTINCT title, regexp_replace(regexp_replace(title, '\\[[^\\]]*\\]', '', 'g'), '\\s+', '', 'g') AS text FROM part_title),
gkey AS (SELECT b.title, arg_min(p.key, -length(p.word) * 100 + p.ord) AS entry_key
         FROM bare b JOIN pat p ON contains(b.text, p.word) GROUP BY b.title)"""

ACTIONS = ActionVocabulary(
    subsidiary=("small",),
    stages=(
        ("WITHDRAWN", ("anvil",)),
        ("CORRECTION", ("[정정]",)),
        ("COMPLETION", ("LARGE",)),
        ("RESULT", ("gizmo", "ring")),
        ("NOTICE", ("ECONOMY",)),
    ),
    families=("red", "bolt", "gear", "blue", "old"),
    effects={
        "red": ("PRICE", "SHARES"),
        "bolt": ("SHARES", "LISTING"),
        "gear": ("SHARES",),
        "blue": ("TRADABLE",),
        "old": ("LISTING", "TRADABLE"),
    },
    halt=("hot", "plate"),
)
ACTIONS_SQL = PART_TITLE + """,
fam(ord, family) AS (VALUES (0,'red'),(1,'bolt'),(2,'gear'),(3,'blue'),(4,'old')),
eff(family, effect) AS (VALUES ('red','PRICE'),('red','SHARES'),('bolt','SHARES'),('bolt','LISTING'),('gear','SHARES'),
  ('blue','TRADABLE'),('old','LISTING'),('old','TRADABLE')),
fact0 AS (
  SELECT p.id, p.brand, p.title,
    CASE WHEN contains(title,'small') THEN 'SUBSIDIARY' ELSE 'SELF' END AS subject,
    CASE WHEN contains(title,'anvil') THEN 'WITHDRAWN' WHEN contains(title,'[정정]') THEN 'CORRECTION'
         WHEN contains(title,'LARGE') THEN 'COMPLETION' WHEN contains(title,'gizmo') OR contains(title,'ring') THEN 'RESULT'
         WHEN contains(title,'ECONOMY') THEN 'NOTICE' ELSE 'DECISION' END AS stage,
    (SELECT min_by(f.family, f.ord) FROM fam f WHERE contains(p.title, f.family)) AS family,
    (SELECT string_agg(f.family, ',' ORDER BY f.ord) FROM fam f WHERE contains(p.title, f.family)) AS terms,
    (SELECT string_agg(DISTINCT e.effect, ',' ORDER BY e.effect) FROM eff e WHERE contains(p.title, e.family)) AS effects
  FROM part_title p),
fact AS (SELECT *, (contains(title,'hot') AND contains(title,'plate')) OR family IS NULL AS needs_document FROM fact0)"""


def finance(t) -> DataFrame:
    """Company-years in wide form: status, basis and six accounts (null = not found)."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    urgent = F.col("o_orderpriority") == "1-URGENT"
    status = F.col("o_orderstatus")
    return (
        t.orders.groupBy(six(F.col("o_custkey")).alias("code"), F.year("o_orderdate").alias("year"))
        .agg(
            F.when((F.count("*") == 1) & (F.max("o_orderstatus") == "P"), "NO_DATA").otherwise("OK").alias("status"),
            F.when(F.count_if(status == "F") > 0, "CFS").otherwise("OFS").alias("fs_div"),
            F.sum(cents).alias("revenue"),
            F.sum(F.when(urgent, -cents).otherwise(F.floor(cents / 10))).alias("operatingIncome"),
            F.sum(F.when(urgent, -F.floor(cents / 4)).otherwise(F.floor(cents / 20))).alias("netIncome"),
            F.sum(F.when(status == "O", cents)).alias("totalLiabilities"),
            F.sum(F.when(status == "F", cents).when(status == "P", -F.floor(cents / 2))).alias("totalEquity"),
            F.sum(F.when(F.col("o_orderpriority") == "5-LOW", cents)).alias("currentAssets"),
        )
    )


FINANCE = """
finance AS (
  SELECT code, year, CASE WHEN count(*) = 1 AND max(o_orderstatus) = 'P' THEN 'NO_DATA' ELSE 'OK' END AS status,
    CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 'CFS' ELSE 'OFS' END AS fs_div,
    CAST(sum(c) AS BIGINT) AS revenue,
    CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN -c ELSE c // 10 END) AS BIGINT) AS "operatingIncome",
    CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN -(c // 4) ELSE c // 20 END) AS BIGINT) AS "netIncome",
    CAST(sum(CASE WHEN o_orderstatus = 'O' THEN c END) AS BIGINT) AS "totalLiabilities",
    CAST(sum(CASE WHEN o_orderstatus = 'F' THEN c WHEN o_orderstatus = 'P' THEN -(c // 2) END) AS BIGINT) AS "totalEquity",
    CAST(sum(CASE WHEN o_orderpriority = '5-LOW' THEN c END) AS BIGINT) AS "currentAssets"
  FROM (SELECT *, printf('%06d', o_custkey) AS code, CAST(year(o_orderdate) AS INT) AS year,
               CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders)
  GROUP BY code, year)"""
ACCOUNTS = ("revenue", "operatingIncome", "netIncome", "totalLiabilities", "totalEquity", "currentAssets")
YEARS = (1997, 1998, 1999)


def with_sector(df: DataFrame, t) -> DataFrame:
    return df.join(universe(t).select("code", "sector"), "code")


def joined(array_col) -> F.Column:
    """Array as comma text, for flat query results."""
    return F.array_join(array_col, ",")


def day_text(col) -> F.Column:
    return F.date_format(col, "yyyy-MM-dd")


__all__ = [n for n in dir() if not n.startswith("_")] + ["tx"]
