"""Queries on weekly digests, glossary usage, summaries, recommendations, feeds and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.vocab import KEY_ACCOUNTS
from docketry.operators import changes as ch, digests as op, events as ev, financials as fin
from docketry.operators.classify import Glossary, GlossaryEntry, classify_titles, glossary_key
from docketry.plans import standins as sv
from docketry.plans.changes import CLASSED, WIN, changes_sql
from docketry.plans.financials import WIDE, long_form, wide
from docketry.plans.registry import query
from docketry.plans.titles import CHAINS, STAGED
from docketry.session import cut_lineage

GLOSSARY = Glossary((
    GlossaryEntry("buy", "Buy", "a purchase", ("purchase",)),
    GlossaryEntry("buy-decision", "Decision", "a decision to buy", ("purchase decision",)),
    GlossaryEntry("join", "Join", "a new member", ("signup",)),
    GlossaryEntry("look", "Look", "a view", ("view",)),
))
KEY_SQL = """(CASE WHEN contains(title, 'purchase decision') THEN 'buy-decision' WHEN contains(title, 'purchase') THEN 'buy'
  WHEN contains(title, 'signup') THEN 'join' WHEN contains(title, 'view') THEN 'look' END)"""
KEYED = sv.FILING + "," + sv.UNIVERSE + f""",
keyed AS (SELECT *, strftime(date_trunc('week', received_on), '%Y-%m-%d') AS week, coalesce({KEY_SQL}, 'other-general') AS entry_key FROM filing),
kt AS (SELECT f.*, {KEY_SQL} AS entry_key, u.name FROM filing f JOIN universe u USING (code))"""


def keyed(t):
    return op.keyed_weeks(sv.filing(t), glossary_key("title", GLOSSARY))


def week_text(df, *cols):
    for c in cols:
        df = df.withColumn(c, sv.day_text(c))
    return df


@query(
    "src5_weekly_scan",
    "WITH " + sv.FILING + "," + sv.UNIVERSE + r""" SELECT f.code, coalesce(u.name, f.code) AS name, title, strftime(received_on, '%Y-%m-%d') AS date, rcept_no,
  u.code IS NOT NULL AS tracked, regexp_matches(title, '\[(기재정정|정정|첨부정정|첨부추가)\]') AS is_correction FROM filing f LEFT JOIN universe u ON f.code = u.code WHERE length(rcept_no) = 14""",
)
def _(t):
    from docketry.sources.registry import weekly_rows

    seen = sv.filing(t).select("rcept_no", F.col("code").alias("ticker"), F.col("title").alias("report_name"))
    return week_text(weekly_rows(seen, sv.universe(t)), "date").drop("url")


@query("ag17_weekly_summary", "WITH " + KEYED + " SELECT week, count(*) AS filings, count(DISTINCT code) AS companies, strftime(max(received_on), '%Y-%m-%d') AS last_date FROM keyed GROUP BY 1")
def _(t):
    return week_text(op.weekly_summary(keyed(t)), "week", "last_date")


@query(
    "ag17_weekly_types",
    "WITH " + KEYED + """, c AS (SELECT week, entry_key, count(*) AS n FROM keyed WHERE entry_key <> 'other-general' GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY week ORDER BY n DESC, entry_key) AS INT) AS rank FROM c QUALIFY rank <= 8""",
)
def _(t):
    return week_text(op.weekly_types(keyed(t)), "week")


@query(
    "ag17_weekly_busiest",
    "WITH " + KEYED + """, c AS (SELECT week, code, count(*) AS n FROM keyed GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY week ORDER BY n DESC, code) AS INT) AS rank FROM c QUALIFY rank <= 5""",
)
def _(t):
    return week_text(op.weekly_busiest(keyed(t)), "week")


THEMES = {"money": ("buy", "buy-decision"), "people": ("join", "look")}


@query(
    "ag18_weekly_themes",
    "WITH " + KEYED + """, th AS (SELECT *, CASE WHEN entry_key LIKE 'buy%' THEN 'money' WHEN entry_key IN ('join', 'look') THEN 'people' END AS theme FROM keyed)
SELECT week, theme, rcept_no, CAST(row_number() OVER (PARTITION BY week, theme ORDER BY received_on DESC, rcept_no DESC) AS INT) AS rank,
  greatest(0, count(*) OVER (PARTITION BY week, theme) - 12) AS more FROM th WHERE theme IS NOT NULL QUALIFY rank <= 12""",
)
def _(t):
    return week_text(op.weekly_themes(keyed(t), THEMES), "week").select("week", "theme", "rcept_no", "rank", "more")


@query("wn7_week_neighbours", "WITH " + KEYED + " SELECT week, lag(week) OVER (ORDER BY week) AS previous_week, lead(week) OVER (ORDER BY week) AS next_week FROM (SELECT DISTINCT week FROM keyed)")
def _(t):
    return week_text(op.week_neighbours(keyed(t)), "week", "previous_week", "next_week")


@query(
    "ag19_glossary_usage",
    "WITH " + KEYED + f""", c AS (SELECT {KEY_SQL} AS entry_key, count(*) AS n FROM filing GROUP BY 1),
e AS (SELECT entry_key, code, name, rcept_no, CAST(row_number() OVER (PARTITION BY entry_key ORDER BY received_on DESC, rcept_no DESC) AS INT) AS rank FROM kt QUALIFY rank <= 8)
SELECT c.entry_key, n, rank, code, name, rcept_no FROM c LEFT JOIN e USING (entry_key) WHERE c.entry_key IS NOT NULL""",
)
def _(t):
    rows = sv.filing(t).withColumn("entry_key", glossary_key("title", GLOSSARY))
    return op.glossary_usage(rows, sv.universe(t))


@query(
    "ag22_company_entries",
    "WITH " + KEYED + """, m AS (SELECT code, entry_key, max(rcept_no) AS newest FROM kt WHERE entry_key IS NOT NULL GROUP BY 1, 2)
SELECT code, entry_key, CAST(row_number() OVER (PARTITION BY code ORDER BY newest DESC) AS INT) AS rank FROM m QUALIFY rank <= 8""",
)
def _(t):
    rows = sv.tracked_filing(t).withColumn("entry_key", glossary_key("title", GLOSSARY))
    return op.company_entries(rows)


CHAIN_CATEGORY = {"buying": "purchase", "joining": "membership"}
CATS = CLASSED + STAGED[len(sv.TRACKED):] + """,
own AS (SELECT code, category, 0 AS tier, -count(*) AS w, category AS nm FROM (SELECT * FROM cls QUALIFY row_number() OVER (PARTITION BY code ORDER BY received_on DESC, rcept_no DESC) <= 40) GROUP BY code, category),
chn AS (SELECT code, CASE chain WHEN 'buying' THEN 'purchase' ELSE 'membership' END AS category, 1 AS tier, -CAST(latest_received_on - DATE '1970-01-01' AS BIGINT) AS w,
  CASE chain WHEN 'buying' THEN '000000' ELSE '000001' END AS nm FROM lines),
fst AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM chn) QUALIFY row_number() OVER (PARTITION BY code, category ORDER BY tier, w, nm) = 1),
cats AS (SELECT code, category, CAST(row_number() OVER (PARTITION BY code ORDER BY tier, w, nm) AS INT) AS rank FROM fst QUALIFY rank <= 6)"""


def classified(t):
    return classify_titles(sv.tracked_filing(t), "title", sv.CATEGORIES)


def lines_of(filings):
    items = ev.match_stages(filings.select("code", "rcept_no", "title", "received_on"), CHAINS)
    order = F.create_map(*[x for i, c in enumerate(CHAINS) for x in (F.lit(c.key), F.lit(i))])
    return ev.timelines(items, CHAINS).withColumn("chain_ord", order[F.col("chain")])


def lines(t):
    return lines_of(sv.tracked_filing(t))


def categories(t):
    return op.company_categories(ch.filing_page(classified(t)), lines(t), CHAIN_CATEGORY)


@query("ag20_company_categories", "WITH " + CATS + " SELECT * FROM cats")
def _(t):
    return categories(t)


SUMMARY = (
    changes_sql("", WIN.format(src="tracked")).replace("\nSELECT code, CASE category", ",\nchg AS (SELECT code, CASE category", 1)
    + ")"
    + CATS[len(CLASSED):]
    + "," + WIDE.replace(sv.UNIVERSE, "ignored AS (SELECT 1)").replace("chg AS (", "fchg AS (") + """,
lp AS (SELECT a.code, max(b.year) AS to_year FROM ok a JOIN ok b ON a.code = b.code AND b.year = a.year + 1 AND a.fs_div = b.fs_div GROUP BY 1),
kc AS (SELECT code, string_agg(account || ':' || change_abs, ',' ORDER BY account) AS key_changes FROM fchg JOIN lp USING (code, to_year) WHERE account IN ('revenue', 'operatingIncome', 'netIncome') GROUP BY 1),
fh AS (SELECT code, max_by(fs_div, year) AS fs_div FROM finance WHERE status = 'OK' AND year IN (1997, 1998, 1999) GROUP BY 1),
hd AS (SELECT code, count(*) AS filing_count, count(*) FILTER (received_on BETWEEN rf AND hi) AS recent_count FROM cls, win GROUP BY code),
ln AS (SELECT code, string_agg(text, ' / ' ORDER BY position) AS lines FROM (SELECT * FROM chg QUALIFY row_number() OVER (PARTITION BY code ORDER BY position) <= 2) GROUP BY 1),
nw AS (SELECT code, string_agg(chain || ' ' || strftime(latest_received_on, '%Y-%m-%d') || ' ' || latest_label, ',' ORDER BY latest_received_on DESC, chain) AS newest_timelines, count(*) AS timeline_count FROM lines GROUP BY 1),
ct AS (SELECT code, string_agg(category, ',' ORDER BY rank) AS categories FROM cats GROUP BY 1)
SELECT u.code, u.name, filing_count, recent_count, coalesce(ln.lines, '') AS lines, fs_div, CAST(to_year - 1 AS INT) AS from_year, to_year, coalesce(key_changes, '') AS key_changes, timeline_count, coalesce(newest_timelines, '') AS newest_timelines, coalesce(categories, '') AS categories,
  CASE WHEN fs_div IS NULL THEN 'NOT_COLLECTED' ELSE 'OK' END AS financial_state
FROM universe u LEFT JOIN hd USING (code) LEFT JOIN lp USING (code) LEFT JOIN kc USING (code) LEFT JOIN ln USING (code) LEFT JOIN fh USING (code) LEFT JOIN nw USING (code) LEFT JOIN ct USING (code)"""
)


@query("ag20_company_summary", SUMMARY)
def _(t):
    # The products a summary reads are written once, then read by every part of it.
    rows = cut_lineage(classified(t), "classified")
    stages = cut_lineage(lines_of(rows), "timelines")
    windows = cut_lineage(ch.data_windows(rows), "windows")
    headers = ch.company_headers(rows.withColumn("listed", F.lit(True)), windows.scalar()).select("code", "filing_count", "recent_count")
    change_lines = ch.window_changes(rows, windows.scalar(), sv.CATEGORIES).select("code", "position", "text")
    records = cut_lineage(wide(t), "records")
    basis = fin.companies_with_data(records, sv.YEARS).select("code", "fs_div")
    changes = fin.account_changes(fin.account_values(long_form(records), sv.YEARS, KEY_ACCOUNTS))
    last = fin.latest_pair_changes(fin.comparable_pairs(records, sv.YEARS), changes)
    financial = basis.join(last, "code", "left")
    cats = op.company_categories(ch.filing_page(rows), stages, CHAIN_CATEGORY)
    out = op.company_summary(sv.universe(t), headers, change_lines, financial, stages, cats)
    empty = F.lit("")
    timeline = lambda x: F.concat_ws(" ", x["chain"], sv.day_text(x["latest_received_on"]), x["stage_label"])
    return (
        out.withColumn("lines", F.coalesce(F.array_join("lines", " / "), empty))
        .withColumn("newest_timelines", F.coalesce(sv.joined(F.transform("newest_timelines", timeline)), empty))
        .withColumn("categories", F.coalesce(sv.joined("categories"), empty))
        .withColumn(
            "key_changes",
            F.coalesce(sv.joined(F.transform("key_changes", lambda c: F.concat_ws(":", c["account"], c["change_abs"].cast("string")))), empty),
        )
    )


LESSONS = {"purchase": (77, 18), "traffic": (33,), "signup": (18, 34), "membership": (80,)}


@query(
    "jn11_recommended_lessons",
    "WITH " + CATS + """, les(category, at_, lesson) AS (VALUES ('purchase',0,77),('purchase',1,18),('traffic',0,33),('signup',0,18),('signup',1,34),('membership',0,80)),
a AS (SELECT code, lesson, rank * 10 + at_ AS o FROM cats JOIN les USING (category) UNION ALL SELECT DISTINCT code, 68, 1000 FROM cats),
b AS (SELECT code, lesson, min(o) AS o FROM a GROUP BY 1, 2)
SELECT code, lesson, CAST(row_number() OVER (PARTITION BY code ORDER BY o) - 1 AS INT) AS place FROM b QUALIFY place < 3""",
)
def _(t):
    return op.recommended_lessons(categories(t), LESSONS, (68,))


@query(
    "jn9_name_resolution",
    """WITH q AS (SELECT DISTINCT CASE o_custkey % 4 WHEN 0 THEN printf('%06d', o_custkey) WHEN 1 THEN printf('Customer#%09d', o_custkey)
  WHEN 2 THEN printf('%d', o_custkey) ELSE 'nobody ' || o_custkey END AS query FROM orders),
n AS (SELECT c_custkey AS ord, printf('%06d', c_custkey) AS code, c_name AS name FROM customer)
SELECT query, CASE WHEN regexp_full_match(query, '\\d{6}') THEN query ELSE coalesce((SELECT min_by(code, ord) FROM n WHERE name = query),
  (SELECT min_by(code, ord) FROM n WHERE contains(name, query)), query) END AS code FROM q""".replace("\\\\", "\\"),
)
def _(t):
    k = F.col("o_custkey")
    text = (
        F.when(k % 4 == 0, sv.six(k)).when(k % 4 == 1, F.format_string("Customer#%09d", k)).when(k % 4 == 2, k.cast("string"))
        .otherwise(F.concat(F.lit("nobody "), k.cast("string")))
    )
    names = t.customer.select(F.col("c_custkey").alias("ord"), sv.six(F.col("c_custkey")).alias("code"), F.col("c_name").alias("name"))
    return op.resolve_names(t.orders.select(text.alias("query")).distinct(), names)


ADDR = """new AS (SELECT regexp_replace(url, '^https?://[^/]*', CASE page_id % 4 WHEN 0 THEN 'https://other.example.com' ELSE 'https://www.example.com' END) || '#' || page_id AS loc,
  CASE WHEN page_id % 3 = 0 THEN '2024-01-02' END AS lastmod, page_id FROM pages),
live AS (SELECT loc, CASE WHEN page_id % 5 = 0 THEN '2024-01-01' ELSE lastmod END AS lastmod FROM new WHERE page_id % 7 <> 0)"""


def addresses(t):
    host = F.when(F.col("page_id") % 4 == 0, "https://other.example.com").otherwise("https://www.example.com")
    path = F.regexp_extract("url", r"^https?://[^/]*(.*)$", 1)
    return t.pages.select(
        F.concat(host, path, F.lit("#"), F.col("page_id").cast("string")).alias("loc"),
        F.when(F.col("page_id") % 3 == 0, "2024-01-02").alias("lastmod"),
        "page_id",
    )


@query(
    "jn10_changed_addresses",
    "WITH " + ADDR + """ SELECT new.loc, new.lastmod FROM new LEFT JOIN live ON new.loc = live.loc WHERE new.loc LIKE 'https://www.example.com/%' AND (live.loc IS NULL OR new.lastmod IS DISTINCT FROM live.lastmod)""",
)
def _(t):
    new = addresses(t)
    live = new.where("page_id % 7 <> 0").withColumn("lastmod", F.when(F.col("page_id") % 5 == 0, "2024-01-01").otherwise(F.col("lastmod")))
    return op.changed_addresses(new.drop("page_id"), live, "www.example.com")


@query(
    "st5_address_set",
    "WITH " + ADDR + """ SELECT loc, CASE WHEN page_id % 7 <> 0 THEN CASE WHEN page_id % 5 = 0 THEN '2024-01-01' ELSE lastmod END ELSE lastmod END AS lastmod FROM new""",
)
def _(t):
    new = addresses(t)
    static = new.where("page_id % 7 <> 0").withColumn("lastmod", F.when(F.col("page_id") % 5 == 0, "2024-01-01").otherwise(F.col("lastmod")))
    return op.merge_addresses(static.drop("page_id"), new.drop("page_id"))


@query(
    "st4_thin_companies",
    "WITH " + STAGED + "," + sv.FINANCE + """ SELECT code FROM universe WHERE code NOT IN (SELECT code FROM tracked)
  AND code NOT IN (SELECT code FROM finance WHERE status = 'OK' AND year IN (1997, 1998, 1999)) AND code NOT IN (SELECT code FROM lines)""",
)
def _(t):
    financial = fin.companies_with_data(sv.finance(t), sv.YEARS)
    return op.thin_companies(sv.universe(t), sv.tracked_filing(t), financial, lines(t))


@query(
    "jn12_related_items",
    """WITH i AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 97 = 0 THEN 'rare' || p_partkey // 388 ELSE p_brand END AS category, CAST(p_size AS BIGINT) AS d FROM part),
s AS (SELECT a.id, b.id AS rid, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.id - b.id), b.id) AS rn FROM i a JOIN i b ON a.category = b.category AND a.id <> b.id QUALIFY rn <= 3),
r AS (SELECT a.id, b.id AS rid, 100 + row_number() OVER (PARTITION BY a.id ORDER BY b.d DESC, b.id DESC) AS rn FROM i a JOIN (SELECT * FROM i ORDER BY d DESC, id DESC LIMIT 6) b ON a.category <> b.category)
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY rn) - 1 AS INT) AS place, rid AS related_id FROM (SELECT * FROM s UNION ALL SELECT * FROM r) QUALIFY place < 3""",
)
def _(t):
    rare = F.concat(F.lit("rare"), F.floor(F.col("p_partkey") / 388).cast("string"))
    items = t.part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") % 97 == 0, rare).otherwise(F.col("p_brand")).alias("category"),
        F.col("p_size").cast("bigint").alias("date"),
    )
    return op.related_items(items, 3, 512)


@query(
    "wn14_feed",
    "WITH " + KEYED + """, wk AS (SELECT max(received_on) AS day, 'weekly' AS kind, week AS key, 'week of ' || week AS title FROM keyed GROUP BY week),
grp AS (SELECT received_on AS day, 'filing' AS kind, code AS key, min_by(title, rcept_no) || CASE WHEN count(*) > 1 THEN ' +' || (count(*) - 1) ELSE '' END AS title
  FROM kt GROUP BY received_on, code ORDER BY received_on DESC, code DESC LIMIT 25),
st AS (SELECT DATE '2024-01-01' + CAST(doc_id % 29 AS INT) AS day, 'study' AS kind, printf('%06d', doc_id) AS key, lang || '-' || source AS title FROM documents)
SELECT strftime(day, '%Y-%m-%d') AS day, kind, key, title FROM (SELECT * FROM (SELECT *, 0 AS tier FROM wk UNION ALL SELECT *, 1 FROM grp UNION ALL SELECT *, 2 FROM st) ORDER BY day DESC, tier, CASE WHEN tier = 1 THEN key END DESC NULLS LAST, key LIMIT 60)""",
)
def _(t):
    week = op.weekly_summary(keyed(t)).select(
        F.col("last_date").alias("day"), F.lit("weekly").alias("kind"), sv.day_text("week").alias("key"), F.concat(F.lit("week of "), sv.day_text("week")).alias("title")
    )
    study = t.documents.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 29).cast("int")).alias("day"),
        F.lit("study").alias("kind"), sv.six(F.col("doc_id")).alias("key"), F.concat_ws("-", "lang", "source").alias("title"),
    )
    return week_text(op.feed(week, sv.tracked_filing(t), study), "day")
