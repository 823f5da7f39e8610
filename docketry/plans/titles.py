"""Queries on title classification, glossary lookup, corporate actions and timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.functions.actions import action_facts
from docketry.operators import classify as cl, events as ev, terms as tm
from docketry.plans import standins as sv
from docketry.plans.registry import query


@query("fn4_classify_titles", "WITH " + sv.CLASSIFY_SQL + " SELECT id, category, tags, tie FROM part_title JOIN cls USING (title)")
def _(t):
    done = cl.classify_titles(sv.part_title(t), "title", sv.PART_CATEGORIES, or_word="or")
    return done.select("id", "category", sv.joined("category_tags").alias("tags"), F.col("category_tie").alias("tie"))


@query(
    "fn5_category_columns",
    "WITH " + sv.CLASSIFY_SQL + " SELECT id, category, nullif(tags, '') AS category_tags, CASE WHEN tie THEN true END AS category_ambiguous FROM part_title JOIN cls USING (title)",
)
def _(t):
    done = cl.with_category_columns(sv.part_title(t), "title", sv.PART_CATEGORIES, or_word="or")
    return done.select("id", "category", sv.joined("category_tags").alias("category_tags"), "category_ambiguous")


GLOSS = "WITH " + sv.PART_TITLE + "," + sv.GLOSSARY_SQL.replace("\\\\", "\\")


@query("fn6_glossary_lookup", GLOSS + " SELECT id, entry_key, plain FROM part_title LEFT JOIN gkey USING (title) LEFT JOIN gloss ON key = entry_key")
def _(t):
    rows = sv.part_title(t).withColumn("entry_key", cl.glossary_key("title", sv.GLOSSARY))
    return rows.select("id", "entry_key", cl.glossary_fields(F.col("entry_key"), sv.GLOSSARY)["plain"].alias("plain"))


@query(
    "fn7_explain_titles",
    "WITH " + sv.CLASSIFY_SQL + "," + sv.GLOSSARY_SQL.replace("\\\\", "\\") + """,
hint(category, label, why, nx) AS (VALUES ('promo','Promotion','A campaign.','Read the term.'),('size','Size','A size.','Read the gauge.'),
 ('colour','Colour','A colour.','Read the code.'),('tool','Tool','A tool.','Read the use.'),('branded','Branded','A brand.','Read the mark.'),('state','State','A state.','Read the age.')),
x AS (SELECT p.id, p.title, c.category, c.tie, coalesce(k.entry_key, CASE WHEN c.category = 'other' THEN 'other-general' END) AS ek
  FROM part_title p JOIN cls c USING (title) LEFT JOIN gkey k USING (title))
SELECT id, ek AS entry_key, g.plain, coalesce(g.what, h.label) AS what,
  coalesce(g.why, CASE WHEN tie THEN '제목만으로는 어느 종류인지 정할 수 없어 한 가지 읽는 법을 고르지 않았어요.' ELSE h.why END) AS why,
  CASE WHEN ek IS NULL AND NOT tie THEN nx END AS check_next,
  concat_ws(',', CASE WHEN contains(title, 'PROMO') THEN 'limited time' END, CASE WHEN contains(title, 'report') THEN 'a report' END,
    CASE WHEN contains(title, '[정정]') THEN 'corrected' END) AS notes
FROM x LEFT JOIN gloss g ON g.key = ek LEFT JOIN hint h ON h.category = x.category""",
)
def _(t):
    rows = sv.part_title(t).withColumn("is_correction", F.lit(False))
    done = cl.explain_titles(rows, "title", "is_correction", sv.PART_CATEGORIES, sv.GLOSSARY, or_word="or")
    return done.select("id", "entry_key", "plain", "what", "why", "check_next", sv.joined("notes").alias("notes"))


@query(
    "fn8_action_facts",
    "WITH " + sv.ACTIONS_SQL + " SELECT id, subject, stage, coalesce(terms, '') AS terms, coalesce(effects, '') AS effects, family, needs_document FROM fact",
)
def _(t):
    return sv.part_title(t).withColumn("f", action_facts("title", sv.ACTIONS)).select(
        "id", "f.subject", "f.stage", sv.joined("f.terms").alias("terms"), sv.joined("f.effects").alias("effects"),
        "f.family", "f.needs_document",
    )


EVENTS_SQL = sv.ACTIONS_SQL + """,
grp AS (SELECT brand AS code, subject, family, string_agg(DISTINCT stage, ',' ORDER BY stage) AS stages,
  count(CASE WHEN id % 6 <> 0 THEN id END) AS document_count, bool_or(needs_document) AS needs_document FROM fact GROUP BY ALL),
geff AS (SELECT f.brand AS code, f.subject, f.family, string_agg(DISTINCT e.effect, ',' ORDER BY e.effect) AS effects
  FROM fact f JOIN eff e ON contains(f.title, e.family) GROUP BY ALL),
gid AS (SELECT brand AS code, subject, family, string_agg(printf('%08d', id), ',' ORDER BY id) AS ids FROM (
  SELECT *, row_number() OVER (PARTITION BY brand, subject, family ORDER BY id) AS rn FROM fact WHERE id % 6 <> 0) WHERE rn <= 20 GROUP BY ALL),
ev0 AS (SELECT g.*, coalesce(e.effects, '') AS effects, coalesce(i.ids, '') AS ids, contains(stages, 'COMPLETION') AS company_completed,
  contains(stages, 'COMPLETION') OR contains(stages, 'WITHDRAWN') AS done
  FROM grp g LEFT JOIN geff e ON g.code = e.code AND g.subject = e.subject AND g.family IS NOT DISTINCT FROM e.family
  LEFT JOIN gid i ON g.code = i.code AND g.subject = i.subject AND g.family IS NOT DISTINCT FROM i.family),
ev AS (SELECT *, concat_ws(',', CASE WHEN NOT done THEN 'CORPORATE_EVENT' END, CASE WHEN contains(effects, 'LISTING') THEN 'LISTING' END,
  CASE WHEN contains(effects, 'PRICE') THEN 'PRICE,PRICE_BASIS' END, CASE WHEN contains(effects, 'SHARES') THEN 'SHARES,SHARE_COUNT' END,
  CASE WHEN contains(effects, 'TRADABLE') THEN 'TRADABLE' END) AS unresolved FROM ev0)"""


def findings(t):
    return sv.part_title(t).select(
        F.col("brand").alias("code"),
        F.when(F.col("id") % 6 != 0, F.format_string("%08d", "id")).alias("id"),
        "title",
    )


@query(
    "ag7_action_events",
    "WITH " + EVENTS_SQL + " SELECT code, subject, family, stages, effects, document_count, ids, needs_document, company_completed FROM ev",
)
def _(t):
    e = ev.action_events(findings(t), sv.ACTIONS)
    return e.select(
        "code", "subject", "family", sv.joined("stages").alias("stages"), sv.joined("effects").alias("effects"),
        "document_count", sv.joined("ids").alias("ids"), "needs_document", "company_completed",
    )


@query(
    "fn9_effect_states",
    "WITH " + EVENTS_SQL + """ SELECT code, subject, family, unresolved, subject = 'SELF' AND unresolved <> '' AS open,
  CASE WHEN done THEN 'RESOLVED_CONFIRMED' ELSE 'OPEN' END AS company_step,
  CASE WHEN contains(effects, 'LISTING') THEN 'NEEDS_EXCHANGE' END AS listing, CASE WHEN contains(effects, 'PRICE') THEN 'OPEN' END AS price FROM ev""",
)
def _(t):
    e = ev.action_events(findings(t), sv.ACTIONS)
    s = F.col("effect_states")
    return e.select(
        "code", "subject", "family", sv.joined("unresolved_effects").alias("unresolved"), "open",
        s["CORPORATE_EVENT"].alias("company_step"), s["LISTING"].alias("listing"), s["PRICE"].alias("price"),
    )


@query(
    "ag8_event_rollup",
    "WITH " + EVENTS_SQL + """, n AS (SELECT brand AS code, count(*) FILTER (needs_document) AS needs_document FROM fact GROUP BY brand)
SELECT code, count(*) FILTER (subject = 'SELF' AND unresolved <> '') AS open_self, count(*) FILTER (subject <> 'SELF') AS subsidiary,
  count(*) FILTER (subject = 'SELF' AND done AND unresolved <> '') AS company_done_awaiting_exchange,
  count(*) FILTER (subject = 'SELF' AND unresolved = '') AS fully_resolved, count(*) AS events, any_value(n.needs_document) AS needs_document
FROM ev JOIN n USING (code) GROUP BY code""",
)
def _(t):
    counts = ev.event_counts(ev.action_events(findings(t), sv.ACTIONS))
    return counts.join(ev.documents_needed(findings(t), sv.ACTIONS), "code")


CHAINS = (
    ev.Chain("buying", "Buying", (
        ev.Stage("PLANNED", "plan", ("purchase decision",)),
        ev.Stage("REPORTED", "report", ("purchase progress", "purchase result")),
        ev.Stage("COMPLETED", "end", ("purchase end",)),
    )),
    ev.Chain("joining", "Joining", (
        ev.Stage("PLANNED", "plan", ("signup decision",)),
        ev.Stage("IN_PROGRESS", "step", ("signup progress",)),
        ev.Stage("COMPLETED", "end", ("signup result",)),
    )),
)
STAGED = sv.TRACKED + """,
chain(chain, chain_ord, stage, stage_label, stage_ord, word) AS (VALUES ('buying',0,'PLANNED','plan',0,'purchasedecision'),
 ('buying',0,'REPORTED','report',1,'purchaseprogress'),('buying',0,'REPORTED','report',1,'purchaseresult'),('buying',0,'COMPLETED','end',2,'purchaseend'),
 ('joining',1,'PLANNED','plan',0,'signupdecision'),('joining',1,'IN_PROGRESS','step',1,'signupprogress'),('joining',1,'COMPLETED','end',2,'signupresult')),
staged AS (SELECT code, rcept_no, received_on, chain, stage, stage_label, stage_ord FROM tracked JOIN chain ON contains(replace(title, ' ', ''), word)
  QUALIFY row_number() OVER (PARTITION BY rcept_no, chain ORDER BY stage_ord) = 1),
grid AS (SELECT DISTINCT chain, stage, stage_label, stage_ord FROM chain),
lines AS (SELECT code, chain, count(*) AS items, max_by(stage, rcept_no) AS latest_stage, max_by(stage_label, rcept_no) AS latest_label, max(received_on) AS latest_received_on FROM staged GROUP BY 1, 2),
cells AS (SELECT l.code, l.chain, g.stage, g.stage_label, g.stage_ord, EXISTS (SELECT 1 FROM staged s WHERE s.code = l.code AND s.chain = l.chain AND s.stage = g.stage) AS found
  FROM lines l JOIN grid g USING (chain))"""


def staged(t):
    return ev.match_stages(sv.tracked_filing(t).select("code", "rcept_no", "title", "received_on"), CHAINS)


@query("ev1_stage_matching", "WITH " + STAGED + " SELECT rcept_no, chain, stage, stage_label FROM staged")
def _(t):
    return staged(t).select("rcept_no", "chain", "stage", "stage_label")


@query(
    "ev2_timelines",
    "WITH " + STAGED + """ SELECT code, chain, items, latest_stage, strftime(latest_received_on, '%Y-%m-%d') AS latest_received_on,
  (SELECT coalesce(string_agg(stage, ',' ORDER BY stage_ord), '') FROM cells c WHERE c.code = l.code AND c.chain = l.chain AND found) AS stages_seen,
  (SELECT coalesce(string_agg(stage, ',' ORDER BY stage_ord), '') FROM cells c WHERE c.code = l.code AND c.chain = l.chain AND NOT found) AS stages_not_found FROM lines l""",
)
def _(t):
    lines = ev.timelines(staged(t), CHAINS)
    return lines.select(
        "code", "chain", "items", "latest_stage", sv.day_text("latest_received_on").alias("latest_received_on"),
        sv.joined("stages_seen").alias("stages_seen"), sv.joined("stages_not_found").alias("stages_not_found"),
    )


@query(
    "ev3_timeline_nodes",
    "WITH " + STAGED + """ SELECT code, chain, stage_ord, stage, stage_label, rcept_no, 'FOUND' AS node_state FROM staged
UNION ALL SELECT code, chain, stage_ord, stage, stage_label, NULL, 'NOT_FOUND' FROM cells WHERE NOT found""",
)
def _(t):
    return ev.timeline_nodes(staged(t), CHAINS).drop("received_on")


@query(
    "wn6_active_timelines",
    "WITH " + STAGED + " SELECT code, count(*) AS chains, strftime(max(latest_received_on), '%Y-%m-%d') AS latest FROM lines GROUP BY code ORDER BY max(latest_received_on) DESC, code LIMIT 80",
)
def _(t):
    return ev.active_timelines(ev.timelines(staged(t), CHAINS)).withColumn("latest", sv.day_text("latest"))


# Vocabularies as tables, taken from the data: every word of a part's name and type is a term.


def part_words(t):
    words = F.explode(F.concat(F.split("p_name", " "), F.split("p_type", " ")))
    return t.part.select(words.alias("word")).where("word <> ''").distinct()


PART_WORDS = "words AS (SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name, ' ') || string_split(p_type, ' ')) AS w FROM part) WHERE w <> '')"
WORD_TERMS = PART_WORDS + ", term AS (SELECT ascii(word) AS ord, left(word, 1) AS key, ascii(word) % 5 = 0 AS form, word FROM words)"


@query(
    "fn4_table_terms",
    "WITH " + sv.CLASSIFY_SQL.replace(sv.PART_TERMS_SQL, WORD_TERMS) + " SELECT id, category, tags, tie FROM part_title JOIN cls USING (title)",
)
def _(t):
    code = F.ascii("word")
    terms = part_words(t).select(code.alias("ord"), F.left("word", F.lit(1)).alias("key"), (code % 5 == 0).alias("form"), "word")
    done = tm.classify_by_table(sv.part_title(t), "title", terms, or_word="or")
    return done.select("id", "category", sv.joined("category_tags").alias("tags"), F.col("category_tie").alias("tie"))


BARE = r"regexp_replace(regexp_replace(title, '\[[^\]]*\]', '', 'g'), '\s+', '', 'g')"


@query(
    "fn6_table_patterns",
    "WITH " + sv.PART_TITLE + "," + PART_WORDS + f""", best AS (SELECT id, word FROM part_title JOIN words ON contains({BARE}, word)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(word) DESC, word) = 1)
SELECT id, word AS entry_key FROM part_title LEFT JOIN best USING (id)""",
)
def _(t):
    patterns = part_words(t).select(F.lit(0).alias("ord"), F.col("word").alias("key"), "word")
    return tm.glossary_by_table(sv.part_title(t), "title", patterns).select("id", "entry_key")


@query(
    "ev1_table_stages",
    "WITH " + sv.FILING + f""", stages AS (SELECT DISTINCT left(event_type, 1) AS chain, ascii(event_type) AS chain_ord, event_type AS stage, length(event_type) AS stage_ord FROM events),
hit AS (SELECT rcept_no, chain, stage, stage_ord FROM filing JOIN stages ON contains({BARE}, stage) QUALIFY row_number() OVER (PARTITION BY rcept_no, chain ORDER BY stage_ord, stage) = 1)
SELECT rcept_no, chain, stage, CAST(stage_ord AS INT) AS stage_ord FROM hit""",
)
def _(t):
    kind = F.col("event_type")
    stages = t.events.select(kind).distinct().select(
        F.left(kind, F.lit(1)).alias("chain"), F.ascii(kind).alias("chain_ord"), kind.alias("stage"), kind.alias("stage_label"), F.length(kind).alias("stage_ord"), kind.alias("word")
    )
    return tm.stages_by_table(sv.filing(t), stages).select("rcept_no", "chain", "stage", "stage_ord")
