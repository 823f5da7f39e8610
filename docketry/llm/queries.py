"""Registered queries of the training-data operators over the given tables, and their SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import langid, ngrams
from docketry.llm.common import bucket_of, read_table
from docketry.llm.decontaminate import leaks
from docketry.llm.dialogue import line_digests, repair
from docketry.llm.forest import Forest, near_classes
from docketry.llm.langid import load_pieces
from docketry.llm.linkgraph import Propagation, Rule, judge_urls
from docketry.llm.mixing import Mixture, mix_plan
from docketry.llm.negatives import mine
from docketry.llm.pseudonyms import KINDS, pseudonymise
from docketry.llm.quality import Divergence, judge
from docketry.llm.secrets import KINDS as SECRET_KINDS
from docketry.llm.secrets import scan
from docketry.llm.sharding import shard_rows
from docketry.llm.tokens import token_index, write_tokens
from docketry.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARDS = 40
#: The pseudonym key of the registered query; a job passes its own.
PSEUDONYM_KEY = "registered-query"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_feistel_pseudonyms(spark: SparkSession, root: str) -> DataFrame:
    done = pseudonymise(read_table(spark, root, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return done.select(
        "doc_id",
        "text",
        F.size("pii_spans").cast("bigint").alias("n_values"),
        *[
            F.expr(f"cast(size(filter(pii_spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in KINDS
        ],
    )


@query
def op8_minimax_shards(spark: SparkSession, root: str) -> DataFrame:
    return shard_rows(read_table(spark, root, "documents"), SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op10_temperature_mixing(spark: SparkSession, root: str) -> DataFrame:
    return mix_plan(read_table(spark, root, "documents"), Mixture(repeat_limit=2.0))


@query
def op3_distribution_divergence(spark: SparkSession, root: str) -> DataFrame:
    return judge(read_table(spark, root, "documents"), Divergence())


@query
def op9_markov_secrets(spark: SparkSession, root: str) -> DataFrame:
    found = scan(read_table(spark, root, "documents"))
    joined = "array_join(transform({0}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    base = "filter(spans, s -> s.kind <> 'model')"
    return found.select(
        "doc_id",
        *[F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in SECRET_KINDS],
        F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"),
        F.expr(joined.format("spans")).alias("spans"),
    )


@query
def op2_orc_tokens(spark: SparkSession, root: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(read_table(spark, root, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_index(spark, path)


@query
def op4_segmentation_unigrams(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents").withColumn("held_out", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False)))
    names = load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    langs, table = langid.train(docs.where("not held_out").select("text", "lang"), names)
    found = langid.predict(docs, langs, table, names)
    return found.withColumn("held_out", F.coalesce(bucket_of("doc_id", 5) == 0, F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")


@query
def op1_qgram_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return leaks(read_table(spark, root, "documents"), read_table(spark, root, "benchmark"))


@query
def op5_minhash_forest(spark: SparkSession, root: str) -> DataFrame:
    return near_classes(read_table(spark, root, "documents"), Forest()).select("doc_id", "class_id", "n_links")


@query
def op6_elias_fano_ngrams(spark: SparkSession, root: str) -> DataFrame:
    docs = read_table(spark, root, "documents")
    held_out = F.coalesce(bucket_of("doc_id", 7) == 2, F.lit(False))
    model, words = ngrams.train(docs.where(~held_out))
    return ngrams.score(docs, model, words).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults, by crc32 of ``conv_id:turn`` modulo 20; a null counts as one blank."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text, fault = F.coalesce("text", F.lit(" ")), F.col("fault")
    marked = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.pmod(F.crc32(named.cast("binary")), F.lit(20)).alias("fault"))
    return marked.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


@query
def op11_path_ranking(spark: SparkSession, root: str) -> DataFrame:
    turns = read_table(spark, root, "conversations")
    done = repair(damaged(turns))
    digests = line_digests(done.lines, "conv_id").withColumnRenamed("conv_id", "k1")
    report = done.report.withColumnRenamed("conv_id", "k2")
    nothing = hashlib.sha256(b"").hexdigest()
    return (
        turns.select("conv_id").distinct()
        .join(report, F.col("conv_id").eqNullSafe(F.col("k2")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("k1")), "left")
        .select(
            "conv_id",
            *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
            F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )


_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ord(s[i])::BIGINT FOR i IN range(1, length(s) + 1)]),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT FOR i IN range(8)]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1)))))"""


def _best(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _way(state: str, cost: str, letters: str, line: str) -> str:
    """A path (cost c, audit a, lines t) carried on; a null path cannot be."""
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || {letters}, 't': {state}.t || {line}}} END"


_USER, _BOTH = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'"
_KEEP = lambda state, first: f"CASE WHEN free AND role LIKE '{first}%' THEN {_way(state, 'held', chr(39) + 'K' + chr(39), 'chr(10) || role || chr(58) || text')} END"
_REROLE = lambda state, role: f"CASE WHEN free THEN {_way(state, 'held + 1', chr(39) + 'R' + chr(39), f'chr(10) || {chr(39)}{role}:{chr(39)} || text')} END"
_DELETE = lambda state: _way(state, "2", "'D'", "''")
ORACLES["op11_path_ranking"] = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
marked AS (SELECT *, {_CRC32} % 20 AS fault FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM marked WHERE fault <> 0),
numbered AS (SELECT *, row_number() OVER w AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
    lag(role) OVER w AS before FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text), copy)),
judged AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered),
steps AS (SELECT conv_id, i, role, text, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS held FROM judged),
paths AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}} AS n0, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS n1, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS n2,
    NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR) AS n3 FROM (SELECT DISTINCT conv_id FROM steps)
  UNION ALL
  SELECT conv_id, i, {_DELETE("n0")}, {_best(_DELETE("n1"), _KEEP("n0", "s"))},
    {_best(_DELETE("w2"), *[_KEEP(n, "u") for n in ("n0", "n1", "w3")], *[_REROLE(n, "user") for n in ("n0", "n1", "w3")])},
    {_best(_DELETE("w3"), _KEEP("w2", "a"), _REROLE("w2", "assistant"))}
  FROM (SELECT p.conv_id, steps.i, n0, n1, role, text, free, held,
      {_best("n2", *[_way(n, "5", "'I'", _USER) for n in ("n0", "n1", "n3")])} AS w2,
      {_best("n3", _way("n2", "5", "'I'", "chr(10) || 'assistant:'"), *[_way(n, "10", "'II'", _BOTH) for n in ("n0", "n1")])} AS w3
    FROM paths p JOIN steps ON steps.conv_id IS NOT DISTINCT FROM p.conv_id AND steps.i = p.i + 1)),
ends AS (SELECT conv_id, {_best("n0", "n3", _way("n2", "5", "'I'", "chr(10) || 'assistant:'"), _way("n1", "10", "'II'", _BOTH))} AS best
  FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
report AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN report r ON o.conv_id IS NOT DISTINCT FROM r.conv_id
LEFT JOIN ends e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
"""


URL_RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@query
def op12_link_propagation(spark: SparkSession, root: str) -> DataFrame:
    pages = read_table(spark, root, "pages").select("page_id", "url", "html")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def _propagation_sql(rules=URL_RULES, how=Propagation()) -> str:
    """The rounds spelt out; a fixed point that ends the Spark rounds early does not change in later ones."""
    host = r"translate(regexp_extract({0}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    after = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) ELSE '' END"
    longest = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN"
    choose = lambda field: "CASE " + " ".join(f"{fits(r)} '{getattr(r, field)}'" for r in longest) + " END"
    kept, limit = 1 - how.damping, round((1 - how.damping) * 1_000_000_000) - 1
    rounds = "".join(
        f""", v{n} AS MATERIALIZED (SELECT kind, host, max(base) AS base, bool_or(hands) AS hands, sum(got)::BIGINT AS value FROM (
  SELECT kind, host, base + CASE WHEN hands THEN 0 ELSE floor(value::DOUBLE * {how.damping}::DOUBLE)::BIGINT END AS got, base, hands FROM v{n - 1}
  UNION ALL SELECT kind, taker, floor(value::DOUBLE * share * {how.damping}::DOUBLE)::BIGINT, NULL, NULL FROM v{n - 1} JOIN ways ON kind = way AND host = giver WHERE hands) GROUP BY 1, 2)"""
        for n in range(1, how.rounds + 1)
    )
    return f"""
WITH cut AS (SELECT page_id, html, coalesce({after.format("url")}, '') AS rest FROM pages),
named AS (SELECT page_id, html, {host.format("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (SELECT *, {choose("name")} AS rule, {choose("verdict")} AS said FROM named),
seeds AS (SELECT host, floor(count(*) FILTER (said = 'allow')::DOUBLE * 1e9 / count(*))::BIGINT AS trust,
  floor(count(*) FILTER (said = 'block')::DOUBLE * 1e9 / count(*))::BIGINT AS distrust FROM ruled WHERE host <> '' GROUP BY 1),
hrefs AS (SELECT page_id, host, row_number() OVER () AS page, regexp_extract_all(html, '(?i)href[\\x09-\\x0D\\x20]*=[\\x09-\\x0D\\x20]*["'']?([^\\x09-\\x0D\\x20"''<>]+)', 1) AS all_links FROM named WHERE host <> ''),
leads AS (SELECT DISTINCT page, host AS source, {host.format(after.format("link"))} AS target FROM (
  SELECT page, host, CASE WHEN starts_with(l, '//') THEN 'http:' || l ELSE l END AS link FROM (SELECT page, host, unnest(all_links) AS l FROM hrefs)
  WHERE starts_with(l, '//') OR regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://'))),
above AS (SELECT s.host, t.host AS above FROM seeds s JOIN seeds t ON ends_with(s.host, '.' || t.host) AND contains(t.host, '.')
  WHERE length(s.host) <= 253 QUALIFY row_number() OVER (PARTITION BY s.host ORDER BY length(t.host) DESC) = 1),
edges AS (SELECT source, target, count(*) AS weight FROM (SELECT source, target FROM leads WHERE target <> '' AND target <> source
  UNION ALL SELECT host, above FROM above UNION ALL SELECT above, host FROM above) GROUP BY 1, 2),
shares AS (SELECT *, weight::DOUBLE / sum(weight) OVER (PARTITION BY source)::DOUBLE AS a, weight::DOUBLE / sum(weight) OVER (PARTITION BY target)::DOUBLE AS b FROM edges),
ways AS MATERIALIZED (SELECT 'trust' AS way, source AS giver, target AS taker, a AS share FROM shares UNION ALL SELECT 'distrust', target, source, b FROM shares),
known AS (SELECT host FROM seeds UNION SELECT source FROM edges UNION SELECT target FROM edges),
v0 AS MATERIALIZED (SELECT kind, host, floor(start::DOUBLE * {kept!r}::DOUBLE)::BIGINT AS base, EXISTS (SELECT 1 FROM ways WHERE way = kind AND giver = host) AS hands, start AS value FROM (
  SELECT 'trust' AS kind, host, coalesce(trust, 0) AS start FROM known LEFT JOIN seeds USING (host)
  UNION ALL SELECT 'distrust', host, coalesce(distrust, 0) FROM known LEFT JOIN seeds USING (host))){rounds},
hosts AS (SELECT host, max(value) FILTER (kind = 'trust') AS trust, max(value) FILTER (kind = 'distrust') AS distrust FROM v{how.rounds} GROUP BY 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust >= {limit} AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM ruled LEFT JOIN hosts USING (host)
"""


ORACLES["op12_link_propagation"] = _propagation_sql()


@query
def op13_slot_negatives(spark: SparkSession, root: str) -> DataFrame:
    label = F.col("label").cast("bigint")
    vectors = read_table(spark, root, "embeddings").select(
        "vec_id", "embedding", F.when(F.pmod("vec_id", F.lit(7)) == 0, (label + 1) % 10).otherwise(label).alias("label")
    )
    return mine(vectors, F.pmod("vec_id", F.lit(50)) == 0)


ORACLES["op13_slot_negatives"] = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.e, r.e)::BIGINT AS score
  FROM v a JOIN v r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""
