"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wirelens.functions.storage import materialize
from wirelens.functions import text as tx
from wirelens.functions.dates import event_date_label, publication_date, rfc822
from wirelens.functions.rulepacks import SYNTHETIC as PACK
from wirelens.operators import classify as cl
from wirelens.operators import events as ev
from wirelens.operators import duplicates, feed, intake, pairs
from wirelens.operators.render import render, tags, truncate, usable_image

NOW = "2024-01-31 00:00:00"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: the first line is the title, an hour lies between two."""
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ordinal"),
        F.substring_index(t, "\n", 1).alias("title"),
        F.when(F.instr(t, "\n") > 0, F.substring(t, F.instr(t, "\n") + 1, F.length(t))).otherwise("").alias("description"),
        F.concat(F.lit("https://example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        "source",
        "lang",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600).alias("published_at"),
    )


NEWS = """news AS (SELECT doc_id AS ordinal, split_part(coalesce(text, ''), chr(10), 1) AS title,
  CASE WHEN instr(coalesce(text, ''), chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS description,
  'https://example.org/' || source || '/' || doc_id AS url, source, lang, TIMESTAMP '2024-01-01' + INTERVAL (doc_id) HOUR AS published_at FROM documents),
items AS (SELECT *, replace(lower(title), 'ß', 'ss') || ' ' || replace(lower(description), 'ß', 'ss') AS t FROM news)"""


def has(stem: str) -> str:
    return rf"regexp_matches(t, '(^|[^\p{{L}}\p{{N}}_]){stem}')"


def listed(stems) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(s)} THEN '{s}' END" for s in stems) + "], lambda x: x IS NOT NULL)"


_HEAVY = ", ".join(f"CASE WHEN {has(s)} THEN {p} ELSE 0 END" for s, p in PACK.scores.items() if p > 1)
_SLIGHT = " + ".join(f"CASE WHEN {has(s)} THEN {p} ELSE 0 END" for s, p in PACK.scores.items() if p <= 1)
SCORE = f"greatest({_HEAVY}) + least({_SLIGHT}, {PACK.bonus_limit})"
STRONG, CONDITIONAL, CONTEXTUAL, OUTCOMES = (listed(x) for x in (PACK.strong, PACK.conditional, PACK.contextual, PACK.outcomes))
_EXCLUDED = " OR ".join(f"contains(t, '{w}')" for w in PACK.excluded)
CLASSIFIED = f"""{NEWS}, parts AS (SELECT *, {STRONG} AS strong, {CONDITIONAL} AS cond, {CONTEXTUAL} AS ctx, {OUTCOMES} AS outc, ({_EXCLUDED}) AS excl, {SCORE} AS score FROM items),
classified AS (SELECT *, (len(strong) > 0 OR (len(cond) > 0 AND len(outc) > 0)) AS supported, len(cond) > 0 AND len(outc) > 0 AS severe,
  list_concat(strong, list_filter(ctx, lambda x: NOT list_contains(strong, x))) AS matched FROM parts),
judged AS (SELECT *, supported AND len(matched) > 0 AND NOT excl AS admitted,
  CASE WHEN len(strong) > 0 THEN 'hard serious topic "' || strong[1] || '"' WHEN severe THEN 'conditional "' || cond[1] || '" + severe outcome "' || outc[1] || '"' END AS admission_reason,
  CASE WHEN excl THEN 'excluded keyword' WHEN len(cond) > 0 AND len(outc) = 0 THEN 'violent context without severe outcome: ' || array_to_string(cond, ', ')
    WHEN len(ctx) > 0 THEN 'only contextual topics: ' || array_to_string(ctx, ', ') WHEN len(matched) = 0 THEN 'no crime topics'
    WHEN NOT supported THEN 'no supporting crime context' END AS rejection_reason FROM classified)"""


def classified(spark, sf_dir) -> DataFrame:
    return cl.classify(news(spark, sf_dir), PACK, scored=True)


@query(f"WITH {CLASSIFIED} SELECT ordinal, score, array_to_string(strong, ',') AS topics FROM judged WHERE admitted AND score >= 4 ORDER BY score DESC, ordinal LIMIT 20")
def topic_topk(spark, sf_dir):
    """Classify, score, rank: the twenty best."""
    best = cl.rank(classified(spark, sf_dir).where("admitted and score >= 4"), 20)
    topics = F.filter("strong_topics", lambda t: ~F.contains(t, F.lit(" + ")))
    return best.select("ordinal", "score", F.array_join(topics, ",").alias("topics"))


@query(f"WITH {CLASSIFIED} SELECT ordinal, array_to_string(matched, ',') AS matched FROM judged")
def topic_match_arrays(spark, sf_dir):
    return classified(spark, sf_dir).select("ordinal", F.array_join("matched_topics", ",").alias("matched"))


@query(f"WITH {CLASSIFIED} SELECT ordinal, admitted, admission_reason FROM judged")
def conditional_admission(spark, sf_dir):
    return classified(spark, sf_dir).select("ordinal", "admitted", "admission_reason")


@query(f"WITH {CLASSIFIED} SELECT coalesce(rejection_reason, 'none') AS reason, admitted, count(*) AS n FROM judged GROUP BY ALL")
def reason_cascade_counts(spark, sf_dir):
    return classified(spark, sf_dir).groupBy(F.coalesce("rejection_reason", F.lit("none")).alias("reason"), "admitted").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {NEWS} SELECT ordinal, {SCORE} AS score FROM items")
def severity_score(spark, sf_dir):
    return cl.add_score(news(spark, sf_dir), PACK).select("ordinal", "score")


@query(f"WITH {CLASSIFIED} SELECT ordinal, score, CASE WHEN score < 4 THEN 'score ' || score || ' below minimum 4' END AS score_rejection FROM judged")
def minimum_score(spark, sf_dir):
    return cl.minimum_score(classified(spark, sf_dir), 4).select("ordinal", "score", "score_rejection")


@query(f"WITH {CLASSIFIED} SELECT count(*) AS collected, count(*) FILTER (len(matched) > 0) AS about, count(*) FILTER (len(matched) > 0 AND admitted) AS admitted, count(*) FILTER (len(matched) > 0 AND admitted AND score >= 10) AS severe FROM judged")
def stage_counters(spark, sf_dir):
    flagged = classified(spark, sf_dir).withColumns({"about": F.size("matched_topics") > 0, "severe": F.col("score") >= 10})
    return cl.stage_counts(flagged, ["about", "admitted", "severe"])


@query(f"WITH {CLASSIFIED} SELECT ordinal, score, rejection_reason FROM judged WHERE NOT admitted AND len(matched) > 0 ORDER BY score DESC, ordinal LIMIT 5")
def rejected_top5(spark, sf_dir):
    return cl.rejected_report(classified(spark, sf_dir)).select("ordinal", "score", "rejection_reason")


_TAGS = ", ".join(f"'{s}': '{t}'" for s, t in PACK.tags.items())


@query(
    f"WITH {CLASSIFIED}, k AS (SELECT ordinal, list_filter(list_transform(matched, lambda x: (MAP {{{_TAGS}}})[x]), lambda x: x IS NOT NULL) AS g FROM judged) "
    "SELECT ordinal, array_to_string(list_transform(list_filter(range(1, len(g) + 1), lambda i: list_position(g, g[i]) = i), lambda i: g[i])[1:4], ' ') AS tags FROM k"
)
def dim_lookup_tags(spark, sf_dir):
    return classified(spark, sf_dir).select("ordinal", F.array_join(tags(F.col("matched_topics"), PACK), " ").alias("tags"))


@query(f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY")
def freshness_filter(spark, sf_dir):
    return cl.fresh(table(spark, sf_dir, "events"), F.lit(NOW).cast("timestamp"), 3, "ts").select("event_id", "ts")


@query(f"SELECT event_id, ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{NOW}' AS recent FROM events")
def candidate_age_between(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", intake.recent(F.col("ts"), F.lit(NOW).cast("timestamp"), 7).alias("recent"))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_by_source(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang")
def count_by_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 40")
def per_source_limit(spark, sf_dir):
    return cl.limit_per_key(table(spark, sf_dir, "documents"), "source", [F.col("doc_id")]).select("source", "doc_id")


@query("SELECT sha256(coalesce(text, '')) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1")
def first_per_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS cards, max_by(o_orderpriority, struct_pack(a := length(o_orderpriority), b := -o_orderkey)) AS longest, max(o_orderdate) AS latest FROM orders GROUP BY o_custkey")
def card_merge_by_key(spark, sf_dir):
    """Cards of one key merged: the longest title, the first of equal ones, and the latest date."""
    order = F.struct(F.length("o_orderpriority"), -F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cards"), F.max_by("o_orderpriority", order).alias("longest"), F.max("o_orderdate").alias("latest"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END DESC NULLS LAST, o_orderkey) AS place FROM orders")
def null_last_sort_rank(spark, sf_dir):
    dated = F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
    w = Window.partitionBy("o_custkey").orderBy(dated.desc_nulls_last(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("place"))


@query(rf"WITH {NEWS} SELECT ordinal, trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM news")
def title_normalise(spark, sf_dir):
    return news(spark, sf_dir).select("ordinal", tx.normalize_title(F.col("title")).alias("title"))


_CLEAN = "html"
for _e, _c in tx.ENTITIES.items():
    _CLEAN = f"replace({_CLEAN}, '{_e.replace(chr(39), chr(39) * 2)}', '{_c.replace(chr(39), chr(39) * 2)}')"


@query(rf"SELECT page_id, md5(trim(regexp_replace(regexp_replace(coalesce({_CLEAN}, ''), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM pages")
def tag_and_entity_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.clean_description(F.col("html"))).alias("digest"))


@query(r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_host_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.host(F.col("url")).alias("host"), tx.path(F.col("url")).alias("path"))


@query(r"SELECT page_id FROM pages WHERE regexp_full_match(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/[a-z]{2}/\d+/?')")
def direct_url_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(tx.path(F.col("url")).rlike(r"^/[a-z]{2}/\d+/?$")).select("page_id")


@query(r"SELECT page_id, NOT (contains(p, '.html') OR contains(p, '/fr/')) AS usable FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)")
def service_image_filter(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", usable_image(F.col("url"), (".html", "/fr/")).alias("usable"))


@query(r"SELECT count(*) AS checked, count(*) FILTER (NOT contains(p, '.html')) AS available, count(*) FILTER (contains(p, '.html')) AS not_found FROM (SELECT lower(url) AS p FROM pages)")
def image_diag_counters(spark, sf_dir):
    ok = usable_image(F.col("url"), (".html",))
    return table(spark, sf_dir, "pages").agg(F.count(F.lit(1)).alias("checked"), F.count_if(ok).alias("available"), F.count_if(~ok).alias("not_found"))


@query("""SELECT page_id, length(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped FROM pages""".replace("''''", "''''"))
def escaped_length(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.escape_html(F.col("html"))).alias("escaped"))


_WORDS = rf"list_filter(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[a-zà-öø-ÿ]+'), lambda w: length(w) >= 4 AND w NOT IN ({', '.join(repr(w) for w in PACK.stop_words)}))"
_SUFFIXES = "|".join(sorted(PACK.suffixes, key=len, reverse=True))


def stem_sql(w: str) -> str:
    once = f"regexp_replace({w}, '^(.{{4,}}?)(?:{_SUFFIXES})$', '\\1')"
    return f"regexp_replace({once}, '^(.{{4,}}?)(?:{'|'.join(PACK.role_suffixes)})$', '\\1')"


@query(f"SELECT w, {stem_sql('w')} AS stem, count(*) AS n FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY ALL")
def light_stem(spark, sf_dir):
    words = F.filter(tx.extract_all(tx.fold(F.col("text")), PACK.token), lambda w: (F.length(w) >= 4) & ~w.isin(*PACK.stop_words))
    counted = table(spark, sf_dir, "documents").select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("w", tx.stem(F.col("w"), PACK.suffixes, PACK.role_suffixes).alias("stem"), "n")


_NOISE = " OR ".join([f"starts_with(s, '{p}')" for p in PACK.noise_prefixes] + [f"contains(s, '{g}')" for own in PACK.families.values() for g in own])


def tokens_sql(text: str) -> str:
    words = _WORDS.replace("coalesce(text, '')", text)
    return f"list_sort(list_distinct(list_filter(list_transform({words}, lambda w: {stem_sql('w')}), lambda s: length(s) >= 4 AND NOT ({_NOISE}))))"


@query(f"SELECT doc_id, CAST(len(k) AS INTEGER) AS n, md5(array_to_string(k, ' ')) AS digest FROM (SELECT doc_id, {tokens_sql(chr(39) * 2 + ' || coalesce(text, ' + chr(39) * 2 + ')')} AS k FROM documents)")
def token_sets(spark, sf_dir):
    own = table(spark, sf_dir, "documents").select("doc_id", ev.tokens(F.coalesce("text", F.lit("")), PACK).alias("k"))
    return own.select("doc_id", F.size("k").alias("n"), F.md5(F.array_join("k", " ")).alias("digest"))


_PLACES = rf"list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}_])(?:[Ii]n|[Aa]t|[Oo]n)\s+([A-ZÀ-Ö][a-zà-öø-ÿ]{{3,}})', 1), lambda w: {stem_sql('lower(w)')})))"


@query(f"SELECT doc_id, array_to_string({_PLACES}, ' ') AS places FROM documents WHERE text IS NOT NULL")
def location_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(ev.locations(F.col("text"), PACK), " ").alias("places"))


def printed(spark, sf_dir) -> DataFrame:
    items = classified(spark, sf_dir).withColumns({"article_text": F.lit(None).cast("string"), "image_url": F.lit(None).cast("string")})
    return ev.fingerprint(items, PACK)


_BODY = "title || ' ' || substr(description, 1, 1600)"
_FAMILIES = "list_sort(list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'''contains(array_to_string(strong, ' '), '{s}')''' for s in stems)} THEN '{f}' END" for f, stems in PACK.families.items()) + "], lambda x: x IS NOT NULL))"
_NAMED = "list_concat(strong, CASE WHEN severe THEN [cond[1] || ' + ' || outc[1]] ELSE [] END)"
PRINTED = f"""{CLASSIFIED}, named AS (SELECT * REPLACE ({_NAMED} AS strong) FROM judged),
prints AS (SELECT ordinal, url, published_at, score, {_FAMILIES} AS topics, {tokens_sql(_BODY)} AS tokens, {_PLACES.replace('text', '(' + _BODY + ')', 1)} AS places FROM named)"""


@query(f"WITH {PRINTED} SELECT ordinal, array_to_string(topics, ',') AS topics, CAST(len(tokens) AS INTEGER) AS n_tokens, CAST(len(places) AS INTEGER) AS n_places FROM prints")
def fingerprint_sizes(spark, sf_dir):
    p = printed(spark, sf_dir)
    return p.select("ordinal", F.array_join("event_fingerprint.topics", ",").alias("topics"), F.size("event_fingerprint.tokens").alias("n_tokens"), F.size("event_fingerprint.locations").alias("n_places"))


@query(
    f"""WITH {PRINTED}, c AS (SELECT a.ordinal AS l_id, b.ordinal AS r_id, len(list_intersect(a.tokens, b.tokens)) AS n, len(a.tokens) AS x, len(b.tokens) AS y, list_has_any(a.places, b.places) AS placed
  FROM prints a JOIN prints b ON a.ordinal < b.ordinal AND b.ordinal - a.ordinal <= 36 WHERE list_has_any(a.topics, b.topics) AND len(a.tokens) > 0 AND len(b.tokens) > 0)
SELECT l_id, r_id, CAST(n AS INTEGER) AS shared, round(n / least(x, y), 6) AS overlap, round(n / (x + y - n), 6) AS jaccard FROM c
WHERE n >= 5 AND n / least(x, y) >= 0.45 AND (placed OR (n >= 7 AND n / (x + y - n) >= 0.20))"""
)
def event_pairs_blocked(spark, sf_dir):
    """Pairs of one event within 36 hours by rare tokens in family and time bucket."""
    p = printed(spark, sf_dir).select("ordinal", "published_at", "event_fingerprint").transform(materialize)
    found = pairs.event_pairs(p, p).where("l_id < r_id")
    return found.select("l_id", "r_id", F.size("details.shared_tokens").alias("shared"), F.round("details.token_overlap", 6).alias("overlap"), F.round("details.token_jaccard", 6).alias("jaccard"))


@query("SELECT a.o_orderkey AS first_key, b.o_orderkey AS second_key FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND abs(epoch(a.o_orderdate) - epoch(b.o_orderdate)) <= 129600")
def interval_pairs_36h(spark, sf_dir):
    side = lambda p: table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic"), F.col("o_orderkey").alias(f"{p}_id"), F.unix_timestamp("o_orderdate").alias(f"{p}_at"), F.floor(F.unix_timestamp("o_orderdate") / 129600).alias(f"{p}_bucket"))
    near = pairs.near_in_time(side("l"), side("r")).where((F.col("l_id") < F.col("r_id")) & (F.abs(F.col("l_at") - F.col("r_at")) <= 129600))
    return near.select(F.col("l_id").alias("first_key"), F.col("r_id").alias("second_key"))


@query()
def greedy_dedup(spark, sf_dir):
    """What remains of admitted items after url, title and event duplicates (2.10)."""
    kept = duplicates.remove_duplicates(printed(spark, sf_dir).where("admitted"), PACK)
    return kept.select("ordinal", "slot_ordinal", "score")


@query(f"WITH {NEWS} SELECT ordinal FROM news WHERE ordinal NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def history_anti_url(spark, sf_dir):
    items, old = news(spark, sf_dir), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ordinal"))
    published = news(spark, sf_dir).join(old.distinct(), "ordinal", "left_semi").select("url")
    return items.join(published, "url", "left_anti").select("ordinal")


@query("SELECT kind, part, count(*) AS n, sum(length(text)) AS chars FROM (SELECT 'document' AS kind, source AS part, text FROM documents UNION ALL SELECT 'chat', role, text FROM conversations) GROUP BY ALL")
def source_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("source").alias("part"), "text")
    chats = table(spark, sf_dir, "conversations").select(F.lit("chat").alias("kind"), F.col("role").alias("part"), "text")
    return docs.unionByName(chats).groupBy("kind", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {PRINTED} SELECT ordinal, CAST(len(list_intersect(tokens, places)) AS INTEGER) AS both, CAST(len(list_distinct(list_concat(tokens, places))) AS INTEGER) AS any_of, CAST(len(list_filter(tokens, lambda x: NOT list_contains(places, x))) AS INTEGER) AS only_tokens FROM prints")
def set_array_ops(spark, sf_dir):
    a, b = F.col("event_fingerprint.tokens"), F.col("event_fingerprint.locations")
    return printed(spark, sf_dir).select("ordinal", F.size(F.array_intersect(a, b)).alias("both"), F.size(F.array_union(a, b)).alias("any_of"), F.size(F.array_except(a, b)).alias("only_tokens"))


_JSON = "'[' || array_to_string(list_transform({0}, lambda x: '\"' || x || '\"'), ',') || ']'"
_KEY = "CASE WHEN len(topics) > 0 AND len(tokens) > 0 AND len(places) > 0 THEN sha256('{\"locations\":' || " + _JSON.format("places") + " || ',\"tokens\":' || " + _JSON.format("tokens") + " || ',\"topics\":' || " + _JSON.format("topics") + " || '}') END"


@query(f"WITH {PRINTED} SELECT ordinal, strftime(published_at, '%Y-%m-%d') || '-' || substr(sha256(url), 1, 12) AS candidate_id, {_KEY} AS event_key FROM prints")
def event_key_sha(spark, sf_dir):
    at = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    return printed(spark, sf_dir).select("ordinal", intake.candidate_id(at, F.col("url")).alias("candidate_id"), intake.event_key(F.col("event_fingerprint")).alias("event_key"))


@query(f"WITH {PRINTED}, k AS (SELECT ordinal, {_KEY} AS event_key FROM prints) SELECT ordinal FROM k QUALIFY event_key IS NULL OR row_number() OVER (PARTITION BY event_key ORDER BY ordinal) = 1")
def first_seen_event_key(spark, sf_dir):
    keyed = printed(spark, sf_dir).select("ordinal", intake.event_key(F.col("event_fingerprint")).alias("key"))
    group = F.coalesce("key", F.concat(F.lit("#"), F.col("ordinal").cast("string")))
    return keyed.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("ordinal"))).where("n = 1").select("ordinal")


@query("WITH h AS (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders) SELECT position, o_orderkey FROM h WHERE position >= 100 AND position < 200 AND o_orderdate <= TIMESTAMP '1999-01-01'")
def cursor_scan_prefix(spark, sf_dir):
    """A bounded scan from a cursor on: the hundred rows after the first hundred in key order."""
    first = table(spark, sf_dir, "orders").orderBy("o_orderkey").limit(200)
    placed = first.withColumn("position", (F.row_number().over(Window.orderBy("o_orderkey")) - 1).cast("long"))
    return placed.where((F.col("position") >= 100) & (F.col("o_orderdate") <= F.lit("1999-01-01").cast("timestamp"))).select("position", "o_orderkey")


@query(
    """WITH a AS (SELECT conv_id AS message_id, min(text) AS text, CAST(NULL AS VARCHAR) AS source_url FROM conversations WHERE role = 'user' GROUP BY 1),
b AS (SELECT conv_id AS message_id, max(text) AS text, CASE WHEN count(*) > 1 THEN 'https://example.org/' || conv_id END AS source_url FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT coalesce(a.message_id, b.message_id) AS message_id, CASE WHEN a.message_id IS NULL THEN 'insert' WHEN b.source_url IS NOT NULL THEN 'link' ELSE 'keep' END AS action,
  md5(CASE WHEN a.message_id IS NULL OR b.source_url IS NOT NULL THEN b.text ELSE a.text END) AS text, CASE WHEN a.message_id IS NULL OR b.source_url IS NOT NULL THEN b.source_url END AS source_url
FROM a FULL JOIN b ON a.message_id = b.message_id"""
)
def upsert_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "message_id")
    none = F.lit(None).cast("string")
    old = rows.where("role = 'user'").groupBy("message_id").agg(F.min("text").alias("text")).withColumns({"published_at": none, "image_url": none, "source_url": none})
    link = F.when(F.count(F.lit(1)) > 1, F.concat(F.lit("https://example.org/"), F.col("message_id").cast("string")))
    new = rows.where("role = 'assistant'").groupBy("message_id").agg(F.max("text").alias("text"), link.alias("source_url")).withColumns({"published_at": none, "image_url": none})
    return feed.upsert(old, new).select("message_id", "action", F.md5("text").alias("text"), "source_url")


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def feed_sort_tail(spark, sf_dir):
    return feed.tail(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


def cards(spark, sf_dir) -> DataFrame:
    """Labelled documents as event cards."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select(
        F.col("doc_id").cast("string").alias("event_id"), F.lit("crime").alias("section"), F.when(F.col("quality") == 1, "ready").otherwise("draft").alias("publication_status"),
        F.substring_index("text", "\n", 1).alias("title"), F.coalesce("text", F.lit("")).alias("summary"), F.array("source").alias("sources"),
        F.when(F.col("n_chars") > 500, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("updates"), (F.col("toxic") == 1).alias("demo"), F.lit("2024-01-01T00:00:00.000Z").alias("lastmod"),
    )


_SHOWN = "quality = 1 AND trim(coalesce(text, '')) <> '' AND (coalesce(toxic = 1, FALSE) OR n_chars > 500)"


@query(f"SELECT CAST(doc_id AS VARCHAR) AS event_id FROM documents LEFT JOIN labels USING (doc_id) WHERE {_SHOWN}")
def publishable_filter(spark, sf_dir):
    return cards(spark, sf_dir).where(feed.publishable()).select("event_id")


@query(
    f"""SELECT '  <url>' || chr(10) || '    <loc>https://example.org' || path || '</loc>' || last || chr(10) || '    <changefreq>' || freq || '</changefreq>' || chr(10) || '    <priority>' || prio || '</priority>' || chr(10) || '  </url>' AS xml
FROM (SELECT '/' AS path, 'weekly' AS freq, '1.0' AS prio, '' AS last UNION ALL SELECT '/a&amp;b/', 'daily', '0.9', ''
UNION ALL SELECT '/crime/' || doc_id || '/', 'weekly', '0.8', chr(10) || '    <lastmod>2024-01-01T00:00:00.000Z</lastmod>' FROM documents LEFT JOIN labels USING (doc_id) WHERE {_SHOWN} AND NOT coalesce(toxic = 1, FALSE))"""
)
def sitemap_rows(spark, sf_dir):
    static = spark.createDataFrame([("/", "weekly", "1.0"), ("/a&b/", "daily", "0.9")], "path string, changefreq string, priority string")
    return feed.sitemap_rows(static, cards(spark, sf_dir), "https://example.org/").select("xml")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS event_id, (SELECT string_agg(n_name, ',' ORDER BY n_nationkey DESC) FROM nation WHERE n_regionkey = r_regionkey) AS related FROM region")
def related_lookup(spark, sf_dir):
    """Ids listed on a row looked up in the order listed; unknown ids are left out."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("event_id"), F.col("n_name").alias("title"), F.array().cast("array<string>").alias("related_events"))
    ids = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey"), asc=False).alias("ids"))
    named = F.concat(F.array(F.lit("unknown")), F.transform("ids", lambda i: F.concat(F.lit("n"), i.cast("string"))))
    regions = table(spark, sf_dir, "region").join(ids, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("r_regionkey").cast("string").alias("event_id"), F.col("r_name").alias("title"), named.alias("related_events"))
    found = feed.related(regions.unionByName(nations)).where(~F.startswith("event_id", F.lit("n")))
    return found.select("event_id", F.array_join("related", ",").alias("related"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT lang, count(*) AS n, count(quality) AS labelled, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_join_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query("SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def rfc822_dates(spark, sf_dir):
    """Dates as feeds write them, parsed again."""
    written = F.concat(F.lit("Fri, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    return table(spark, sf_dir, "events").select("event_id", rfc822(written).alias("parsed"))


@query("SELECT event_id, date_trunc('minute', ts) AS parsed FROM events")
def listing_dates(spark, sf_dir):
    """Dates as listings write them, parsed again in their zone."""
    from wirelens.functions.dates import month_name

    local = F.from_utc_timestamp("ts", "Asia/Novosibirsk")
    written = F.concat(F.dayofmonth(local).cast("string"), F.lit(" "), month_name(F.month(local)), F.lit(", "), F.year(local).cast("string"), F.lit(", "), F.date_format(local, "H:mm"))
    return table(spark, sf_dir, "events").select("event_id", publication_date(written, F.lit("Asia/Novosibirsk"), F.lit(NOW).cast("timestamp")).alias("parsed"))


@query("SELECT o_orderkey, year(o_orderdate) || ' год' AS label FROM orders")
def event_date_years(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", event_date_label(F.year("o_orderdate").cast("string")).alias("label"))


_LINES = r"list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))"


@query(
    f"""WITH l AS (SELECT doc_id, list_filter({_LINES}, lambda x: x <> '') AS p FROM documents),
s AS (SELECT doc_id, p, list_position(list_transform(p, lambda x: starts_with(lower(x), 'copyright')), TRUE) AS stop FROM l)
SELECT doc_id, md5(array_to_string(list_filter(CASE WHEN stop > 0 THEN p[1:stop - 1] ELSE p END, lambda x: NOT starts_with(lower(x), 'the ')), chr(10) || chr(10))) AS digest FROM s"""
)
def article_clean_takewhile(spark, sf_dir):
    """Lines up to the footer, without service lines."""
    from wirelens.sources.article import clean_paragraphs

    lines = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_paragraphs(lines, ("copyright",), ("the ",))).alias("digest"))


def _escaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


def _unescaped(x: str) -> str:
    return f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', chr(39)), '&amp;', '&')"


def _short(source: str, text: str, limit: str, into: str) -> str:
    """CTEs that cut column text of source to limit escaped characters, as column of into."""
    lines = rf"list_transform(regexp_split_to_array(coalesce({text}, ''), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g')))"
    end = rf"regexp_extract(cut, '(?s)^(.*[.!?])[ \n]', 1)"
    word = r"regexp_extract(cut, '(?s)^(.+)[ \n]', 1)"
    return f"""{into}1 AS (SELECT *, array_to_string(list_filter({lines}, lambda x: x <> ''), chr(10) || chr(10)) AS clean FROM {source}),
{into}2 AS (SELECT *, {_escaped('clean')} AS esc FROM {into}1),
{into}3 AS (SELECT *, rtrim({_unescaped(f"regexp_replace(substr(esc, 1, greatest({limit} - 1, 0)), '&[^;]*$', '')")}, ' ' || chr(10)) AS cut FROM {into}2),
{into}4 AS (SELECT *, rtrim(CASE WHEN {end} <> '' AND length({end}) - 1 >= length(cut) // 2 THEN {end} WHEN {word} <> '' THEN {word} ELSE cut END, ' ' || chr(10)) AS kept FROM {into}3),
{into} AS (SELECT * EXCLUDE (clean, esc, cut, kept), CASE WHEN length(esc) <= greatest({limit}, 0) THEN clean WHEN kept <> '' THEN kept || '…' ELSE '' END AS {into}_text FROM {into}4)"""


_TAGGED = ", ".join(f"CASE WHEN list_contains(matched, '{t}') THEN '{tag}' END" for t, tag in ((t, PACK.tags[t]) for t in PACK.topics if t in PACK.tags))
#: Tags in the topics' order, each once, at most four.
_TAGS = f"list_filter([{_TAGGED}], lambda x: x IS NOT NULL)"
_ONCE = "array_to_string(list_filter(tags, lambda x, i: NOT list_contains(tags[1:i - 1], x))[1:4], ' ')"
_MONTH = "['января','февраля','марта','апреля','мая','июня','июля','августа','сентября','октября','ноября','декабря'][month(published_at)]"


@query(
    f"""WITH {CLASSIFIED}, tagged AS (SELECT ordinal, title, description, source, url, published_at, {_TAGS} AS tags FROM judged), {_short('tagged', 'title', '500', 'head')},
framed AS (SELECT *, '🔴 <b>' || {_escaped('head_text')} || '</b>' AS head, '📅 ' || day(published_at) || ' ' || {_MONTH} || ' ' || year(published_at) || chr(10) || '📰 ' || {_escaped('source')} || chr(10) || chr(10) || '🔗 <a href="' || {_escaped('url')} || '">Читать источник</a>' || CASE WHEN len(tags) > 0 THEN chr(10) || chr(10) || {_ONCE} ELSE '' END AS foot FROM head),
roomy AS (SELECT *, greatest(0, 3996 - length(head) - length(foot)) AS room FROM framed), {_short('roomy', 'description', 'room', 'body')},
posts AS (SELECT ordinal, head || CASE WHEN body_text <> '' THEN chr(10) || chr(10) || {_escaped('body_text')} ELSE '' END || chr(10) || chr(10) || foot AS post FROM body)
SELECT ordinal, length(post) AS n, md5(post) AS digest FROM posts"""
)
def render_post_length(spark, sf_dir):
    posts = render(classified(spark, sf_dir).withColumn("article_text", F.lit(None).cast("string")), PACK)
    return posts.select("ordinal", F.length("post").alias("n"), F.md5("post").alias("digest"))


@query(f"WITH {_short('documents', 'text', '300', 'short')} SELECT doc_id, short_text AS short FROM short")
def truncate_escaped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", truncate(F.col("text"), F.lit(300)).alias("short"))


@query()
def article_paragraphs(spark, sf_dir):
    """Paragraphs of raw pages."""
    from wirelens.sources.article import article_text

    return table(spark, sf_dir, "pages").select("page_id", article_text(F.col("html"), F.lit(None).cast("string")).alias("text"))


@query()
def title_similarity_pairs(spark, sf_dir):
    """Pairs of documents' titles that are alike (A7); a title that several have stands for the least of them."""
    rows = news(spark, sf_dir).select("ordinal", tx.normalize_title(F.col("title")).alias("title"))
    return ev.title_pairs(rows.groupBy("title").agg(F.min("ordinal").alias("id"))).select("l_id", "r_id")
