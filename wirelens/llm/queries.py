"""The numbered queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm.chat import format_chats
from wirelens.llm.common import materialize
from wirelens.llm.decontamination import contamination
from wirelens.llm.fingerprints import compare_with_edits
from wirelens.llm.packing import pack_documents
from wirelens.llm.phrases import collocations
from wirelens.llm.pseudonyms import pseudonymized
from wirelens.llm.repeats import remove_repeats
from wirelens.llm.search import ranked
from wirelens.llm.simhash import near_duplicates
from wirelens.llm.toxicity import toxicity
from wirelens.llm.url_filter import Rule, host_of, judge_urls
from wirelens.llm.vector_dedup import vector_near_duplicates
from wirelens.llm.warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- op6

#: Fixed rules of the query.
URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def thin_hosts(pages: DataFrame) -> DataFrame:
    """key: hosts whose pages are on average shorter (in bytes) than all pages are."""
    sizes = materialize(pages.groupBy(host_of(F.col("url")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")), "hosts")
    whole = sizes.agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    mean = (whole["bytes"] or 0) / (whole["n"] or 1)
    return sizes.where(F.col("bytes") < F.col("n") * F.lit(mean)).select("key")


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts with thin pages are listed for blocking."""
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, URL_RULES, thin_hosts(pages))


OP6_SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), sized AS (
  SELECT host, coalesce(octet_length(encode(html)), 0) AS b FROM split JOIN pages ON split.page_id IS NOT DISTINCT FROM pages.page_id
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN host IN (SELECT host FROM sized GROUP BY host HAVING sum(b) < count(*) * (SELECT sum(b) / count(*) FROM sized)) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
"""

# ---------------------------------------------------------------- op9


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "spans")


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 13) AS n FROM (SELECT item_id, coalesce({_WORDS.format('text')}, []) AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM i)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, dw.n FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# ---------------------------------------------------------------- op5


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


# ---------------------------------------------------------------- op3


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


# ---------------------------------------------------------------- op4


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM h),
r AS (SELECT *, CASE WHEN payload_bytes >= 100 AND (page_id > first OR page_id IS NULL) THEN first END AS refers_to FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

# ---------------------------------------------------------------- op10


def op10_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

# ---------------------------------------------------------------- op2


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("hits")


# ---------------------------------------------------------------- op8

#: In production the key comes from the cluster's secrets; results are reproducible with this one.
PSEUDONYM_KEY = "wirelens-example-key"


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymized(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


# ---------------------------------------------------------------- op7


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


# ---------------------------------------------------------------- op1


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


# ---------------------------------------------------------------- op11


def op11_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
own AS (SELECT * FROM d WHERE len(w) > 0),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM own),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
q AS (SELECT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i),
qt AS (SELECT item_id, text, t, count(*) AS times FROM q GROUP BY ALL),
p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS t FROM own) WHERE t IN (SELECT t FROM qt) GROUP BY ALL),
wt AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT t, count(*) AS df FROM p GROUP BY t), g),
s AS (SELECT item_id, text, row, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM p JOIN wt USING (t) JOIN qt USING (t), g GROUP BY item_id, text, row, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""

# ---------------------------------------------------------------- op12


def op12_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op13


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT lang, m, phrase, a, k, array_to_string(w[:k], ' ') AS left_part, array_to_string(w[k + 1:], ' ') AS right_part FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT k.lang, k.phrase, k.a, x.a AS l, y.a AS r, n, k, CAST((CAST(1000 AS HUGEINT) * k.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.left_part JOIN f y ON y.lang = k.lang AND y.phrase = k.right_part JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT DISTINCT o.lang, array_to_string(o.w[o.s:o.s + o.z - 1], ' ') AS phrase, o.a FROM (SELECT lang, w, a, z, unnest(range(1, m - z + 2)) AS s FROM c, (SELECT unnest(range(2, 5)) AS z) WHERE z < m) o),
x AS (SELECT lang, phrase, max(a) AS a FROM i GROUP BY ALL),
t AS (SELECT b.* FROM b LEFT JOIN x ON x.lang = b.lang AND x.phrase = b.phrase WHERE x.a IS NULL OR 100 * x.a < 100 * b.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t)
SELECT * FROM r WHERE rank <= 2000
"""

QUERIES = {"op11_maxscore": op11_maxscore, "op12_bottom_k": op12_bottom_k, "op13_collocations": op13_collocations, "op1_chat_repair": op1_chat_repair, "op7_repeats": op7_repeats, "op8_pseudonyms": op8_pseudonyms, "op2_toxicity": op2_toxicity, "op10_pivot_index": op10_pivot_index, "op4_warc": op4_warc, "op3_simhash": op3_simhash, "op5_packing": op5_packing, "op9_decontamination": op9_decontamination, "op6_url_cascade": op6_url_cascade}
ORACLES = {"op10_pivot_index": OP10_SQL, "op4_warc": OP4_SQL, "op9_decontamination": OP9_SQL, "op6_url_cascade": OP6_SQL, "op11_maxscore": OP11_SQL, "op13_collocations": OP13_SQL}
