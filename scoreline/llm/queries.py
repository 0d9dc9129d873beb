"""The numbered queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.llm import ann, chat, decontam, neardup, packing, phrases, quality, ranked, secrets, shards, substrings, tokens, urls
from scoreline.llm.common import limit_batches, table

WORD_BPE = "word_bpe_49k.json"

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secrets", lambda s: s.kind.isin(*secrets.BASE))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path(WORD_BPE)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation against itself with another one's last answer; see chat.answer_pairs."""
    pairs = chat.answer_pairs(table(spark, sf_dir, "conversations"))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.start, s.end)), ",")
    return pairs.withColumns({"chosen_spans": spans("chosen_spans"), "rejected_spans": spans("rejected_spans")})


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", quality.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_rows(table(spark, sf_dir, "documents"), 8, keep=["doc_id"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    limit_batches(spark)
    return phrases.mine_phrases(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_benchmark_decontamination,
        op3_token_counts,
        op4_chat_formatting,
        op5_quality_classifier,
        op6_url_filters,
        op7_minhash_near_dedup,
        op8_nearest_neighbours,
        op9_sharding,
        op10_packing,
        op11_ranked_lexical_search,
        op12_substring_dedup,
        op13_phrase_collocations,
    )
}

ORACLE: dict[str, str] = {}

ORACLE["op6_url_filters"] = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*(/[^?#]*)', 1) AS path
  FROM parts),
rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost) * 10000 + length(rpath)) AS rule,
         arg_max(verdict, length(rhost) * 10000 + length(rpath)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut c LEFT JOIN fit f ON c.page_id = f.page_id
"""

ORACLE["op4_chat_formatting"] = r"""
WITH own AS (
  SELECT conv_id AS pair_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT pair_id, max(n) FILTER (role = 'assistant') AS last FROM own GROUP BY pair_id),
given AS (SELECT pair_id, role, text FROM own JOIN ends USING (pair_id) WHERE n = last),
rings AS (
  SELECT e.pair_id, CASE WHEN g.pair_id IS NOT NULL THEN {'role': role, 'text': text} END AS own,
         CAST('0x' || substr(md5(CAST(e.pair_id AS VARCHAR)), 1, 8) AS BIGINT) % greatest(1, (SELECT (count(*) + 999) // 1000 FROM given)) AS ring
  FROM ends e LEFT JOIN given g ON e.pair_id = g.pair_id),
others AS (
  SELECT pair_id, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY ring ORDER BY pair_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                           last_value(own IGNORE NULLS) OVER (PARTITION BY ring ORDER BY pair_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS other
  FROM rings),
answers AS (SELECT pair_id, other.role AS role, other.text AS text FROM others WHERE other IS NOT NULL),
t AS (
  SELECT pair_id, 0 AS side, role, text, n FROM own
  UNION ALL SELECT pair_id, 1, role, text, n FROM own JOIN ends USING (pair_id) WHERE last IS NULL OR n < last
  UNION ALL SELECT pair_id, 1, a.role, a.text, coalesce(e.last, (SELECT max(n) + 1 FROM own o WHERE o.pair_id = a.pair_id)) FROM answers a JOIN ends e USING (pair_id)),
k AS (SELECT pair_id, n, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM t GROUP BY pair_id, n),
p AS (SELECT pair_id, CAST(coalesce(min(n) FILTER (NOT same) - 1, max(n)) AS INTEGER) AS common_turns FROM k GROUP BY pair_id),
m AS (
  SELECT t.pair_id, side, n, role, text, common_turns, n <= common_turns AS shared,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM t JOIN p ON t.pair_id = p.pair_id),
w AS (SELECT *, sum(length(shown)) OVER (PARTITION BY pair_id, side, shared ORDER BY n) AS stop FROM m)
SELECT pair_id, any_value(common_turns) AS common_turns,
       coalesce(string_agg(shown, '' ORDER BY n) FILTER (shared AND side = 0), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY n) FILTER (NOT shared AND side = 0), '') AS chosen,
       coalesce(string_agg((stop - length(text) - 11) || ':' || stop, ',' ORDER BY n) FILTER (NOT shared AND side = 0 AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg(shown, '' ORDER BY n) FILTER (NOT shared AND side = 1), '') AS rejected,
       coalesce(string_agg((stop - length(text) - 11) || ':' || stop, ',' ORDER BY n) FILTER (NOT shared AND side = 1 AND role = 'assistant'), '') AS rejected_spans
FROM w GROUP BY pair_id
"""

ORACLE["op11_ranked_lexical_search"] = r"""
WITH cut AS (
  SELECT 'd' AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
  UNION ALL SELECT 'i', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
terms AS (SELECT kind, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM cut),
tf AS (SELECT kind, id, term, count(*) AS tf FROM terms GROUP BY kind, id, term),
lengths AS (SELECT id, CAST(sum(tf) AS BIGINT) AS n FROM tf WHERE kind = 'd' GROUP BY id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM lengths),
df AS (SELECT term, count(*) AS df FROM tf WHERE kind = 'd' GROUP BY term),
scores AS (
  SELECT i.id AS item_id, d.id AS doc_id,
         CAST(sum(i.tf * CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
                  * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * docs) // total)))) AS BIGINT) AS score
  FROM tf i JOIN df ON i.term = df.term JOIN tf d ON d.kind = 'd' AND d.term = i.term
  JOIN lengths ON lengths.id = d.id CROSS JOIN corpus
  WHERE i.kind = 'i' GROUP BY i.id, d.id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""

ORACLE["op12_substring_dedup"] = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, p, md5(array_to_string(words[p : p + 49], ' ')) AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS p FROM split)),
marked AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM marked),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM split),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
  FROM placed LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""

ORACLE["op13_phrase_collocations"] = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS p FROM split),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS size),
grams AS (
  SELECT lang, size, array_to_string(words[p : p + size - 1], ' ') AS phrase, count(*) AS f
  FROM places JOIN sizes ON p + size - 1 <= len(words) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM grams WHERE size = 1 GROUP BY lang),
found AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f AS a FROM grams WHERE size > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM found),
parts AS (
  SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS BIGINT) AS score
  FROM cuts c JOIN grams l ON l.lang = c.lang AND l.phrase = array_to_string(words[1 : k], ' ')
  JOIN grams r ON r.lang = c.lang AND r.phrase = array_to_string(words[k + 1 :], ' ')),
best AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, array_to_string(words[p : p + s - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(1, size - s + 2)) AS p FROM (SELECT *, unnest(range(2, size)) AS s FROM found))
  GROUP BY ALL),
kept AS (
  SELECT b.* FROM best b LEFT JOIN inner_phrases i ON b.lang = i.lang AND b.phrase = i.phrase
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k
JOIN totals USING (lang) WHERE rank <= 2000
"""
