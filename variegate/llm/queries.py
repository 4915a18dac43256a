"""The queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variegate.llm import (decontamination, html_text, language, mixing, neighbours, pieces,
                           quality, sharding, simhash, suffixes, tries, url_filter, whitening)
from variegate.llm.common import fold, table
from variegate.llm.vocabulary import read_vocabulary

# The rules of the query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"),
             ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
# Hosts whose URLs make up the list of the query: a label with one of these words.
LISTED_HOSTS = r"(^|\.)[^.]*(casino|pills|bets|ads-track)[^.]*\."

# The public vocabulary of the language model and the pieces; only the driver reads the file.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.fit(docs, labels, fold(F.col("doc_id"), 5) != 0)
    return quality.score_quality(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= quality.CUT).cast("int").alias("predicted"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return neighbours.nearest(vectors, F.col("vec_id") % 50 == 0, 5)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = language.fit(docs.where(~held_out), read_vocabulary(VOCABULARY))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.mark_contamination(
        table(spark, sf_dir, "documents", "doc_id", "text"),
        table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        decontamination.items_digest(F.col("hit_items")).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return suffixes.remove_repeats(docs).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return sharding.kd_shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces, byte pieces and a digest of the ids of every text, and whether it decodes to itself."""
    vocabulary = read_vocabulary(VOCABULARY)
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rows = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    low, high = int(vocabulary["byte_ids"].min()), int(vocabulary["byte_ids"].max())
    return rows.select(
        "doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).cast("long").alias("n_pieces"),
        pieces.fallbacks(F.col("piece_ids"), low, high).alias("n_byte_pieces"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url", "html")
    return html_text.extract(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)) \
        .select(url_filter.canonical(F.col("url")).alias("canonical"))
    return url_filter.judge_urls(pages, listed, URL_RULES) \
        .select("page_id", "host", "path", "rule", "verdict")


def op11_qdwh_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (
    op1_bradley_terry, op2_simhash_pivots, op3_multiprobe, op4_language, op5_decontamination,
    op6_suffix_arrays, op7_kd_sharding,
    op8_sentence_pieces, op9_site_templates, op10_url_filter,
    op11_qdwh_whitening, op12_prefix_trie, op13_golden_mix)}

ORACLES = {
    "op5_decontamination": r"""
WITH plain AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n,
    array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS w
  FROM items, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') AS w
  FROM plain, sizes, unnest(range(1, len(words) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, item_id, i, p.n FROM places p JOIN windows USING (w, n)),
counts AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(j)
  GROUP BY doc_id),
found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
    array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names
  FROM hits GROUP BY doc_id)
SELECT p.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM plain p LEFT JOIN counts USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_url_filter": r"""
WITH cut AS (
  SELECT page_id, url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''),
      '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))) AS fields
  FROM pages),
named AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '')
    || regexp_replace(path, '/+$', '')
    || CASE WHEN len(fields) > 0 THEN '?' || array_to_string(fields, '&') ELSE '' END END AS name,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1')
           THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/')
           THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM cut),
listed AS (
  SELECT DISTINCT name FROM named WHERE name IS NOT NULL
    AND regexp_matches(host, '(^|\.)[^.]*(casino|pills|bets|ads-track)[^.]*\.'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN l.name IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM named n LEFT JOIN listed l ON n.name = l.name""",
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      coalesce(role, ''), coalesce(text, '')) - 1 AS at,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - (conv_id % 5 + 5) % 5 AS base, xor(4294967295, list_reduce(
      list_prepend(4294967295::UBIGINT,
        list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda a, c: list_reduce(list_prepend(xor(a, c), list_transform(range(8),
        lambda i: i::UBIGINT)), lambda y, i: xor(y >> 1, 3988292384::UBIGINT * (y & 1)))
    ))::BIGINT % 9 AS h, count(*) AS own
  FROM turns GROUP BY conv_id),
headed AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.own, 0)) AS shared
  FROM convs c LEFT JOIN convs b ON c.base = b.conv_id),
rebuilt AS (
  SELECT h.conv_id, t.at, t.role, t.text
  FROM headed h JOIN turns t ON t.conv_id = h.base AND t.at < h.h
  UNION ALL
  SELECT h.conv_id, t.at - h.h + h.shared, t.role, t.text
  FROM headed h JOIN turns t ON t.conv_id = h.conv_id AND t.at >= h.h),
whole AS (
  SELECT c.conv_id, coalesce(list({'role': r.role, 'text': r.text} ORDER BY r.at)
    FILTER (r.at IS NOT NULL), []) AS seq
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
members AS (
  SELECT conv_id, d AS depth, seq[:d] AS path, len(seq) AS size
  FROM whole, unnest(range(len(seq) + 1)) AS t(d)),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(path[depth].text) ELSE 0 END AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
      FILTER (size = depth), '')) AS ends_sha256
  FROM members GROUP BY path, depth),
kids AS (SELECT path[:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
sums AS (
  SELECT seq[:d] AS path, sum(saved) AS saved, sum((k.n IS NULL)::INT) AS leaves
  FROM (SELECT path AS seq, depth, saved FROM nodes) n LEFT JOIN kids k ON n.seq = k.path,
    unnest(range(n.depth + 1)) AS t(d)
  GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id,
  n.n_convs::BIGINT AS n_convs, coalesce(k.n, 0)::BIGINT AS n_children,
  s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON n.path = s.path LEFT JOIN kids k ON n.path = k.path
  LEFT JOIN nodes p ON n.depth > 0 AND n.path[:n.depth - 1] = p.path""",
    "op13_golden_mix": r"""
WITH docs AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM docs GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][(no % 3)::INT + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (
      ORDER BY cap / w, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY cap / w, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM weighted),
level AS (
  SELECT rest, heavy FROM levels WHERE cap > rest * w / heavy ORDER BY cap / w, no LIMIT 1),
targets AS (
  SELECT source, no, source_size,
    coalesce(least(cap, (SELECT rest FROM level) * w / (SELECT heavy FROM level)), cap) AS target
  FROM weighted),
placed AS (
  SELECT d.doc_id, d.size, t.*, sum(d.size) OVER (PARTITION BY t.no ORDER BY k, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - d.size AS first,
    row_number() OVER () AS id
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
blocks AS (
  SELECT no, source_size, floor(target)::BIGINT AS quota, block, pass,
    least(512, source_size - 512 * block)::BIGINT AS words
  FROM targets, unnest(range((source_size + 511) // 512)) AS b(block), (VALUES (0), (1)) AS p(pass)
  WHERE pass * source_size < floor(target)),
uses AS (
  SELECT no, block, least(words, quota - pass * source_size - coalesce(sum(words) OVER (
    PARTITION BY no, pass ORDER BY md5(pass || ':' || block), block
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS take
  FROM blocks),
cut AS (
  SELECT id, no, first, size, block
  FROM placed, unnest(range(first // 512, (first + size - 1) // 512 + 1)) AS b(block) WHERE size > 0),
found AS (
  SELECT id, sum(greatest(0, least(first + size, block * 512 + take)
    - greatest(first, block * 512))) AS taken
  FROM cut JOIN uses USING (no, block) WHERE take > 0 GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN found USING (id)""",
}
