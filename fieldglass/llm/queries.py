"""Registered queries of the operators, each over its whole table, and their DuckDB equivalents where SQL has one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm import content_sort, conversation_trie, importance, mixing, packing, quality, revisits, simhash, substrings, token_files, toxicity, urls, vectors

#: The rules that op3 judges by.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Archive records of a page table: each page is a full response at minute page_id, and one, two or three days later a revisit.

    The revisit carries the entity tag of its own page, so it resolves to that page's response unless another capture of the url came between.
    """
    tag = F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    page = pages.select("page_id", "url", tag.alias("tag"))
    at = F.col("page_id") * 60
    text = lambda s: s.cast("string")
    response = page.select((F.col("page_id") * 2).alias("record_id"), "url", at.cast("double").alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("http_status"), F.create_map(F.lit("ETag"), F.concat(F.lit('"'), "tag", F.lit('"')), F.lit("Date"), text(at), F.lit("Content-Type"), F.lit("text/html")).alias("headers"), F.col("tag").alias("digest"))
    later = at + (F.pmod("page_id", F.lit(3)) + 1) * 86_400
    revisit = page.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", later.cast("double").alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("http_status"), F.create_map(F.lit("etag"), F.concat(F.lit('W/"'), "tag", F.lit('"')), F.lit("date"), text(later), F.lit("content-type"), F.lit("none")).alias("headers"), F.lit(None).cast("string").alias("digest"))
    return response.unionByName(revisit)


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(records_of_pages(_read(spark, sf_dir, "pages")))
    header = lambda name: F.col("headers")[name].alias(name.replace("-", "_"))
    return found.select("record_id", "url_key", "response_id", "status", header("etag"), header("date"), header("content-type"), "digest")


def op3_url_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge_urls(pages, rules, urls.page_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.dedup_substrings(_read(spark, sf_dir, "documents"))).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.neighbours(_read(spark, sf_dir, "embeddings"))


def op6_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_simhash_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_files.write(_read(spark, sf_dir, "documents"))
    return token_files.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.dedup_content(_read(spark, sf_dir, "documents"))


def op12_partition_refinement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(*conversation_trie.rebuilt(*conversation_trie.numbered_turns(_read(spark, sf_dir, "conversations"))))


def op13_suffix_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_cube_mix, op2_warc_revisits, op3_url_classes, op4_phrase_automata, op5_multi_index_hashing, op6_concatenate_and_cut, op7_simhash_blocks, op8_line_rules, op9_clause_grammar, op10_wavelet_shards, op11_content_sort, op12_partition_refinement, op13_suffix_importance)}

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2 = r"""
WITH page AS (SELECT page_id, url, md5(coalesce(html, '')) AS tag FROM pages),
keyed AS (SELECT *, regexp_extract(split_part(trim(url), '#', 1), '^([^:/?#]+)://([^/?#]*)(.*)$', ['s', 'h', 'r']) AS p, split_part(trim(url), '#', 1) AS bare FROM page),
named AS (SELECT page_id, tag, bare, lower(p.s) AS s, lower(p.h) AS h, CASE WHEN starts_with(p.r, '/') THEN p.r ELSE '/' || p.r END AS r FROM keyed),
canon AS (SELECT page_id, tag, CASE WHEN s = '' THEN bare ELSE s || '://' || CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') WHEN s = 'https' THEN regexp_replace(h, ':443$', '') ELSE h END || r END AS url_key FROM named),
base AS (SELECT page_id * 2 AS response_id, page_id * 60 AS ts, url_key, tag FROM canon),
asked AS (SELECT page_id * 2 + 1 AS record_id, page_id * 60 + (page_id % 3 + 1) * 86400 AS ts, url_key, tag FROM canon),
found AS (SELECT a.record_id, a.url_key, a.ts, a.tag, arg_max(b.response_id, (b.ts, b.response_id)) AS response_id, arg_max(b.tag, (b.ts, b.response_id)) AS base_tag
          FROM asked a LEFT JOIN base b ON a.url_key = b.url_key AND (b.ts < a.ts OR b.ts = a.ts AND b.response_id < a.record_id) GROUP BY ALL)
SELECT record_id, url_key, response_id, CASE WHEN response_id IS NULL THEN 'missing' WHEN tag = base_tag THEN 'resolved' ELSE 'mismatch' END AS status,
       CASE WHEN tag = base_tag THEN 'W/"' || tag || '"' END AS etag, CASE WHEN tag = base_tag THEN CAST(ts AS VARCHAR) END AS date,
       CASE WHEN tag = base_tag THEN 'text/html' END AS content_type, CASE WHEN tag = base_tag THEN tag END AS digest
FROM found
"""

OP3 = r"""
WITH RECURSIVE rules(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
tags AS (
  SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>')), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS h FROM pages WHERE html ILIKE '%canonical%'
  UNION SELECT url, regexp_extract(unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>')), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) FROM pages WHERE html ILIKE '%refresh%'),
seen AS (SELECT url, replace(h, '&amp;', '&') AS h, regexp_extract(url, '^[^?#]*') AS bare, regexp_extract(url, '^[^:/?#]+://[^/?#]*') AS site FROM tags),
edges AS (
  SELECT split_part(url, '#', 1) AS a, split_part(CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN site = '' OR h = '' OR starts_with(h, '#') THEN NULL WHEN starts_with(h, '//') THEN regexp_extract(url, '^[^:/?#]+:') || h
    WHEN starts_with(h, '/') THEN site || h WHEN starts_with(h, '?') THEN bare || h WHEN bare = site THEN site || '/' || h ELSE regexp_replace(bare, '[^/]*$', '') || h END, '#', 1) AS b FROM seen),
links AS (SELECT a, b FROM edges WHERE b LIKE '%://%' AND a <> b UNION SELECT b, a FROM edges WHERE b LIKE '%://%' AND a <> b),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, e.b FROM reach r JOIN links e ON r.b = e.a),
urls AS (SELECT DISTINCT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM links),
parts AS (SELECT url, split_part(url, '#', 1) AS bare, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM urls),
ruled AS (SELECT url, bare, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
          FROM parts LEFT JOIN rules ON (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY ALL),
class AS (SELECT r.a AS bare, max(CASE m.rv WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS k FROM reach r JOIN ruled m ON m.bare = r.b GROUP BY ALL)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(rv, CASE k WHEN 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM pages LEFT JOIN ruled USING (url) LEFT JOIN class USING (bare)
"""

OP4 = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS k, doc_id, {WORDS} AS w FROM documents),
win AS (SELECT k, i, md5(array_to_string(w[i:i+19], ' ')) AS h FROM (SELECT k, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
late AS (SELECT k, i FROM win QUALIFY row_number() OVER (PARTITION BY h ORDER BY k, i) > 1),
gone AS (SELECT DISTINCT k, i + unnest(range(0, 20)) AS j FROM late),
word AS (SELECT k, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS x FROM d),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (k, j) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k)
"""

OP8 = rf"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id, text) AS k, doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT k, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT j) AS n_repeat FROM (SELECT k, i + unnest([0, 1, 2]) AS j FROM twice) GROUP BY k),
line AS (SELECT k, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d)),
judged AS (SELECT k, x, n, (n >= {{long_line}} AND NOT regexp_matches(x, $sentence)) OR (n >= 3 AND 2 * len(regexp_extract_all(x, $symbols)) >= n) OR regexp_matches(x, $menu) OR regexp_matches(x, $link)
             OR (len(regexp_extract_all(x, $separators)) >= 3 AND 5 * len(regexp_extract_all(x, $separators)) >= n) OR (n <= 40 AND regexp_matches(x, $boilerplate)) AS bad FROM line WHERE n > 0),
lines AS (SELECT k, count(*) - count(DISTINCT x) AS n_dup, coalesce(sum(n) FILTER (bad), 0) AS lost FROM judged GROUP BY k),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost
         FROM d LEFT JOIN rep USING (k) LEFT JOIN lines USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= n_words AS kept
FROM base
"""


OP11 = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""

#: CRC-32 of a list of bytes by a table that is made from its rule.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], range(8)), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"
CRC = "xor(list_reduce(list_concat([4294967295], {bytes}), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"

OP12 = f"""
WITH {CRC_TABLE},
t AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, key) AS i, key, bytes FROM (SELECT conv_id AS c, turn, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL)),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
conv AS (SELECT n.c, n.n, n.c - n.c % 5 AS b, {CRC.format(bytes="list_transform(string_split(CAST(n.c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 9 AS h FROM n, crc),
known AS (SELECT conv.*, least(h, coalesce(m.n, 0)) AS taken FROM conv LEFT JOIN n m ON m.c = conv.b),
turn AS (SELECT x.c, t.i AS pos, key, bytes FROM known x JOIN t ON t.c = x.b AND t.i <= x.h UNION ALL SELECT x.c, taken + t.i - h, key, bytes FROM known x JOIN t ON t.c = x.c AND t.i > x.h),
link AS (SELECT c, 0 AS pos, '' AS prefix, 0 AS bytes FROM n UNION ALL SELECT c, pos, md5(string_agg(key, '') OVER (PARTITION BY c ORDER BY pos)), bytes FROM turn),
last AS (SELECT c, max(pos) AS total FROM link GROUP BY c),
node AS (SELECT pos, prefix, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes FROM link GROUP BY ALL),
member AS (SELECT link.c, link.pos, node.conv_id FROM link JOIN node USING (pos, prefix)),
leaf AS (SELECT conv_id, pos, max(total) = pos AS is_leaf, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (total = pos), '')) AS ends FROM member JOIN last USING (c) GROUP BY conv_id, pos),
pair AS (SELECT m.conv_id, m.pos, node.pos AS sub_pos, is_leaf, (node.n - 1) * node.bytes AS saved FROM node JOIN leaf USING (conv_id, pos) JOIN member m ON m.c = node.conv_id AND m.pos <= node.pos),
fold AS (SELECT conv_id, pos, count(*) FILTER (sub_pos = pos + 1) AS n_children, count(*) FILTER (is_leaf) AS n_leaves, sum(saved) AS saved FROM pair GROUP BY ALL)
SELECT CAST(f.conv_id AS BIGINT) AS conv_id, CAST(f.pos AS BIGINT) AS depth, CAST(p.conv_id AS BIGINT) AS parent_conv_id, CAST(node.n AS BIGINT) AS n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM fold f JOIN node ON node.conv_id = f.conv_id AND node.pos = f.pos JOIN leaf ON leaf.conv_id = f.conv_id AND leaf.pos = f.pos LEFT JOIN member p ON p.c = f.conv_id AND p.pos = f.pos - 1
"""

OP13 = rf"""
WITH {CRC_TABLE},
texts AS (SELECT 1 AS kind, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 2, row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT kind, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feature AS (SELECT kind, k, f, count(*) AS n FROM (SELECT kind, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM split) GROUP BY ALL),
coded AS (SELECT f, {CRC.format(bytes="list_transform(range(octet_length(encode(f))), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT))")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM feature), crc),
cell AS (SELECT kind, k, bucket, sum(n) AS n FROM feature JOIN coded USING (f) GROUP BY ALL),
total AS (SELECT coalesce(sum(n) FILTER (kind = 1), 0) AS ss, coalesce(sum(n) FILTER (kind = 2), 0) AS tt FROM cell),
gain AS (SELECT bucket, floor(1000 * ln((CAST(coalesce(sum(n) FILTER (kind = 2), 0) AS DOUBLE) + 1) * (CAST(any_value(ss) AS DOUBLE) + 10000) / ((CAST(coalesce(sum(n) FILTER (kind = 1), 0) AS DOUBLE) + 1) * (CAST(any_value(tt) AS DOUBLE) + 10000)))) AS gain FROM cell, total GROUP BY bucket),
weighed AS (SELECT k, sum(n) AS n_features, sum(n * CAST(gain AS BIGINT)) AS weight FROM cell JOIN gain USING (bucket) WHERE kind = 1 GROUP BY k),
scored AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM split LEFT JOIN weighed USING (k) WHERE kind = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) FILTER (n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
"""


def _quoted(sql: str, **patterns: str) -> str:
    for name, pattern in patterns.items():
        sql = sql.replace(f"${name}", "'" + pattern.replace("'", "''") + "'")
    return sql


#: The others have no SQL: op1 draws a balanced sample, op5 is approximate, op6 and op10 need a tokenizer, op7 XXH64, op9 learns.
ORACLES: dict[str, str] = {
    "op2_warc_revisits": OP2,
    "op3_url_classes": OP3,
    "op4_phrase_automata": OP4,
    "op11_content_sort": OP11,
    "op12_partition_refinement": OP12,
    "op13_suffix_importance": OP13,
    "op8_line_rules": _quoted(OP8.replace("{long_line}", "25"), sentence=quality.SENTENCE, symbols=quality.SYMBOLS, menu=quality.MENU, link=quality.LINK, separators=quality.SEPARATORS, boilerplate=quality.BOILERPLATE),
}
