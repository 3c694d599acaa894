"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import decontamination, language, line_dedup, near_dup, packing, quality, repeats, sharding, token_files, warc
from quernstone.llm.shared import ship


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.learn_and_identify(_table(spark, sf_dir, "documents"), per_language=4000, one_in=5)


def op5_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.revisits_of_pages(_table(spark, sf_dir, "pages"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=50, stored=True)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, size=2048)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.find_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return decontamination.digest(hits).drop("text_hash", "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), 16)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_token_files": op3_token_files,
    "op4_language": op4_language,
    "op5_revisits": op5_revisits,
    "op6_repeats": op6_repeats,
    "op7_packing": op7_packing,
    "op8_decontamination": op8_decontamination,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
}

_OP1_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE coalesce(text, '') <> ''),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
m AS (SELECT doc_id, line, pos, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
s AS (SELECT *, row_number() OVER w AS i, pos - coalesce(lag(pos) OVER w, -1) - 1 AS above, coalesce(lead(pos) OVER w, size) - pos - 1 AS below
      FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS size FROM m) WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
p AS (SELECT e.doc_id AS e, d.doc_id AS d, d.i - e.i AS diag, d.i AS i, d.n AS n, d.pos AS pos, d.above = e.above AS same, least(d.above, e.above) AS above, least(d.below, e.below) AS below
      FROM s d JOIN s e ON e.key = d.key AND e.doc_id < d.doc_id),
g AS (SELECT *, sum(CASE WHEN same AND was = i - 1 THEN 0 ELSE 1 END) OVER (PARTITION BY e, d, diag ORDER BY i) AS run
      FROM (SELECT *, lag(i) OVER (PARTITION BY e, d, diag ORDER BY i) AS was FROM p)),
r AS (SELECT DISTINCT d AS doc_id, min(pos) - arg_min(above, i) AS a, max(pos) + 1 + arg_max(below, i) AS b FROM g GROUP BY e, d, diag, run HAVING sum(n) >= 10),
c AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS pos FROM r),
k AS (SELECT m.doc_id, count(*) AS n_lines, sum(m.n) AS n_words, count(c.pos) AS cut, coalesce(sum(m.n) FILTER (c.pos IS NOT NULL), 0) AS cut_words, string_agg(m.line, chr(10) ORDER BY m.pos) FILTER (c.pos IS NULL) AS kept
      FROM m LEFT JOIN c ON c.doc_id = m.doc_id AND c.pos = m.pos GROUP BY m.doc_id),
h AS (SELECT doc_id, count(*) AS n_blocks FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM c) WHERE was IS NULL OR was < pos - 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(cut, 0) AS BIGINT) AS n_removed_lines,
       CAST(coalesce(cut_words, 0) AS BIGINT) AS n_removed_words, CAST(coalesce(n_blocks, 0) AS BIGINT) AS n_blocks, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN h ON h.doc_id = d.doc_id
"""

_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[s + 1:s + least(13, len(ws))], ' ') AS win
      FROM (SELECT item_id, ws, unnest(range(0, greatest(1, len(ws) - 12))) AS s FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, s, n, array_to_string(ws[s + 1:s + n], ' ') AS win
      FROM (SELECT doc_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS (SELECT p.doc_id, p.s, p.n, w.item_id FROM p JOIN w ON p.n = w.n AND p.win = w.win),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM h) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""

_OP5_SQL = r"""
WITH a AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(url, '#(?s).*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages WHERE page_id IS NOT NULL),
b AS (SELECT *, regexp_extract(bare, '^[^?]*') AS place, regexp_extract(bare, '^[^/?]*') AS host FROM a),
c AS (SELECT *, list_sort(list_filter(string_split(substr(bare, length(place) + 2), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[A-Za-z]+|ref|fbclid|gclid)(=|$)'))) AS kept FROM b),
k AS (SELECT page_id, html, '"' || substr(md5(html), 1, 16) || '"' AS tag,
             regexp_replace(regexp_replace(lower(host), ':(80|443)$', ''), '^www\.', '') || regexp_replace(substr(place, length(host) + 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key FROM c),
f AS (SELECT v.page_id, max(r.page_id) AS response_page_id FROM k v JOIN k r ON r.url_key = v.url_key AND (r.page_id < v.page_id + 6000) GROUP BY v.page_id),
j AS (SELECT k.page_id, k.url_key, f.response_page_id, k.tag, r.tag AS old_tag, r.html AS old_html FROM k LEFT JOIN f ON f.page_id = k.page_id LEFT JOIN k r ON r.page_id = f.response_page_id)
SELECT DISTINCT page_id, url_key, CASE WHEN response_page_id IS NULL THEN 'missing' WHEN tag = old_tag THEN 'resolved' ELSE 'mismatch' END AS outcome, response_page_id,
  md5(CASE WHEN tag = old_tag THEN 'content-length: ' || strlen(old_html) || chr(10) || 'content-type: text/html' || chr(10) || 'date: t' || (page_id + 6000) || chr(10) || 'etag: W/' || tag || chr(10) || 'x-cache: HIT'
  ELSE 'connection: close' || chr(10) || 'content-length: 0' || chr(10) || 'date: t' || (page_id + 6000) || chr(10) || 'etag: W/' || tag || chr(10) || 'x-cache: HIT' END) AS headers_md5
FROM j
"""

_OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[k + 1:k + least(5, len(ws))], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS k FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS z FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.z),
m AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_OP6_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM d WHERE n >= 50)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS x FROM w JOIN f ON w.g = f.g WHERE first < doc_id),
r AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (head) AS n_spans FROM (SELECT doc_id, x, coalesce(x > lag(x) OVER (PARTITION BY doc_id ORDER BY x) + 1, true) AS head FROM c) GROUP BY doc_id),
b AS (SELECT doc_id, h, unnest(range(0, n)) AS x FROM d WHERE doc_id IN (SELECT doc_id FROM r)),
k AS (SELECT b.doc_id, string_agg(substr(h, 2 * b.x + 1, 2), '' ORDER BY b.x) AS kept FROM b LEFT JOIN c ON c.doc_id = b.doc_id AND c.x = b.x WHERE c.x IS NULL GROUP BY b.doc_id)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN r.doc_id IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

_OP10_SQL = r"""
WITH t AS (SELECT list_transform(range(256), lambda x: list_reduce([CAST(x AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
d AS (SELECT doc_id, coalesce(text, '') AS s, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size FROM documents),
b AS (SELECT doc_id, s, size, hex(encode(s)) AS h FROM d),
k AS (SELECT doc_id, size, CAST('0x' || substr(md5(s), 1, 15) AS BIGINT) AS key,
             CAST(xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS UBIGINT))), lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) AS BIGINT) AS text_crc32 FROM b, t),
p AS (SELECT *, sum(size) OVER w - size AS above, row_number() OVER w AS place, sum(size) OVER () AS total FROM k WINDOW w AS (ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CAST(least(15, floor((above + size / 2.0) * 16 / CAST(total AS DOUBLE))) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(place - min(place) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""

#: The patterns as DuckDB's regular expressions spell them.
_MARKS, _LINKS, _PUNCTUATION = (re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", x) for x in (quality.MARKS, quality.LINKS, quality.PUNCTUATION))

_OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, g) AS times FROM (SELECT doc_id, s, ws[s + 1:s + 3] AS g FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS s FROM d WHERE len(ws) > 2))),
r AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS x FROM w WHERE times > 1) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d)),
m AS (SELECT *, len(ws) AS n, strlen(array_to_string(ws, '')) AS size FROM (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM l) WHERE len(ws) > 0),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
             row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 3 OR row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) <= 3 AS edge FROM m),
f AS (SELECT doc_id, n, dup, dup
  OR length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > CAST(0.12 AS DOUBLE) * size
  OR n >= 4 AND len(list_filter(ws, lambda x: regexp_full_match(x, '{_MARKS}'))) >= greatest(2, CAST(0.2 AS DOUBLE) * n)
  OR strlen(array_to_string(regexp_extract_all(line, '{_LINKS}'), '')) >= CAST(0.5 AS DOUBLE) * size
  OR n >= 8 AND length(line) - length(regexp_replace(line, '[!\x{{ff01}}]', '', 'g')) >= CAST(0.5 AS DOUBLE) * n
  OR n >= 12 AND len(list_distinct(ws)) < CAST(0.34 AS DOUBLE) * pow(n, CAST(0.9 AS DOUBLE))
  OR (n >= 30 OR size >= greatest(360, 40 * n)) AND NOT regexp_matches(line, '{_PUNCTUATION}')
  OR n <= 20 AND (regexp_matches(line, '{quality.PHRASES}', 'i') OR edge AND regexp_matches(line, '{quality.LEGAL}')) AS bad FROM e),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup, count(*) FILTER (bad) AS n_bad, coalesce(sum(n) FILTER (NOT bad), 0) AS good FROM f GROUP BY doc_id),
c AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_bad, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(good, 0) AS BIGINT) AS words_kept
      FROM d LEFT JOIN r ON r.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - words_kept) <= 50 * n_words AS kept FROM c
"""

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": _OP1_SQL, "op2_near_duplicates": _OP2_SQL, "op6_repeats": _OP6_SQL, "op5_revisits": _OP5_SQL, "op8_decontamination": _OP8_SQL, "op9_quality": _OP9_SQL, "op10_sharding": _OP10_SQL}
