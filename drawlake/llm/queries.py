"""The registered queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from drawlake.llm import ann, chat, decontam, langid, lexical, minhash, packing, pii, quality, repeats, tokens, trie, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_read(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), 400)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), k=5, every=50)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_read(spark, sf_dir, "conversations"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages"), min_bytes=0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return packing.pack(_read(spark, sf_dir, "documents"), (path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_minhash, op3_decontaminate, op4_langid, op5_pii, op6_repeats, op7_neighbours, op8_chat, op9_warc, op10_packing, op11_tokens, op12_lexical, op13_trie)}

_ESCAPED = r"regexp_replace(regexp_replace({x}, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g')"
_CHAT = rf"""
WITH lines AS (
  SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         strlen(coalesce(role, 'unknown')) + strlen(coalesce(text, '')) + 1024 AS cost
  FROM conversations),
numbered AS (
  SELECT *, CAST(coalesce(sum(cost) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4194304 AS BIGINT) AS part FROM lines),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM lines WHERE role <> 'system'),
heads AS (
  SELECT l.conv_id, p.perspective, l.part, l.turn, l.role, l.text AS raw, {_ESCAPED.format(x="l.text")} AS text,
         '<|' || CASE WHEN l.role = p.perspective THEN 'assistant' WHEN l.role = 'system' THEN 'system'
                      ELSE 'user name=' || regexp_replace({_ESCAPED.format(x="l.role")}, '[\r\n]', ' ', 'g') END || '|>' || chr(10) AS head
  FROM numbered l JOIN people p ON l.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (
  SELECT *, row_number() OVER w AS n,
         CAST(coalesce(sum(length(head) + length(text) + 8) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM heads WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY turn, role, raw))
SELECT conv_id, perspective, part, count(*) AS n_turns, count(*) FILTER (WHERE role = perspective) AS n_learned,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY n) AS rendered,
       coalesce(list({{'start': pos + length(head), 'end': pos + length(head) + length(text)}} ORDER BY n) FILTER (WHERE role = perspective), []) AS mask
FROM placed GROUP BY conv_id, perspective, part
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""

_NEAREST = """
WITH e AS (
  SELECT vec_id, v, sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(v, lambda x: x * x)), lambda a, b: a + b)) AS n
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])), lambda a, b: a + b) / (q.n * c.n) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM pairs)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), stats),
items AS (SELECT DISTINCT item_id, text, unnest({_TERMS}) AS term FROM benchmark),
scores AS (
  SELECT item_id, text, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN weights USING (term), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS place FROM scores WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM ranked WHERE place <= 10
"""

_TRIE = r"""
WITH own AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda s, i: xor(s >> 1, (s & 1) * 3988292384))), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT c.conv_id, 0 AS later, o.pos, o.t FROM convs c JOIN own o ON o.conv_id = c.base AND o.pos < c.h
  UNION ALL SELECT c.conv_id, 1, o.pos, o.t FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.pos >= c.h),
seqs AS (SELECT conv_id, coalesce(list(t ORDER BY later, pos) FILTER (t IS NOT NULL), []) AS s FROM convs LEFT JOIN turns USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seqs)),
nodes AS (
  SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256,
         CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[-1].text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM members GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (p, d)),
below AS (
  SELECT p[1:a] AS p, a AS d, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT p, saved, n_children, unnest(range(d + 1)) AS a FROM full_nodes) GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below b USING (p, d) LEFT JOIN nodes u ON u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]
"""

ORACLE_SQL = {"op7_neighbours": _NEAREST, "op8_chat": _CHAT, "op9_warc": _WARC, "op12_lexical": _LEXICAL, "op13_trie": _TRIE}
