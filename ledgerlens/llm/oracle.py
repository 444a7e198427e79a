"""DuckDB SQL of the corpus queries that SQL can express.

The others are tested against brute force: SQL has no tokenizer and no
cipher, and the language model, language identification, near duplicates and
approximate search are not practical in it.
"""

from __future__ import annotations

USABLE = "vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

EXACT_TOP_K = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings WHERE {USABLE}
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def crc_entry(n: int) -> int:
    """One entry of the byte table of CRC-32 (reflected polynomial 0xEDB88320)."""
    for _ in range(8):
        n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
    return n


def crc32(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, as an unsigned number."""
    table = f"[{', '.join(str(crc_entry(n)) for n in range(256))}]::BIGINT[]"
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    step = f"lambda c, x: xor(c >> 8, ({table})[(xor(c, x) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), {step}), 4294967295)"


INTERLEAVE = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || source, '') AS src, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         {crc32("coalesce(text, '')")} AS text_crc32, md5('interleave:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
),
r AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY digest, doc_id NULLS FIRST) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM d
),
p AS (
  SELECT *, row_number() OVER (ORDER BY (2 * r + 1) / CAST(2 * n AS DOUBLE), src, r) - 1 AS pos, count(*) OVER () AS total FROM r
),
s AS (
  SELECT *, total // 8 AS base, total % 8 AS extra,
         CAST(CASE WHEN pos < (total % 8) * (total // 8 + 1) THEN pos // (total // 8 + 1)
              ELSE total % 8 + (pos - (total % 8) * (total // 8 + 1)) // greatest(total // 8, 1) END AS INTEGER) AS shard
  FROM p
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, CAST(pos - (shard * base + least(shard, extra)) AS BIGINT) AS slot,
       CAST(NULL AS INTEGER) AS grown_shard
FROM s"""

WORDS = r"list_filter(string_split_regex(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"

# flags of a document as the bits of one number; an order is a permutation of 0 .. 4
FILTER_AUDIT = rf"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
),
sized AS (
  SELECT *, length(t) AS chars, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS capitals, {WORDS} AS words,
         min(doc_id) OVER (PARTITION BY t) AS first_id
  FROM texts
),
marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id
),
flagged AS (
  SELECT s.part, coalesce(good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         CAST(len(words) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER)
         + 4 * CAST(100 * capitals > 3 * chars AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
         + 16 * CAST(coalesce(s.doc_id > first_id, false) AS INTEGER) AS failed
  FROM sized s LEFT JOIN marks m USING (doc_id)
),
atoms AS (
  SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY ALL
),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS letter, unnest([1, 2, 4, 8, 16]) AS bit),
paths AS (
  SELECT '' AS o, 0 AS done, 0 AS step
  UNION ALL
  SELECT o || letter, done + bit, step + 1 FROM paths, letters WHERE done & bit = 0
),
orders AS (SELECT o AS filter_order FROM paths WHERE step = 5),
steps AS (
  SELECT filter_order, CAST(length(o) + 1 AS INTEGER) AS step, letter AS filter, done, bit
  FROM orders JOIN paths ON starts_with(filter_order, o) AND length(o) < 5 JOIN letters ON letter = filter_order[length(o) + 1]
),
parts AS (SELECT DISTINCT part FROM atoms),
counted AS (
  SELECT part, filter_order, step, filter,
         sum(CASE WHEN failed & (done | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failed & done = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed & done > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed & done = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed & done = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM parts JOIN atoms USING (part) CROSS JOIN steps GROUP BY ALL
)
SELECT part, filter_order, step, filter, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted"""

FILL_IN_MIDDLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
),
h AS (
  SELECT *, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || x[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || x[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d
),
c AS (
  SELECT *, substring(t, 1, least(a, b)) AS pre, substring(t, least(a, b) + 1, greatest(a, b) - least(a, b)) AS mid, substring(t, greatest(a, b) + 1) AS suf
  FROM h
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(least(a, b) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(greatest(a, b) - least(a, b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""

GRAPH_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE {USABLE} AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
),
reached AS (
  SELECT a AS start, a AS node FROM (SELECT DISTINCT a FROM links)
  UNION
  SELECT r.start, l.b FROM reached r JOIN links l ON l.a = r.node
),
least AS (SELECT start, min(node) AS component_id FROM reached GROUP BY start),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN least ON start = vec_id LEFT JOIN degree ON a = vec_id"""

ORACLE = {"op3_interleave": INTERLEAVE, "op6_exact_top_k": EXACT_TOP_K, "op11_filter_audit": FILTER_AUDIT, "op12_fill_in_middle": FILL_IN_MIDDLE, "op13_graph_dedup": GRAPH_DEDUP}
