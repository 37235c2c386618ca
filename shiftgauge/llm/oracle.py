"""The results of text operators as SQL for DuckDB, where SQL can state them."""

# crc32 by its table of 256 entries, leaves, levels of the trees of langs and of the tree above them, then a climb per leaf.
MERKLE_SQL = r"""
WITH RECURSIVE
tab AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda a, x: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
),
marked AS (
  SELECT d.*, coalesce(xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 7 = 0, false) AS tampered
  FROM documents d, tab
),
parts AS (
  SELECT doc_id, lang, tampered, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM marked
),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN tampered AND n_chars IS NOT NULL
              THEN sha256(head || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || tail) END AS other
  FROM parts
),
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, leaf, coalesce(other, leaf) AS claimed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed
),
lv(g, k, pos, n, h) AS (
  SELECT g, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT g, k + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY g, k, pos // 2
),
sub AS (
  SELECT g, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM lv WHERE n = 1
),
up(k, pos, n, h) AS (
  SELECT 0, pos, n, h FROM sub
  UNION ALL
  SELECT k + 1, pos // 2, (any_value(n) + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY k, pos // 2
),
inner_climb(doc_id, g, leaf, k, pos, n, proof, folded) AS (
  SELECT doc_id, g, leaf, 0, pos, n, '', claimed FROM leaves
  UNION ALL
  SELECT c.doc_id, c.g, c.leaf, c.k + 1, c.pos // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.folded ELSE c.folded || coalesce(s.h, '') END)
  FROM inner_climb c LEFT JOIN lv s ON s.g = c.g AND s.k = c.k AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
),
outer_climb(doc_id, leaf, subroot, k, pos, n, proof, folded) AS (
  SELECT c.doc_id, c.leaf, sub.h, 0, sub.pos, sub.n, c.proof, c.folded FROM inner_climb c JOIN sub USING (g) WHERE c.n = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.k + 1, c.pos // 2, (c.n + 1) // 2, c.proof || coalesce(s.h, ''),
         sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.folded ELSE c.folded || coalesce(s.h, '') END)
  FROM outer_climb c LEFT JOIN up s ON s.k = c.k AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1
)
SELECT c.doc_id, c.leaf, c.subroot, top.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
       c.folded = top.h AS verified
FROM outer_climb c, (SELECT h FROM up WHERE n = 1) top
WHERE c.n = 1
"""

# Ranks by sums of integer shares; only terms of the items are counted, over all documents.
LEXICAL_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
),
held AS (SELECT row, doc_id, len(terms)::BIGINT AS n, terms FROM docs WHERE len(terms) > 0),
corpus AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM held),
items AS (
  SELECT DISTINCT item_id, text,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM benchmark WHERE text IS NOT NULL
),
asked AS (SELECT item_id, text, term, count(*) AS times FROM (SELECT item_id, text, unnest(terms) AS term FROM items) GROUP BY ALL),
tf AS (
  SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(terms) AS term FROM held)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY ALL),
weight AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, corpus
),
sized AS (SELECT row, doc_id, 25 + (75 * n * n_docs) // n_terms AS m FROM held, corpus),
share AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS s FROM tf JOIN weight USING (term) JOIN sized USING (row)),
scored AS (SELECT item_id, text, row, doc_id, sum(times * s)::BIGINT AS score FROM share JOIN asked USING (term) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST, row) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
