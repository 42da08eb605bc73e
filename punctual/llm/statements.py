"""DuckDB SQL for the queries of this package that SQL can express on whole tables."""

_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

RANKED_SEARCH = f"""
WITH words AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY ALL),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM lengths),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted, corpus GROUP BY term
),
scored AS (
  SELECT item_id, doc_id,
    CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term) JOIN lengths USING (doc_id), corpus
  GROUP BY ALL
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
  FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

NEAR_DUPLICATES = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
),
pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors AS a JOIN vectors AS b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95
),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT reach.x, pairs.y FROM reach JOIN pairs ON reach.y = pairs.x
),
counted AS (SELECT x, count(*) AS n FROM pairs GROUP BY x),
components AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN components ON vec_id = components.x LEFT JOIN counted ON vec_id = counted.x
"""

# A byte of CRC-32 is eight shifts, each with the polynomial if a one falls out.
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, unused: xor(x >> 1, 3988292384 * (x & 1)))
  ), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT DISTINCT conv_id, {_CRC32} % 6 AS h FROM turns),
placed AS (
  SELECT convs.conv_id, 0 AS own, pos, role, text FROM convs JOIN turns ON turns.conv_id = convs.conv_id - convs.conv_id % 100 AND pos <= h
  UNION ALL
  SELECT convs.conv_id, 1, pos, role, text FROM convs JOIN turns ON turns.conv_id = convs.conv_id AND pos > h
),
paths AS (
  SELECT conv_id, row_number() OVER way AS depth, length(text) AS chars,
    sha256(CAST(to_json(list({{'r': role, 't': text}}) OVER way) AS VARCHAR)) AS key
  FROM placed WINDOW way AS (PARTITION BY conv_id ORDER BY own, pos)
  UNION ALL
  SELECT conv_id, 0, 0, 'root' FROM convs
),
lengths AS (SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY key, depth
),
linked AS (
  SELECT nodes.*, above.key AS parent_key, parents.conv_id AS parent_conv_id
  FROM nodes LEFT JOIN paths AS above ON above.conv_id = nodes.conv_id AND above.depth = nodes.depth - 1
  LEFT JOIN nodes AS parents ON parents.key = above.key
),
children AS (SELECT parent_key AS key, count(*) AS n_children FROM linked GROUP BY parent_key),
whole AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN children USING (key)),
sums AS (
  SELECT above.key, count(*) FILTER (n_children = 0) AS n_leaves,
    CAST(sum((n_convs - 1) * whole.chars) AS BIGINT) AS saved_tokens
  FROM whole JOIN paths AS above ON above.conv_id = whole.conv_id AND above.depth <= whole.depth
  GROUP BY above.key
),
ends AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM paths JOIN lengths USING (conv_id, depth) GROUP BY key
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM whole JOIN sums USING (key) LEFT JOIN ends USING (key)
"""
