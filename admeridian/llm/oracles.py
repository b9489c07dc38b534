"""DuckDB SQL of the queries that SQL can express."""

OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS most FROM per
), leveled AS (
  SELECT *, most / weight AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER earlier, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
  FROM weighed WINDOW earlier AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
  SELECT min_by(level, ratio) AS level FROM leveled WHERE ratio > level
), targets AS (
  SELECT source, source_size, CASE WHEN common.level IS NULL OR ratio <= common.level THEN most ELSE weight * common.level END AS target
  FROM leveled CROSS JOIN common
), keyed AS (
  SELECT *, md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS ord, coalesce('=' || source, '') AS src,
    length(bin(size)) * 16 + (size >> greatest(0, length(bin(size)) - 4)) AS class FROM sized
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY class DESC, substr(ord, 1, 2), size DESC, ord) AS r,
    ('0x' || substr(md5('mix-1:' || src), 1, 13))::UBIGINT::DOUBLE / 4503599627370496 AS start FROM keyed
), rated AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM placed d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + floor(start + r * (rate - floor(rate))) - floor(start + (r - 1) * (rate - floor(rate)))))::BIGINT AS taken
FROM rated
"""

OP10 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""

OP11 = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT p FROM pattern))) AS term FROM documents
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), (SELECT p FROM pattern))) AS term FROM benchmark
), sizes AS (
  SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS n_docs, sum(n)::BIGINT AS all_terms FROM sizes
), held AS (
  SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, corpus GROUP BY term
), parts AS (
  SELECT h.doc_id, h.term, w.w * ((1000000000 * h.tf) // (1000 * h.tf + 8 * (25 + (75 * s.n * c.n_docs) // c.all_terms))) AS part
  FROM held h JOIN weights w USING (term) JOIN sizes s USING (doc_id), corpus c
), scored AS (
  SELECT item_id, doc_id, sum(part)::BIGINT AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, (row_number() OVER best)::INT AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 10
"""

#: For conversations of up to 64 turns, as in all tables here: one rendering each.
OP12 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '<\\*(?:s>|/s>|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>)|\[\\*/?INST\]')) AS inside,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 18
      ELSE 21 + len(role) + len(regexp_extract_all(role, '<\\*(?:s>|/s>|<SYS>>|</SYS>>|<ROLE>>|</ROLE>>)|\[\\*/?INST\]')) END AS marks FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(inside + marks))::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP13 = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, byte: list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))) AS crc
  FROM (SELECT DISTINCT conv_id FROM turns)
), plans AS (
  SELECT conv_id, conv_id - conv_id % 5 AS first_id, xor(crc, 4294967295) % 9 AS h FROM convs
), paths AS (
  SELECT p.conv_id, coalesce((SELECT list({'role': role, 'text': text} ORDER BY place) FROM turns t WHERE t.conv_id = p.first_id AND place < h), [])
    || coalesce((SELECT list({'role': role, 'text': text} ORDER BY place) FROM turns t WHERE t.conv_id = p.conv_id AND place >= h), []) AS path
  FROM plans p
), members AS (
  SELECT conv_id, d, path[:d] AS node, len(path) = d AS ends FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM paths)
), nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(strlen(node[d].text), 0) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, d
), children AS (
  SELECT node[:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1
), below AS (
  SELECT node[:up] AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (WHERE childless) AS n_leaves
  FROM (SELECT n.node, n.own, c.n IS NULL AS childless, unnest(range(n.d + 1)) AS up FROM nodes n LEFT JOIN children c ON n.node = c.node) GROUP BY 1
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.d > 0 AND p.node = n.node[:n.d - 1] LEFT JOIN children c ON c.node = n.node JOIN below b ON b.node = n.node
"""


def oracle_sql():
    return {"op7_source_mixing": OP7, "op10_exact_dedup": OP10, "op11_lexical_search": OP11, "op12_chat_formatting": OP12, "op13_prefix_trie": OP13}
