"""DuckDB statements with the results of the queries that SQL can express."""

_OP7 = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), w AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after,
         length(replace(replace(text, '\', '\\'), '<|', '<\|')) AS text_len,
         length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<\n|')) AS role_len
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(text_len + CASE WHEN before IS DISTINCT FROM role THEN 12 + role_len + 1 ELSE 10 END
      + CASE WHEN after IS DISTINCT FROM role THEN 11 ELSE 0 END)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id
"""


_OP4 = """
WITH RECURSIVE size AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, source NULLS FIRST) - 1 AS stream, greatest(16, ((SELECT count(*) FROM documents) + 4194303) // 4194304) AS block
  FROM documents GROUP BY source
), plan AS (
  SELECT list((n + block - 1) // block ORDER BY stream) AS blocks, sum((n + block - 1) // block)::BIGINT AS total, count(*) AS streams FROM size
), run(slot, nexts, stream, nth) AS (
  SELECT 0::BIGINT, list_transform(blocks, lambda x: 0::BIGINT), NULL::BIGINT, NULL::BIGINT FROM plan
  UNION ALL
  SELECT slot + 1, list_transform(nexts, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick - 1, nexts[pick] FROM (
    SELECT slot, nexts, list_min(list_filter(list_transform(nexts, lambda x, i: CASE WHEN x < blocks[i] AND x * total // blocks[i] <= slot THEN ((x + 1) * total + blocks[i] - 1) // blocks[i] * (streams + 1) + i END), lambda x: x IS NOT NULL)) % (streams + 1) AS pick
    FROM run, plan WHERE slot < total)
), turn AS (
  SELECT r.stream, r.nth, r.slot - 1 AS slot, r.nth * total // blocks[r.stream + 1] AS release, ((r.nth + 1) * total + blocks[r.stream + 1] - 1) // blocks[r.stream + 1] AS deadline FROM run r, plan WHERE r.stream IS NOT NULL
), ranked AS (
  SELECT d.doc_id, d.source, s.stream, s.block AS size, row_number() OVER (PARTITION BY d.source ORDER BY md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST) - 1 AS rank
  FROM documents d JOIN size s ON d.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, source, r.stream, rank, rank // size AS block, release, deadline, slot, slot * size + rank % size AS position, true AS selected
FROM ranked r JOIN turn t ON t.stream = r.stream AND t.nth = r.rank // size
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": _OP4, "op7_exact_dedup": _OP7, "op10_chat_format": _OP10}
