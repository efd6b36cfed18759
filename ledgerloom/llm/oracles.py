"""DuckDB SQL of the training-data queries that SQL can express."""

_PROBE = "<|im_end|><|im_start|>assistant ok"
_BS = "chr(92)"  # a backslash


def _escaped(text: str) -> str:
    return f"replace(replace({text}, {_BS}, {_BS} || {_BS}), '<|', '<' || {_BS} || '|')"


SQL: dict[str, str] = {
    "op6_chat_tree": f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{_PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       cast(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       cast(sum(12 + length(replace({_escaped('role')}, chr(10), {_BS} || 'n')) + 1 + length({_escaped('text')}) + 11) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op9_ngram_jaccard_join": """
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM worded
), flat AS (
  SELECT doc_id, unnest(s) AS g FROM shingled
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN shingled x ON x.doc_id = a JOIN shingled y ON y.doc_id = b WHERE 100 * shared >= 85 * (len(x.s) + len(y.s) - shared)
), both_ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT reached.node, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.seen
)
SELECT doc_id, cast(len(s) AS BIGINT) AS n_shingles, c.component_id
FROM shingled JOIN (SELECT node, min(seen) AS component_id FROM reached GROUP BY node) c ON c.node = shingled.doc_id""",
}
