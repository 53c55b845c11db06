"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from stepfold.llm.decontaminate import WINDOW
from stepfold.llm.quality import BOILERPLATE, MARKUP, SEPARATORS, SYMBOLS

WS = r"[\x20\x09-\x0D]"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

CHAT = r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 20 AS size FROM all_turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

DECONTAMINATION = rf"""
WITH items AS (
  SELECT DISTINCT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), {AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS i FROM items WHERE len(w) > 0)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {AZ}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS gram
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM windows) WHERE len(w) >= m)
), hits AS (SELECT rid, m, i, item_id FROM grams JOIN windows USING (m, gram)),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM hits) GROUP BY rid),
ids AS (SELECT rid, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n USING (rid) LEFT JOIN ids USING (rid)
"""

SUBSTRINGS = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS did, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
windows AS (SELECT rid, did, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT rid, did, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM docs WHERE len(h) >= 100)),
firsts AS (SELECT g, min(did) AS first FROM windows GROUP BY g HAVING count(*) > 1),
starts AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM windows JOIN firsts USING (g) WHERE first < did),
runs AS (SELECT rid, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS run FROM starts),
spans AS (SELECT rid, run, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY rid, run),
gaps AS (SELECT rid, a, b, lag(b, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS free FROM spans),
kept AS (
  SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail, string_agg(substr(h, 2 * free + 1, 2 * (a - free)), '' ORDER BY a) AS k
  FROM gaps JOIN docs USING (rid) GROUP BY rid
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE k || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)
"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _count(chars: str) -> str:
    return f"(length(s) - length(translate(s, {_quote(chars)}, '')))"


QUALITY = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda x: x <> '') AS w,
    string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), tri AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM (SELECT rid, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2))
), rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY rid),
lines AS (SELECT rid, i, l[i] AS line, trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s FROM (SELECT rid, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
ruled AS (
  SELECT rid, i, line, CASE WHEN length(s) = 0 THEN NULL
    WHEN {_count(MARKUP)} * 10 > length(s) OR NOT regexp_matches(s, '\p{{L}}') THEN 'punctuation'
    WHEN {_count(SEPARATORS)} >= 3 OR (len(string_split(s, ' ')) <= 3 AND regexp_matches(s, '^[{SEPARATORS}]') AND NOT regexp_matches(s, '[.!?…。！？:;"''”’)\]]{WS}*$')) THEN 'navigation'
    WHEN regexp_matches(lower(s), {_quote("|".join(BOILERPLATE))}) THEN 'boilerplate' END AS rule FROM lines
), verdict AS (
  SELECT rid, count(*) FILTER (rule = 'punctuation') AS punctuation_lines, count(*) FILTER (rule = 'navigation') AS navigation_lines,
    count(*) FILTER (rule = 'boilerplate') AS boilerplate_lines, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (rule IS NULL), '') AS cleaned,
    count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines FROM ruled GROUP BY rid
), counted AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, {_quote(SYMBOLS)}, '')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CASE WHEN punctuation_lines + navigation_lines + boilerplate_lines > 0
      THEN 1 - length(regexp_replace(cleaned, '{WS}+', '', 'g')) / CAST(greatest(length(regexp_replace(t, '{WS}+', '', 'g')), 1) AS DOUBLE) ELSE 0.0 END AS lost_share,
    punctuation_lines, navigation_lines, boilerplate_lines
  FROM docs JOIN verdict USING (rid) LEFT JOIN rep USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT lost_share > 0.5 AS kept, CAST(lost_share AS DOUBLE) AS lost_share,
  punctuation_lines, navigation_lines, boilerplate_lines
FROM counted
"""

PREFIX_TRIE = rf"""
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), heads AS (
  SELECT c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT c, n AS d, role, text FROM (SELECT heads.c, h, n, role, text FROM heads JOIN turns ON turns.c = heads.c - heads.c % 20 WHERE n <= h)
  UNION ALL
  SELECT c, n - h + (SELECT count(*) FROM turns b WHERE b.c = t.c - t.c % 20 AND b.n <= h), role, text FROM (SELECT * FROM heads JOIN turns USING (c) WHERE n > h) t
), paths AS (
  SELECT c, d, k, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, w, d = max(d) OVER (PARTITION BY c) AS ends FROM (
    SELECT c, d, sha256(string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY c ORDER BY d)) AS k, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM rebuilt
    UNION ALL SELECT c, 0, 'root', 0 FROM heads)
), nodes AS (
  SELECT k, d, min(c) AS conv_id, count(*) AS n_convs, min(up) AS up, min(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY k, d
), kids AS (SELECT up AS k, count(*) AS n_children FROM nodes WHERE up IS NOT NULL GROUP BY up),
below AS (
  SELECT p.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, CAST(sum((u.n_convs - 1) * u.w) AS BIGINT) AS saved_tokens
  FROM nodes u LEFT JOIN kids ON kids.k = u.k JOIN paths p ON p.c = u.conv_id AND p.d <= u.d GROUP BY p.k
)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM nodes n JOIN below USING (k) LEFT JOIN kids USING (k) LEFT JOIN nodes up ON up.k = n.up
"""
