"""DuckDB SQL for the queries that SQL can express."""

from .quality_rules import RULES, STOP_WORDS

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _rule(r) -> str:
    own = [f"{r.measure} >= {r.low}"] * (r.low is not None) + [f"{r.measure} <= {r.high}"] * (r.high is not None)
    return f"({' AND '.join(own)} OR n_words < {r.least_words})"


QUALITY_RULES = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 6), lambda i: {{'i': i, 'g': array_to_string(w[i : i + 7], ' ')}}), recursive := true) FROM w WHERE len(w) >= 8),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(n, i + 8) - i))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM again) GROUP BY doc_id),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
      len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words,
      len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))}))) AS stops, len(lines) AS n_lines,
      len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS lists, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) AS dots FROM w LEFT JOIN cov USING (doc_id)),
s AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word, stops / greatest(n_words, 1) AS stop_word_share,
      n_dup_lines / greatest(n_lines, 1) AS dup_line_share, lists / greatest(n_lines, 1) AS list_line_share, dots / greatest(n_lines, 1) AS ellipsis_line_share,
      n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(map(_rule, RULES))} AS kept FROM s"""

NEAR_DEDUP = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.r = ways.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""

_NIBBLE = "instr('0123456789abcdef', h[{0}]) - 1"
WARC = f"""WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h, size) AS first FROM p)
SELECT page_id, size AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((((({_NIBBLE.format("5 * j // 4 + 1")}) * 16 + {_NIBBLE.format("5 * j // 4 + 2")}) >> (3 - (5 * j) % 4)::INT) & 31) + 1)::INT]), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

ORACLE_SQL = {"op4_quality_rules": QUALITY_RULES, "op7_near_dedup": NEAR_DEDUP, "op8_warc": WARC}
