"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from odonymy.llm import rules

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SQL: dict[str, str] = {}

SQL["op8_decontaminate"] = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_ALNUM}'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM bw),
dw AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM d, sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hits AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (win)),
pos AS (SELECT DISTINCT doc_id, p FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS p)),
np AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY doc_id),
ni AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN np USING (doc_id) LEFT JOIN ni USING (doc_id)
"""

SQL["op1_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{_SPACED}'), []) AS w FROM documents),
win AS (SELECT doc_id, i, w[i:i + 12] AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
low AS (SELECT k, min(doc_id) AS lo FROM win GROUP BY k),
hit AS (SELECT DISTINCT doc_id, p FROM win JOIN low USING (k), LATERAL (SELECT unnest(range(i, i + 13)) AS p) WHERE lo < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
rest AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN rest USING (doc_id)
"""

SQL["op4_jaccard_join"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '{_SPACED}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[i:i + 2] AS k FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ids AS (SELECT k, row_number() OVER () AS t FROM s GROUP BY k),
e AS (SELECT doc_id, t FROM s JOIN ids USING (k)),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 90 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, y.b FROM reach r JOIN both_ways y ON r.b = y.a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a) USING (doc_id)
"""

_COMMON = [*rules.COMMON]
_KEEP = {k: v.replace("'", "''") for k, v in rules.CLASSES.items()}
_PLAIN = "regexp_replace(t, '{}', '', 'g')"
_JS = "list_sum(list_transform(list_zip(p, q), lambda x: 0.5 * (CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(2 * x[2] / (x[1] + x[2])) ELSE 0 END)))"
_SHARE = "list_transform({0}, lambda x: x / list_sum({0}))"


def _nearest(column: str, width: int) -> str:
    sums = ", ".join(f"sum({column}[{i}])" for i in range(1, width + 1))
    return f"""(SELECT doc_id, sqrt(greatest(min({_JS}), 0)) AS {column}_distance FROM
      (SELECT doc_id, {_SHARE.format(column)} AS p FROM c WHERE list_sum({column}) > 0), (SELECT {_SHARE.format("s")} AS q FROM (SELECT [{sums}] AS s FROM c WHERE lang IS NOT NULL GROUP BY lang)) GROUP BY doc_id)"""


SQL["op10_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, lang, t, regexp_extract_all(t, '{_SPACED}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines FROM d),
win AS (SELECT doc_id, i, w[i:i + 7] AS k FROM b, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM win JOIN twice USING (doc_id, k), LATERAL (SELECT unnest(range(i, i + 8)) AS p) GROUP BY doc_id),
m AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(t) AS n_all, length({_PLAIN.format(rules.SPACES)})::BIGINT AS word_chars,
        {", ".join(f"length({_PLAIN.format(p)}) AS {k}" for k, p in _KEEP.items())},
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        [{", ".join(f"len(list_filter(w, lambda x: x = '{x}'))" for x in _COMMON)}] AS known FROM b),
c AS (SELECT doc_id, lang, n_words, word_chars, symbol::BIGINT AS n_symbols, n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
        [word_chars - upper - digit - symbol - mark, n_all - word_chars, upper, digit, symbol, mark]::DOUBLE[] AS chars,
        list_concat([n_words - list_sum(known)], known)::DOUBLE[] AS common,
        n_words < 20 OR 100 * coalesce(n, 0) > 30 * n_words AS base_failed FROM m LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(word_chars >= 100 AND chars_distance > {rules.CHAR_LIMIT}, false) AND NOT coalesce(n_words >= 50 AND common_distance > {rules.WORD_LIMIT}, false) AS kept
FROM c LEFT JOIN {_nearest("chars", 6)} USING (doc_id) LEFT JOIN {_nearest("common", 1 + len(_COMMON))} USING (doc_id)
"""
