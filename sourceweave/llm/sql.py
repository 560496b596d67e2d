"""DuckDB SQL for those queries that SQL can express, written apart from the operators."""

from .license import BASE, MORE, RARE, SLACK, TEMPLATES, VOTES
from .urls import RULES

WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS.format("text")} AS w FROM benchmark),
pat AS (SELECT DISTINCT item, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p, least(13, len(w)) AS n
        FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("text")} AS w FROM documents),
size AS (SELECT DISTINCT n FROM pat),
win AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT r, i, item, pat.n FROM win JOIN pat ON win.p = pat.p AND win.n = pat.n),
word AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN its USING (r)
"""


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_PHRASES = [(p, label, len(p.split()), p in BASE) for p, label in {**MORE, **BASE}.items()]
_TEMPLATE_WORDS = [(label, i, w, len(t.split())) for label, (_, t) in TEMPLATES.items() for i, w in enumerate(t.split())]
_MANDATORY = [(label, p) for label, (phrases, _) in TEMPLATES.items() for p in phrases]
_KNOWN = sorted({w for p in {**MORE, **BASE} for w in p.split()} | {w for _, _, w, _ in _TEMPLATE_WORDS})
OP5 = rf"""
WITH tw AS (SELECT * FROM (VALUES {_values(_TEMPLATE_WORDS)}) AS t(label, pos, word, size)),
key AS (SELECT * FROM (VALUES {_values(_MANDATORY)}) AS t(label, p)),
phrase AS (SELECT * FROM (VALUES {_values([(p, a, n, str(b).lower()) for p, a, n, b in _PHRASES])}) AS t(p, label, n, base)),
doc AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format("text")} AS w FROM documents),
maybe AS (SELECT r, w, p, label, n, base = 'true' AS base FROM doc, phrase WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' ' || p || ' ')),
place AS (SELECT r, i - 1 AS start, label, n, base, p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM maybe) WHERE array_to_string(w[i:i + n - 1], ' ') = p),
spot AS (SELECT r, i - 1 AS i, w[i] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc) WHERE list_contains({_KNOWN}, w[i])),
df AS (SELECT word, count(DISTINCT r) AS df FROM spot GROUP BY word),
rare AS (SELECT r, word FROM (SELECT r, word, row_number() OVER (PARTITION BY r ORDER BY df, word) AS k FROM (SELECT DISTINCT r, word FROM spot) JOIN df USING (word)) WHERE k <= {RARE}),
asked AS (SELECT r, label, count(*) AS looked_up FROM rare JOIN tw USING (word) GROUP BY r, label),
vote AS (SELECT r, label, shift, (i - pos + size + shift) // {SLACK} AS bucket, count(DISTINCT pos) AS votes FROM spot JOIN rare USING (r, word) JOIN tw USING (word), (VALUES (0), ({SLACK // 2})) AS s(shift) GROUP BY ALL),
whole AS (SELECT r, label FROM (SELECT DISTINCT r, p FROM place) JOIN key USING (p) GROUP BY r, label HAVING count(*) = (SELECT count(*) FROM key k WHERE k.label = any_value(key.label))),
template AS (SELECT r, label FROM (SELECT r, label, max(votes) AS votes FROM vote GROUP BY r, label) JOIN asked USING (r, label) JOIN whole USING (r, label) WHERE votes >= {VOTES} AND 2 * votes >= looked_up),
named AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION SELECT r, label FROM template) GROUP BY r),
sums AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, sum(n) AS covered
         FROM place GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(CASE WHEN covered IS NULL THEN 0 ELSE least(1.0, CAST(covered AS DOUBLE) / len(w)) END AS DOUBLE) AS score
FROM doc LEFT JOIN sums USING (r) LEFT JOIN named USING (r)
"""

OP8 = rf"""
WITH rule AS (SELECT * FROM (VALUES {_values(RULES)}) AS t(h, p, v)),
page AS (SELECT page_id, row_number() OVER () AS r, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
part AS (SELECT page_id, r, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM page),
best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM part, rule
         WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM part LEFT JOIN best USING (r)
"""


def _escaped(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '\\', '\\\\'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"


def _restored(c: str) -> str:
    return f"replace(replace(replace(replace({c}, '<\\/s>', '</s>'), '[\\INST]', '[INST]'), '[\\/INST]', '[/INST]'), '\\\\', '\\')"


OP9 = rf"""
WITH chat AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
odd AS (SELECT *, role LIKE '%[/INST]%' OR role LIKE '%</s>%' OR text LIKE '%</s>%' OR {_restored("text")} <> text OR {_restored("role")} <> role AS odd FROM chat)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(17 * count(*) + CASE WHEN bool_or(odd) THEN sum(length({_escaped("role")}) + length({_escaped("text")})) ELSE sum(length(role) + length(text)) END AS BIGINT) AS formatted_chars
FROM odd GROUP BY conv_id
"""

ORACLES = {"op1_decontaminate": OP1, "op5_license_scan": OP5, "op8_url_filter": OP8, "op9_chat_format": OP9}
