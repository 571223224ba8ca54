"""What the queries return, as DuckDB SQL over the same tables."""

from __future__ import annotations

from isohyet.llm.quality import CUTOFFS, levels

_SPACE = r"[\x20\x09-\x0D]+"
#: node, component: the smallest node reachable over links(a, b), both ways listed.
_REACH = "reach AS (SELECT a AS node, least(a, min(b)) AS c FROM links GROUP BY a UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.node WHERE r.c < l.b), comp AS (SELECT node, min(c) AS component FROM reach GROUP BY node)"

#: The schedule slot by slot: next holds each source's next job, x the one that runs.
OP3 = """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS nth FROM documents),
z AS (SELECT src, CAST(ceil(count(*) / 16.0) AS BIGINT) AS b, CAST(greatest(1, floor(pow(CAST(count(*) AS DOUBLE), 0.5) * 1048576)) AS HUGEINT) AS w FROM d GROUP BY 1),
a AS (SELECT list(src ORDER BY src) AS src, list(b ORDER BY src) AS b, list(w ORDER BY src) AS w, sum(w) AS total, count(*) AS n FROM z),
s AS (
  SELECT CAST(-1 AS BIGINT) AS t, list_transform(range(n), lambda i: CAST(1 AS BIGINT)) AS next, NULL::STRUCT(deadline BIGINT, less HUGEINT, src VARCHAR, i BIGINT, job BIGINT, release BIGINT) AS x, CAST(list_sum(b) AS BIGINT) AS todo FROM a
  UNION ALL
  SELECT t, list_transform(range(1, n + 1), lambda i: next[i] + CASE WHEN i = x.i THEN 1 ELSE 0 END), x, todo - CASE WHEN x IS NULL THEN 0 ELSE 1 END
  FROM (SELECT s.t + 1 AS t, next, todo, n, list_min(list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN next[i] <= a.b[i] AND (next[i] - 1) * total // a.w[i] <= s.t + 1 THEN {deadline: CAST((next[i] * total + a.w[i] - 1) // a.w[i] AS BIGINT), less: -a.w[i], src: a.src[i], i: i, job: next[i], release: CAST((next[i] - 1) * total // a.w[i] AS BIGINT)} END), lambda y: y IS NOT NULL)) AS x FROM s, a WHERE todo > 0))
SELECT doc_id, source, CAST(x.job - 1 AS BIGINT) AS mix_block, x.release AS mix_release, x.deadline AS mix_deadline, t AS mix_slot, t * 16 + nth % 16 AS mix_rank
FROM d JOIN s ON x.src = d.src AND x.job = nth // 16 + 1
"""

OP4 = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= CAST(0.95 AS DOUBLE)),
{_REACH},
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, coalesce(component, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.node = vec_id
"""

OP7 = rf"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM t WHERE len(w) >= 20),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i+19], ' ')) ORDER BY doc_id, i) > 1 AS again FROM s),
k AS (SELECT p.doc_id, p.i, word, coalesce(bool_or(again) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN r ON r.doc_id = p.doc_id AND r.i = p.i)
SELECT t.doc_id, CAST(len(t.w) AS BIGINT) AS n_words, count(*) FILTER (k.gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY k.i) FILTER (NOT k.gone), '')) AS kept_sha256
FROM t LEFT JOIN k ON k.doc_id = t.doc_id GROUP BY t.doc_id, t.w
"""

OP8 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(s) AS s FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [len(w) || ' ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM t)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2) x JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
{_REACH}
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, t.doc_id) AS component_id, coalesce(component, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN comp ON comp.node = t.doc_id
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13 = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM t),
p AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM t),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM p GROUP BY ALL),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * s.n + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), s),
x AS (SELECT item_id, r, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * tf.n * s.n) // s.l)))) AS BIGINT) AS score FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0 AND doc_id IS NOT NULL) WHERE rank <= 10
"""


def op10(alpha: float, delta: float) -> str:
    rules = list(CUTOFFS)
    grid = ", ".join(f"({i}, {', '.join(f'CAST({c} AS DOUBLE)' for c in x.values())})" for i, x in enumerate(levels()))
    broken = ", ".join(f"CASE WHEN g.{r} > c.{r} THEN '{r}' END" for r in rules)
    limit = f"CAST({alpha} AS DOUBLE)"
    marks = "!?;:\"()[]{}=~^_@/\\"
    return rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
ww AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i+7], ' '))) > 1 AS again FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8)),
pw AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM t),
rep AS (SELECT doc_id, count(*) FILTER (gone) AS n FROM (SELECT pw.doc_id, bool_or(again) OVER (PARTITION BY pw.doc_id ORDER BY pw.i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS gone FROM pw LEFT JOIN ww ON ww.doc_id = pw.doc_id AND ww.i = pw.i) GROUP BY 1),
f AS (SELECT t.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
  length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_upper, length(t) - length(translate(t, '{marks}', '')) AS n_marks, coalesce(rep.n, 0) AS n_repeat_words FROM t LEFT JOIN rep ON rep.doc_id = t.doc_id),
g AS (SELECT *, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, coalesce(n_symbols / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS symbol_share, coalesce((len(l) - len(list_distinct(l))) / nullif(CAST(len(l) AS DOUBLE), 0), 0) AS dup_line_share, coalesce(n_repeat_words / nullif(CAST(n_words AS DOUBLE), 0), 0) AS repeat_share, coalesce(n_upper / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS upper_share, coalesce(n_marks / nullif(CAST(word_chars AS DOUBLE), 0), 0) AS mark_share FROM f),
good AS (SELECT g.* FROM g JOIN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1) USING (doc_id) WHERE NOT base_failed AND lang IS NOT NULL),
c AS (SELECT * FROM (VALUES {grid}) x(i, {', '.join(rules)})),
k AS (SELECT lang, i, count(*) AS n, count(*) FILTER (list_count([{broken}]) > 0) AS k FROM good g, c GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN k >= n * {limit} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({limit}) + (n - j) * ln(1 - {limit})))) END <= CAST({delta} AS DOUBLE) / (SELECT count(DISTINCT lang) FROM good) AS ok FROM k),
lim AS (SELECT p.lang AS stratum, max(i) AS i FROM p JOIN (SELECT lang AS l2, min(i) FILTER (NOT ok) AS stop FROM p GROUP BY 1) s ON s.l2 = p.lang WHERE stop IS NULL OR i < stop GROUP BY 1),
r AS (SELECT g.*, array_to_string(list_filter([{broken}], lambda x: x IS NOT NULL), ',') AS rejected_by FROM g LEFT JOIN lim ON g.lang = stratum LEFT JOIN c ON c.i = lim.i)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM r
"""
