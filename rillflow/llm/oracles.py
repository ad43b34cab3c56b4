"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from rillflow.llm.licenses import NOTICES, PHRASES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{WORDS}')"


def licenses() -> str:
    def rows(templates):
        return ", ".join(f"('{t.label}', {_words(repr(t.text))}, {t.threshold}::DOUBLE)" for t in templates)

    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, {_words('text')} AS w FROM documents),
p AS (SELECT * FROM (VALUES {rows(PHRASES)}) t(label, p, threshold)),
n AS (SELECT * FROM (VALUES {rows(NOTICES)}) t(label, p, threshold)),
places AS (SELECT u, label, s - 1 AS s FROM (SELECT u, w, unnest(range(1, len(w) + 1)) AS s FROM d), p WHERE w[s] = p[1] AND w[s : s + len(p) - 1] = p),
blocks AS (SELECT u, label, threshold, list_distinct(p) AS t, w[b * len(p) + 1 : b * len(p) + 2 * len(p)] AS x
  FROM (SELECT u, w, label, p, threshold, unnest(range(0, CAST(ceil(len(w) / len(p)) AS BIGINT))) AS b FROM d, n)),
found AS (SELECT u, label, len(list_intersect(t, x)) / len(t) AS share FROM blocks WHERE len(list_intersect(t, x)) >= ceil(threshold * len(t) - 1e-9)),
a AS (SELECT u, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY u),
l AS (SELECT u, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT u, label FROM places UNION ALL SELECT u, label FROM found) GROUP BY u),
m AS (SELECT u, max(share) AS share FROM found GROUP BY u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
FROM d LEFT JOIN a USING (u) LEFT JOIN l USING (u) LEFT JOIN m USING (u)"""


def decontamination() -> str:
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, {_words('text')} AS w FROM documents),
i AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
windows AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, w[s : s + 9] AS x FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(x) AS n FROM windows),
spots AS (SELECT u, s, n, w[s : s + n - 1] AS x FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths)),
hits AS (SELECT u, s, n, item_id FROM spots JOIN windows USING (x)),
marked AS (SELECT u, count(DISTINCT k) AS n_hit FROM (SELECT u, unnest(range(s, s + n)) AS k FROM hits) GROUP BY u),
items AS (SELECT u, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY u)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (u) LEFT JOIN items USING (u)"""


def quality() -> str:
    space = r"[\x09-\x0D ]"
    return rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT u, s, w[s : s + 7] AS x FROM (SELECT u, w, unnest(range(1, len(w) - 6)) AS s FROM d)),
twice AS (SELECT u, x FROM spots GROUP BY u, x HAVING count(*) > 1),
rep AS (SELECT u, count(DISTINCT k) AS n FROM (SELECT u, unnest(range(s, s + 8)) AS k FROM spots JOIN twice USING (u, x)) GROUP BY u),
m AS (SELECT u, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x09-\x0D ]')) AS lines,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, coalesce(rep.n, 0) AS n_repeat_words FROM d LEFT JOIN rep USING (u)),
v AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_symbols / greatest(n_words, 1) AS a, (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1) AS b, n_upper / greatest(word_chars, 1) AS c, word_chars / greatest(n_words, 1) AS e FROM m),
g AS (SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, quantile_disc(a, [0.1, 0.5, 0.9]) AS a, quantile_disc(b, [0.1, 0.5, 0.9]) AS b,
    quantile_disc(c, [0.1, 0.5, 0.9]) AS c, quantile_disc(e, [0.1, 0.5, 0.9]) AS e FROM v WHERE NOT base_failed GROUP BY ROLLUP (lang, source)),
j AS (SELECT v.*, coalesce(g0.a, g1.a, g3.a) AS qa, coalesce(g0.b, g1.b, g3.b) AS qb, coalesce(g0.c, g1.c, g3.c) AS qc, coalesce(g0.e, g1.e, g3.e) AS qe FROM v
    LEFT JOIN g g0 ON g0.level = 0 AND g0.n >= 50 AND g0.lang IS NOT DISTINCT FROM v.lang AND g0.source IS NOT DISTINCT FROM v.source
    LEFT JOIN g g1 ON g1.level = 1 AND g1.n >= 50 AND g1.lang IS NOT DISTINCT FROM v.lang LEFT JOIN g g3 ON g3.level = 3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(a > qa[2] + 4 * (qa[2] - qa[1]) + 0.15
    OR b > qb[2] + 4 * (qb[2] - qb[1]) + 0.3 OR c > qc[2] + 4 * (qc[2] - qc[1]) + 0.15 OR e > qe[2] + 4 * (qe[2] - qe[1]) + 3.0 OR e < qe[2] - 4 * (qe[3] - qe[2]) - 2.0, false) AS kept FROM j"""


def _crc32(digits: str, table: str = "crc.t") -> str:
    """CRC-32 of an ASCII text by its byte table."""
    codes = f"list_transform(range(1, length({digits}) + 1), lambda j: ascii(substr({digits}, CAST(j AS INTEGER), 1))::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"


_CRC = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def panes() -> str:
    return f"""WITH {_CRC},
once AS (SELECT * FROM (SELECT click_id, ts, coalesce(arrived_at, ts) AS arrived, kind, value,
    row_number() OVER (PARTITION BY click_id ORDER BY ts, coalesce(arrived_at, ts), kind NULLS FIRST, value NULLS FIRST) AS k FROM clicks WHERE ts IS NOT NULL AND click_id IS NOT NULL) WHERE k = 1),
dated AS (SELECT *, arrived::DATE - DATE '1970-01-01' AS d, ((arrived::DATE - DATE '1970-01-01') % 10 + 10) % 10 AS q FROM once),
r AS (SELECT click_id, coalesce(kind, 'none') AS kind, ((ts::DATE - DATE '1970-01-01') - d + q) * 24 + hour(ts) AS hour, CASE WHEN abs(value) < 9e15 THEN floor(100 * value + 0.5)::BIGINT ELSE 0 END AS cents,
    least(9, q + greatest(0, {_crc32('click_id::VARCHAR')} % 30 - 23)) AS batch FROM dated, crc),
w AS (SELECT b, max(top) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM range(10) g(b) LEFT JOIN (SELECT batch, max(hour) AS top FROM r GROUP BY batch) ON batch = b),
marked AS (SELECT r.*, coalesce(w >= hour + 49, false) AS late FROM r JOIN w ON batch = b),
p AS (SELECT kind, hour, batch, count(*) AS n, sum(cents) AS c FROM marked WHERE NOT late GROUP BY ALL),
s AS (SELECT kind, hour, batch, sum(n) OVER x AS n, sum(c) OVER x AS c, min(batch) OVER (PARTITION BY kind, hour) AS f FROM p WINDOW x AS (PARTITION BY kind, hour ORDER BY batch)),
e AS (SELECT kind, hour, min(b) AS e FROM (SELECT DISTINCT kind, hour, f FROM s) JOIN w ON b >= f AND w >= hour + 13 GROUP BY ALL),
v AS (SELECT s.*, e, lag(n) OVER x AS n0, lag(c) OVER x AS c0 FROM s LEFT JOIN e USING (kind, hour) WINDOW x AS (PARTITION BY kind, hour ORDER BY batch)),
out AS (SELECT batch, hour, click_id, 1 AS n_rows, cents, 'late' AS record, kind FROM marked WHERE late
UNION ALL SELECT max(e), hour, -1, max_by(n, batch), max_by(c, batch), 'emit', kind FROM v WHERE batch <= e GROUP BY kind, hour
UNION ALL SELECT batch, hour, -1, n0, c0, 'retract', kind FROM v WHERE batch > e
UNION ALL SELECT batch, hour, -1, n, c, 'replace', kind FROM v WHERE batch > e
UNION ALL SELECT 9, hour, -1, max_by(n, batch), max_by(c, batch), 'final', kind FROM v WHERE e IS NULL GROUP BY kind, hour)
SELECT batch::BIGINT AS batch, hour::BIGINT AS hour, click_id::BIGINT AS click_id, n_rows::BIGINT AS n_rows, cents::BIGINT AS cents, record, kind FROM out"""


def jaccard_join() -> str:
    return rf"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT u, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)) AS x FROM d WHERE len(w) > 0),
n AS MATERIALIZED (SELECT u, count(*) AS n FROM s GROUP BY u),
l AS MATERIALIZED (SELECT a, b FROM (SELECT p.u AS a, q.u AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.u <> q.u GROUP BY ALL) JOIN n na ON na.u = a JOIN n nb ON nb.u = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
low AS (SELECT a AS u, min(doc_id) AS least FROM reach JOIN d ON d.u = b GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, least) AS component_id FROM d LEFT JOIN n USING (u) LEFT JOIN low USING (u)"""


def trie() -> str:
    return f"""WITH {_CRC},
t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS size, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (SELECT conv_id, size, d, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS pos FROM t),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), crc),
turns AS (SELECT c.conv_id, 0 AS src, pos, d, size FROM c JOIN own ON own.conv_id = base AND pos <= h UNION ALL SELECT c.conv_id, 1, pos, d, size FROM c JOIN own ON own.conv_id = c.conv_id AND pos > h),
placed AS (SELECT conv_id, d, size, row_number() OVER (PARTITION BY conv_id ORDER BY src, pos) AS depth FROM turns),
paths AS MATERIALIZED (SELECT conv_id, 0 AS depth, 'root' AS key, 0 AS size FROM c UNION ALL
    SELECT conv_id, depth, md5(string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key, size FROM placed),
nodes AS MATERIALIZED (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM paths GROUP BY key, depth),
up AS MATERIALIZED (SELECT DISTINCT p.key, q.key AS parent FROM paths p JOIN paths q ON p.conv_id = q.conv_id AND q.depth = p.depth - 1),
kids AS (SELECT parent AS key, count(*) AS n FROM up GROUP BY parent),
below AS (SELECT q.key, sum((n.n_convs - 1) * n.size) AS saved, sum(CASE WHEN kids.key IS NULL THEN 1 ELSE 0 END) AS leaves
    FROM nodes n LEFT JOIN kids ON kids.key = n.key JOIN paths q ON q.conv_id = n.conv_id AND q.depth <= n.depth GROUP BY q.key),
ends AS (SELECT key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT key, conv_id, depth, max(depth) OVER (PARTITION BY conv_id) AS last FROM paths) WHERE depth = last GROUP BY key)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, p.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
    leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN up ON up.key = n.key LEFT JOIN nodes p ON p.key = up.parent LEFT JOIN kids ON kids.key = n.key JOIN below ON below.key = n.key LEFT JOIN ends ON ends.key = n.key"""
