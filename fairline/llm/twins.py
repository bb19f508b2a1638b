"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from fairline.llm import quality as Q

_BLANKS = r"[\x20\x09-\x0D]+"

MIXING = r"""
WITH d AS (SELECT doc_id, source, coalesce(source, '') || CASE WHEN source IS NULL THEN '-' ELSE '=' END AS k,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT k, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY k),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s),
r AS (SELECT *, row_number() OVER o AS place,
    (sum(total) OVER () - 3 * coalesce(sum(total) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w WINDOW o AS (ORDER BY total / weight, n)),
f AS (SELECT min(place) AS first, arg_min(level, place) AS level FROM r WHERE level * weight <= 3 * total),
t AS (SELECT k, total, CASE WHEN place >= f.first THEN f.level * weight ELSE CAST(3 * total AS DOUBLE) END AS target FROM r LEFT JOIN f ON true),
c AS (SELECT d.k, length(bin(size)) AS class, sum(size) AS words, any_value(target) AS target FROM d JOIN t USING (k) GROUP BY 1, 2 HAVING sum(size) > 0),
g AS (SELECT *, row_number() OVER o AS place, (target - 3 * coalesce(sum(words) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(class * words) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM c WINDOW o AS (PARTITION BY k ORDER BY class DESC)),
h AS (SELECT k, min(place) AS first, arg_min(factor, place) AS factor FROM g WHERE factor * class <= 3 GROUP BY k),
e AS (SELECT g.k, class, CASE WHEN place >= h.first THEN least(3.0::DOUBLE, greatest(0.0::DOUBLE, h.factor * class)) ELSE 3.0::DOUBLE END AS e FROM g LEFT JOIN h USING (k)),
x AS (SELECT d.doc_id, d.k, d.size, floor(e) AS whole, e - floor(e) AS p,
    (CAST(CAST('0x' || substr(md5('mix:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0::DOUBLE AS u
    FROM d JOIN e ON e.k = d.k AND e.class = length(bin(d.size))),
y AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds, CAST(doc_id AS VARCHAR) AS id FROM x),
o AS (SELECT t.k, t.target - coalesce(sum(whole * size), 0) AS open FROM t LEFT JOIN y USING (k) GROUP BY t.k, t.target),
z AS (SELECT y.*, open, sum(size) OVER (PARTITION BY k ORDER BY odds, id ROWS UNBOUNDED PRECEDING) <= open AS led FROM y JOIN o USING (k) WHERE odds IS NOT NULL),
q AS (SELECT o.k, open - coalesce(sum(size) FILTER (WHERE led), 0) AS gap FROM o LEFT JOIN z USING (k, open) GROUP BY o.k, open),
v AS (SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY abs(size - gap), odds, id) AS r FROM z JOIN q USING (k) WHERE NOT led AND abs(size - gap) < gap),
m AS (SELECT doc_id, 1 AS more FROM z WHERE led UNION ALL SELECT doc_id, 1 FROM v WHERE r = 1)
SELECT d.doc_id, d.size, t.total AS source_size, t.target, CAST((coalesce(whole, 0) + coalesce(more, 0)) * d.size AS BIGINT) AS taken, d.source
FROM d JOIN t USING (k) LEFT JOIN y ON y.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id
"""


def _distance() -> str:
    z: list[str] = []
    for i in Q.P:
        rest = f"(x{i} - m{i})" + "".join(f" - l{i}{k} * ({z[k]})" for k in range(i))
        z.append(f"({rest}) / l{i}{i}")
    return " + ".join(f"({v}) * ({v})" for v in z)


def _factored(moments: str) -> str:
    """Cholesky factor, one column after the other."""
    sql = moments
    for j in Q.P:
        for i in Q.P:
            if i >= j:
                rest = f"c{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
                sql = f"SELECT *, {f'sqrt({rest})' if i == j else f'({rest}) / l{j}{j}'} AS l{i}{j} FROM ({sql})"
    return sql


def quality_sql() -> str:
    """Robust distances by the same steps; statistics from words and lines unnested by document."""
    pairs = [(i, j) for i in Q.P for j in Q.P if j <= i]
    xs = ", ".join(f"x{i}" for i in Q.P)
    floors = [(f * Q.SCALE) ** 2 for f in Q.FLOORS]
    start = ", ".join(
        f"sqrt((d{i} * 1.4826::DOUBLE) * (d{i} * 1.4826::DOUBLE) + {floors[i]!r}::DOUBLE) AS l{i}{j}" if i == j else f"0.0::DOUBLE AS l{i}{j}" for i, j in pairs
    )
    steps, last = [], "e0"
    for s in range(1, Q.STEPS + 1):
        moments = f"""SELECT level, {', '.join(f'sum(x{i}) / count(*) AS m{i}' for i in Q.P)}, {', '.join(
            f'(sum(x{i} * x{j}) / count(*) - (sum(x{i}) / count(*)) * (sum(x{j}) / count(*))) * {Q.CONSISTENCY}::DOUBLE + {floors[i] if i == j else 0.0!r}::DOUBLE AS c{i}{j}'
            for i, j in pairs)} FROM b{s} JOIN c{s} USING (level) WHERE bin <= cut GROUP BY level"""
        steps.append(f"b{s} AS MATERIALIZED (SELECT level, {xs}, floor(ln(1 + {_distance()}) * 32) AS bin FROM lv JOIN {last} USING (level))")
        steps.append(f"c{s} AS MATERIALIZED (SELECT level, quantile_cont(bin, {Q.SUPPORT}) AS cut FROM b{s} GROUP BY level)")
        steps.append(f"e{s} AS MATERIALIZED ({_factored(moments)})")
        last = f"e{s}"
    chosen = ", ".join(
        f"CASE WHEN a.n >= {Q.LEAST_ROWS} THEN a.{c} WHEN b.n >= {Q.LEAST_ROWS} THEN b.{c} ELSE g.{c} END AS {c}"
        for c in [*[f"m{i}" for i in Q.P], *[f"l{i}{j}" for i, j in pairs]]
    )
    return rf"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) AS t, range(3) AS s(k) WHERE t.n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(l) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
v AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    '2' || coalesce('=' || lang, '-') || '|' || coalesce('=' || source, '-') AS k2, '1' || coalesce('=' || lang, '-') AS k1, '0' AS k0,
    CAST(floor(ln(greatest(word_chars, 1) / greatest(n_words, 1)) * {Q.SCALE} + 0.5) AS BIGINT) AS x0,
    CAST(floor(n_symbols / greatest(word_chars, 1) * {Q.SCALE} + 0.5) AS BIGINT) AS x1,
    CAST(floor(n_repeat_words / greatest(n_words, 1) * {Q.SCALE} + 0.5) AS BIGINT) AS x2,
    CAST(floor(n_dup_lines / greatest(n_lines, 1) * {Q.SCALE} + 0.5) AS BIGINT) AS x3 FROM s),
lv AS MATERIALIZED (SELECT unnest([k2, k1, k0]) AS level, {xs} FROM v WHERE NOT base_failed),
md AS (SELECT level, {', '.join(f'median(x{i}) AS m{i}' for i in Q.P)} FROM lv GROUP BY level),
sp AS (SELECT level, {', '.join(f'median(abs(x{i} - m{i})) AS d{i}' for i in Q.P)} FROM lv JOIN md USING (level) GROUP BY level),
e0 AS MATERIALIZED (SELECT level, {', '.join(f'm{i}' for i in Q.P)}, {start} FROM md JOIN sp USING (level)),
{', '.join(steps)},
n AS (SELECT level, count(*) AS n FROM lv GROUP BY level), e AS MATERIALIZED (SELECT * FROM {last} JOIN n USING (level)),
u AS (SELECT v.*, {chosen} FROM v LEFT JOIN e a ON a.level = k2 LEFT JOIN e b ON b.level = k1 LEFT JOIN e g ON g.level = k0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(NOT base_failed AND {_distance()} <= {Q.LIMIT}, false) AS kept FROM u
"""


WINDOWS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
s AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50),
k AS (SELECT r, doc_id, pos, array_to_string(w[pos:pos + 49], ' ') AS k FROM s),
f AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
x AS (SELECT DISTINCT r, pos + j AS pos FROM k JOIN f USING (k), range(50) AS t(j) WHERE least < doc_id),
c AS (SELECT p.r, count(x.pos) AS n_removed, coalesce(string_agg(p.word, ' ' ORDER BY p.pos) FILTER (WHERE x.pos IS NULL), '') AS kept
    FROM p LEFT JOIN x ON x.r = p.r AND x.pos = p.pos GROUP BY p.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (r)
"""

_EDITS = """(VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) AS st(q, c, q2)"""
_SAYS = """(VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)) AS sp(q, said, q2)"""
_INSERTS = r"""(VALUES (0, 0, 0, ''), (1, 0, 1, ''), (2, 0, 2, ''), (3, 0, 3, ''), (0, 1, 2, E'\nuser:'), (1, 1, 2, E'\nuser:'), (2, 1, 3, E'\nassistant:'), (3, 1, 2, E'\nuser:'),
    (0, 2, 3, E'\nuser:\nassistant:'), (1, 2, 3, E'\nuser:\nassistant:'), (2, 2, 2, E'\nassistant:\nuser:'), (3, 2, 3, E'\nuser:\nassistant:')) AS i(q, k, q2, said)"""


def _with_inserts() -> str:
    """Ways of ``w`` followed by up to two inserted turns (a third only goes in circles)."""
    return f"""SELECT w.g, w.n, i.q2 AS q, lpad(CAST(CAST(left(w.way, 9) AS BIGINT) + 5 * i.k AS VARCHAR), 9, '0') || substr(w.way, 10) || repeat('I', i.k) AS way,
    w.said || i.said AS said FROM w JOIN {_INSERTS} ON i.q = w.q"""


#: Row by row over all states; a way is its cost in nine digits and then its audit, so the least string is the best way.
CONVERSATIONS = rf"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT k.*, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM c, range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS n FROM d),
f AS (SELECT *, left(role, 1) AS c, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY n) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut, lag(left(role, 1)) OVER (PARTITION BY g ORDER BY n) || left(role, 1) AS pair FROM o),
s AS (SELECT g, any_value(conv_id) AS conv_id, max(n) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
    count(*) FILTER (WHERE again AND NOT blank) AS duplicate, count(*) FILTER (WHERE cut AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY g),
w AS (SELECT g, CAST(0 AS BIGINT) AS n, 0 AS q, '000000000' AS way, '' AS said FROM s
  UNION ALL SELECT g, n, q, min(way), arg_min(said, way) FROM (
    SELECT e.g, e.n + 1 AS n, z.q2 AS q, lpad(CAST(CAST(left(e.way, 9) AS BIGINT) + z.cost AS VARCHAR), 9, '0') || substr(e.way, 10) || z.letter AS way, e.said || z.said AS said
    FROM ({_with_inserts()}) AS e JOIN (
      SELECT g, n, 2 AS cost, 'D' AS letter, q, q AS q2, '' AS said FROM f, range(4) AS t(q)
      UNION ALL SELECT g, n, CASE WHEN cut THEN 5 ELSE 0 END, 'K', q, q2, E'
' || role || ':' || text FROM f JOIN {_EDITS} ON st.c = f.c WHERE NOT blank AND NOT again
      UNION ALL SELECT g, n, CASE WHEN cut THEN 6 ELSE 1 END, 'R', q, q2, E'
' || said || ':' || text FROM f, {_SAYS} WHERE NOT blank AND NOT again
    ) AS z ON z.g = e.g AND z.n = e.n + 1 AND z.q = e.q) GROUP BY g, n, q),
b AS (SELECT e.g, min(way) AS way, arg_min(said, way) AS said FROM ({_with_inserts()}) AS e JOIN s ON s.g = e.g AND s.n = e.n WHERE q IN (0, 3) GROUP BY e.g),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(left(way, 9), '0') AS BIGINT) AS cost,
    coalesce(substr(way, 10), '') AS audit, sha256(coalesce(substr(said, 2), '')) AS repaired_sha256
FROM a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.g = s.g
"""
