"""DuckDB statements whose rows the queries of the same names must return."""

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_SPACED = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_ALNUM}), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOW}, {_ALNUM}) AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_SPACED}), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 75 * (na.n + nb.n - i)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least_id AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS least_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_SPACED}), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
own AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(i, i + 49)) AS p FROM win JOIN own USING (g) WHERE m < doc_id)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id)
"""


def mixing_sql(weights: tuple[int, ...], most: int, seed: int) -> str:
    weight = f"[{', '.join(map(str, weights))}]"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_SPACED})), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, {weight}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, {most} * source_size::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM c),
l AS (SELECT min_by((total - filled) / free, cap / w) FILTER (WHERE w * ((total - filled) / free) <= cap) AS level FROM f),
t AS (SELECT source, source_size, coalesce(least(w * level, cap), cap) AS target FROM f, l),
b AS (SELECT *, round_even(target, 0)::BIGINT AS budget, CASE WHEN source_size > 0 THEN floor(round_even(target, 0) / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
o AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(md5('{seed}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13), d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM o
"""


def license_sql(phrases: dict[str, str], templates: list[tuple[str, list[str], int, int]]) -> str:
    """``templates``: label, distinct words, words needed, words of a block."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    places = " UNION ALL ".join(f"SELECT doc_id, {quoted(label)} AS label, i FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - {len(p.split()) - 1})) AS i FROM d WHERE len(w) >= {len(p.split())}) WHERE w[i : i + {len(p.split()) - 1}] = [{', '.join(map(quoted, p.split()))}]" for p, label in phrases.items())
    sets = ", ".join(f"({k}, {quoted(label)}, [{', '.join(map(quoted, words))}], {need}, {span})" for k, (label, words, need, span) in enumerate(templates))
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOW.replace('text', "coalesce(text, '')")}, {_ALNUM}) AS w FROM documents),
found AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(i) - 1 AS lo, max(i) - 1 AS hi, list_sort(list(DISTINCT label)) AS labels FROM found GROUP BY doc_id),
t(k, label, words, need, span) AS (VALUES {sets}),
tw AS (SELECT k, span, need, len(words) AS size, label, unnest(words) AS word FROM t),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i FROM d),
h AS (SELECT doc_id, k, label, span, need, size, i, word FROM dw JOIN tw USING (word)),
met AS (SELECT a.doc_id, a.k, a.label, a.i, a.span, count(DISTINCT b.word)::DOUBLE / a.size AS share FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.span
        GROUP BY a.doc_id, a.k, a.label, a.i, a.span, a.size, a.need HAVING count(DISTINCT b.word) >= a.need),
nested AS (SELECT a.k AS small, b.k AS large FROM t a, t b WHERE len(a.words) < len(b.words) AND list_has_all(b.words, a.words)),
best AS (SELECT doc_id, label, share FROM met m WHERE NOT EXISTS (SELECT 1 FROM met n WHERE n.doc_id = m.doc_id AND (n.share > m.share OR n.share = m.share AND (m.k, n.k) IN (SELECT (small, large) FROM nested)) AND n.i < m.i + m.span AND m.i < n.i + n.span)),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM best GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, lo::BIGINT AS first_word, hi::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


def secret_sql(kinds: list[tuple[str, str, int, int]], candidate: str, window: int, classes: list[tuple[str, float]], allowed: list[str], parts: str, word: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def spans(place: int, kind: str, pattern: str, group: int, least: int) -> str:
        return f"""SELECT doc_id, {place} AS place, {quoted(kind)} AS kind, past - size AS start, past AS stop FROM (
  SELECT doc_id, size, judged, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY i) AS past FROM (
    SELECT doc_id, unnest(generate_series(1, len(m))) AS i, unnest(list_transform(p[1 : len(m)], lambda x: length(x))) AS gap, unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(g, lambda x: length(x))) AS judged
    FROM (SELECT doc_id, string_split_regex(text, {quoted(pattern)}) AS p, regexp_extract_all(text, {quoted(pattern)}) AS m, regexp_extract_all(text, {quoted(pattern)}, {group}) AS g FROM d) WHERE len(m) > 0)) WHERE judged >= {least}"""

    base = " UNION ALL ".join(spans(i, *k) for i, k in enumerate(kinds))
    judged = " ".join(f"WHEN {fits} THEN bits >= {bits}" for fits, bits in classes)
    allow = " OR ".join(f"regexp_matches(s, {quoted(a)})" for a in allowed) or "false"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({base}),
spot AS ({spans(len(kinds), 'entropy', candidate, 0, window)}),
lone AS (SELECT spot.*, substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)) AS s FROM spot JOIN d USING (doc_id)
         WHERE NOT contains(substr(text, CAST(start + 1 AS BIGINT), CAST(stop - start AS BIGINT)), '://') AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = spot.doc_id AND base.start <= spot.start AND base.stop >= spot.stop)),
slid AS (SELECT doc_id, start, k, substr(s, k + j, 1) AS c FROM (SELECT doc_id, start, s, k, unnest(generate_series(0, {window - 1})) AS j
         FROM (SELECT doc_id, start, s, unnest(generate_series(1, length(s) - {window - 1})) AS k FROM lone))),
ent AS (SELECT doc_id, start, max(h) AS bits FROM (SELECT doc_id, start, k, log2({window}.0) - sum(n * log2(n)) / {window}.0 AS h
        FROM (SELECT doc_id, start, k, c, count(*)::DOUBLE AS n FROM slid GROUP BY ALL) GROUP BY ALL) GROUP BY ALL),
slug AS (SELECT doc_id, start, 2 * coalesce(list_sum(list_transform(list_filter(string_split_regex(s, {quoted(parts)}), lambda x: regexp_matches(x, {quoted(word)})), lambda x: length(x))), 0) >= length(regexp_replace(s, {quoted(parts)}, '', 'g')) AS slug FROM lone),
added AS (SELECT doc_id, place, kind, start, stop FROM lone JOIN ent USING (doc_id, start) JOIN slug USING (doc_id, start) WHERE NOT slug AND NOT ({allow}) AND CASE {judged} ELSE false END),
every AS (SELECT *, true AS is_base FROM base UNION ALL SELECT *, false FROM added),
told AS (SELECT doc_id, {', '.join(f"count(*) FILTER (WHERE kind = {quoted(k[0])}) AS n_{k[0]}" for k in kinds)},
  coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) FILTER (WHERE is_base), '') AS b,
  string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, place) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f"coalesce(n_{k[0]}, 0)::BIGINT AS n_{k[0]}" for k in kinds)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""


#: CRC-32 by the rule: a table of remainders, and a fold over a text's bytes.
_CRC = """
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT))) AS tab)"""


def _crc(text: str) -> str:
    spelt = f"hex(encode({text}))"
    values = f"list_transform(range(0, CAST(length({spelt}) AS BIGINT), 2), lambda i: CAST('0x' || substr({spelt}, i + 1, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce({values}, lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)))"


RESAMPLING = f"""
WITH {_CRC},
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(regexp_extract_all({_LOW}, {_ALNUM}), []) AS w FROM documents),
b AS (SELECT row_number() OVER () AS row, coalesce(regexp_extract_all({_LOW}, {_ALNUM}), []) AS w FROM benchmark),
df AS (SELECT row, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT row, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)),
bf AS (SELECT array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM b, (VALUES (1), (2), (3)) v(n) WHERE len(w) >= n)),
f AS (SELECT g, {_crc("g")} % 10000 AS k FROM (SELECT g FROM df UNION SELECT g FROM bf), tab),
s AS (SELECT k, count(*) AS s FROM df JOIN f USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN f USING (g) GROUP BY k),
every AS (SELECT (SELECT count(*) FROM df) AS s_all, (SELECT count(*) FROM bf) AS t_all),
gain AS (SELECT k, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((coalesce(s, 0) + 1) * (t_all + 10000) AS DOUBLE))) AS gain
         FROM (SELECT unnest(range(10000)) AS k) LEFT JOIN s USING (k) LEFT JOIN t USING (k), every),
weights AS (SELECT row, CAST(sum(gain) AS BIGINT) AS weight, count(*) AS n FROM df JOIN f USING (g) JOIN gain USING (k) GROUP BY row),
scored AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256(concat('42:', CAST(doc_id AS VARCHAR))), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
           FROM d LEFT JOIN weights USING (row))
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored)
"""


def _way(e: str, cost: str, letters: str) -> str:
    """An element, its cost in nine digits ahead of its audit, with more of both: so the least string is the best way."""
    return f"(printf('%09d', CAST(substr({e}, 1, 9) AS BIGINT) + {cost}) || substr({e}, 10) || '{letters}')"


def _kept(to: str, role: str, states: str) -> str:
    keep = [f"CASE WHEN ok AND c = '{role}' THEN {_way(s, 'x', 'K')} END" for s in states.split()]
    change = [f"CASE WHEN ok THEN {_way(s, 'x + 1', 'R')} END" for s in states.split()]
    return f"least({', '.join([_way(to, '2', 'D'), *keep, *change])})"


CONVERSATIONS = f"""
WITH RECURSIVE {_CRC},
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
c AS (SELECT *, {_crc("k")} % 20 AS kind FROM b, tab),
e AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS r FROM e),
f AS (SELECT *, role[1] AS c, CASE WHEN NOT regexp_matches(text, {_SPACED}) THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '-' END AS fault FROM o),
g AS (SELECT conv_id, r, c, fault NOT IN ('b', 'd') AS ok, CASE fault WHEN 't' THEN 5 ELSE 0 END AS x FROM f),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS r, '000000000' AS e0, CAST(NULL AS VARCHAR) AS e1, CAST(NULL AS VARCHAR) AS e2, CAST(NULL AS VARCHAR) AS e3 FROM f
      UNION ALL
      SELECT conv_id, r, {_way("k0", "2", "D")}, least({_way("k1", "2", "D")}, CASE WHEN ok AND c = 's' THEN {_way("k0", "x", "K")} END), {_kept("k2", "u", "k0 k1 k3")}, {_kept("k3", "a", "k2")}
      FROM (SELECT w.conv_id, g.r, g.c, g.ok, g.x, e0 AS k0, e1 AS k1, least(e2, {_way("e0", "5", "I")}, {_way("e1", "5", "I")}, {_way("e3", "5", "I")}) AS k2, least(e3, {_way("e0", "10", "II")}, {_way("e1", "10", "II")}, {_way("e2", "5", "I")}) AS k3
            FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND g.r = w.r + 1)),
best AS (SELECT conv_id, CAST(substr(way, 1, 9) AS BIGINT) AS cost, substr(way, 10) AS audit
         FROM (SELECT conv_id, least(e0, e3, {_way("e0", "10", "II")}, {_way("e1", "10", "II")}, {_way("e2", "5", "I")}) AS way FROM w WHERE (conv_id, r) IN (SELECT (conv_id, max(r)) FROM f GROUP BY conv_id))),
letters AS (SELECT conv_id, i, audit[i] AS l FROM (SELECT conv_id, audit, unnest(generate_series(1, CAST(length(audit) AS BIGINT))) AS i FROM best)),
placed AS (SELECT *, sum(CASE WHEN l <> 'I' THEN 1 ELSE 0 END) OVER p AS r, sum(CASE WHEN l <> 'D' THEN 1 ELSE 0 END) OVER p AS j FROM letters WINDOW p AS (PARTITION BY conv_id ORDER BY i)),
given AS (SELECT placed.conv_id, i, l, j, CASE WHEN l <> 'I' THEN f.role END AS role, CASE WHEN l = 'I' THEN '' ELSE f.text END AS text FROM placed JOIN f ON f.conv_id = placed.conv_id AND f.r = greatest(placed.r, 1) WHERE l <> 'D'),
led AS (SELECT conv_id, max(CASE WHEN j = 1 AND l = 'K' AND role[1] = 's' THEN 1 ELSE 0 END) AS led FROM given GROUP BY conv_id),
lines AS (SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN (j - 1 - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS lines FROM given JOIN led USING (conv_id) GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated FROM f GROUP BY conv_id),
wrong AS (SELECT conv_id, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, lag(c) OVER (PARTITION BY conv_id ORDER BY r) || c AS pair FROM f) GROUP BY conv_id)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN wrong USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN lines USING (conv_id)
"""
