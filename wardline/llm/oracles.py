"""DuckDB SQL for the queries that SQL can express. Written apart from the operators: windows are counted anew each time."""

from __future__ import annotations

from wardline.llm import centroids, decontam, filter_audit, quality_rules, secrets


def _found(name: str, pattern: str, group: int = 0) -> str:
    p = pattern.replace("'", "''")
    return f"""
{name}_m AS (
  SELECT doc_id, t, string_split_regex(t, '{p}') AS gaps, regexp_extract_all(t, '{p}') AS hits,
         regexp_extract_all(t, '{p}', {group}) AS vals
  FROM d WHERE regexp_matches(t, '{p}')),
{name} AS (
  SELECT doc_id, list_sum([length(g) for g in gaps[:i]]) + coalesce(list_sum([length(h) for h in hits[:i - 1]]), 0) AS s,
         length(hits[i]) AS n, vals[i] AS v
  FROM {name}_m, unnest(range(1, len(hits) + 1)) AS u(i))"""


def _windows(c: secrets.CharClass) -> str:
    allowed = " AND ".join(f"NOT regexp_matches(v, '{p}')" for p in secrets.ALLOWED)
    # RE2 has no look-around: runs are taken whole, then those that touch another letter or digit are left out.
    bare = c.pattern.replace("(?<![0-9A-Za-z])", "").replace("(?![0-9A-Za-z])", "")
    alone = "" if bare == c.pattern else """
      AND NOT regexp_matches(substr(t, s::BIGINT, CASE WHEN s = 0 THEN 0 ELSE 1 END), '[0-9A-Za-z]')
      AND NOT regexp_matches(substr(t, (s + n + 1)::BIGINT, 1), '[0-9A-Za-z]')"""
    return _found(f"{c.kind}_all", bare).replace("SELECT doc_id, list_sum", "SELECT doc_id, t, list_sum") + f""",
{c.kind}_c AS (SELECT DISTINCT doc_id, s, n, v FROM {c.kind}_all_all WHERE {allowed}{alone}),
{c.kind}_w AS (
  SELECT DISTINCT doc_id, s, n, v FROM (
    SELECT doc_id, s, n, v, i, ch, count(*) AS k
    FROM (SELECT doc_id, s, n, v, i, unnest(string_split(substr(v, i, {c.width}), '')) AS ch
          FROM {c.kind}_c, unnest(range(1, n::BIGINT - {c.width} + 2)) AS u(i))
    WHERE ch <> '' GROUP BY ALL)
  GROUP BY doc_id, s, n, v, i HAVING sum(k * log2(k)) <= {c.width} * (log2({c.width}) - {c.bits}))""".replace(f"{c.kind}_all_all", f"{c.kind}_all")


def _clear(c: secrets.CharClass, earlier: list[str]) -> str:
    taken = " UNION ALL ".join(f"SELECT doc_id, s, n FROM {e}" for e in earlier)
    return f"""
{c.kind} AS (
  SELECT * FROM {c.kind}_w w WHERE NOT EXISTS (
    SELECT 1 FROM ({taken}) x WHERE x.doc_id = w.doc_id AND x.s < w.s + w.n AND w.s < x.s + x.n))"""


def _secrets() -> str:
    parts, earlier = [], ["assign", "access", "hex"]
    for c in secrets.CLASSES:
        parts += [_windows(c), _clear(c, earlier)]
        earlier = [*earlier, c.kind]
    every = " UNION ALL ".join(f"SELECT doc_id, s, n, {k} AS o, '{name}' AS kind FROM {name}" for k, name in enumerate(secrets.KINDS))
    ctes = [
        "d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
        _found("assign_any", secrets.ASSIGN, 2),
        "assign AS (SELECT * FROM assign_any WHERE length(v) >= 6)",
        _found("access", secrets.ACCESS),
        _found("hex", secrets.HEX),
        *parts,
        f"spans AS ({every})",
        """listed AS (
  SELECT doc_id, count(*) FILTER (o = 0) AS a, count(*) FILTER (o = 1) AS b, count(*) FILTER (o = 2) AS c,
         coalesce(string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, o) FILTER (o < 3), '') AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || (s + n)::BIGINT, ',' ORDER BY s, o) AS every
  FROM spans GROUP BY doc_id)""",
    ]
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)"""


SECRETS = _secrets()

_L = quality_rules.Limits()
QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
g AS (SELECT rid, i, array_to_string(ws[i:i + {_L.window - 1}], chr(1)) AS g
      FROM w, unnest(range(1, len(ws) - {_L.window} + 2)) AS u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, sum(least({_L.window}, i - coalesce(before, -{_L.window})))::BIGINT AS n_rep
        FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS before FROM twice) GROUP BY rid),
lines AS (SELECT w.rid, doc_id, source, p,
                 trim(regexp_replace(regexp_replace(lower(l), '[\x20\x09-\x0D]+', ' ', 'g'), '[0-9]+', '0', 'g')) AS line,
                 len([x FOR x IN string_split_regex(l, '[\x20\x09-\x0D]+') IF x <> '']) AS n
          FROM (SELECT rid, unnest(ls) AS l, unnest(range(len(ls))) AS p FROM w) w JOIN d USING (rid)),
hashed AS (SELECT lines.*, sig FROM lines JOIN (SELECT rid, string_agg(line, chr(10) ORDER BY p) AS sig FROM lines GROUP BY rid) USING (rid)),
common AS (SELECT source, line, min(doc_id) AS first_doc FROM hashed GROUP BY source, line HAVING count(DISTINCT sig) > {_L.min_docs}),
gone AS (SELECT rid, sum(n)::BIGINT AS n_gone FROM hashed h JOIN common c ON h.line = c.line AND h.source IS NOT DISTINCT FROM c.source
         WHERE doc_id IS DISTINCT FROM first_doc GROUP BY rid),
m AS (SELECT d.doc_id, d.t, ls, len(ws) AS n_words, coalesce(n_rep, 0) AS n_repeat_words, coalesce(n_gone, 0) AS n_removed_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
       len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, n_repeat_words,
       n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_pct} * n_words AS base_failed,
       NOT (n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_pct} * n_words)
         AND n_words - n_removed_words >= {_L.min_left} * n_words AS kept, n_removed_words
FROM m"""

LEAKS = rf"""
WITH d AS (SELECT DISTINCT doc_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents),
b AS (SELECT DISTINCT item_id, [x FOR x IN string_split_regex(lower(coalesce(text, '')), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM benchmark),
i AS (SELECT item_id, w, len(w) AS size, least(len(w), {decontam.SHINGLE}) AS k FROM b WHERE len(w) > 0),
ig AS (SELECT item_id, size, k, o, array_to_string(w[o + 1:o + k], ' ') AS g FROM i, unnest(range(size - k + 1)) AS u(o)),
ks AS (SELECT DISTINCT k FROM i),
dg AS (SELECT doc_id, len(w) AS n, k, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM d, ks, unnest(range(len(w) - k + 1)) AS u(p)),
win AS (SELECT DISTINCT doc_id, ig.k, least(size, n) AS size,
               greatest(0, least(p - o, n - least(size, n))) AS start
        FROM dg JOIN ig ON dg.g = ig.g AND dg.k = ig.k),
wg AS (SELECT win.doc_id, win.k, start, size, g, count(*) AS n
       FROM win JOIN d USING (doc_id), LATERAL (SELECT array_to_string(w[start + p + 1:start + p + k], ' ') AS g FROM unnest(range(size - k + 1)) AS u(p))
       GROUP BY ALL),
ic AS (SELECT item_id, g, count(*) AS n FROM ig GROUP BY ALL),
it AS (SELECT item_id, k, sum(n * length(g)) AS ti FROM ic JOIN i USING (item_id) GROUP BY ALL),
tot AS (SELECT doc_id, k, start, size, sum(n * length(g)) AS tw FROM wg GROUP BY ALL),
j AS (SELECT doc_id, wg.k, start, size, ic.item_id, sum(least(wg.n, ic.n) * length(wg.g)) AS common
      FROM wg JOIN ic ON wg.g = ic.g GROUP BY ALL),
m AS (SELECT doc_id, item_id, start, size, common, tw + ti - common AS either FROM j JOIN tot USING (doc_id, k, start, size) JOIN it USING (item_id, k)
      WHERE 100 * common >= {decontam.PERCENT} * (tw + ti - common))
SELECT doc_id, item_id, start::INTEGER AS start, size::INTEGER AS size, common::BIGINT AS common_weight, either::BIGINT AS either_weight
FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY common / either DESC, start) = 1"""


# Documents are counted by the set of filters they fail; orders are built by joins.
FILTERS = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d),
f AS (SELECT part, doc_id, [
        len(ws) < {filter_audit.MIN_WORDS}, 100 * len(list_distinct(ws)) < {filter_audit.MIN_DISTINCT_PCT} * len(ws),
        100 * len(regexp_extract_all(t, '[A-Z]')) > {filter_audit.MAX_CAPITAL_PCT} * length(t), regexp_matches(t, '[#$%&*|]'),
        coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)] AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
sets AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
         FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest(range(1, 6)) AS i),
seq AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.i, b.i, c.i, d.i, e.i] AS places
        FROM letter a JOIN letter b ON b.x <> a.x JOIN letter c ON c.x NOT IN (a.x, b.x)
             JOIN letter d ON d.x NOT IN (a.x, b.x, c.x) JOIN letter e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, places, unnest(range(1, 6))::INTEGER AS step FROM seq),
j AS (SELECT part, filter_order, step, places[step] AS i, n, good, toxic, fails[places[step]] AS hit,
             list_bool_or([fails[k] FOR k IN places[:step - 1]]) IS TRUE AS gone,
             list_sum([fails[k]::INT FOR k IN places]) = 1 AS lone
      FROM sets, steps),
r AS (SELECT part, filter_order, step, i,
             sum(n) FILTER (NOT hit AND NOT gone) AS kept, sum(n) FILTER (hit AND NOT gone) AS removed, sum(n) FILTER (hit AND gone) AS redundant,
             sum(n) FILTER (hit AND lone) AS unique_fails, sum(good) FILTER (hit AND NOT gone) AS good_lost,
             sum(toxic) FILTER (hit AND NOT gone) AS toxic_lost
      FROM j GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, i), 0)::BIGINT AS shapley
FROM r"""


def _centroids() -> str:
    """Distances as |q|^2 - 2 q.c + |c|^2 in doubles, which hold these integers exactly."""
    k, width, scale = centroids.CLUSTERS, centroids.WIDTH, centroids.SCALE
    ctes = [
        f"""v AS (SELECT row_number() OVER () AS rid, vec_id, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = {width} AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = {width})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id) NULLS LAST, q) - 1 AS c, q AS m FROM v
  QUALIFY c < {k})""",
    ]
    for r in range(centroids.ROUNDS + 1):
        ctes.append(f"""a{r} AS (SELECT rid, c, d FROM (
  SELECT rid, c, list_inner_product(q, q) - 2 * list_inner_product(q, m) + list_inner_product(m, m) AS d FROM v, c{r})
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)""")
        if r < centroids.ROUNDS:
            ctes.append(f"""s{r} AS (SELECT c, i, floor(sum(q[i])::BIGINT::DOUBLE / count(*)) AS x FROM a{r} JOIN v USING (rid), unnest(range(1, {width + 1})) AS u(i)
  GROUP BY c, i)""")
            ctes.append(f"""c{r + 1} AS (SELECT c, coalesce(n.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
  SELECT c, list(x ORDER BY i) AS m FROM s{r} GROUP BY c) n USING (c))""")
    r = centroids.ROUNDS
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string([x::BIGINT FOR x IN m], ',')) AS centroid_sha256
FROM a{r} JOIN v USING (rid) JOIN c{r} USING (c)"""


CENTROIDS = _centroids()
