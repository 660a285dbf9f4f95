"""DuckDB SQL of the corpus queries that SQL can express."""
from __future__ import annotations


def _clusters(k: int = 16, rounds: int = 3, dim: int = 64) -> str:
    """Plain Lloyd rounds, one set of tables per round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS (
  SELECT rid, vec_id, v, c, distance, cv FROM (
    SELECT x.rid, x.vec_id, x.v, y.c, y.v AS cv,
           list_sum(list_transform(range(1, {dim + 1}), lambda i: (x.v[i] - y.v[i]) * (x.v[i] - y.v[i]))) AS distance,
           row_number() OVER (PARTITION BY x.rid ORDER BY distance, y.c) AS place
    FROM ints x CROSS JOIN cents{r} y) WHERE place = 1)""")
        if r < rounds:
            steps.append(f"""
parts{r} AS (SELECT c, d, sum(x) AS s, count(*) AS n
             FROM (SELECT c, unnest(range({dim})) AS d, unnest(v) AS x FROM near{r}) GROUP BY c, d),
cents{r + 1} AS MATERIALIZED (
  SELECT y.c, coalesce(m.v, y.v) AS v FROM cents{r} y
  LEFT JOIN (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS v
             FROM parts{r} GROUP BY c) m ON y.c = m.c)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
ints AS MATERIALIZED (
  SELECT rid, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM kept),
cents0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v
  FROM ints ORDER BY c LIMIT {k}),
{",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
       CAST(sum(distance) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM near{rounds}"""


# CRC-32 of a decimal number, byte by byte and bit by bit
_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                               lambda s, z: xor(s >> 1, 3988292384::BIGINT * (s & 1)))), 4294967295::BIGINT)"""

_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n, {_CRC32} % 9 AS h, conv_id - conv_id % 5 AS base FROM turns GROUP BY conv_id),
plan AS (SELECT s.conv_id, s.h, s.base, least(s.h, coalesce(b.n, 0)) AS take
         FROM sizes s LEFT JOIN sizes b ON s.base = b.conv_id),
rebuilt AS (
  SELECT p.conv_id, t.pos AS depth, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= p.take
  UNION ALL
  SELECT p.conv_id, t.pos - p.h + p.take, t.role, t.text FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.h),
whole AS (
  SELECT p.conv_id, coalesce(s.l, []) AS l FROM plan p LEFT JOIN (
    SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY depth) AS l FROM rebuilt GROUP BY conv_id) s
  ON p.conv_id = s.conv_id),
prefixes AS (SELECT conv_id, d, l[1:d] AS k, len(l) = d AS at_end
             FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM whole)),
nodes AS (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256
  FROM prefixes GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (
  SELECT a.*, coalesce(c.n, 0) AS n_children, p.conv_id AS parent_conv_id,
         CASE WHEN a.d = 0 THEN 0 ELSE (a.n_convs - 1) * strlen(a.k[a.d].text) END AS saved
  FROM nodes a LEFT JOIN kids c ON a.k = c.k AND a.d = c.d
  LEFT JOIN nodes p ON a.d > 0 AND p.d = a.d - 1 AND p.k = a.k[1:a.d - 1]),
below AS (SELECT k[1:i] AS k, i AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved
          FROM (SELECT k, n_children, saved, unnest(range(0, d + 1)) AS i FROM full_nodes) GROUP BY ALL)
SELECT a.conv_id, CAST(a.d AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, CAST(a.n_children AS BIGINT) AS n_children,
       CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN below b ON a.k = b.k AND a.d = b.d"""

def _quality() -> str:
    """Counts by plain lists, rates and their prior by sums over hosts, verdicts joined back."""
    word = r"[^\x20\x09-\x0D]"
    rules = {"symbols": ("n_symbols", "n_words", 100, 30), "dup_lines": ("n_dup_lines", "n_lines", 500, 300),
             "capitals": ("n_upper", "word_chars", 500, 300), "long_words": ("word_chars", "n_words", 10_000, 9_000),
             "repeats": ("n_repeat_words", "n_words", 200, 100)}

    def fails(rule, limit):
        num, base = rules[rule][:2]
        few = " AND n_dup_lines >= 3" if rule == "dup_lines" else ""
        return f"(1000 * {num} > {limit} * {base}{few})"

    counts = " UNION ALL ".join(
        f"SELECT source, '{r}' AS rule, count(*) AS n, count(*) FILTER (WHERE {fails(r, soft)}) AS k FROM m GROUP BY source"
        for r, (_, _, _, soft) in rules.items())
    bad = " OR ".join(f"{fails(r, hard)} OR (list_contains(host_strict, '{r}') AND {fails(r, soft)})"
                      for r, (_, _, hard, soft) in rules.items())
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (
  SELECT rid, doc_id, source, t, regexp_extract_all(t, '{word}+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM d),
windows AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g
            FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM again) GROUP BY rid),
m AS MATERIALIZED (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(l) AS n_lines, len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper
  FROM w LEFT JOIN covered USING (rid)),
long AS MATERIALIZED ({counts}),
prior AS (
  SELECT rule, mean, CASE WHEN spread > 1e-12 THEN least(1e6, greatest(10.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS conc
  FROM (SELECT rule, sum(k) / sum(n) AS mean,
               sum(CAST(k * k AS DOUBLE) / n) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS spread
        FROM long GROUP BY rule)),
strict AS (
  SELECT source, coalesce(list_sort(list(rule) FILTER (WHERE rate > 0.3 AND rate > round(2.0 * mean, 9))), []) AS host_strict
  FROM (SELECT l.source, l.rule, p.mean, round((l.k + p.mean * p.conc) / (l.n + p.conc), 9) AS rate
        FROM long l JOIN prior p USING (rule)) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce({bad}, false) AS kept,
       m.source, host_strict
FROM m JOIN strict ON m.source IS NOT DISTINCT FROM strict.source"""


SQL: dict[str, str] = {
    "op2_quality_rules": _quality(),
    "op12_centroid_clusters": _clusters(),
    "op13_conversation_trie": _TRIE,
}
