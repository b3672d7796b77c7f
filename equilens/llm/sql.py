"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from .secrets import RULES

OP11 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (
  SELECT doc_id, text, n, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
              THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, substr(text, 1, lo) AS pre, substr(text, lo + 1, hi - lo) AS mid, substr(text, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (hi - lo)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _either_case(pattern: str) -> str:
    """The pattern with ``(?i:...)`` spelled out in classes of both cases (ASCII letters only)."""
    head, sep, rest = pattern.partition("(?i:")
    if not sep:
        return pattern
    inner, _, tail = rest.partition(")")
    return head + "(" + "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in inner) + ")" + tail


def secrets_sql() -> str:
    """All rules: matches and the texts between them give the places."""
    parts = []
    for i, r in enumerate(RULES):
        pattern = _either_case(r.pattern).replace("'", "''")
        tail = "length(regexp_extract(m, '[A-Za-z0-9+/_.=-]+$'))" if r.tail > 1 else "0"
        parts.append(f"""
SELECT doc_id, {i} AS o, '{r.kind}' AS kind, s, s + length(m) AS e FROM (
  SELECT doc_id, m, (sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m))::BIGINT AS s FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM t)))
WHERE length(m) >= {r.least} AND {tail} >= {r.tail if r.tail > 1 else 0}""")
    base = "o < 3"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS ({' UNION ALL '.join(parts)}),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) FILTER ({base}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS p, piece FROM (
    SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
w AS (SELECT lang, p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, d, ws[i:i + d - 1] AS ph FROM (
    SELECT lang, ws, d, unnest(range(1, len(ws) - d + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS d) x)),
f AS (SELECT lang, d, ph, count(*) AS f FROM g GROUP BY lang, d, ph HAVING count(*) >= 30),
c AS (SELECT lang, d, ph, f AS a FROM f WHERE d >= 2),
cut AS (
  SELECT c.lang, c.ph, c.d, c.a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * c.a) // (l.f + r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, d)) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.ph = c.ph[1:k] JOIN f r ON r.lang = c.lang AND r.ph = c.ph[k + 1:]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
inside AS (
  SELECT lang, ph[i:i + m - 1] AS ph, max(a) AS longer FROM (
    SELECT lang, ph, d, a, m, unnest(range(1, d - m + 2)) AS i FROM (
      SELECT *, unnest(range(2, d)) AS m FROM c WHERE d > 2)) GROUP BY ALL),
kept AS (
  SELECT low.*, array_to_string(low.ph, ' ') AS phrase FROM low LEFT JOIN inside USING (lang, ph)
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE = {"op11_fill_in_middle": OP11, "op12_secret_scan": secrets_sql(), "op13_collocations": OP13}
