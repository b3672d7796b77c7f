"""DuckDB oracle SQL of the queries in ``catalog_models``, and of the copula and SMOTE tables."""

from __future__ import annotations

from ..functions.mathx import hash_uniform_sql, norm_cdf_sql, norm_ppf_sql, two_sided_p_sql
from ..operators.resample import MULTIPLIERS, PRIME, poisson_cuts
from ..spec import COPULA_CLIP, CORR_JITTER, DIR_HI, DIR_LO, DPD_LIMIT
from .oracle import (FEATS_C, FRAME_B, FRAME_C, LINEAR_BETA, MEAN_ABS, ORACLE, PREP_TRAIN, R, S_C, _cf_union, _dist_sql, fairness_ctes,
                     prepare_sql, rates_ctes)

RULE_OFFSET = 0.3
TWO48 = "281474976710656.0"
PREP = f"WITH {prepare_sql(FRAME_C)},\ntrn AS (SELECT * EXCLUDE (split) FROM prep WHERE split = 'train'),\n" \
       "tst AS (SELECT * EXCLUDE (split) FROM prep WHERE split = 'test')"


def open_uniform_sql(seed: int, salt: str, *keys: str) -> str:
    return f"(({hash_uniform_sql(seed, salt, *keys)} * {TWO48} + 0.5) / {TWO48})"


ORACLE["knn_all"] = f"""
WITH mv AS (SELECT vec_id AS id, embedding AS e FROM embeddings),
pr AS (SELECT a.id AS base_id, b.id AS nn_id, {_dist_sql('a.e', 'b.e')} AS dist FROM mv a, mv b WHERE a.id <> b.id),
kr AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY dist, nn_id) AS rank FROM pr)
SELECT base_id, CAST(rank AS INTEGER) AS rank, nn_id, {R('dist')} AS dist FROM kr WHERE rank <= 5"""


# ---------------------------------------------------------------------------
# SMOTE and the copula over any table of prepared rows
# ---------------------------------------------------------------------------
def smote_ctes(src: str, s_cols: list[str], tag: str = "", feats: list[str] = FEATS_C, seed: int = 42) -> str:
    """sm{tag}: synth_id, base_id, nn_id, gap, y, s_*, features."""
    vec = "[" + ", ".join(f"CAST({c} AS DOUBLE)" for c in feats) + "]"
    x = ", ".join(f"b.{c} + j.gap * (n.{c} - b.{c}) AS {c}" for c in feats)
    s_sel = "".join(f", sp.{c}" for c in s_cols)
    draw = f"floor({hash_uniform_sql(seed, 'smote_s', 'synth_id')} * (SELECT count(*) FROM {src}))"
    tup = f"""
sh{tag} AS (SELECT {', '.join(s_cols)}, count(*) AS cnt FROM {src} GROUP BY ALL),
sc{tag} AS (SELECT *, sum(cnt) OVER (ORDER BY {', '.join(s_cols)}) - cnt AS cb FROM sh{tag}),
sx{tag} AS (SELECT synth_id, {draw} AS pos FROM tt{tag}),
sp{tag}_ AS (SELECT synth_id, {', '.join(s_cols)} FROM sx{tag} JOIN sc{tag} ON pos >= cb AND pos < cb + cnt),""" if s_cols else ""
    join = f"JOIN sp{tag}_ sp ON sp.synth_id = j.synth_id" if s_cols else ""
    return f"""
cc{tag} AS (SELECT y, count(*) AS n FROM {src} GROUP BY y),
pl{tag} AS (SELECT arg_min(y, n * 10 + y) AS mino, min(n) AS m, max(n) - min(n) AS extra,
                   greatest(1, least(5, min(n) - 1)) AS k FROM cc{tag}),
mo{tag} AS (SELECT row_id AS id, {vec} AS e, {', '.join(feats)} FROM {src} WHERE y = (SELECT mino FROM pl{tag})),
kn{tag} AS (SELECT base_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS rank FROM (
  SELECT a.id AS base_id, min(ROW({_dist_sql('a.e', 'b.e')}, b.id), 5) AS l FROM mo{tag} a, mo{tag} b WHERE a.id <> b.id GROUP BY a.id)),
di{tag} AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS base_idx FROM mo{tag}),
tt{tag} AS (SELECT CAST(unnest(range(CAST((SELECT extra FROM pl{tag}) AS BIGINT))) AS BIGINT) AS synth_id),
dr{tag} AS (SELECT synth_id, CAST(floor({hash_uniform_sql(seed, 'smote_t', 'synth_id')} * CAST(m * k AS DOUBLE)) AS BIGINT) AS r, k,
                   {hash_uniform_sql(seed, 'smote_gap', 'synth_id')} AS gap FROM tt{tag}, pl{tag}),
jj{tag} AS (SELECT synth_id, gap, di.id AS base_id, kn.s[2] AS nn_id FROM dr{tag} dr JOIN di{tag} di ON di.base_idx = dr.r // dr.k
            JOIN kn{tag} kn ON kn.base_id = di.id AND kn.rank = dr.r % dr.k + 1),{tup}
sm{tag} AS (SELECT j.synth_id, j.base_id, j.nn_id, j.gap, CAST((SELECT mino FROM pl{tag}) AS INTEGER) AS y{s_sel}, {x}
            FROM jj{tag} j JOIN mo{tag} b ON b.id = j.base_id JOIN mo{tag} n ON n.id = j.nn_id {join})"""


def copula_ctes(src: str, n_extra: str, s_cols: list[str], tag: str = "", feats: list[str] = FEATS_C, seed: int = 42,
                salt: str = "copula") -> str:
    """cop{tag}: synth_id, features, y, s_*. The correlation matrix is taken to be safely positive definite."""
    d = len(feats)
    n = f"(SELECT count(*) FROM {src})"
    u = lambda c: f"least(greatest(r_{c} / ({n} + 1), {COPULA_CLIP!r}), 1 - {COPULA_CLIP!r})"
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY {c}) + 1) / 2.0 AS r_{c}" for c in feats)
    corr = ", ".join(f"corr(z_{feats[i]}, z_{feats[j]}) AS c{j}_{i}" for i in range(d) for j in range(i + 1, d))
    chol = []
    for j in range(d):
        own = " - ".join([f"(1.0 + {CORR_JITTER!r})", *[f"l{j}_{k} * l{j}_{k}" for k in range(j)]])
        chol.append(f"sqrt({own}) AS l{j}_{j}")
        for i in range(j + 1, d):
            rest = " - ".join([f"c{i}_{j}", *[f"l{i}_{k} * l{j}_{k}" for k in range(j)]])
            chol.append(f"({rest}) / l{j}_{j} AS l{i}_{j}")
    mixed = ", ".join(" + ".join(f"l{i}_{j} * z{j}" for j in range(i + 1)) + f" AS x{i}" for i in range(d))
    values = " ".join(f"JOIN o{tag}_{i} ON o{tag}_{i}.pos = p.p{i}" for i in range(d))
    ctes = [f"rk{tag}_ AS (SELECT {ranks} FROM {src})",
            f"su{tag}_ AS (SELECT {', '.join(f'{u(c)} AS u_{c}' for c in feats)} FROM rk{tag}_)",
            f"sc{tag}_ AS (SELECT {', '.join(f'{norm_ppf_sql(f'u_{c}')} AS z_{c}' for c in feats)} FROM su{tag}_)",
            f"cr{tag}_ AS (SELECT {corr} FROM sc{tag}_)",
            f"ch{tag}_ AS (SELECT {', '.join(chol)} FROM cr{tag}_)",
            f"id{tag}_ AS (SELECT CAST(unnest(range(CAST({n_extra} AS BIGINT))) AS BIGINT) AS synth_id)",
            f"uu{tag}_ AS (SELECT synth_id, {', '.join(f'{open_uniform_sql(seed, f'{salt}_z{j}', 'synth_id')} AS u{j}' for j in range(d))} FROM id{tag}_)",
            f"zz{tag}_ AS (SELECT synth_id, {', '.join(f'{norm_ppf_sql(f'u{j}')} AS z{j}' for j in range(d))} FROM uu{tag}_)",
            f"mx{tag}_ AS (SELECT synth_id, {mixed} FROM zz{tag}_, ch{tag}_)",
            f"cd{tag}_ AS (SELECT synth_id, {', '.join(f'{norm_cdf_sql(f'x{i}')} AS q{i}' for i in range(d))} FROM mx{tag}_)",
            f"ps{tag}_ AS (SELECT synth_id, {', '.join(f'CAST(least(greatest(floor(q{i} * {n}), 0), {n} - 1) AS BIGINT) AS p{i}' for i in range(d))} FROM cd{tag}_)",
            *[f"o{tag}_{i} AS (SELECT {c} AS v{i}, row_number() OVER (ORDER BY {c}) - 1 AS pos FROM {src})" for i, c in enumerate(feats)],
            f"th{tag}_ AS (SELECT {', '.join(s_cols)}, count(*) AS cnt FROM {src} GROUP BY ALL)",
            f"tc{tag}_ AS (SELECT *, sum(cnt) OVER (ORDER BY {', '.join(s_cols)}) - cnt AS cb FROM th{tag}_)",
            f"tx{tag}_ AS (SELECT synth_id, floor({hash_uniform_sql(seed, f'{salt}_s', 'synth_id')} * {n}) AS sp FROM id{tag}_)",
            f"cop{tag} AS (SELECT p.synth_id, {', '.join(f'v{i} AS {c}' for i, c in enumerate(feats))}, "
            f"CAST({hash_uniform_sql(seed, f'{salt}_y', 'p.synth_id')} < (SELECT avg(CAST(y AS DOUBLE)) FROM {src}) AS INTEGER) AS y, "
            f"{', '.join(f't.{c}' for c in s_cols)} FROM ps{tag}_ p {values} JOIN tx{tag}_ x ON x.synth_id = p.synth_id "
            f"JOIN tc{tag}_ t ON x.sp >= t.cb AND x.sp < t.cb + t.cnt)"]
    return ",\n".join(ctes)


_cols = ", ".join(f"{R(c)} AS {c}" for c in S_C + FEATS_C)
ORACLE["smote_orders"] = f"""WITH {PREP_TRAIN},{smote_ctes('trn', S_C)}
SELECT synth_id, base_id, nn_id, {R('gap')} AS gap, y, {_cols}, 'smote' AS origin FROM sm"""
ORACLE["copula_sample"] = f"""WITH {PREP_TRAIN},
{copula_ctes('trn', '(SELECT count(*) FROM trn)', S_C)}
SELECT synth_id, y, {_cols}, 'copula' AS origin FROM cop"""


def synth_id_sql(code: int, x: str) -> str:
    return f"-({code << 40} + {x} + 1)"


def _augment_full() -> str:
    each = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in S_C + FEATS_C)
    names = ", ".join(S_C + FEATS_C)
    dom = " UNION ALL ".join(f"SELECT DISTINCT {j} AS a, '{c}' AS attr, s_{c} AS s, {c} AS f FROM trn"
                             for j, c in enumerate(["c_mktsegment", "r_name"]))
    return f"""WITH {PREP_TRAIN},{smote_ctes('trn', S_C, 'a')},
allr AS (SELECT row_id, y, {each} FROM trn UNION ALL SELECT {synth_id_sql(1, 'synth_id')}, y, {each} FROM sma),
{copula_ctes('allr', '(SELECT greatest(1, count(*) // 2) FROM trn)', S_C, 'b')},
dom AS ({dom}),
vi AS (SELECT attr, s, f, row_number() OVER (ORDER BY a, f, s) AS vi FROM dom),
bi AS (SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS bi FROM trn),
cfv AS ({_cf_union('trn')}),
cf AS (SELECT {synth_id_sql(2, "(bi.bi * (SELECT count(*) + 1 FROM dom) + coalesce(vi.vi, 0))")} AS row_id, cfv.y, {each}
       FROM cfv JOIN bi ON bi.row_id = cfv.base_id LEFT JOIN vi ON vi.attr = cfv.cf_attr AND vi.s = cfv.cf_value),
un AS (SELECT row_id, y, {names}, CASE WHEN row_id < 0 THEN 'smote' ELSE 'real' END AS origin FROM allr
  UNION ALL SELECT {synth_id_sql(3, 'synth_id')}, y, {names}, 'copula' FROM copb
  UNION ALL SELECT row_id, y, {names}, 'cf' FROM cf)
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(y AS INTEGER) AS y, {_cols}, origin FROM un"""


ORACLE["augment_full"] = _augment_full()


# ---------------------------------------------------------------------------
# The rule model: explanations, leakage, scores
# ---------------------------------------------------------------------------
def rule_sql(x, offset: float = RULE_OFFSET) -> str:  # noqa: ANN001
    """The rule's probability; ``x`` gives the SQL of a feature."""
    z = " + ".join(["0.0", *[f"{b!r} * {x(c)}" for c, b in LINEAR_BETA.items()]])
    return f"(1.0 / (1.0 + exp(-(({z}) - {offset!r}))))"


def lattice_sql(train: str, test: str, offset: float = RULE_OFFSET) -> str:
    """(row_id, s_c_mktsegment, feature, phi): Shapley values from all pairs of coalitions a feature joins."""
    d = len(FEATS_C)
    means = ", ".join(f"avg({c}) AS m_{c}" for c in FEATS_C)
    bit = {c: 1 << j for j, c in enumerate(FEATS_C)}
    value = rule_sql(lambda c: f"(CASE WHEN (m & {bit[c]}) <> 0 THEN {c} ELSE m_{c} END)", offset)
    fact = [1, 1, 2, 6, 24, 120]
    weight = "CASE bit_count(a.m) " + " ".join(f"WHEN {s} THEN {fact[s] * fact[d - s - 1] / fact[d]!r}" for s in range(d)) + " END"
    parts = " UNION ALL ".join(
        f"SELECT a.row_id, any_value(a.s_c_mktsegment) AS s_c_mktsegment, '{c}' AS feature, sum({weight} * (b.v - a.v)) AS phi "
        f"FROM v a JOIN v b ON b.row_id = a.row_id AND b.m = a.m + {bit[c]} WHERE (a.m & {bit[c]}) = 0 GROUP BY a.row_id" for c in FEATS_C)
    return f"""
WITH bm AS (SELECT {means} FROM {train}),
v AS (SELECT row_id, s_c_mktsegment, m, {value} AS v FROM {test}, bm, (SELECT unnest(range({1 << d})) AS m) q)
{parts}"""


ORACLE["kernel_shap"] = f"""{PREP}
SELECT row_id, {R('s_c_mktsegment')} AS s_c_mktsegment, feature, {R('phi')} AS phi FROM ({lattice_sql('trn', 'tst')})"""


def lime_sql(train: str, test: str, offset: float = RULE_OFFSET, draws: int = 200, seed: int = 42) -> str:
    """(row_id, feature, weight): weighted ridge fits by elimination."""
    d = len(FEATS_C)
    st = ", ".join(f"avg({c}) AS m{j}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS d{j}" for j, c in enumerate(FEATS_C))
    own = ", ".join(f"({c} - m{j}) / d{j} AS o{j}" for j, c in enumerate(FEATS_C))
    z = ", ".join(f"CASE WHEN s = 0 THEN o{j} ELSE {norm_ppf_sql(f'u{j}')} END AS z{j}" for j in range(d))
    gap = " + ".join(f"(z{j} - o{j}) * (z{j} - o{j})" for j in range(d))
    y = rule_sql(lambda c: f"(z{FEATS_C.index(c)} * d{FEATS_C.index(c)} + m{FEATS_C.index(c)})", offset)
    sums = ["sum(w) AS sw", "sum(w * y) AS sy", *[f"sum(w * z{i}) AS s{i}, sum(w * z{i} * y) AS t{i}" for i in range(d)],
            *[f"sum(w * z{i} * z{j}) AS g{i}_{j}" for i in range(d) for j in range(i, d)]]
    steps = [", ".join([f"g{i}_{j} - s{i} * s{j} / sw{' + 1.0' if i == j else ''} AS a0_{i}_{j}" for i in range(d) for j in range(i, d)]
                       + [f"t{i} - s{i} * sy / sw AS b0_{i}" for i in range(d)])]
    for p in range(d - 1):
        steps.append(", ".join([f"a{p}_{i}_{j} - a{p}_{p}_{i} / a{p}_{p}_{p} * a{p}_{p}_{j} AS a{p + 1}_{i}_{j}" for i in range(p + 1, d) for j in range(i, d)]
                               + [f"b{p}_{i} - a{p}_{p}_{i} / a{p}_{p}_{p} * b{p}_{p} AS b{p + 1}_{i}" for i in range(p + 1, d)]))
    back = []
    for i in reversed(range(d)):
        rest = "".join(f" - a{i}_{i}_{j} * x{j}" for j in range(i + 1, d))
        back.append(f"(b{i}_{i}{rest}) / a{i}_{i}_{i} AS x{i}")
    chain = "".join(f",\ne{k + 1} AS (SELECT *, {s} FROM e{k})" for k, s in enumerate(steps))
    parts = " UNION ALL ".join(f"SELECT row_id, '{c}' AS feature, x{j} AS weight FROM sol" for j, c in enumerate(FEATS_C))
    return f"""
WITH st_ AS (SELECT {st} FROM {train}),
o_ AS (SELECT row_id, {own}, s FROM {test}, st_, (SELECT unnest(range({draws})) AS s) q),
u_ AS (SELECT *, {', '.join(f'{open_uniform_sql(seed, f"lime{j}", "row_id", "s")} AS u{j}' for j in range(d))} FROM o_),
z_ AS (SELECT row_id, {', '.join(f'o{j}' for j in range(d))}, {z} FROM u_),
w_ AS (SELECT *, sqrt(exp(-({gap}) / {0.75 * 0.75 * d!r})) AS w, {y} AS y FROM z_, st_),
e0 AS (SELECT row_id, {', '.join(sums)} FROM w_ GROUP BY row_id){chain},
sol AS (SELECT *, {', '.join(back)} FROM e{len(steps)})
{parts}"""


ORACLE["lime"] = f"{PREP}\nSELECT row_id, feature, {R('weight')} AS weight FROM ({lime_sql('trn', 'tst')})"
_hit = f"CAST(y = CAST({rule_sql(lambda c: c)} >= 0.5 AS INTEGER) AS DOUBLE)"
ORACLE["leakage_rule"] = f"""{PREP},{smote_ctes('tst', [], 'l')},
h AS (SELECT 0 AS syn, {_hit} AS hit FROM tst UNION ALL SELECT 1, {_hit} FROM sml),
g AS (SELECT avg(hit) FILTER (WHERE syn = 0) * 100 AS real_only, avg(hit) * 100 AS real_plus_synth FROM h)
SELECT {R('real_only')} AS real_only, {R('real_plus_synth')} AS real_plus_synth, {R('real_only - real_plus_synth')} AS delta FROM g"""
ORACLE["minmax_scores"] = f"""{PREP},
r AS (SELECT row_id, {' + '.join(['0.0', *[f'{b!r} * {c}' for c, b in LINEAR_BETA.items()]])} AS raw FROM tst),
m AS (SELECT min(raw) AS lo, max(raw) AS hi FROM r)
SELECT row_id, {R('raw')} AS raw, {R('(raw - lo) / (hi - lo + 1e-9)')} AS proba FROM r, m"""


# ---------------------------------------------------------------------------
# Bootstrap, CSV, ids, dictionaries
# ---------------------------------------------------------------------------
_weight = " + ".join(f"CAST(r >= {int(c * PRIME)} AS INTEGER)" for c in poisson_cuts())
ORACLE["bootstrap_docs"] = f"""
WITH h AS (SELECT CAST(lang AS VARCHAR) AS lang, CAST(y = pred AS INTEGER) AS hit,
                  ('0x' || substr(md5('42:boot:' || doc_id), 1, 12))::BIGINT % {PRIME} AS key FROM ({FRAME_B})),
b AS (SELECT unnest(range(1, 5001)) AS b),
t1 AS (SELECT lang, hit, key, b, (key + b * {MULTIPLIERS[0]}) % {PRIME} AS t FROM h, b),
t2 AS (SELECT lang, hit, key, b, (t * t + b) % {PRIME} AS t FROM t1),
t3 AS (SELECT lang, hit, b, (t * {MULTIPLIERS[1]} + key) % {PRIME} AS t FROM t2),
t4 AS (SELECT lang, hit, b, (t * t + t) % {PRIME} AS r FROM t3),
w AS (SELECT lang, b, sum(hit * ({_weight})) / sum({_weight}) AS m FROM t4 GROUP BY lang, b HAVING sum({_weight}) > 0),
q AS (SELECT lang, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM w GROUP BY lang),
e AS (SELECT lang, count(*) AS n, avg(hit) AS mean FROM h GROUP BY lang)
SELECT e.lang, e.n, {R('mean')} AS mean, {R('lo')} AS ci_low, {R('hi')} AS ci_high
FROM e JOIN q ON e.lang IS NOT DISTINCT FROM q.lang"""

ORACLE["csv_quarantine"] = f"""
SELECT c_custkey, c_name, c_nationkey,
  {R("CASE WHEN c_custkey % 7 = 0 OR c_custkey % 13 = 0 OR c_custkey % 29 = 0 THEN NULL ELSE c_acctbal END")} AS c_acctbal,
  CASE WHEN c_custkey % 11 = 0 OR c_custkey % 31 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 17 <> 0 AND c_custkey % 37 <> 0"""
ORACLE["csv_rejects"] = """
WITH t AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'NA' WHEN c_custkey % 13 = 0 THEN '12.x' WHEN c_custkey % 29 = 0 THEN 'N/A' END AS bal,
  CASE WHEN c_custkey % 11 = 0 THEN '?' WHEN c_custkey % 31 = 0 THEN '' ELSE c_mktsegment END AS seg FROM customer)
SELECT 'broken line' AS reason, CAST(NULL AS VARCHAR) AS "column", c_custkey || ',' || c_name AS value, 1::BIGINT AS n
FROM t WHERE c_custkey % 17 = 0
UNION ALL SELECT 'broken line', NULL, c_custkey || ',' || c_name || ',' || c_nationkey || ',' || coalesce(bal, c_acctbal::VARCHAR) || ',' || seg || ',more', 1
FROM t WHERE c_custkey % 37 = 0 AND c_custkey % 17 <> 0
UNION ALL SELECT 'not of the type', 'c_acctbal', '12.x', count(*) FROM t
WHERE bal = '12.x' AND c_custkey % 17 <> 0 AND c_custkey % 37 <> 0 HAVING count(*) > 0"""
ORACLE["stable_ids"] = """
SELECT l_returnflag, count(*) AS n, (SELECT count(*) FROM lineitem) AS n_ids, 0::BIGINT AS low,
       (SELECT count(*) - 1 FROM lineitem) AS high FROM lineitem GROUP BY l_returnflag"""
ORACLE["encode_large"] = """
WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'first' WHEN 2 THEN NULL ELSE l_orderkey::VARCHAR END AS key FROM lineitem),
e AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS code FROM (SELECT DISTINCT key FROM t WHERE key IS NOT NULL AND l_orderkey % 3 <> 0))
SELECT l_orderkey, l_linenumber, CAST(coalesce(code, 0) AS DOUBLE) AS key FROM t LEFT JOIN e USING (key)"""


# ---------------------------------------------------------------------------
# Run history: rule-scored runs of frame C
# ---------------------------------------------------------------------------
VARIANT_OFFSETS = {"baseline": 0.3, "smote": 0.25, "cf": 0.2, "gan": 0.15, "smote_gan": 0.1, "full": -0.2}
RUN_SEEDS = (42, 43)


def run_ctes(s: int) -> str:
    """rn{s}: one row with everything a run row holds."""
    preds = ", ".join(f"CAST({rule_sql(lambda c: c, o)} >= 0.5 AS INTEGER) AS pred_{k}" for k, o in VARIANT_OFFSETS.items())
    fair = ""
    for t, k in (("b", "baseline"), ("f", "full")):
        frame = f"SELECT y, s_c_mktsegment AS c_mktsegment, s_r_name AS r_name, pred_{k} AS pred FROM sx{s}"
        fair += rates_ctes("orders_tab", frame, ["c_mktsegment", "r_name"], f"{t}{s}") + "," + fairness_ctes(f"{t}{s}") + f""",
fs{t}{s} AS (SELECT avg(dpd) AS dpd_avg, avg(dir) AS dir_avg, avg(eod) AS eod_avg, avg(bias_score) AS bias_score,
  count(*) FILTER (WHERE verdict = 'FAIL') AS fail_count FROM fv{t}{s}),"""
    hit = f"CAST(y = CAST({rule_sql(lambda c: c, VARIANT_OFFSETS['full'])} >= 0.5 AS INTEGER) AS DOUBLE)"
    pos = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FEATS_C)) + " END"
    return f"""
pp{s} AS (WITH {prepare_sql(FRAME_C, s)} SELECT * FROM prep),
trn{s} AS (SELECT * EXCLUDE (split) FROM pp{s} WHERE split = 'train'),
tst{s} AS (SELECT * EXCLUDE (split) FROM pp{s} WHERE split = 'test'),
sx{s} AS (SELECT *, {preds} FROM tst{s}),
ac{s} AS (SELECT {', '.join(f"avg(CAST(y = pred_{k} AS INTEGER)) AS accuracy_{k}" for k in VARIANT_OFFSETS)} FROM sx{s}),{fair}
{smote_ctes(f'tst{s}', [], f'l{s}', seed=s).strip()},
lh{s} AS (SELECT 0 AS syn, {hit} AS hit FROM tst{s} UNION ALL SELECT 1, {hit} FROM sml{s}),
lk{s} AS (SELECT avg(hit) FILTER (WHERE syn = 0) * 100 AS real_only, avg(hit) * 100 AS real_plus_synth FROM lh{s}),
ia{s} AS (SELECT feature, {MEAN_ABS} AS ma FROM ({lattice_sql(f'trn{s}', f'tst{s}', VARIANT_OFFSETS['full'])}) GROUP BY feature),
ib{s} AS (SELECT feature, {MEAN_ABS} AS ma FROM ({lattice_sql(f'trn{s}', f'tst{s}', VARIANT_OFFSETS['baseline'])}) GROUP BY feature),
il{s} AS (SELECT feature, sum(abs(weight)) / 25 AS ma FROM ({lime_sql(f'trn{s}', f"(SELECT * FROM tst{s} ORDER BY {hash_uniform_sql(s, 'lime_rows', 'row_id')}, row_id LIMIT 25)", VARIANT_OFFSETS['full'], seed=s)}) GROUP BY feature),
tk{s} AS (SELECT list(feature ORDER BY ma DESC, {pos}) AS shap FROM ia{s}),
tl{s} AS (SELECT list(feature ORDER BY ma DESC, {pos}) AS lime FROM il{s}),
rn{s} AS (SELECT 'orders_tab' AS dataset, {s} AS seed, (SELECT count(*) FROM trn{s}) AS n_train, (SELECT count(*) FROM tst{s}) AS n_test,
  ac{s}.*, {', '.join(f'{t}.{m} AS {m}_{w}' for t, w in (('b', 'before'), ('f', 'after')) for m in ('dpd_avg', 'dir_avg', 'eod_avg', 'bias_score', 'fail_count'))},
  lk{s}.*, tk{s}.shap, tl{s}.lime FROM ac{s}, fsb{s} b, fsf{s} f, lk{s}, tk{s}, tl{s})"""


RUNS = "WITH " + ",".join(run_ctes(s) for s in RUN_SEEDS) + ",\nruns AS (" + " UNION ALL ".join(f"SELECT * FROM rn{s}" for s in RUN_SEEDS) + ")"
_fair = [f"{m}_{t}" for t in ("before", "after") for m in ("dpd_avg", "dir_avg", "eod_avg", "bias_score", "fail_count")]
ORACLE["runs_flat"] = f"""{RUNS}
SELECT dataset, CAST(seed AS INTEGER) AS seed, n_train, n_test, CAST(5 AS INTEGER) AS feature_count, 'c_mktsegment, r_name' AS sensitive,
  {', '.join(f"{R(f'accuracy_{k}')} AS accuracy_{k}" for k in VARIANT_OFFSETS)}, array_to_string(shap, ', ') AS shap_topk,
  array_to_string(lime, ', ') AS lime_topk, {', '.join(f'{R(c)} AS {c}' for c in _fair)}, 1::BIGINT AS n_failed FROM runs"""
_round = lambda x, n: f"(round(CAST({x} AS DOUBLE), {n}) + 0.0)"
ORACLE["runs_summary"] = f"""{RUNS},
st AS (SELECT dataset, avg(accuracy_full) AS mean, min(accuracy_full) AS low, max(accuracy_full) AS high, count(*) AS runs FROM runs GROUP BY dataset)
SELECT dataset, CAST(seed AS INTEGER) AS seed, {_round('accuracy_baseline * 100', 2)} AS accuracy_baseline, {_round('accuracy_full * 100', 2)} AS accuracy_full,
  {', '.join(f"{_round(f'{m}_avg_{t}', 3)} AS {m}_{t}" for m in ('dpd', 'dir', 'eod') for t in ('before', 'after'))},
  CASE WHEN fail_count_before > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict_before, CASE WHEN fail_count_after > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict_after,
  {R('mean')} AS mean, {R('low')} AS low, {R('high')} AS high, runs FROM runs JOIN st USING (dataset)"""


def _tables_sql() -> str:
    jac = lambda c: f"len(list_intersect(a.{c}[1:2], b.{c}[1:2])) / len(list_distinct(list_concat(a.{c}[1:2], b.{c}[1:2])))"
    ds = f"""{RUNS},
pj AS (SELECT avg({jac('shap')}) AS shap, var_pop({jac('shap')}) AS shap_var, avg({jac('lime')}) AS lime, var_pop({jac('lime')}) AS lime_var
       FROM runs a JOIN runs b ON a.seed < b.seed),
sf AS (SELECT feature, avg(before) AS before, avg(after) AS after FROM ({' UNION ALL '.join(
        f'SELECT feature, ib{s}.ma AS before, ia{s}.ma AS after FROM ia{s} JOIN ib{s} USING (feature)' for s in RUN_SEEDS)}) GROUP BY feature),
fl AS (SELECT feature, max(note) AS note FROM ({' UNION ALL '.join(f"SELECT feature, CASE WHEN ratio > 0.2 THEN 'flagged' ELSE '' END AS note FROM ("
        f"SELECT g.feature, (max(g.ma) - min(g.ma)) / greatest(1e-6, any_value(ia{s}.ma)) AS ratio FROM (SELECT feature, s_c_mktsegment, {MEAN_ABS} AS ma FROM ("
        + lattice_sql(f'trn{s}', f'tst{s}', VARIANT_OFFSETS['full']) + f") GROUP BY 1, 2) g JOIN ia{s} ON ia{s}.feature = g.feature GROUP BY g.feature)" for s in RUN_SEEDS)}) GROUP BY feature),
d AS (SELECT avg(accuracy_baseline) * 100 AS base, avg(accuracy_smote_gan) * 100 AS sg, avg(accuracy_cf) * 100 AS cf, avg(accuracy_full) * 100 AS mean,
  min(accuracy_full) * 100 AS low, max(accuracy_full) * 100 AS high, avg(real_plus_synth) AS rs, avg(real_only) AS ro, avg(real_only - real_plus_synth) AS delta,
  {', '.join(f'avg({m}_avg_{t}) AS {m}_{t}' for m in ('dpd', 'dir', 'eod') for t in ('before', 'after'))},
  CASE WHEN avg(bias_score_before) <> 0 THEN 100.0 * (avg(bias_score_before) - avg(bias_score_after)) / avg(bias_score_before) END AS red FROM runs)"""
    rows = []

    def add(tab: str, key: str, col: str, value: str | None, text: str | None = None, src: str = "d") -> None:
        rows.append(f"SELECT '{tab}' AS tab, {key} AS key, '{col}' AS col, {R(value) if value else 'CAST(NULL AS DOUBLE)'} AS value, "
                    f"{text or 'CAST(NULL AS VARCHAR)'} AS text FROM {src}")
    even = lambda x, n: f"round_even({x}, {n})"
    own, avg = "'orders_tab'", "'Average'"
    infl = lambda x: f"CASE WHEN abs({x}) >= 1 THEN 'Yes' ELSE 'No' END"
    for key, f, diff in ((own, lambda x: x, "delta"), (avg, lambda x: even(x, 1), even("ro - rs", 1))):
        add("T2", key, "Real+Synth (%)", f("rs"))
        add("T2", key, "Real Only (%)", f("ro"))
        add("T2", key, "Diff", diff)
        add("T2", key, "Inflated?", None, infl(diff))
    gain = even("mean - base", 1)
    for key, f in ((own, lambda x: x), (avg, lambda x: even(x, 1))):
        for col, x in (("Baseline", "base"), ("Avg (10 runs)", "mean"), ("Lowest", "low"), ("Highest", "high")):
            add("T3", key, col, f(x))
        add("T3", key, "Gain", gain)
    four = (("Baseline", "base"), ("S+G only", "sg"), ("CF only", "cf"), ("Base+S+G", "sg"), ("+CF", "mean"), ("Full Framework", "mean"))
    for key, f in ((own, lambda x: x), (avg, lambda x: even(x, 2))):
        for col, x in four:
            add("T4", key, col, f(x))
        add("T4", key, "Total Gain", gain)
    e2 = lambda x: even(x, 2)
    for col, x in (("Baseline", None), ("S+G only", f"{e2('sg')} - {e2('base')}"), ("CF only", f"{e2('cf')} - {e2('base')}"), ("Base+S+G", None),
                   ("+CF", f"{e2('mean')} - {e2('sg')}"), ("Full Framework", f"{e2('mean')} - {e2('mean')}"), ("Total Gain", None)):
        add("T4", "'Marginal'", col, even(x, 1) if x else None)
    five = (("DPD Before", "dpd_before"), ("DPD After", "dpd_after"), ("DIR Before", "dir_before"), ("DIR After", "dir_after"),
            ("EOD Before", "eod_before"), ("Bias Reduction (%)", "red"))
    for key, f in ((own, lambda x: x), (avg, lambda x: even(x, 2))):
        for col, x in five:
            add("T5", key, col, f(x))
    v = lambda t: f"CASE WHEN dir_{t} < {DIR_LO} OR dir_{t} > {DIR_HI} OR dpd_{t} > {DPD_LIMIT} THEN 'FAIL' ELSE 'PASS' END"
    add("T5", own, "Verdict", None, f"({v('before')}) || ' -> ' || ({v('after')})")
    add("T5", avg, "Verdict", None)
    for col, x in (("Before", "before"), ("After", "after")):
        add("T6", "'orders_tab/' || feature", col, x, None, "sf")
    add("T6", "'orders_tab/' || feature", "Note", None, "note", "fl")
    for key, f in ((own, lambda x: x), (avg, lambda x: even(x, 3))):
        for col, x in (("SHAP", "shap"), ("SHAP Var", "shap_var"), ("LIME", "lime"), ("LIME Var", "lime_var")):
            add("T7", key, col, f(x), None, "pj")
    add("V2", "'orders_tab/' || feature", "reduction_pct", "CASE WHEN before > 0 THEN round_even((before - after) / before * 100, 0) ELSE 0 END", None, "sf")
    add("V3", own, "err_low", "mean - low")
    add("V3", own, "err_high", "high - mean")
    add("V3", own, "gain_label", None, "printf('+%.1f', mean - base)")
    add("V4", own, "abs_delta", "abs(delta)")
    add("V4", own, "top", "greatest(rs, ro)")
    return ds + "\n" + "\nUNION ALL ".join(rows)


ORACLE["runs_tables"] = _tables_sql()


def _statistics_sql() -> str:
    metrics = {"Accuracy Gain": ("accuracy_baseline", "accuracy_full", 100.0), "DPD Change": ("dpd_avg_before", "dpd_avg_after", 1.0),
               "EOD Change": ("eod_avg_before", "eod_avg_after", 1.0), "Bias Score Change": ("bias_score_before", "bias_score_after", 1.0)}
    long = " UNION ALL ".join(f"SELECT dataset, seed, '{m}' AS metric, {b} * {f!r} AS b0, {a} * {f!r} AS a0 FROM runs" for m, (b, a, f) in metrics.items())
    z = "(md / (sd / sqrt(n)))"
    return f"""{RUNS},
lo AS (SELECT metric, a0 - b0 AS ch, ('0x' || substr(md5('42:boot:' || dataset || ':' || seed || ':' || metric), 1, 12))::BIGINT % {PRIME} AS key FROM ({long})),
b AS (SELECT unnest(range(1, 5001)) AS b),
t1 AS (SELECT metric, ch, key, b, (key + b * {MULTIPLIERS[0]}) % {PRIME} AS t FROM lo, b),
t2 AS (SELECT metric, ch, key, b, (t * t + b) % {PRIME} AS t FROM t1),
t3 AS (SELECT metric, ch, b, (t * {MULTIPLIERS[1]} + key) % {PRIME} AS t FROM t2),
t4 AS (SELECT metric, ch, b, (t * t + t) % {PRIME} AS r FROM t3),
w AS (SELECT metric, b, sum(ch * ({_weight})) / sum({_weight}) AS m FROM t4 GROUP BY metric, b HAVING sum({_weight}) > 0),
q AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM w GROUP BY metric),
e AS (SELECT metric, count(*) AS n, avg(ch) AS md, stddev_samp(ch) AS sd FROM lo GROUP BY metric),
p AS (SELECT *, CASE WHEN sd > 0 THEN {two_sided_p_sql(z)} END AS pv FROM e)
SELECT p.metric AS "Metric", {R('md')} AS "Mean", {R('lo')} AS "CI Low", {R('hi')} AS "CI High",
  CASE WHEN pv < 0.001 THEN '<0.001' ELSE printf('%.3f', pv) END AS "p-value", {R('md / sd')} AS "Cohen's d" FROM p JOIN q USING (metric)"""


ORACLE["runs_statistics"] = _statistics_sql()
