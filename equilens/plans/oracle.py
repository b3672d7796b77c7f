"""DuckDB oracle SQL for the registered queries (plain SQL over the driver tables).

Written independently of the Spark plans: row-level joins, window functions
and GROUP BY, the way one would write the audit by hand. Shared pieces (the
normal CDF, hash draws) render from the same published constants.
"""

from __future__ import annotations

from ..functions.mathx import two_sided_p_sql
from ..spec import DIR_HI, DIR_LO, DPD_LIMIT, EOD_LIMIT, P_LIMIT

ORACLE: dict[str, str] = {}


def R(x: str) -> str:
    """round to 6 places, fold -0.0."""
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


# ---------------------------------------------------------------------------
# Frames
# ---------------------------------------------------------------------------
FRAME_A = """
SELECT CAST(l.l_returnflag = 'R' AS INTEGER) AS y,
       CAST(l.l_discount >= 0.05 AS INTEGER) AS pred,
       c.c_mktsegment, r.r_name, n.n_name
FROM lineitem l
JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""

FRAME_B = """
SELECT d.doc_id, d.lang, d.source, d.n_chars, CAST(lb.toxic AS INTEGER) AS y,
       CAST(d.n_chars >= (SELECT median(d2.n_chars) FROM documents d2
                          JOIN labels l2 ON d2.doc_id = l2.doc_id) AS INTEGER) AS pred
FROM documents d JOIN labels lb ON d.doc_id = lb.doc_id
"""

FRAME_C = """
SELECT o.o_orderkey AS row_id, CAST(o.o_orderstatus = 'F' AS INTEGER) AS y,
       o.o_totalprice, c.c_acctbal, o.o_orderpriority, c.c_mktsegment, r.r_name
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
"""


def unpivot(frame_cte: str, sensitive: list[str]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS sensitive, CAST({c} AS VARCHAR) AS grp, y, pred FROM {frame_cte}"
        for c in sensitive)


def rates_ctes(dataset: str, frame_sql: str, sensitive: list[str], tag: str = "") -> str:
    """CTEs f{tag} (frame), g{tag} (per group counts + rates)."""
    return f"""
f{tag} AS ({frame_sql}),
u{tag} AS ({unpivot(f'f{tag}', sensitive)}),
g{tag} AS (
  SELECT '{dataset}' AS dataset, sensitive, grp,
         CAST(count(*) AS BIGINT) AS n, CAST(sum(pred) AS BIGINT) AS n_pred_pos,
         CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(y * pred) AS BIGINT) AS n_tp
  FROM u{tag} GROUP BY sensitive, grp),
gr{tag} AS (
  SELECT *, n_pred_pos * 1.0 / n AS rate,
         CASE WHEN n_pos = 0 THEN 0.0 ELSE n_tp * 1.0 / n_pos END AS tpr,
         CASE WHEN n - n_pos = 0 THEN 0.0 ELSE (n_pred_pos - n_tp) * 1.0 / (n - n_pos) END AS fpr
  FROM g{tag})"""


def fairness_ctes(tag: str = "") -> str:
    """From gr{tag}: ranked groups, extremes, metrics -> fz{tag}."""
    p = two_sided_p_sql("z")
    return f"""
rk{tag} AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, sensitive ORDER BY rate DESC, grp) AS rp,
            row_number() OVER (PARTITION BY dataset, sensitive ORDER BY rate ASC, grp) AS ru,
            count(*) OVER (PARTITION BY dataset, sensitive) AS ng
  FROM gr{tag}),
ex{tag} AS (
  SELECT a.dataset, a.sensitive, CAST(a.ng AS BIGINT) AS n_groups,
         a.grp AS priv, b.grp AS unpriv, a.rate AS pp, b.rate AS pu,
         a.tpr AS tp_p, b.tpr AS tp_u, a.fpr AS fp_p, b.fpr AS fp_u,
         a.n AS n_p, b.n AS n_u, a.n_pred_pos AS s_p, b.n_pred_pos AS s_u
  FROM rk{tag} a JOIN rk{tag} b ON a.dataset = b.dataset AND a.sensitive = b.sensitive
  WHERE a.rp = 1 AND b.ru = 1),
m{tag} AS (
  SELECT *, (s_p + s_u) * 1.0 / greatest(n_p + n_u, 1) AS q FROM ex{tag}),
zz{tag} AS (
  SELECT *, sqrt(q * (1.0 - q) * (1.0 / greatest(n_p, 1) + 1.0 / greatest(n_u, 1))) AS se
  FROM m{tag}),
z2{tag} AS (
  SELECT dataset, sensitive, n_groups, priv, unpriv,
    CASE WHEN n_groups < 2 THEN 0.0 ELSE abs(pp - pu) END AS dpd,
    CASE WHEN n_groups < 2 THEN 1.0 WHEN pp > 0 THEN pu / pp ELSE 1.0 END AS dir,
    CASE WHEN n_groups < 2 THEN 0.0 ELSE greatest(abs(tp_p - tp_u), abs(fp_p - fp_u)) END AS eod,
    CASE WHEN n_groups < 2 OR se = 0 THEN 0.0 ELSE (pp - pu) / se END AS z
  FROM zz{tag}),
fz{tag} AS (
  SELECT *, CASE WHEN n_groups < 2 THEN 1.0 ELSE {p} END AS p_value,
         (dpd + greatest(0.0, 1.0 - dir) + eod) / 3.0 AS bias_score
  FROM z2{tag}),
fv{tag} AS (
  SELECT *, CASE WHEN dir < {DIR_LO} OR dir > {DIR_HI} THEN 'FAIL'
                 WHEN dpd > {DPD_LIMIT} THEN 'FAIL'
                 WHEN eod > {EOD_LIMIT} AND p_value < {P_LIMIT} THEN 'FAIL'
                 ELSE 'PASS' END AS verdict
  FROM fz{tag})"""


FAIR_COLS = ("dataset, sensitive, n_groups, priv, unpriv, " + ", ".join(
    f"{R(c)} AS {c}" for c in ("dpd", "dir", "eod", "z", "p_value", "bias_score")) + ", verdict")

FAIR_A = rates_ctes("orders_lines", FRAME_A, ["c_mktsegment", "r_name", "n_name"], "a") + "," + \
    fairness_ctes("a")
FAIR_B = rates_ctes("documents", FRAME_B, ["lang", "source"], "b") + "," + fairness_ctes("b")

ORACLE["group_rates_orders"] = "WITH " + rates_ctes(
    "orders_lines", FRAME_A, ["c_mktsegment", "r_name", "n_name"]) + f"""
SELECT dataset, sensitive, grp, n, n_pred_pos, n_pos, n_tp,
       {R('rate')} AS rate, {R('tpr')} AS tpr, {R('fpr')} AS fpr FROM gr"""

ORACLE["extreme_groups_orders"] = "WITH " + FAIR_A + f"""
SELECT dataset, sensitive, n_groups, priv, unpriv, {R('pp')} AS rate_priv, {R('pu')} AS rate_unpriv,
       CAST(n_p AS BIGINT) AS n_priv, CAST(n_u AS BIGINT) AS n_unpriv FROM exa"""

ORACLE["fairness_orders"] = "WITH " + FAIR_A + f"\nSELECT {FAIR_COLS} FROM fva"
ORACLE["fairness_orders_rowlevel"] = ORACLE["fairness_orders"]
ORACLE["fairness_docs"] = "WITH " + FAIR_B + f"\nSELECT {FAIR_COLS} FROM fvb"

ORACLE["fairness_summary"] = "WITH " + FAIR_A + "," + FAIR_B + f""",
allf AS (SELECT * FROM fva UNION ALL SELECT * FROM fvb)
SELECT dataset, {R('avg(dpd)')} AS dpd_avg, {R('avg(dir)')} AS dir_avg, {R('avg(eod)')} AS eod_avg,
       {R('avg(bias_score)')} AS bias_score,
       CAST(count(*) FILTER (WHERE verdict = 'FAIL') AS BIGINT) AS fail_count
FROM allf GROUP BY dataset"""

ORACLE["ztest"] = "WITH " + FAIR_A + "," + FAIR_B + f""",
allf AS (SELECT * FROM fva UNION ALL SELECT * FROM fvb)
SELECT dataset, sensitive, priv, unpriv, {R('z')} AS z, {R('p_value')} AS p_value FROM allf"""

ORACLE["verdict_grid"] = "WITH " + FAIR_A + "," + FAIR_B + f""",
allf AS (SELECT * FROM fva UNION ALL SELECT * FROM fvb),
grid(setting, dpd_limit, dir_lo, dir_hi, eod_limit, p_limit) AS (VALUES
  ('default', {DPD_LIMIT}, {DIR_LO}, {DIR_HI}, {EOD_LIMIT}, {P_LIMIT}),
  ('strict', 0.05, 0.9, {1.0 / 0.9!r}, 0.05, 0.05),
  ('lenient', 0.2, 0.6, {1.0 / 0.6!r}, 0.2, 0.01))
SELECT dataset, sensitive, setting,
  CASE WHEN dir < dir_lo OR dir > dir_hi THEN 'FAIL' WHEN dpd > dpd_limit THEN 'FAIL'
       WHEN eod > eod_limit AND p_value < p_limit THEN 'FAIL' ELSE 'PASS' END AS verdict
FROM allf, grid"""


# ---------------------------------------------------------------------------
# Stage 1: preparation
# ---------------------------------------------------------------------------
from ..functions.mathx import hash_uniform_sql  # noqa: E402

FRAME_E = f"""
SELECT row_id, y, o_totalprice,
       CASE WHEN row_id % 17 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
       CASE WHEN row_id % 19 = 0 THEN '?' ELSE o_orderpriority END AS o_orderpriority,
       c_mktsegment, r_name
FROM ({FRAME_C}) fc
"""

FRAME_E_CLEAN = f"""
SELECT row_id, y, o_totalprice, c_acctbal,
       CASE WHEN trim(o_orderpriority) IN ('?') THEN NULL ELSE o_orderpriority END AS o_orderpriority,
       CASE WHEN trim(c_mktsegment) IN ('?') THEN NULL ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN trim(r_name) IN ('?') THEN NULL ELSE r_name END AS r_name
FROM ({FRAME_E}) fe
"""

ORACLE["keep_columns"] = "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer"
ORACLE["drop_columns"] = "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer"
ORACLE["normalise_names"] = "SELECT c_custkey, c_mktsegment AS market_segment FROM customer"
ORACLE["null_tokens"] = f"""
SELECT row_id, {R('c_acctbal')} AS c_acctbal,
       CASE WHEN trim(o_orderpriority) = '?' THEN NULL ELSE o_orderpriority END AS o_orderpriority
FROM ({FRAME_E}) e"""
ORACLE["drop_missing"] = f"""
SELECT row_id, y, {R('o_totalprice')} AS o_totalprice, {R('c_acctbal')} AS c_acctbal,
       o_orderpriority, c_mktsegment, r_name
FROM ({FRAME_E_CLEAN}) e
WHERE row_id IS NOT NULL AND y IS NOT NULL AND o_totalprice IS NOT NULL AND c_acctbal IS NOT NULL
  AND o_orderpriority IS NOT NULL AND c_mktsegment IS NOT NULL AND r_name IS NOT NULL"""
ORACLE["label_from"] = """
SELECT o_orderkey, CAST(trim(o_orderstatus) = 'F' AS INTEGER) AS y_eq,
       CAST(trim(replace(o_orderpriority, '.', '')) <> '1-URGENT' AS INTEGER) AS y_ne,
       CAST(o_totalprice >= 100000.0 AS INTEGER) AS y_ge
FROM orders"""
ORACLE["to_binary_string"] = """
SELECT o_orderkey, CAST(o_orderstatus = (SELECT max(o_orderstatus) FROM orders) AS INTEGER) AS y
FROM orders"""
ORACLE["to_binary_float"] = """
SELECT o_orderkey, CAST(o_totalprice >= (SELECT median(o_totalprice) FROM orders) AS INTEGER) AS y
FROM orders"""
ORACLE["to_binary_int"] = """
SELECT CAST(l_linenumber = (SELECT max(l_linenumber) FROM lineitem) AS INTEGER) AS y,
       CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1"""
ORACLE["impute_median"] = f"""
WITH e AS ({FRAME_E})
SELECT row_id,
  {R('coalesce(c_acctbal, (SELECT coalesce(median(c_acctbal), 0.0) FROM e))')} AS c_acctbal,
  {R('coalesce(o_totalprice, (SELECT coalesce(median(o_totalprice), 0.0) FROM e))')} AS o_totalprice
FROM e"""


def mode_sql(src: str, col: str) -> str:
    return (f"coalesce((SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT 1), 'missing')")


ORACLE["impute_mode"] = f"""
WITH e AS ({FRAME_E_CLEAN})
SELECT row_id, coalesce(o_orderpriority, {mode_sql('e', 'o_orderpriority')}) AS o_orderpriority,
       coalesce(r_name, {mode_sql('e', 'r_name')}) AS r_name
FROM e"""


def split_ctes(src: str, seed: int, tag: str = "", test_size: float = 0.2) -> str:
    """sp{tag}: rows of {src} (with row_id, y) plus split, by exact per-class quotas."""
    u = hash_uniform_sql(seed, "split", "row_id")
    return f"""
cnt{tag} AS (SELECT y, count(*) AS n_c FROM {src} GROUP BY y),
tot{tag} AS (SELECT sum(n_c) AS n, CAST(ceil(CAST({test_size!r} AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_test FROM cnt{tag}),
q0{tag} AS (
  SELECT c.y, c.n_c, t.n - t.n_test AS n_train,
         CAST(((t.n - t.n_test) * c.n_c) // t.n AS BIGINT) AS base,
         CAST(((t.n - t.n_test) * c.n_c) % t.n AS BIGINT) AS frac
  FROM cnt{tag} c, tot{tag} t),
q1{tag} AS (
  SELECT *, row_number() OVER (ORDER BY frac DESC, n_c, y) AS r,
         n_train - sum(base) OVER () AS rem FROM q0{tag}),
quota{tag} AS (
  SELECT y, n_c, base + CASE WHEN r <= rem THEN 1 ELSE 0 END AS q_train,
         n_c - (base + CASE WHEN r <= rem THEN 1 ELSE 0 END) AS q_test FROM q1{tag}),
rk{tag} AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.y ORDER BY {u}, s.row_id) AS rn FROM {src} s),
sp{tag} AS (
  SELECT rk{tag}.* EXCLUDE (rn), CASE WHEN rn <= q.q_test THEN 'test' ELSE 'train' END AS split
  FROM rk{tag} JOIN quota{tag} q ON rk{tag}.y = q.y)"""


ORACLE["split_quotas"] = f"""
WITH c AS ({FRAME_C}),{split_ctes('c', 42)}
SELECT CAST(y AS INTEGER) AS y, CAST(n_c AS BIGINT) AS n, CAST(q_train AS BIGINT) AS n_train,
       CAST(q_test AS BIGINT) AS n_test FROM quota"""
ORACLE["stratified_split"] = f"""
WITH c AS (SELECT row_id, y FROM ({FRAME_C}) x),{split_ctes('c', 42)}
SELECT row_id, y, split FROM sp"""
ORACLE["stratified_split_docs"] = f"""
WITH c AS (SELECT doc_id AS row_id, y FROM ({FRAME_B}) x),{split_ctes('c', 7)}
SELECT row_id, y, split FROM sp"""

CAT_C = ["o_orderpriority", "c_mktsegment", "r_name"]
NUM_C = ["o_totalprice", "c_acctbal"]


def encoder_cte(src: str, cats: list[str], tag: str = "") -> str:
    vals = " UNION ".join(f"SELECT DISTINCT '{c}' AS feature, CAST({c} AS VARCHAR) AS value "
                          f"FROM {src} WHERE {c} IS NOT NULL" for c in cats)
    return f"""
encv{tag} AS ({vals}),
enc{tag} AS (SELECT feature, value,
  CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS code FROM encv{tag})"""


ORACLE["fit_encoder"] = f"""
WITH c AS ({FRAME_C}),{split_ctes('c', 42)}, tr AS (SELECT * FROM sp WHERE split = 'train'),
{encoder_cte('tr', CAT_C)}
SELECT feature, value, code FROM enc"""
ORACLE["encode_unseen"] = f"""
WITH tr AS (SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'),{encoder_cte('tr', ['o_orderpriority'])}
SELECT o.o_orderkey, CAST(coalesce(e.code, 0) AS DOUBLE) AS code
FROM orders o LEFT JOIN enc e ON e.feature = 'o_orderpriority' AND o.o_orderpriority = e.value"""


def scaler_cte(src: str, nums: list[str], tag: str = "") -> str:
    parts = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in nums)
    return f"st{tag} AS (SELECT {parts} FROM {src})"


def z_sql(c: str, tag: str = "") -> str:
    return (f"coalesce(({c} - st{tag}.m_{c}) / (CASE WHEN coalesce(st{tag}.s_{c}, 0) = 0 THEN 1.0 "
            f"ELSE st{tag}.s_{c} END), 0.0)")


ORACLE["scale"] = f"""
WITH c AS ({FRAME_C}),{split_ctes('c', 42)}, tr AS (SELECT * FROM sp WHERE split = 'train'),
{scaler_cte('tr', NUM_C)}
SELECT sp.row_id, sp.split, {R(z_sql('o_totalprice'))} AS o_totalprice, {R(z_sql('c_acctbal'))} AS c_acctbal
FROM sp, st"""


def prepare_sql(frame_sql: str, seed: int = 42, impute: bool = False) -> str:
    """CTE chain ending in ``prep``: row_id, split, y, s_*, features (unrounded)."""
    if impute:
        fill = f"""
raw AS ({frame_sql}),
c AS (SELECT row_id, y,
  coalesce(o_totalprice, (SELECT coalesce(median(o_totalprice), 0.0) FROM raw)) AS o_totalprice,
  coalesce(c_acctbal, (SELECT coalesce(median(c_acctbal), 0.0) FROM raw)) AS c_acctbal,
  coalesce(o_orderpriority, {mode_sql('raw', 'o_orderpriority')}) AS o_orderpriority,
  coalesce(c_mktsegment, {mode_sql('raw', 'c_mktsegment')}) AS c_mktsegment,
  coalesce(r_name, {mode_sql('raw', 'r_name')}) AS r_name
FROM raw WHERE y IS NOT NULL)"""
    else:
        fill = f"c AS ({frame_sql})"
    codes = ", ".join(f"CAST(coalesce(e_{c}.code, 0) AS DOUBLE) AS {c}" for c in CAT_C)
    joins = " ".join(f"LEFT JOIN enc e_{c} ON e_{c}.feature = '{c}' AND sp.{c} = e_{c}.value"
                     for c in CAT_C)
    return f"""{fill},{split_ctes('c', seed)}, tr AS (SELECT * FROM sp WHERE split = 'train'),
{encoder_cte('tr', CAT_C)},
ec AS (SELECT sp.row_id, sp.split, sp.y, sp.o_totalprice, sp.c_acctbal, {codes} FROM sp {joins}),
{scaler_cte("(SELECT * FROM ec WHERE split = 'train')", NUM_C)},
prep AS (SELECT ec.row_id, ec.split, CAST(ec.y AS INTEGER) AS y,
  ec.c_mktsegment AS s_c_mktsegment, ec.r_name AS s_r_name,
  {z_sql('o_totalprice')} AS o_totalprice, {z_sql('c_acctbal')} AS c_acctbal,
  ec.o_orderpriority, ec.c_mktsegment, ec.r_name FROM ec, st)"""


PREP_COLS = ("row_id, split, y, " + ", ".join(
    f"{R(c)} AS {c}" for c in ["s_c_mktsegment", "s_r_name", "o_totalprice", "c_acctbal",
                               "o_orderpriority", "c_mktsegment", "r_name"]))

ORACLE["prepare"] = f"WITH {prepare_sql(FRAME_C)}\nSELECT {PREP_COLS} FROM prep"
ORACLE["prepare_dirty"] = f"WITH {prepare_sql(FRAME_E_CLEAN, impute=True)}\nSELECT {PREP_COLS} FROM prep"
ORACLE["profile"] = f"""WITH {prepare_sql(FRAME_C)}
SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(5 AS INTEGER) AS n_features,
       {R('avg(y)')} AS pos_rate, CAST(0 AS BIGINT) AS n_null FROM prep GROUP BY split"""

_ap_codes = ", ".join(f"CAST(coalesce(e_{c}.code, 0) AS DOUBLE) AS {c}" for c in CAT_C)
_ap_joins = " ".join(f"LEFT JOIN enc e_{c} ON e_{c}.feature = '{c}' AND d.{c} = e_{c}.value"
                     for c in CAT_C)
ORACLE["apply_prep"] = f"""WITH {prepare_sql(FRAME_C)},
d AS ({FRAME_E}),
ad AS (SELECT d.row_id, coalesce(d.o_totalprice, 0.0) AS o_totalprice,
              coalesce(d.c_acctbal, 0.0) AS c_acctbal, {_ap_codes} FROM d {_ap_joins})
SELECT ad.row_id, {R(z_sql('o_totalprice'))} AS o_totalprice, {R(z_sql('c_acctbal'))} AS c_acctbal,
       {R('ad.o_orderpriority')} AS o_orderpriority, {R('ad.c_mktsegment')} AS c_mktsegment,
       {R('ad.r_name')} AS r_name
FROM ad, st"""


# ---------------------------------------------------------------------------
# Stage 2: sampling, augmentation, fidelity
# ---------------------------------------------------------------------------
from ..functions.mathx import norm_cdf_sql, norm_ppf_sql  # noqa: E402

FEATS_C = NUM_C + CAT_C
S_C = ["s_c_mktsegment", "s_r_name"]
LINE_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PREP_TRAIN = prepare_sql(FRAME_C) + ",\ntrn AS (SELECT * EXCLUDE (split) FROM prep WHERE split = 'train')"


def D(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


ORACLE["class_balance"] = f"""WITH {PREP_TRAIN},
cc AS (SELECT y, count(*) AS n FROM trn GROUP BY y),
mm AS (SELECT min(n) AS mn, max(n) AS mx FROM cc),
mino AS (SELECT cc.y FROM cc, mm WHERE cc.n = mm.mn ORDER BY cc.y LIMIT 1)
SELECT CAST(cc.y AS INTEGER) AS y, CAST(cc.n AS BIGINT) AS n, cc.y = (SELECT y FROM mino) AS is_minority,
       CAST(greatest(1, least(5, mm.mn - 1)) AS INTEGER) AS k,
       CAST(CASE WHEN mm.mn < 2 OR mm.mx = mm.mn THEN 0 ELSE mm.mx - mm.mn END AS BIGINT) AS n_extra,
       (mm.mn < 2 OR mm.mx = mm.mn) AS skip
FROM cc, mm"""

ORACLE["sample_n"] = f"""
SELECT o_orderkey AS row_id, {R('o_totalprice')} AS o_totalprice FROM orders
ORDER BY {hash_uniform_sql(42, 'sample', 'o_orderkey')}, o_orderkey LIMIT 1000"""

ORACLE["stratified_sample"] = f"""
WITH s AS (SELECT o_orderpriority, count(*) AS cnt FROM orders GROUP BY 1),
q AS (SELECT o_orderpriority, CAST(least(cnt, greatest(1, round_even(
        {D('cnt')} / {D('(SELECT count(*) FROM orders)')} * CAST(1500 AS DOUBLE), 0))) AS BIGINT) AS quota FROM s),
r AS (SELECT o.o_orderkey AS row_id, o.o_orderpriority,
        row_number() OVER (PARTITION BY o.o_orderpriority
                           ORDER BY {hash_uniform_sql(0, 'strat', 'o.o_orderkey')}, o.o_orderkey) AS rn
      FROM orders o)
SELECT r.row_id, r.o_orderpriority FROM r JOIN q USING (o_orderpriority) WHERE r.rn <= q.quota"""

ORACLE["stratified_sample_nulls"] = f"""
WITH k AS (SELECT o_orderkey AS row_id, nullif(o_orderpriority, '1-URGENT') AS key FROM orders),
kn AS (SELECT * FROM k WHERE key IS NOT NULL),
s AS (SELECT key, count(*) AS cnt FROM kn GROUP BY 1),
q AS (SELECT key, CAST(least(cnt, greatest(1, round_even(
        {D('cnt')} / {D('(SELECT count(*) FROM kn)')} * CAST(1500 AS DOUBLE), 0))) AS BIGINT) AS quota FROM s),
r AS (SELECT kn.*, row_number() OVER (PARTITION BY key ORDER BY {hash_uniform_sql(0, 'strat', 'kn.row_id')}, kn.row_id) AS rn
      FROM kn)
SELECT r.row_id, r.key FROM r JOIN q USING (key) WHERE r.rn <= q.quota"""

ORACLE["smote_duplicates"] = """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount >= 0.09 AND l_quantity > 40) AS p,
                  count(DISTINCT l_linestatus = 'O') AS k FROM lineitem)
SELECT 'smote' AS origin, CAST(n - 2 * p AS BIGINT) AS n, CAST(n - 2 * p AS BIGINT) AS n_ids FROM c
UNION ALL SELECT 'cf', CAST(n * (1 + k) AS BIGINT), CAST(n * (1 + k) AS BIGINT) FROM c"""


def _cf_union(src: str) -> str:
    feats = ", ".join(f"b.{c}" for c in FEATS_C)
    parts = [f"SELECT b.row_id AS base_id, CAST(NULL AS VARCHAR) AS cf_attr, CAST(NULL AS DOUBLE) AS cf_value, "
             f"b.y, b.s_c_mktsegment, b.s_r_name, {feats} FROM {src} b"]
    for c in ["c_mktsegment", "r_name"]:
        sv = ", ".join("d.s" if s == f"s_{c}" else f"b.{s}" for s in S_C)
        fv = ", ".join("d.f" if f == c else f"b.{f}" for f in FEATS_C)
        parts.append(f"SELECT b.row_id, '{c}', d.s, b.y, {sv}, {fv} FROM {src} b, "
                     f"(SELECT DISTINCT s_{c} AS s, {c} AS f FROM trn) d")
    return "\nUNION ALL\n".join(parts)


CF_CTES = f"""{PREP_TRAIN},
cfbase AS (SELECT * FROM trn),
cfv AS ({_cf_union('cfbase')})"""

ORACLE["counterfactual"] = f"""WITH {CF_CTES}
SELECT base_id, cf_attr, {R('cf_value')} AS cf_value, y, {', '.join(f"{R(c)} AS {c}" for c in S_C + FEATS_C)},
       'cf' AS origin FROM cfv"""


def long_sql(src: str, cols: list[str], extra: str = "") -> str:
    return "\nUNION ALL\n".join(
        f"SELECT {extra}'{c}' AS feature, CAST({c} AS DOUBLE) + 0.0 AS value FROM {src}" for c in cols)


RANK_CTES = f"""
lg AS ({long_sql('lineitem', LINE_NUM)}),
hh AS (SELECT feature, value, count(*) AS cnt FROM lg GROUP BY feature, value),
cu AS (SELECT *, CAST(sum(cnt) OVER (PARTITION BY feature ORDER BY value) - cnt AS BIGINT) AS cum_before,
              sum(cnt) OVER (PARTITION BY feature) AS nn FROM hh),
ar AS (SELECT *, cum_before + (cnt + 1) / 2.0 AS avg_rank FROM cu),
au AS (SELECT *, least(greatest(avg_rank / (nn + 1), 1e-6), 1 - 1e-6) AS u FROM ar)"""

ORACLE["avg_rank"] = f"""WITH {RANK_CTES}
SELECT feature, {R('value')} AS value, CAST(cnt AS BIGINT) AS cnt, cum_before,
       {R('avg_rank')} AS avg_rank, {R('u')} AS u FROM au"""
ORACLE["norm_scores"] = f"""WITH {RANK_CTES}
SELECT feature, {R('value')} AS value, {R('u')} AS u, {R(norm_ppf_sql('u'))} AS score FROM au"""

_pairs = [(a, b) for i, a in enumerate(FEATS_C) for b in FEATS_C[i + 1:]]
ORACLE["copula_corr"] = f"""WITH {PREP_TRAIN},
lg AS ({long_sql('trn', FEATS_C, 'row_id, ')}),
hh AS (SELECT feature, value, count(*) AS cnt FROM lg GROUP BY feature, value),
cu AS (SELECT *, sum(cnt) OVER (PARTITION BY feature ORDER BY value) - cnt AS cum_before,
              sum(cnt) OVER (PARTITION BY feature) AS nn FROM hh),
au AS (SELECT feature, value,
        least(greatest((cum_before + (cnt + 1) / 2.0) / (nn + 1), 1e-6), 1 - 1e-6) AS u FROM cu),
sc AS (SELECT feature, value, {norm_ppf_sql('u')} AS score FROM au),
rs AS (SELECT lg.row_id, lg.feature, sc.score FROM lg JOIN sc USING (feature, value)),
wd AS (SELECT row_id, {', '.join(f"max(CASE WHEN feature = '{c}' THEN score END) AS {c}" for c in FEATS_C)}
       FROM rs GROUP BY row_id)
{' UNION ALL '.join(f"SELECT '{a}' AS fi, '{b}' AS fj, {R(f'corr({a}, {b})')} AS corr FROM wd" for a, b in _pairs)}"""


def _copula_indep() -> str:
    n = "(SELECT count(*) FROM lineitem)"
    ctes = [f"sid AS (SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS synth_id FROM lineitem)"]
    sel, joins = [], []
    for j, c in enumerate(LINE_NUM):
        u = f"(({hash_uniform_sql(42, f'copula_z{j}', 'synth_id')} * {TWO_POW_48_SQL} + 0.5) / {TWO_POW_48_SQL})"
        ctes.append(f"u{j} AS (SELECT synth_id, {u} AS u FROM sid)")
        ctes.append(f"z{j} AS (SELECT synth_id, {norm_ppf_sql('u')} AS z FROM u{j})")
        ctes.append(f"p{j} AS (SELECT synth_id, {norm_cdf_sql('1.0 * z')} AS uu FROM z{j})")
        ctes.append(f"i{j} AS (SELECT synth_id, CAST(least(greatest(floor(uu * {n}), 0), {n} - 1) AS BIGINT) AS pos "
                    f"FROM p{j})")
        ctes.append(f"o{j} AS (SELECT CAST({c} AS DOUBLE) + 0.0 AS value, "
                    f"row_number() OVER (ORDER BY {c}) - 1 AS pos FROM lineitem)")
        joins.append(f"JOIN i{j} ON i{j}.synth_id = sid.synth_id JOIN o{j} ON o{j}.pos = i{j}.pos")
        sel.append(f"{R(f'o{j}.value')} AS {c}")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT sid.synth_id, {', '.join(sel)}, 'copula' AS origin "
            f"FROM sid {' '.join(joins)}")


TWO_POW_48_SQL = "281474976710656.0"
ORACLE["copula_sample_indep"] = _copula_indep()


def _dist_sql(a: str, b: str) -> str:
    return f"list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


KNN_CTES = f"""
mv AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE label = 0),
pr AS (SELECT a.id AS base_id, b.id AS nn_id, {_dist_sql('a.e', 'b.e')} AS dist FROM mv a, mv b WHERE a.id <> b.id),
kr AS (SELECT *, row_number() OVER (PARTITION BY base_id ORDER BY dist, nn_id) AS rank FROM pr),
knn AS (SELECT base_id, CAST(rank AS INTEGER) AS rank, nn_id, dist FROM kr
        WHERE rank <= (SELECT greatest(1, least(5, count(*) - 1)) FROM mv))"""

ORACLE["knn_minority"] = f"WITH {KNN_CTES}\nSELECT base_id, rank, nn_id, {R('dist')} AS dist FROM knn"


def _smote_vectors() -> str:
    m = "(SELECT count(*) FROM mv)"
    k = f"(SELECT greatest(1, least(5, count(*) - 1)) FROM mv)"
    extra = "(SELECT count(*) FILTER (WHERE label <> 0) - count(*) FILTER (WHERE label = 0) FROM embeddings)"
    xs = ", ".join(
        f"{R(f'CAST(b.e[{i + 1}] AS DOUBLE) + j.gap * (CAST(n.e[{i + 1}] AS DOUBLE) - CAST(b.e[{i + 1}] AS DOUBLE))')}"
        f" AS f{i:02d}" for i in range(64))
    return f"""WITH {KNN_CTES},
di AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS base_idx FROM mv),
tt AS (SELECT CAST(unnest(range(CAST({extra} AS BIGINT))) AS BIGINT) AS synth_id),
dr AS (SELECT synth_id, CAST(floor({hash_uniform_sql(42, 'smote_t', 'synth_id')} * {m} * {k}) AS BIGINT) AS r,
              {hash_uniform_sql(42, 'smote_gap', 'synth_id')} AS gap FROM tt),
d2 AS (SELECT synth_id, gap, r // {k} AS base_idx, CAST(r % {k} + 1 AS INTEGER) AS rank FROM dr),
j AS (SELECT d2.synth_id, d2.gap, di.id AS base_id, kn.nn_id FROM d2 JOIN di USING (base_idx)
      JOIN knn kn ON kn.base_id = di.id AND kn.rank = d2.rank),
sh AS (SELECT label % 2 AS s_parity, count(*) AS cnt FROM embeddings GROUP BY 1),
sc AS (SELECT s_parity, cnt, sum(cnt) OVER (ORDER BY s_parity) - cnt AS cb FROM sh),
sp AS (SELECT tt.synth_id, sc.s_parity FROM tt JOIN sc ON
       floor({hash_uniform_sql(42, 'smote_s', 'tt.synth_id')} * (SELECT count(*) FROM embeddings)) >= sc.cb
   AND floor({hash_uniform_sql(42, 'smote_s', 'tt.synth_id')} * (SELECT count(*) FROM embeddings)) < sc.cb + sc.cnt)
SELECT j.synth_id, j.base_id, j.nn_id, {R('j.gap')} AS gap, CAST(1 AS INTEGER) AS y, {xs},
       CAST(sp.s_parity AS INTEGER) AS s_parity, 'smote' AS origin
FROM j JOIN mv b ON b.id = j.base_id JOIN mv n ON n.id = j.nn_id JOIN sp ON sp.synth_id = j.synth_id"""


ORACLE["smote_vectors"] = _smote_vectors()

ORACLE["resample_sensitive"] = f"""WITH {PREP_TRAIN},
sh AS (SELECT s_c_mktsegment, s_r_name, count(*) AS cnt FROM trn GROUP BY 1, 2),
sc AS (SELECT *, sum(cnt) OVER (ORDER BY s_c_mktsegment, s_r_name) - cnt AS cb FROM sh),
tt AS (SELECT CAST(row_number() OVER () - 1 AS BIGINT) AS synth_id FROM trn),
ix AS (SELECT synth_id, floor({hash_uniform_sql(42, 'resample', 'synth_id')} * (SELECT count(*) FROM trn)) AS idx FROM tt)
SELECT ix.synth_id, {R('sc.s_c_mktsegment')} AS s_c_mktsegment, {R('sc.s_r_name')} AS s_r_name
FROM ix JOIN sc ON ix.idx >= sc.cb AND ix.idx < sc.cb + sc.cnt"""


def ks_sql(long_src: str) -> str:
    """long_src has (s int 0/1, feature, value) -> (feature, ks)."""
    return f"""
kh AS (SELECT feature, value, sum(1 - s) AS cr, sum(s) AS cs FROM {long_src} WHERE value IS NOT NULL
       GROUP BY feature, value),
kc AS (SELECT *, sum(cr) OVER w AS ccr, sum(cs) OVER w AS ccs,
              sum(cr) OVER (PARTITION BY feature) AS nr, sum(cs) OVER (PARTITION BY feature) AS ns
       FROM kh WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs({D('ccr')} / {D('nr')} - {D('ccs')} / {D('ns')})) AS ks FROM kc GROUP BY feature)"""


def chi_sql(long_src: str) -> str:
    """long_src has (s, feature, value string) -> chi(feature, n_categories, chi2)."""
    def term(o: str, rs: str) -> str:
        e = f"({rs} * (o_r + o_s) / (R_r + R_s))"
        dev = f"abs({o} - {e})"
        dev = f"(CASE WHEN C = 2 THEN {dev} - least(CAST(0.5 AS DOUBLE), {dev}) ELSE {dev} END)"
        return f"({dev} * {dev} / {e})"
    return f"""
ce AS (SELECT feature, value, {D('sum(1 - s)')} + CAST(0.001 AS DOUBLE) AS o_r,
              {D('sum(s)')} + CAST(0.001 AS DOUBLE) AS o_s FROM {long_src} GROUP BY feature, value),
mg AS (SELECT feature, sum(o_r) AS R_r, sum(o_s) AS R_s, count(*) AS C FROM ce GROUP BY feature),
ct AS (SELECT ce.feature, mg.C, {term('o_r', 'R_r')} + {term('o_s', 'R_s')} AS t FROM ce JOIN mg USING (feature)),
chi AS (SELECT feature, CAST(C AS BIGINT) AS n_categories,
               CASE WHEN C <= 1 THEN 0.0 ELSE sum(t) END AS chi2 FROM ct GROUP BY feature, C)"""


_li_ks = "\nUNION ALL\n".join(
    f"SELECT CAST(l_returnflag = 'R' AS INTEGER) AS s, '{c}' AS feature, CAST({c} AS DOUBLE) + 0.0 AS value "
    f"FROM lineitem" for c in LINE_NUM)
ORACLE["ks_two_sample"] = f"WITH lgk AS ({_li_ks}),{ks_sql('lgk')}\nSELECT feature, {R('ks')} AS ks FROM ks"

_li_chi = "\nUNION ALL\n".join(
    f"SELECT CAST(l_discount >= 0.05 AS INTEGER) AS s, '{c}' AS feature, CAST({c} AS VARCHAR) AS value "
    f"FROM lineitem" for c in ["l_linestatus", "l_returnflag"])
ORACLE["chi2_two_sample"] = (f"WITH lgc AS ({_li_chi}),{chi_sql('lgc')}\n"
                             f"SELECT feature, n_categories, {R('chi2')} AS chi2 FROM chi")

ORACLE["fidelity_docs"] = f"""WITH dd AS (
  SELECT d.*, CAST(l.doc_id IS NOT NULL AS INTEGER) AS s FROM documents d LEFT JOIN labels l USING (doc_id)),
lgk AS (SELECT s, 'n_chars' AS feature, CAST(n_chars AS DOUBLE) + 0.0 AS value FROM dd),
lgc AS (SELECT s, 'lang' AS feature, CAST(lang AS VARCHAR) AS value FROM dd
        UNION ALL SELECT s, 'source', CAST(source AS VARCHAR) FROM dd),{ks_sql('lgk')},{chi_sql('lgc')}
SELECT {R('(SELECT avg(ks) FROM ks)')} AS ks_mean, {R('(SELECT avg(chi2) FROM chi)')} AS chi_mean,
       CAST((SELECT sum(s) FROM dd) AS BIGINT) AS n_synth"""

_cf_all = f"""SELECT 0 AS s, {', '.join(FEATS_C)} FROM trn UNION ALL SELECT 1 AS s, {', '.join(FEATS_C)} FROM cfv"""
ORACLE["fidelity_cf"] = f"""WITH {CF_CTES},
ff AS ({_cf_all}),
lgk AS ({' UNION ALL '.join(f"SELECT s, '{c}' AS feature, {c} + 0.0 AS value FROM ff" for c in NUM_C)}),
lgc AS ({' UNION ALL '.join(f"SELECT s, '{c}' AS feature, CAST({c} AS VARCHAR) AS value FROM ff" for c in CAT_C)}),
{ks_sql('lgk')},{chi_sql('lgc')}
SELECT {R('(SELECT avg(ks) FROM ks)')} AS ks_mean, {R('(SELECT avg(chi2) FROM chi)')} AS chi_mean,
       CAST((SELECT sum(s) FROM ff) AS BIGINT) AS n_synth"""


# ---------------------------------------------------------------------------
# Stage 3-6
# ---------------------------------------------------------------------------
RISK_SQL = """(o_totalprice / 150000.0 + c_acctbal / 5000.0
  + CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0.4 ELSE 0.0 END
  + CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 0.3 ELSE 0.0 END
  + CASE WHEN r_name = 'EUROPE' THEN -0.25 ELSE 0.0 END)"""


def risk_frame(offset: float) -> str:
    s = f"(0.0 + {RISK_SQL.replace(chr(10), ' ')})"
    return f"""SELECT row_id, y, c_mktsegment, r_name, 1.0 / (1.0 + exp(-({s} - {offset!r}))) AS proba
FROM ({FRAME_C}) fc"""


def risk_scored(offset: float) -> str:
    return f"SELECT *, CAST(proba >= 0.5 AS INTEGER) AS pred FROM ({risk_frame(offset)}) rf"


ORACLE["logistic_score"] = f"SELECT row_id, {R('proba')} AS proba, pred FROM ({risk_scored(1.2)}) x"


def metrics_sql(src: str, by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    return f"""SELECT {sel}n, tp, fp, fn, tn,
  {R('CASE WHEN n = 0 THEN 0.0 ELSE (tp + tn) * 1.0 / n END')} AS accuracy,
  {R('CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END')} AS f1,
  {R('CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fp) END')} AS precision,
  {R('CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp * 1.0 / (tp + fn) END')} AS recall
FROM (SELECT {sel}CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE y = 1 AND pred = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE y = 0 AND pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE y = 1 AND pred = 0) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE y = 0 AND pred = 0) AS BIGINT) AS tn FROM {src} {grp}) mm"""


ORACLE["classification_metrics"] = f"WITH rs AS ({risk_scored(1.2)})\n" + metrics_sql("rs", "c_mktsegment")

FAIR_C = rates_ctes("orders_tab", risk_scored(1.2), ["c_mktsegment", "r_name"], "c") + "," + fairness_ctes("c")
FAIR_C2 = rates_ctes("orders_tab", risk_scored(0.8), ["c_mktsegment", "r_name"], "d") + "," + fairness_ctes("d")
ORACLE["fairness_orders_tab"] = "WITH " + FAIR_C + f"\nSELECT {FAIR_COLS} FROM fvc"
_cmp_m = ["dpd", "dir", "eod", "p_value", "bias_score"]
ORACLE["compare_fairness"] = "WITH " + FAIR_C + "," + FAIR_C2 + f"""
SELECT b.dataset, b.sensitive, {', '.join(f"{R(f'b.{m}')} AS {m}_before" for m in _cmp_m)},
       b.verdict AS verdict_before, {', '.join(f"{R(f'a.{m}')} AS {m}_after" for m in _cmp_m)},
       a.verdict AS verdict_after,
       {R('CASE WHEN b.bias_score > 0 THEN 100.0 * (b.bias_score - a.bias_score) / b.bias_score END')}
         AS bias_reduction_pct
FROM fvc b FULL OUTER JOIN fvd a ON a.dataset = b.dataset AND a.sensitive = b.sensitive"""

LINEAR_BETA = {"o_totalprice": 0.9, "c_acctbal": 0.35, "o_orderpriority": -0.2,
               "c_mktsegment": 0.15, "r_name": -0.1}


def linear_ctes(explain: str = "tst") -> str:
    means = ", ".join(f"avg({c}) AS m_{c}" for c in FEATS_C)
    parts = " UNION ALL ".join(
        f"SELECT e.row_id, e.s_c_mktsegment, '{c}' AS feature, "
        f"{LINEAR_BETA[c]!r} * ({c} - bm.m_{c}) AS phi FROM {explain} e, bm" for c in FEATS_C)
    return f"""
bgs AS (SELECT * FROM prep WHERE split = 'train'),
bm AS (SELECT {means} FROM bgs),
la AS ({parts})"""


MEAN_ABS = "CAST(sum(CAST(round(abs(phi) * 1099511627776.0) AS HUGEINT)) AS DOUBLE) / count(phi) / 1099511627776.0"
LIN_BASE = f"WITH {prepare_sql(FRAME_C)},\ntst AS (SELECT * FROM prep WHERE split = 'test'),{linear_ctes()}"
ORACLE["linear_shap"] = f"{LIN_BASE}\nSELECT row_id, {R('s_c_mktsegment')} AS s_c_mktsegment, feature, {R('phi')} AS phi FROM la"
ORACLE["importance"] = f"{LIN_BASE}\nSELECT feature, {R(MEAN_ABS)} AS mean_abs FROM la GROUP BY feature"
ORACLE["attribution_disparity"] = f"""{LIN_BASE}
SELECT feature, CAST(s_c_mktsegment AS VARCHAR) AS grp, {R(MEAN_ABS)} AS mean_abs
FROM la GROUP BY feature, CAST(s_c_mktsegment AS VARCHAR)"""
ORACLE["flag_features"] = f"""{LIN_BASE},
dg AS (SELECT feature, CAST(s_c_mktsegment AS VARCHAR) AS grp, {MEAN_ABS} AS ma FROM la GROUP BY 1, 2),
spd AS (SELECT feature, max(ma) - min(ma) AS spread FROM dg GROUP BY feature),
im AS (SELECT feature, {MEAN_ABS} AS mean_abs FROM la GROUP BY feature)
SELECT spd.feature, {R('spread')} AS spread, {R('spread / greatest(1e-6, mean_abs)')} AS ratio,
       spread / greatest(1e-6, mean_abs) > 0.2 AS flagged FROM spd JOIN im USING (feature)"""
_fpos = "CASE feature " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(FEATS_C)) + " END"
ORACLE["top_features"] = f"""{LIN_BASE},
im AS (SELECT feature, {MEAN_ABS} AS mean_abs FROM la GROUP BY feature),
rnk AS (SELECT feature, row_number() OVER (ORDER BY mean_abs DESC, {_fpos}) AS rank FROM im)
SELECT feature, CAST(rank AS INTEGER) AS rank FROM rnk WHERE rank <= 3"""


def _consistency_sql() -> str:
    # a random half of the test rows per seed; the background stays fixed
    parts = []
    for s in (42, 43, 44, 45, 46):
        ex = (f"(SELECT * FROM prep WHERE split = 'test' "
              f"AND {hash_uniform_sql(s, 'explain', 'row_id')} < 0.5)")
        for c in FEATS_C:
            parts.append(f"SELECT {s} AS run_id, '{c}' AS feature, {LINEAR_BETA[c]!r} * (e.{c} - bm.m_{c}) AS phi "
                         f"FROM {ex} e, bm")
    return f"""WITH {prepare_sql(FRAME_C)},{linear_ctes()},
rr AS ({' UNION ALL '.join(parts)}),
im AS (SELECT run_id, feature, {MEAN_ABS} AS mean_abs FROM rr GROUP BY 1, 2),
rnk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY mean_abs DESC, {_fpos}) AS rank FROM im),
tp AS (SELECT feature, count(DISTINCT run_id) AS c FROM rnk WHERE rank <= 2 GROUP BY feature),
nr AS (SELECT count(DISTINCT run_id) AS n_runs FROM im)
SELECT CAST(nr.n_runs AS BIGINT) AS n_runs, CAST(count(*) FILTER (WHERE c = nr.n_runs) AS BIGINT) AS inter,
       CAST(count(*) AS BIGINT) AS uni,
       {R('CASE WHEN nr.n_runs < 2 THEN 1.0 ELSE count(*) FILTER (WHERE c = nr.n_runs) * 1.0 / greatest(count(*), 1) END')}
         AS consistency
FROM tp, nr GROUP BY nr.n_runs"""


ORACLE["topk_consistency"] = _consistency_sql()


def _record_sql(raw_accuracy: bool = False) -> str:
    fmt = ("printf('sensitive=''%s'' DPD=%.3f DIR=%.3f EOD=%.3f (p=%.3f)', sensitive, dpd, dir, eod, p_value)")
    order = "CASE sensitive " + " ".join(
        f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(["c_mktsegment", "r_name", "n_name", "lang", "source"])) + " END"
    return "WITH " + FAIR_A + "," + FAIR_B + f""",
allf AS (SELECT * FROM fva UNION ALL SELECT * FROM fvb),
acc AS (SELECT 'orders_lines' AS dataset, avg(CAST(y = pred AS INTEGER)) AS accuracy FROM fa
        UNION ALL SELECT 'documents', avg(CAST(y = pred AS INTEGER)) FROM fb),
agg AS (SELECT dataset, count(*) FILTER (WHERE verdict = 'FAIL') AS fails, count(*) AS n,
          string_agg(CASE WHEN verdict = 'FAIL' THEN {fmt} END, '; ' ORDER BY {order}) AS bits
        FROM allf GROUP BY dataset)
SELECT agg.dataset, {'acc.accuracy' if raw_accuracy else R('acc.accuracy')} AS accuracy,
  CASE WHEN fails > 0 THEN 'FAIL' ELSE 'PASS' END AS overall_verdict,
  CASE WHEN fails > 0 THEN agg.dataset || ': FAIL on ' || bits || '. Top SHAP-flagged features: none.'
       ELSE agg.dataset || ': model passes all fairness checks (DPD<=0.1, 0.8<=DIR<=1.25). No subgroup disparity flagged.'
  END AS plain_summary, CAST(n AS INTEGER) AS n_checks
FROM agg JOIN acc USING (dataset)"""


ORACLE["audit_record"] = _record_sql()


# ---------------------------------------------------------------------------
# Sources and sinks
# ---------------------------------------------------------------------------
ORACLE["csv_roundtrip"] = f"SELECT c_custkey, c_name, c_nationkey, {R('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer"
ORACLE["csv_noheader_roundtrip"] = "SELECT * FROM nation"
ORACLE["json_roundtrip"] = ORACLE["fairness_orders"]


ORACLE["audit_markdown"] = f"""WITH recq AS ({_record_sql(raw_accuracy=True)}),
fr AS (WITH {FAIR_A},{FAIR_B} SELECT * FROM fva UNION ALL SELECT * FROM fvb)
SELECT '# Automated Fairness Audit Report' AS line
UNION ALL SELECT ''
UNION ALL SELECT '## ' || dataset || ' — ' || overall_verdict FROM recq
UNION ALL SELECT printf('- Accuracy: **%.2f%%**', accuracy * 100) FROM recq
UNION ALL SELECT printf('  - %s: DPD=%.3f, DIR=%.3f, EOD=%.3f, p=%.3f, verdict=**%s**',
                        sensitive, dpd, dir, eod, p_value, verdict) FROM fr
UNION ALL SELECT '' FROM recq
UNION ALL SELECT '' FROM recq
UNION ALL SELECT '> ' || plain_summary FROM recq"""
