"""DuckDB SQL of the queries in reference.py, written apart from them."""

from __future__ import annotations

from itertools import combinations

from wardline.functions.keys import user_key_sql

_N = [f"feature_{i:03d}" for i in range(1, 19)]
_F = ", ".join(_N)


def _clean(column: str) -> str:
    """NaN as null; by way of text, as comparisons with NaN may be folded away by statistics."""
    return f"CAST(nullif(CAST({column} AS VARCHAR), 'nan') AS DOUBLE) AS {column}"


_FEATURES = ", ".join(_clean(n) for n in _N)
_BASE = f"""tr AS MATERIALIZED (SELECT row_id, {user_key_sql("user_hash")} AS k, user_hash, {_FEATURES}, {_clean("is_cheating")}, {_clean("high_conf_clean")}, observed_at FROM train),
te AS MATERIALIZED (SELECT row_id, {user_key_sql("user_hash")} AS k, user_hash, {_FEATURES} FROM test),
ro AS (SELECT row_id, k, {_F} FROM tr UNION ALL SELECT row_id, k, {_F} FROM te)"""
_CLS = "CASE WHEN is_cheating IN (0, 1) THEN CAST(is_cheating AS INT) END"
_WEAK = "(is_cheating IS NULL AND coalesce(high_conf_clean = 1, false))"
_PEOPLE = f"""us AS MATERIALIZED (SELECT DISTINCT k FROM ro WHERE k IS NOT NULL),
ly AS (SELECT k, y FROM (SELECT k, {_CLS} AS y, row_number() OVER (PARTITION BY k ORDER BY observed_at DESC NULLS LAST, row_id DESC) AS n FROM tr WHERE k IS NOT NULL AND is_cheating IN (0, 1)) WHERE n = 1),
lw AS (SELECT k, w FROM (SELECT k, {_WEAK} AS w, row_number() OVER (PARTITION BY k ORDER BY observed_at DESC NULLS LAST, row_id DESC) AS n FROM tr WHERE k IS NOT NULL) WHERE n = 1),
la AS MATERIALIZED (SELECT lw.k, ly.y, ly.y IS NULL AND lw.w AS weak FROM lw LEFT JOIN ly ON ly.k = lw.k)"""
_LINKS = f"""li AS MATERIALIZED (SELECT * FROM (SELECT {user_key_sql("user_a")} AS a, {user_key_sql("user_b")} AS b FROM social_graph) WHERE a IS NOT NULL AND b IS NOT NULL),
bi AS MATERIALIZED (SELECT a AS u, b AS v FROM li UNION ALL SELECT b, a FROM li),
si AS MATERIALIZED (SELECT DISTINCT u, v FROM bi)"""
_ALL = f"WITH {_BASE}, {_PEOPLE}, {_LINKS}"
ORACLES: dict[str, str] = {}


def _rows(name: str, columns: dict[str, str], digits: int | None = None) -> None:
    chosen = ", ".join(f"round({c}, {digits}) AS {n}" if digits is not None else f"{c} AS {n}" for n, c in columns.items())
    ORACLES[name] = f"WITH {_BASE} SELECT row_id, {chosen} FROM ro"


_NUM = r"'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
ORACLES["safe_float"] = rf"SELECT row_id, CASE WHEN regexp_matches(t, {_NUM}) THEN TRY_CAST(t AS DOUBLE) WHEN regexp_matches(lower(t), '^[+-]?(inf|infinity)$') THEN CASE WHEN t[1] = '-' THEN -CAST('inf' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END END AS number FROM (SELECT row_id, regexp_replace(user_hash, '^\s+|\s+$', '', 'g') AS t FROM train)"
ORACLES["label_class"] = f"WITH {_BASE} SELECT row_id, {_CLS} AS y, CAST(is_cheating IS NOT NULL AS INT) AS has_label FROM tr"
ORACLES["weak_negatives"] = f"WITH {_BASE} SELECT row_id, CAST({_WEAK} AS INT) AS flag_is_one, CAST(is_cheating IS NULL AND high_conf_clean IS NOT NULL AS INT) AS flag_is_there FROM tr"
ORACLES["pseudo_labels"] = f"WITH {_BASE} SELECT row_id, CASE WHEN {_WEAK} THEN 0.0::DOUBLE ELSE is_cheating END AS label, CAST({_WEAK} AS INT) AS is_pseudo_label FROM tr"
ORACLES["sample_weights"] = f"WITH {_BASE} SELECT row_id, CAST(CASE WHEN is_cheating = 1 THEN 3.0 WHEN is_cheating = 0 THEN 1.0 WHEN {_WEAK} THEN 0.25 END AS DOUBLE) AS weight FROM tr"
ORACLES["label_summary"] = f"WITH {_BASE} SELECT count(*) AS n, count(is_cheating) AS labelled, count(*) FILTER (is_cheating = 1) AS cheaters, count(*) FILTER (is_cheating = 0) AS clean, count(*) FILTER (is_cheating IS NULL) AS unlabelled, count(*) FILTER (high_conf_clean = 1) AS flagged_clean FROM tr"
ORACLES["user_labels"] = f"WITH {_BASE}, {_PEOPLE} SELECT k AS user_key, y, CAST(weak AS INT) AS weak FROM la"
ORACLES["interest_set"] = f"WITH {_BASE}, {_PEOPLE} SELECT k AS user_key FROM us"
ORACLES["base_rate"] = f"WITH {_BASE}, {_PEOPLE} SELECT count(y) AS labelled, CAST(coalesce(sum(y), 0) AS BIGINT) AS cheaters, round(avg(y), 9) AS rate FROM la"
ORACLES["scale_pos"] = f"WITH {_BASE}, c AS (SELECT count(*) FILTER (is_cheating = 0) / greatest(count(*) FILTER (is_cheating = 1), 1) AS r FROM tr) SELECT round(r, 9) AS scale_pos, round(r * 1.5, 9) AS scale_pos_raised FROM c"
ORACLES["split_labeled"] = f"WITH {_BASE} SELECT row_id, CAST(row_id % 1000000007 * 7919 % 100 < 20 AS INT) AS is_validation FROM tr WHERE is_cheating IN (0, 1)"
ORACLES["strat_folds"] = f"WITH {_BASE} SELECT row_id, CAST((row_number() OVER (PARTITION BY is_cheating, b ORDER BY row_id % 1000000007 * 104729 % 1000003, row_id) + b) % 5 AS INT) AS fold FROM (SELECT row_id, is_cheating, row_id % 1000000007 * 7919 % greatest(64, count(*) OVER () // 1000) AS b FROM tr WHERE is_cheating IN (0, 1))"

_miss = " + ".join(f"CAST({n} IS NULL AS INT)" for n in _N)
_flags = {f"{n}_missing": f"CAST({n} IS NULL AS INT)" for n in _N}
_rows("missing_stats", {"missing_count": _miss, "missing_ratio": f"({_miss}) / 18.0::DOUBLE", **_flags})
_rows("impute_flags", {n: f"coalesce({n}, 0)" for n in _N} | _flags)
_sum = "(0.0::DOUBLE + " + " + ".join(f"coalesce({n}, 0)" for n in _N) + ")"
_n = "(" + " + ".join(f"CAST({n} IS NOT NULL AS INT)" for n in _N) + ")"
_dev = " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE ({n} - m) * ({n} - m) END" for n in _N)
ORACLES["row_stats"] = f"WITH {_BASE}, a AS (SELECT *, {_n} AS n, {_sum} AS t, {_sum} / nullif({_n}, 0) AS m, least({_F}) AS lo, greatest({_F}) AS hi FROM ro) SELECT row_id, m AS row_mean, CASE WHEN n > 1 THEN sqrt(({_dev}) / (n - 1)) END AS row_std, lo AS row_min, hi AS row_max, hi - lo AS row_range, t AS row_sum FROM a"
ORACLES["row_skew"] = f"""WITH {_BASE}, v AS (SELECT * FROM ro UNPIVOT INCLUDE NULLS (x FOR f IN ({_F}))), a AS (SELECT row_id, x, avg(x) OVER (PARTITION BY row_id) AS m FROM v WHERE x IS NOT NULL),
c AS (SELECT row_id, CAST(count(*) AS DOUBLE) AS n, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3 FROM a GROUP BY row_id)
SELECT ro.row_id, round(CASE WHEN n > 2 THEN CASE WHEN m2 > 1e-14 THEN sqrt(n * (n - 1)) / (n - 2) * m3 / (m2 * sqrt(m2)) ELSE 0 END END, 6) AS row_skew FROM ro LEFT JOIN c ON c.row_id = ro.row_id"""
_rows("ratios", {f"ratio_{a:03d}_{b:03d}": f"feature_{a:03d} / nullif(feature_{b:03d} + 1e-8, 0)" for a, b in [(15, 17), (16, 17), (8, 10)]} | {f"safe_ratio_{a:03d}_{b:03d}": f"coalesce(feature_{a:03d}, 0) / coalesce(nullif(feature_{b:03d}, 0), 1)" for a, b in [(2, 3), (4, 6), (8, 9)]}, 6)
_rows("log_feats", {f"log_{i:03d}": f"ln(1 + greatest(coalesce(feature_{i:03d}, 0), 0))" for i in (10, 15, 16)} | {"sqrt_010": "sqrt(greatest(coalesce(feature_010, 0), 0))"}, 9)
_rows("flag_feats", {"high_010": "CAST(coalesce(feature_010 > 1000, false) AS INT)", "high_015": "CAST(coalesce(feature_015 > 10, false) AS INT)"})
_rows("square_feats", {f"{n}_sq": f"coalesce({n}, 0) * coalesce({n}, 0)" for n in _N})
_rows("interactions", {f"product_{a:03d}_{b:03d}": f"coalesce(feature_{a:03d}, 0) * coalesce(feature_{b:03d}, 0)" for a, b in [(1, 2), (3, 4), (8, 9), (13, 14)]})
_PAIRS = list(combinations([7, 11, 13, 14], 2))
_rows("binary_pairs", {f"and_{a:03d}_{b:03d}": f"CAST(coalesce(feature_{a:03d}, 0) * coalesce(feature_{b:03d}, 0) AS INT)" for a, b in _PAIRS} | {f"or_{a:03d}_{b:03d}": f"CAST(coalesce(feature_{a:03d}, 0) + coalesce(feature_{b:03d}, 0) > 0 AS INT)" for a, b in _PAIRS})
_rows("value_counts_row", {"zeros": " + ".join(f"CAST(coalesce({n} = 0, false) AS INT)" for n in _N), "ones": " + ".join(f"CAST(coalesce({n} = 1, false) AS INT)" for n in _N)})
_rows("signed_log1p", {n: f"sign({n}) * ln(1 + abs({n}))" for n in _N}, 9)
_sig = lambda x, b: f"CASE WHEN {x} IS NOT NULL THEN 1 / (1 + exp(-least(greatest({x}, -{b}), {b}))) END"
_rows("sigmoid", {"narrow": _sig("(feature_015 / 10)", 20), "wide": _sig("feature_015", 35)}, 9)
ORACLES["clip_proba"] = "SELECT user_hash, CASE WHEN p IS NOT NULL THEN CAST(least(greatest(p, 0.001), 0.999) AS DOUBLE) END AS prediction FROM (SELECT user_hash, CAST(nullif(CAST(prediction AS VARCHAR), 'nan') AS DOUBLE) AS p FROM submission)"

_BOUNDS = f"""tw AS (SELECT row_id, {_F} FROM tr WHERE is_cheating IN (0, 1) OR {_WEAK}), vl AS (SELECT * FROM tw UNPIVOT INCLUDE NULLS (x FOR feature IN ({_F}))),
vr AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY feature) AS n FROM vl WHERE x IS NOT NULL),
bp AS (SELECT feature, max(x) FILTER (i = floor(0.01 * (n - 1))) AS lo, max(x) FILTER (i = floor(0.99 * (n - 1))) AS hi FROM vr GROUP BY feature),
bo AS (SELECT feature, CASE WHEN lo = hi THEN lo - 1 ELSE lo END AS lo, CASE WHEN lo = hi THEN hi + 1 ELSE hi END AS hi FROM bp)"""
ORACLES["clip_bounds"] = f"WITH {_BASE}, {_BOUNDS} SELECT f.feature, coalesce(lo, -1) AS lo, coalesce(hi, 1) AS hi FROM (SELECT DISTINCT feature FROM vl) f LEFT JOIN bo ON bo.feature = f.feature"
ORACLES["winsorize"] = f"WITH {_BASE}, {_BOUNDS} SELECT row_id, " + ", ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE least(greatest({n}, (SELECT lo FROM bo WHERE feature = '{n}')), (SELECT hi FROM bo WHERE feature = '{n}')) END AS {n}" for n in _N) + " FROM ro"
_FIT = "ft AS (SELECT " + ", ".join(f"avg(coalesce({n}, 0)) AS m_{n}, CASE WHEN stddev_pop(coalesce({n}, 0)) > 0 THEN stddev_pop(coalesce({n}, 0)) ELSE 1 END AS s_{n}" for n in _N) + " FROM tr)"
ORACLES["standardize"] = f"WITH {_BASE}, {_FIT} SELECT row_id, " + ", ".join(f"round((coalesce({n}, 0) - m_{n}) / s_{n}, 6) AS {n}" for n in _N) + " FROM ro, ft"
_CLASS = f"""lb AS (SELECT row_id, {_CLS} AS y, {_F} FROM tr WHERE is_cheating IN (0, 1)), lv AS (SELECT * FROM lb UNPIVOT INCLUDE NULLS (x FOR feature IN ({_F}))),
cs AS (SELECT y, feature, count(x) AS n, coalesce(sum(x), 0) AS sx, coalesce(sum(x * x), 0) AS sxx, count(*) - count(x) AS n_missing, count(*) AS n_rows FROM lv GROUP BY y, feature)"""
ORACLES["class_stats"] = f"WITH {_BASE}, {_CLASS} SELECT y, feature, n, round(sx, 4) AS sx, format('{{:.8e}}', sxx) AS sxx, n_missing, n_rows FROM cs"
_WEIGHTS = f"""{_CLASS}, p AS (SELECT feature, coalesce(max(sx / n) FILTER (y = 0 AND n > 0), 0) AS a0, coalesce(max(sx / n) FILTER (y = 1 AND n > 0), 0) AS a1,
  coalesce(max(greatest(sxx / n - (sx / n) ** 2, 0)) FILTER (y = 0 AND n > 0), 0) AS v0, coalesce(max(greatest(sxx / n - (sx / n) ** 2, 0)) FILTER (y = 1 AND n > 0), 0) AS v1,
  coalesce(max(n_missing) FILTER (y = 0), 0) AS m0, coalesce(max(n_missing) FILTER (y = 1), 0) AS m1, coalesce(max(n_rows) FILTER (y = 0), 0) AS r0, coalesce(max(n_rows) FILTER (y = 1), 0) AS r1 FROM cs GROUP BY feature),
we AS MATERIALIZED (SELECT feature, least(greatest((a1 - a0) / (0.5 * (v0 + v1) + 1e-9), -10), 10) AS weight, least(greatest(ln(((m1 + 1) / (r1 + 2)) / ((m0 + 1) / (r0 + 2))), -2), 2) AS weight_missing,
  ln(least(greatest(r1 / (r0 + r1), 1e-6), 1 - 1e-6) / (1 - least(greatest(r1 / (r0 + r1), 1e-6), 1 - 1e-6))) AS bias FROM p)"""
ORACLES["lda_weights"] = f"WITH {_BASE}, {_WEIGHTS} SELECT feature, round(weight, 7) + 0.0 AS weight, round(weight_missing, 7) + 0.0 AS weight_missing, round(bias, 7) + 0.0 AS bias FROM we"


def _score(rows: str, *keep: str) -> str:
    kept = ", ".join(keep)
    return f"(SELECT {kept}, 1 / (1 + exp(-least(greatest((SELECT any_value(bias) FROM we) + sum(CASE WHEN x IS NULL THEN weight_missing ELSE weight * x END), -20), 20))) AS score FROM (SELECT * FROM {rows} UNPIVOT INCLUDE NULLS (x FOR feature IN ({_F}))) z JOIN we USING (feature) GROUP BY {kept})"


_TEST = f"tz AS (SELECT row_id, user_hash, {_F} FROM te)"
ORACLES["linear_score"] = f"WITH {_BASE}, {_WEIGHTS}, {_TEST} SELECT row_id, round(score, 6) AS score FROM {_score('tz', 'row_id')}"
_SCORES = f"{_BASE}, {_WEIGHTS}, sc AS MATERIALIZED (SELECT row_id, y, round(score, 6) AS p FROM {_score('lb', 'row_id', 'y')})"
_CUM = "bs AS (SELECT p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM sc GROUP BY p), cc AS MATERIALIZED (SELECT p, pos, neg, CAST(sum(pos) OVER (ORDER BY p) AS BIGINT) AS cum_pos, CAST(sum(neg) OVER (ORDER BY p) AS BIGINT) AS cum_neg FROM bs)"
ORACLES["cum_counts"] = f"WITH {_SCORES}, {_CUM} SELECT * FROM cc"
ORACLES["auc"] = f"WITH {_SCORES}, rk AS (SELECT y, (rank() OVER (ORDER BY p) + rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM sc) SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM rk"
ORACLES["avg_precision"] = f"WITH {_SCORES}, de AS (SELECT p, y, count(*) FILTER (y = 1) OVER w AS tp, count(*) OVER w AS n FROM sc WINDOW w AS (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) SELECT round(sum(tp / n) / count(*), 6) AS average_precision FROM de WHERE y = 1"
ORACLES["score_dist"] = f"WITH {_SCORES} SELECT y, count(*) AS n, min(p) AS least, median(p) AS middle, max(p) AS greatest, " + ", ".join(f"count(*) FILTER (p < 0.{t}) AS below_0{t}" for t in range(1, 6)) + " FROM sc GROUP BY y"


def _search(pairs: str, costs: tuple[int, int, int, int], low: str, high: str) -> str:
    """Brute force: every row against every pair of thresholds, over distinct scores."""
    fn, fp, look_neg, look_pos = costs
    return f"""{pairs}, al AS (SELECT t1, t2, sum(CASE WHEN p {low} t1 THEN {fn} * pos WHEN p {high} t2 THEN {fp} * neg ELSE {look_neg} * neg + {look_pos} * pos END) AS cost FROM pr, bs GROUP BY t1, t2)"""


_BEST = "SELECT t1 AS t_low, t2 AS t_high, CAST(cost AS DOUBLE) AS cost FROM al ORDER BY al.cost, t1, t2 LIMIT 1"
_G = lambda start, n, step: f"(SELECT {start}::DOUBLE + i * {step}::DOUBLE AS t FROM range({n}) r(i))"
ORACLES["cost_quantile"] = f"""WITH {_SCORES}, {_CUM}, so AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i, count(*) OVER () AS n FROM sc),
pk AS (SELECT DISTINCT p AS t FROM so JOIN range(200) g(k) ON i = CAST(trunc(k / 199 * (n - 1)) AS BIGINT)), pr AS (SELECT a.t AS t1, b.t AS t2 FROM pk a JOIN pk b ON b.t >= a.t), {_search("x1 AS (SELECT 1)", (600, 300, 150, 5), "<", ">=")}
SELECT CAST(-min(cost) AS DOUBLE) AS score FROM al"""
ORACLES["cost_grid_linspace"] = f"WITH {_SCORES}, {_CUM}, {_search(f'pr AS (SELECT a.t AS t1, b.t AS t2 FROM {_G(0.01, 99, 0.01)} a JOIN {_G(0.01, 99, 0.01)} b ON b.t > a.t)', (100, 50, 10, 10), '<=', '>=')} {_BEST}"
_FIXED = f"WITH {_SCORES}, {_CUM}, {_search(f'pr AS (SELECT a.t AS t1, b.t AS t2 FROM {_G(0.01, 69, 0.01)} a JOIN {_G(0.30, 69, 0.01)} b ON b.t > a.t)', (600, 300, 150, 150), '<=', '>=')}"
ORACLES["cost_grid_fixed"] = f"{_FIXED} {_BEST}"
ORACLES["cost_grid_relative"] = f"WITH {_SCORES}, {_CUM}, {_search(f'pr AS (SELECT a.t AS t1, (a.t + 0.05::DOUBLE) + j * 0.02::DOUBLE AS t2 FROM {_G(0.05, 23, 0.02)} a JOIN range(60) r(j) ON j < ceil((0.95::DOUBLE - (a.t + 0.05::DOUBLE)) / 0.02::DOUBLE))', (600, 300, 150, 5), '<', '>')} {_BEST}"
ORACLES["cost_scaled"] = f"{_FIXED} SELECT round(min(cost) * ((SELECT count(*) FROM te) / (SELECT count(*) FROM lb)), 4) AS scaled_cost FROM al"
_DECIDED = f"{_FIXED}, bt AS (SELECT t1, t2 FROM al ORDER BY al.cost, t1, t2 LIMIT 1), d AS (SELECT CASE WHEN p <= t1 THEN 'through' WHEN p >= t2 THEN 'stop' ELSE 'look' END AS region, y FROM sc, bt)"
ORACLES["decision_breakdown"] = f"{_DECIDED} SELECT region, y, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 9) AS share FROM d GROUP BY region, y"
_LINES = [("cheaters through", "through", 1, 600), ("clean stopped", "stop", 0, 300), ("clean looked at", "look", 0, 150), ("cheaters looked at", "look", 1, 150)]
ORACLES["cost_lines"] = f"{_DECIDED}, ln AS (" + " UNION ALL ".join(f"SELECT '{name}' AS line, count(*) AS n, CAST(count(*) * {cost} AS DOUBLE) AS cost FROM d WHERE region = '{region}' AND y = {y}" for name, region, y, cost in _LINES) + ") SELECT * FROM ln UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT), sum(cost) FROM ln"

ORACLES["edges_bidir"] = f"WITH {_LINKS} SELECT u, v FROM bi"
ORACLES["edges_simple"] = f"WITH {_LINKS} SELECT u, v FROM si"
for _name, _from in (("degree_multi", "bi"), ("degree_simple", "si")):
    ORACLES[_name] = f"{_ALL} SELECT us.k AS user_key, count(x.u) AS degree FROM us LEFT JOIN {_from} x ON x.u = us.k GROUP BY us.k"
ORACLES["degree_centrality"] = f"{_ALL} SELECT us.k AS user_key, round(count(x.u) / ((SELECT count(*) FROM (SELECT u FROM si UNION SELECT k FROM us)) - 1), 6) AS centrality FROM us LEFT JOIN si x ON x.u = us.k GROUP BY us.k"


def _nc(edges: str) -> str:
    return f"""nc AS MATERIALIZED (SELECT us.k, count(x.u) AS degree, count(*) FILTER (l.y = 1) AS cheater, count(*) FILTER (l.y = 0) AS clean, count(l.y) AS labeled, count(x.u) - count(l.y) AS unlabeled
FROM us LEFT JOIN {edges} x ON x.u = us.k LEFT JOIN la l ON l.k = x.v GROUP BY us.k)"""


ORACLES["neighbor_stats"] = f"{_ALL}, {_nc('bi')} SELECT k AS user_key, degree, cheater, clean, labeled, unlabeled FROM nc"
_KN = """kn AS MATERIALIZED (SELECT us.k, count(x.u) AS degree, count(CASE WHEN l.y IS NOT NULL OR l.weak THEN 1 END) AS known, CAST(coalesce(sum(l.y), 0) AS BIGINT) AS cheat_sum
FROM us LEFT JOIN bi x ON x.u = us.k LEFT JOIN la l ON l.k = x.v GROUP BY us.k)"""
ORACLES["known_neighbors"] = f"{_ALL}, {_KN} SELECT k AS user_key, degree, known, cheat_sum, round(cheat_sum / greatest(known, 1), 6) AS cheat_fraction FROM kn"
ORACLES["edges_to_class"] = f"{_ALL} SELECT us.k AS user_key, count(*) FILTER (x.v IN (SELECT k FROM la WHERE y = 1)) AS edges_to_cheaters, count(*) FILTER (x.v IN (SELECT k FROM la WHERE y = 0)) AS edges_to_clean FROM us LEFT JOIN bi x ON x.u = us.k GROUP BY us.k"
ORACLES["guilt_features"] = f"""{_ALL}, {_nc('bi')}, b AS (SELECT coalesce(avg(y), 0) AS base FROM la),
g AS (SELECT *, cheater / nullif(labeled, 0) AS rate, cheater / greatest(degree, 1) AS ra, cheater / (cheater + clean + 1) AS dom, CAST(cheater > 0 AS INT) AS hs, CAST(cheater > 0 AND clean = 0 AS INT) AS oc FROM nc, b),
h AS (SELECT *, 0.6 * coalesce(rate, base) + 0.4 * least(ra, 1) AS gs FROM g)
SELECT k AS user_key, degree, cheater, clean, labeled, unlabeled, round(rate, 6) AS cheat_rate_labeled, round(ra, 6) AS cheat_rate_all, round(clean / nullif(labeled, 0), 6) AS clean_rate_labeled,
round(ln(1 + cheater) - ln(1 + clean), 6) AS cheater_clean_ratio, hs AS has_cheater, CAST(cheater >= 2 AS INT) AS has_2plus, CAST(cheater >= 3 AS INT) AS has_3plus, CAST(cheater >= 5 AS INT) AS has_5plus,
CAST(coalesce(rate > 0.5, false) AS INT) AS rate_gt_50, CAST(coalesce(rate > 0.75, false) AS INT) AS rate_gt_75, oc AS only_cheater_friends, CAST(clean = 0 AS INT) AS no_clean_friends,
round(labeled / greatest(degree, 1), 6) AS labeled_pct, CAST(degree <= 1 AS INT) AS is_isolated, round(ln(1 + degree), 6) AS log_degree, round(dom, 6) AS edge_dominance,
round(0.5 * coalesce(rate, base) + 0.3 * ra + 0.2 * dom, 6) AS guilt_v1, round(0.4 * coalesce(rate, base) + 0.3 * hs + 0.3 * oc, 6) AS guilt_v2, round(ln(1 + cheater) / (ln(1 + degree) + 0.1), 6) AS guilt_v3,
hs + CAST(cheater >= 2 AS INT) + CAST(coalesce(rate > 0.5, false) AS INT) + oc AS risk_tier, CAST(cheater >= 3 OR coalesce(rate > 0.75, false) AS INT) AS strong_signal, CAST(cheater > 0 AND clean = 0 AND labeled > 0 AS INT) AS very_suspicious,
round(cheater / (degree + 1), 6) AS cheater_density, round(ln(1 + cheater), 6) AS log_cheaters, CAST(cheater - clean AS DOUBLE) AS cheater_minus_clean, round(cheater * coalesce(rate, 0), 6) AS network_strength,
round(gs, 6) AS guilt_score, hs + CAST(gs > 0.5 AS INT) + CAST(cheater > 2 AS INT) AS guilt_tier FROM h"""
ORACLES["second_pass"] = f"{_ALL}, {_KN} SELECT us.k AS user_key, round(coalesce(sum(coalesce(n.cheat_sum / greatest(n.known, 1), 0)) / nullif(count(x.u), 0), 0), 6) AS mean_cheat_fraction, round(coalesce(sum(coalesce(n.degree, 0)) / nullif(count(x.u), 0), 0), 6) AS mean_degree FROM us LEFT JOIN bi x ON x.u = us.k LEFT JOIN kn n ON n.k = x.v GROUP BY us.k"
ORACLES["neighbor_degree"] = f"{_ALL}, dg AS (SELECT u, count(*) AS d FROM si GROUP BY u) SELECT us.k AS user_key, round(coalesce(avg(d), 0), 6) AS neighbor_degree_mean, coalesce(max(d), 0) AS neighbor_degree_max, round(coalesce(stddev_pop(d), 0), 6) AS neighbor_degree_std FROM us LEFT JOIN si x ON x.u = us.k LEFT JOIN dg ON dg.u = x.v GROUP BY us.k"
_ONE = f"{_ALL}, {_nc('si')}, oh AS (SELECT k, degree, ln(1 + degree) AS log_degree, cheater, clean, labeled, cheater / nullif(labeled, 0) AS cheat_rate, CAST(cheater > 0 AS INT) AS has_cheater FROM nc)"
ORACLES["one_hop"] = f"{_ONE} SELECT k AS user_key, degree, round(log_degree, 6) AS log_degree, cheater, clean, labeled, round(cheat_rate, 6) AS cheat_rate, has_cheater FROM oh"
_IDS = """nd AS MATERIALIZED (SELECT u AS k, CAST(row_number() OVER () AS INT) AS i FROM (SELECT DISTINCT u FROM si)),
ie AS MATERIALIZED (SELECT x.i AS a, y.i AS b FROM si JOIN nd x ON x.k = si.u JOIN nd y ON y.k = si.v),
iu AS MATERIALIZED (SELECT i AS a FROM nd WHERE k IN (SELECT k FROM us)),
h1 AS MATERIALIZED (SELECT a, b FROM ie WHERE a IN (SELECT a FROM iu)),
h2 AS MATERIALIZED (SELECT DISTINCT h1.a, ie.b FROM h1 JOIN ie ON ie.a = h1.b WHERE h1.a <> h1.b AND h1.a <> ie.b EXCEPT SELECT a, b FROM h1)"""
_H3 = "h3 AS MATERIALIZED (SELECT DISTINCT h2.a, ie.b FROM h2 JOIN ie ON ie.a = h2.b WHERE h2.a <> ie.b EXCEPT SELECT a, b FROM h2 EXCEPT SELECT a, b FROM h1)"


def _hops(far: int) -> str:
    per = ", ".join(f"c{h} AS (SELECT nd.k, count(*) AS n, count(*) FILTER (l.y = 1) AS p, count(*) FILTER (l.y = 0) AS q FROM h{h} JOIN nd ON nd.i = h{h}.a JOIN nd t ON t.i = h{h}.b LEFT JOIN la l ON l.k = t.k GROUP BY nd.k)" for h in range(1, far + 1))
    cols = ", ".join(f"coalesce(c{h}.n, 0) AS n_{h}hop, coalesce(c{h}.p, 0) AS cheater_{h}hop, coalesce(c{h}.q, 0) AS clean_{h}hop" for h in range(1, far + 1))
    rates = ", ".join(f"round(cheater_{h}hop / nullif(cheater_{h}hop + clean_{h}hop, 0), 9) AS rate_{h}hop" for h in range(1, far + 1))
    w = [0.6, 0.3, 0.1]
    up = " + ".join(f"coalesce({w[h - 1]}::DOUBLE * (cheater_{h}hop / nullif(cheater_{h}hop + clean_{h}hop, 0)), 0)" for h in range(1, far + 1))
    down = " + ".join(f"CASE WHEN cheater_{h}hop + clean_{h}hop > 0 THEN {w[h - 1]}::DOUBLE ELSE 0 END" for h in range(1, far + 1))
    joins = " ".join(f"LEFT JOIN c{h} ON c{h}.k = us.k" for h in range(1, far + 1))
    reach = " + ".join(f"cheater_{h}hop" for h in range(1, far + 1))
    return f"{_ALL}, {_IDS}{', ' + _H3 if far > 2 else ''}, {per}, al AS (SELECT us.k AS user_key, {cols} FROM us {joins}) SELECT *, {rates}, round(({up}) / nullif({down}, 0), 9) AS combined_rate, {reach} AS cheater_reach FROM al"


ORACLES["two_hop"] = _hops(2)
ORACLES["three_hop"] = _hops(3)
ORACLES["clustering"] = f"""{_ALL}, pl AS MATERIALIZED (SELECT u, v FROM si WHERE u <> v), kd AS (SELECT u, count(*) AS k FROM pl GROUP BY u), o AS MATERIALIZED (SELECT u, v FROM pl WHERE u < v),
t AS (SELECT x.u AS p, x.v AS q, y.v AS r FROM o x JOIN o y ON y.u = x.v JOIN o z ON z.u = x.u AND z.v = y.v), c AS (SELECT n, count(*) AS t FROM (SELECT p AS n FROM t UNION ALL SELECT q FROM t UNION ALL SELECT r FROM t) GROUP BY n)
SELECT us.k AS user_key, coalesce(c.t, 0) AS triangles, round(CASE WHEN kd.k > 1 THEN 2.0 * coalesce(c.t, 0) / (kd.k * (kd.k - 1)) ELSE 0 END, 6) AS clustering FROM us LEFT JOIN kd ON kd.u = us.k LEFT JOIN c ON c.n = us.k"""


def _prop(rounds: int = 15) -> str:
    parts = ["mn AS MATERIALIZED (SELECT u, v FROM si WHERE u IN (SELECT k FROM us))", "s0 AS MATERIALIZED (SELECT us.k, l.y, coalesce(l.y::DOUBLE, 0.5) AS s FROM us LEFT JOIN la l ON l.k = us.k)"]
    for i in range(rounds):
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT c.k, c.y, CASE WHEN m IS NULL THEN c.s WHEN c.y IS NULL THEN m ELSE 0.6 * c.y + 0.4 * m END AS s FROM s{i} c LEFT JOIN (SELECT mn.u, avg(coalesce(n.s, 0.5)) AS m FROM mn LEFT JOIN s{i} n ON n.k = mn.v GROUP BY mn.u) a ON a.u = c.k)")
    return f"{_ALL}, {', '.join(parts)} SELECT k AS user_key, round(s, 6) AS score FROM s{rounds}"


def _risk(rounds: int = 25, value: str = "round(r, 6)") -> str:
    parts = ["mn AS MATERIALIZED (SELECT u, v FROM si WHERE u IN (SELECT k FROM us))", "dg AS MATERIALIZED (SELECT u, count(*) AS d FROM si GROUP BY u)", "s0 AS MATERIALIZED (SELECT us.k, d, coalesce(y, 0) = 1 AS c, CASE WHEN y = 1 THEN 1.0::DOUBLE ELSE 0 END AS r FROM us LEFT JOIN la ON la.k = us.k LEFT JOIN dg ON dg.u = us.k)"]
    for i in range(rounds):
        parts.append(f"q{i} AS MATERIALIZED (SELECT o.k, o.d, o.c, CASE WHEN a.u IS NULL THEN o.r WHEN o.c THEN 0.5 + 0.425 * a.g ELSE 0.85 * a.g END AS r FROM s{i} o LEFT JOIN (SELECT mn.u, coalesce(sum(n.r / n.d), 0) AS g FROM mn LEFT JOIN s{i} n ON n.k = mn.v GROUP BY mn.u) a ON a.u = o.k)")
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT k, d, c, CASE WHEN (SELECT max(r) FROM q{i}) > 0 THEN r / (SELECT max(r) FROM q{i}) ELSE r END AS r FROM q{i})")
    return f"{_ALL}, {', '.join(parts)} SELECT k AS user_key, {value} AS risk FROM s{rounds}"


def _votes(rounds: int = 8) -> str:
    parts = ["pl AS MATERIALIZED (SELECT u, v FROM si WHERE u <> v)", "m0 AS MATERIALIZED (SELECT k, k AS l FROM (SELECT k FROM us UNION SELECT u FROM si))"]
    for i in range(rounds):
        parts.append(f"m{i + 1} AS MATERIALIZED (SELECT o.k, coalesce(w.l, o.l) AS l FROM m{i} o LEFT JOIN (SELECT u, l FROM (SELECT u, l, row_number() OVER (PARTITION BY u ORDER BY count(*) DESC, l) AS n FROM pl JOIN m{i} n ON n.k = pl.v GROUP BY u, l) WHERE n = 1) w ON w.u = o.k)")
    return f"{_ALL}, {', '.join(parts)}, cm AS (SELECT k, l AS c FROM m{rounds})"


ORACLES["label_prop"] = _prop()
ORACLES["pagerank_risk"] = _risk()
_COMP = f"""WITH RECURSIVE {_BASE}, {_PEOPLE}, {_LINKS}, st AS (SELECT k, min(g) AS g FROM (SELECT k, k AS g FROM us UNION ALL SELECT u, least(u, v) FROM si) GROUP BY k),
rc(k, g) USING KEY (k) AS (SELECT k, g FROM st UNION SELECT si.u, min(n.g) FROM rc n JOIN si ON si.v = n.k JOIN recurring.rc o ON o.k = si.u WHERE n.g < o.g GROUP BY si.u), cm AS (SELECT k, g AS c FROM rc)"""
ORACLES["components"] = f"{_COMP} SELECT k AS user_key, c AS component FROM cm"
_SIZES = "sz AS (SELECT c, count(*) AS n FROM cm GROUP BY c), rt AS (SELECT c, avg(y) AS r FROM us JOIN cm ON cm.k = us.k LEFT JOIN la ON la.k = us.k GROUP BY c)"
ORACLES["component_stats"] = f"{_COMP}, {_SIZES} SELECT us.k AS user_key, cm.c AS component, n AS component_size, round(ln(1 + n), 6) AS log_component_size, round(r, 6) AS component_cheat_rate FROM us JOIN cm ON cm.k = us.k JOIN sz ON sz.c = cm.c JOIN rt ON rt.c = cm.c"
ORACLES["communities"] = f"{_votes()} SELECT k AS user_key, c AS community FROM cm"
ORACLES["community_stats"] = f"{_votes()}, {_SIZES} SELECT us.k AS user_key, cm.c AS community, n AS community_size, round(r, 6) AS community_cheat_rate FROM us JOIN cm ON cm.k = us.k JOIN sz ON sz.c = cm.c JOIN rt ON rt.c = cm.c"

_KEYS = f"WITH {_BASE} SELECT row_id, k AS user_key FROM ro"
_zero = lambda *names: ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
ORACLES["attach_graph"] = f"""SELECT row_id, {_zero("degree", "log_degree", "cheater", "clean", "labeled", "has_cheater", "neighbor_degree_mean", "neighbor_degree_max", "neighbor_degree_std", "triangles", "clustering", "component_size", "log_component_size")},
cheat_rate, component_cheat_rate, score AS label_prop_score, risk AS pagerank_risk FROM ({_KEYS}) r {" ".join(f"LEFT JOIN ({ORACLES[q]}) {q} USING (user_key)" for q in ("one_hop", "neighbor_degree", "clustering", "component_stats", "label_prop", "pagerank_risk"))}"""
ORACLES["attach_hops"] = f"""SELECT row_id, {_zero(*[f"{n}_{h}hop" for n in ("n", "cheater", "clean") for h in (1, 2, 3)], "cheater_reach")}, rate_1hop, rate_2hop, rate_3hop, combined_rate
FROM ({_KEYS}) r LEFT JOIN ({ORACLES["three_hop"]}) h USING (user_key)"""
ORACLES["graph_interactions"] = f"""WITH ms AS (WITH {_BASE} SELECT row_id, k AS user_key, {_miss} AS mc, {_sum} / nullif({_n}, 0) AS m FROM ro)
SELECT row_id, round(coalesce(cheater / nullif(labeled, 0), 0) * mc, 6) AS rate_missing, round(coalesce(risk, 0) * coalesce(m, 0), 3) + 0.0 AS risk_mean
FROM ms LEFT JOIN ({ORACLES["one_hop"]}) o USING (user_key) LEFT JOIN ({_risk(value="r")}) p USING (user_key)"""

ORACLES["submission_format"] = f"WITH {_BASE}, {_WEIGHTS}, {_TEST} SELECT user_hash, printf('%.10f', round(score, 6)) AS prediction FROM {_score('tz', 'row_id', 'user_hash')}"
ORACLES["validate_submission"] = """WITH ex AS (SELECT DISTINCT user_hash FROM test WHERE user_hash IS NOT NULL), v AS (
  SELECT 'duplicate id' AS violation, user_hash FROM submission WHERE user_hash IS NOT NULL GROUP BY user_hash HAVING count(*) > 1
  UNION ALL SELECT 'bad prediction', coalesce(user_hash, '') FROM submission WHERE prediction IS NULL OR CAST(prediction AS VARCHAR) = 'nan' OR prediction < 0 OR prediction > 1
  UNION ALL SELECT 'missing id', user_hash FROM ex WHERE user_hash NOT IN (SELECT user_hash FROM submission WHERE user_hash IS NOT NULL)
  UNION ALL SELECT 'unknown id', u FROM (SELECT DISTINCT coalesce(user_hash, '') AS u FROM submission) WHERE u NOT IN (SELECT user_hash FROM ex)),
n AS (SELECT violation, user_hash, row_number() OVER (PARTITION BY violation ORDER BY user_hash) AS i FROM v)
SELECT violation, count(*) AS n, string_agg(CASE WHEN i <= 5 THEN user_hash END, '|' ORDER BY user_hash) AS examples FROM n GROUP BY violation
UNION ALL SELECT 'row count', s, CAST(t AS VARCHAR) FROM (SELECT (SELECT count(*) FROM submission) AS s, (SELECT count(*) FROM ex) AS t) WHERE s <> t"""
