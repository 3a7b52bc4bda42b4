"""Attribution summaries, Shapley values and permutation importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.fixtures import duck
from gridspark.operators import attribution as A
from gridspark.operators import shapley as H
from gridspark.queries.aggregates import _avg_rank
from gridspark.queries.ranking import edges_sql
from gridspark.queries.registry import big, bigs, query, r6, r6s
from gridspark.queries.sampling import hash_sql, uniform_sql


def group(column="f"):
    return F.concat(F.lit("g"), (F.col(column) % 4).cast("string"))


@query("shap_feature_summary", duck("v_attr") + f""", s AS (SELECT cls, f, count(*) AS n, sum(w) AS sw, sum(w * abs(phi)) AS sa, sum(w * phi) AS ss, avg(abs(phi)) AS ma, avg(phi) AS ms
    FROM v_attr GROUP BY cls, f)
    SELECT {bigs('cls', 'f')}, n, {r6('sw', 'sum_weight')}, {r6('sa', 'sum_abs_weighted')}, {r6('ss', 'sum_signed_weighted')}, {r6('ma', 'mean_abs')}, {r6('ms', 'mean_signed')},
    {r6('sa / sw', 'mean_abs_weighted')}, {r6('ss / sw', 'mean_signed_weighted')}, {r6('(sa / sw) / sum(sa / sw) OVER (PARTITION BY cls)', 'share')} FROM s""")
def _(v):
    return A.attribution_summary(v.attr, ["cls"], "f")


OLD = ", m AS (SELECT f, sum(w * abs(phi)) / sum(w) AS m FROM v_attr GROUP BY f), o AS (SELECT 'g' || (f % 4) AS feature_group, sum(m) AS old, count(*) AS k FROM m GROUP BY 1)"


@query("shap_group_summary_old", duck("v_attr") + OLD + f"SELECT feature_group, {r6('old', 'old_sum_mean_abs')}, k AS n_features FROM o")
def _(v):
    return A.group_sum_of_abs(v.attr, group(), feature="f")


TOTALS = ", t AS (SELECT id, 'g' || (f % 4) AS feature_group, sum(phi) AS phi, max(w) AS w FROM v_attr GROUP BY 1, 2)"


@query("shap_group_summary", duck("v_attr") + OLD + TOTALS + f""", n AS (SELECT feature_group, sum(w * abs(phi)) / sum(w) AS new, sum(w * phi) / sum(w) AS sg FROM t GROUP BY 1)
    SELECT feature_group, {r6('new', 'corrected_mean_abs')}, {r6('sg', 'mean_signed')}, {r6('old', 'old_sum_mean_abs')}, k AS n_features,
    {r6('old / new', 'old_to_corrected_ratio')}, {r6('(1 - new / old) * 100', 'cancellation_pct')} FROM n JOIN o USING (feature_group)""")
def _(v):
    return A.group_abs_of_sum(v.attr, group(), feature="f")


@query("class_shap_summary", duck("v_attr") + f"""SELECT {bigs('cls', 'f')}, count(*) AS n, {r6('sum(w * abs(phi)) / sum(w)', 'mean_abs')}, {r6('sum(w * phi) / sum(w)', 'mean_signed')}
    FROM v_attr GROUP BY cls, f""")
def _(v):
    return A.class_attribution(v.attr, ["cls", "f"])


DOMINANT = TOTALS + """, d AS (SELECT id, max(struct_pack(a := abs(phi), g := feature_group, phi := phi)) AS t, sum(abs(phi)) AS tot FROM t GROUP BY id),
    e AS (SELECT id, t.g AS strongest, t.phi AS strongest_phi, t.a / tot AS share FROM d)"""


@query("signed_dominant_factor", duck("v_attr") + DOMINANT + f"""SELECT id, strongest, {r6('strongest_phi')}, {r6('share', 'dominance_share')},
    CASE WHEN share >= 0.45 THEN strongest ELSE 'Mixed' END AS dominant, CASE WHEN share < 0.45 THEN 'mixed' WHEN strongest_phi > 0 THEN 'positive' ELSE 'negative' END AS direction FROM e""")
def _(v):
    return A.dominant_factor(A.group_totals(v.attr, group(), ["id"]), ["id"])


@query("signed_dominant_counts", duck("v_attr") + DOMINANT + f"""SELECT CASE WHEN share >= 0.45 THEN strongest ELSE 'Mixed' END AS dominant,
    CASE WHEN share < 0.45 THEN 'mixed' WHEN strongest_phi > 0 THEN 'positive' ELSE 'negative' END AS direction, count(*) AS n_cells,
    {r6('count(*) / (SELECT count(*) FROM e)', 'share')} FROM e GROUP BY 1, 2""")
def _(v):
    return A.signed_counts(A.dominant_factor(A.group_totals(v.attr, group(), ["id"]), ["id"]))


# Long attributions with feature values, from the four score features.
LONG = """, p AS (SELECT id, cls, feature, x, x * (w / 50.0) - 0.3 AS phi, w FROM (SELECT id, cls, w, unnest(['x1', 'x2', 'x3', 'x4']) AS feature, unnest([x1, x2, x3, x4]) AS x FROM v_score))"""


def phi_long(v):
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in ("x1", "x2", "x3", "x4")])
    exploded = v.score.select("id", "cls", "w", F.explode(pairs).alias("p"))
    return exploded.select("id", "cls", "p.feature", "p.x", (F.col("p.x") * (F.col("w") / 50.0) - 0.3).alias("phi"), "w")


@query("dependence_curve", duck("v_score") + LONG + f""", e AS (SELECT feature, {edges_sql(20, 'x')} AS e FROM p GROUP BY feature),
    k AS (SELECT feature, greatest(len(list_filter(e, lambda q: q < x)) - 1, 0) AS bin, x, phi, w FROM p JOIN e USING (feature))
    SELECT feature, {big('bin')}, count(*) AS n, {r6('sum(w * x) / sum(w)', 'x')}, {r6('sum(w * phi) / sum(w)', 'phi')} FROM k GROUP BY feature, bin""")
def _(v):
    return A.dependence_curve(phi_long(v))


@query("category_curve", duck("v_attr") + f"""SELECT {big('cls')}, count(*) AS n, {r6('sum(w * abs(phi)) / sum(w)', 'mean_abs')}, {r6('sum(w * phi) / sum(w)', 'mean_signed')}
    FROM v_attr GROUP BY cls HAVING count(*) >= 20""")
def _(v):
    return A.category_curve(v.attr, "cls")


@query("value_shap_relation", duck("v_score") + LONG + f""", k AS (SELECT *, {_avg_rank('x', 'feature')} AS rx, {_avg_rank('phi', 'feature')} AS rp FROM p)
    SELECT feature, count(*) AS n, {r6('corr(x, phi)', 'pearson')}, {r6('avg(CASE WHEN phi > 0 THEN 1.0 ELSE 0.0 END)', 'share_positive')},
    {r6('quantile_cont(phi, 0.05)', 'p05')}, {r6('quantile_cont(phi, 0.5)', 'p50')}, {r6('quantile_cont(phi, 0.95)', 'p95')}, {r6('corr(rx, rp)', 'spearman')} FROM k GROUP BY feature""")
def _(v):
    return A.value_attribution_relation(phi_long(v))


@query("color_limit", duck("v_attr") + f""", k AS (SELECT f, abs(phi) AS v, w, sum(w) OVER (PARTITION BY f ORDER BY abs(phi), w, id) / sum(w) OVER (PARTITION BY f) AS x FROM v_attr),
    b AS (SELECT f, max(struct_pack(x := x, v := v)) FILTER (WHERE x < 0.99) AS lo, min(struct_pack(x := x, v := v)) FILTER (WHERE x >= 0.99) AS hi FROM k GROUP BY f),
    q AS (SELECT f, lo.v + (hi.v - lo.v) * (0.99 - lo.x) / (hi.x - lo.x) AS q FROM b)
    SELECT {big('f')}, {r6('q', 'limit')}, {r6('(SELECT ceil(round(max(q) * 100, 6)) / 100 FROM q)', 'common_limit')} FROM q""")
def _(v):
    return A.robust_limit(v.attr, "f")


def archive_groups():
    return ["g0", "g1", "g2", "g3"]


@query("attribution_archive", duck("v_attr") + DOMINANT + f""", c AS (SELECT id, any_value(cls) AS cls FROM v_attr GROUP BY id),
    z AS (SELECT id, {', '.join(f"sum(phi) FILTER (WHERE feature_group = 'g{i}') AS phi_group__g{i}" for i in range(4))} FROM t GROUP BY id)
    SELECT id, {big('cls')}, {', '.join(r6(f'phi_group__g{i}') for i in range(4))}, strongest, {r6('strongest_phi')}, {r6('share', 'dominance_share')},
    CASE WHEN share >= 0.45 THEN strongest ELSE 'Mixed' END AS dominant, CASE WHEN share < 0.45 THEN 'mixed' WHEN strongest_phi > 0 THEN 'positive' ELSE 'negative' END AS direction
    FROM c JOIN z USING (id) JOIN e USING (id)""")
def _(v):
    cells = v.table("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cls"))
    return A.attribution_archive(v.attr, cells, group(), archive_groups())


# --- closed-form two-stage score ------------------------------------------------------------


def score(x):
    linear = 2.0 * x["x1"] - x["x2"] + 0.5 * x["x1"] * x["x3"]
    presence = F.lit(1.0) / (F.lit(1.0) + F.exp(-linear))
    return presence * F.least(F.greatest(0.2 + 0.6 * x["x4"], F.lit(0.0)), F.lit(1.0))


def score_sql(x1, x2, x3, x4):
    return f"(1.0 / (1.0 + exp(-(2 * {x1} - {x2} + 0.5 * {x1} * {x3})))) * least(greatest(0.2 + 0.6 * {x4}, 0), 1)"


FEATURES = ["x1", "x2", "x3", "x4"]
GROUPS = {"a": ["x1", "x2"], "b": ["x3"], "c": ["x4"]}
N_POOL, DRAWS = 64, 32
POOL = f""", pp AS (SELECT *, sum(w) OVER (ORDER BY id) AS e, sum(w) OVER () AS t FROM v_score),
    pd AS (SELECT i AS bg, {uniform_sql(hash_sql('i', 42))} AS u FROM range({N_POOL}) z(i)),
    pool AS (SELECT bg, x1 AS b1, x2 AS b2, x3 AS b3, x4 AS b4 FROM pd JOIN pp ON (e - w) / t <= u AND u < e / t)"""
PAIRED = f""", pr AS (SELECT s.id, x1, x2, x3, x4, b1, b2, b3, b4 FROM (SELECT *, CAST(floor({uniform_sql(hash_sql('id', 42, 'd'))} * {N_POOL}) AS BIGINT) AS bg
    FROM v_score, range({DRAWS}) z(d)) s JOIN pool USING (bg))"""


def _coalition_sql() -> str:
    at = {f: i for i, members in enumerate(GROUPS.values()) for f in members}
    cols = []
    for mask in range(8):
        args = [f if mask >> at[f] & 1 else f"b{f[1]}" for f in FEATURES]
        cols.append(f"avg({score_sql(*args)}) AS v{mask}")
    return f", cv AS (SELECT id, {', '.join(cols)} FROM pr GROUP BY id)"


COALITIONS = POOL + PAIRED + _coalition_sql()


def pool(v):
    return H.background_pool(v.score, "id", "w", FEATURES, N_POOL)


@query("group_shapley_exact", duck("v_score") + COALITIONS + f"""SELECT id, {r6('v0', 'baseline')}, {r6('v7', 'prediction')},
    {r6('(v1 - v0) / 3 + (v3 - v2) / 6 + (v5 - v4) / 6 + (v7 - v6) / 3', 'phi__a')}, {r6('(v2 - v0) / 3 + (v3 - v1) / 6 + (v6 - v4) / 6 + (v7 - v5) / 3', 'phi__b')},
    {r6('(v4 - v0) / 3 + (v5 - v1) / 6 + (v6 - v2) / 6 + (v7 - v3) / 3', 'phi__c')} FROM cv""")
def _(v):
    return H.group_shapley(v.score, "id", GROUPS, score, pool(v), N_POOL, DRAWS)


@query("shapley_interaction", duck("v_score") + COALITIONS + f""", i AS (SELECT (v3 - v1 - v2 + v0) / 2 + (v7 - v5 - v6 + v4) / 2 AS ab, (v5 - v1 - v4 + v0) / 2 + (v7 - v3 - v6 + v2) / 2 AS ac,
    (v6 - v2 - v4 + v0) / 2 + (v7 - v3 - v5 + v1) / 2 AS bc FROM cv)
    SELECT pair, {r6('avg(abs(x))', 'mean_abs')}, {r6('avg(x)', 'mean_signed')} FROM (SELECT 'a__b' AS pair, ab AS x FROM i UNION ALL SELECT 'a__c', ac FROM i UNION ALL SELECT 'b__c', bc FROM i) GROUP BY pair""")
def _(v):
    values = H.coalition_values(v.score, "id", GROUPS, score, pool(v), N_POOL, DRAWS)
    return H.interaction_summary(H.shapley_interaction(values, list(GROUPS), ["id"]), ["id"])


def log_odds(x):
    return 2.0 * x["x1"] - x["x2"] + 0.5 * x["x1"] * x["x3"]


def fraction(x):
    return F.least(F.greatest(0.2 + 0.6 * x["x4"] + 0.3 * x["x1"] * x["x3"], F.lit(0.0)), F.lit(1.0))


def stage_sql(x1, x2, x3, x4):
    return f"(2 * {x1} - {x2} + 0.5 * {x1} * {x3})"


def fraction_sql(x1, x2, x3, x4):
    return f"least(greatest(0.2 + 0.6 * {x4} + 0.3 * {x1} * {x3}, 0), 1)"


STAGES = {"presence": (log_odds, stage_sql), "fraction": (fraction, fraction_sql)}


def _pairs_sql() -> str:
    """Interactions of all pairs of features under both stages by their sums over coalitions."""
    parts = []
    for stage, (_, sql) in STAGES.items():
        cols = [f"avg({sql(*[f if mask >> i & 1 else f'b{f[1]}' for i, f in enumerate(FEATURES)])}) AS v{mask}" for mask in range(16)]
        for i in range(4):
            for j in range(i + 1, 4):
                both = 1 << i | 1 << j
                weight = {0: 1 / 3, 1: 1 / 6, 2: 1 / 3}
                terms = [f"{weight[m.bit_count()]!r} * (v{m | both} - v{m | 1 << i} - v{m | 1 << j} + v{m})" for m in range(16) if not m & both]
                parts.append(f"SELECT id, '{stage}' AS stage, '{FEATURES[i]}' AS first, '{FEATURES[j]}' AS second, {' + '.join(terms)} AS interaction FROM c_{stage}")
        yield f"c_{stage} AS MATERIALIZED (SELECT id, {', '.join(cols)} FROM pr GROUP BY id)"
    yield f"inter AS MATERIALIZED ({' UNION ALL '.join(parts)})"


#: Background rows a cell meets in the queries of pairs, which score sixteen coalitions under two stages.
PAIR_DRAWS = 8
PAIRS = POOL + PAIRED.replace("pr AS (", "pr AS MATERIALIZED (").replace(f"range({DRAWS})", f"range({PAIR_DRAWS})") + ", " + ", ".join(_pairs_sql()) + """, byf AS (SELECT stage, first, second, fold, avg(abs(interaction)) AS a, avg(interaction) AS g, count(*) AS n FROM inter JOIN v_score USING (id) GROUP BY ALL),
    tab AS (SELECT stage, first, second, avg(a) AS a, avg(g) AS g, sum(n) AS n FROM byf GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY round(a, 9) DESC, first, second) AS rank FROM tab QUALIFY rank <= 3)"""


def _interactions(v, stored=False):
    return H.stage_interactions(v.score, "id", {f: [f] for f in FEATURES}, {k: f for k, (f, _) in STAGES.items()}, pool(v), N_POOL, PAIR_DRAWS, keep=("fold",), stored=stored)


@query("top_interactions", duck("v_score") + PAIRS + f"SELECT stage, first, second, {r6('a', 'mean_abs')}, {r6('g', 'mean_signed')}, {bigs('n', 'rank')} FROM top")
def _(v):
    return H.top_interactions(_interactions(v), 3, "fold")


@query("pair_dependence", duck("v_score") + PAIRS + f""", pv AS (SELECT stage, first, second, interaction, CASE first WHEN 'x1' THEN x1 WHEN 'x2' THEN x2 WHEN 'x3' THEN x3 ELSE x4 END AS x,
      CASE second WHEN 'x1' THEN x1 WHEN 'x2' THEN x2 WHEN 'x3' THEN x3 ELSE x4 END AS color FROM inter JOIN top USING (stage, first, second) JOIN v_score USING (id)),
    e AS (SELECT stage, first, second, {edges_sql(5, 'x')} AS ex, {edges_sql(2, 'color')} AS ec FROM pv GROUP BY ALL),
    k AS (SELECT *, greatest(len(list_filter(ex, lambda q: q < x)) - 1, 0) AS bin, greatest(len(list_filter(ec, lambda q: q < color)) - 1, 0) AS color_bin FROM pv JOIN e USING (stage, first, second))
    SELECT stage, first, second, {bigs('bin', 'color_bin')}, count(*) AS n, {r6('avg(x)', 'x')}, {r6('avg(interaction)', 'interaction')} FROM k GROUP BY stage, first, second, bin, color_bin""")
def _(v):
    long = _interactions(v, stored=True)
    values = H.pair_values(long, H.top_interactions(long, 3, "fold"), v.score, "id", FEATURES)
    return H.pair_dependence(values, 5)


N_PERM = 32
ORDERS = H.paired_permutations(4, N_PERM)


def _stepwise_sql(score_of) -> str:
    """Means of each feature's marginal changes over the literal permutations, by brute force."""
    parts = []
    for i, order in enumerate(ORDERS):
        states = []
        for k in range(5):
            args = [f if order.index(j) < k else f"b{f[1]}" for j, f in enumerate(FEATURES)]
            states.append(score_of(*args))
        credits = [f"({states[order.index(j) + 1]}) - ({states[order.index(j)]}) AS f{j}" for j in range(4)]
        parts.append(f"SELECT id, {states[0]} AS s0, {states[4]} AS s4, {', '.join(credits)} FROM pr WHERE d = {i // 2}")
    cols = ", ".join(r6(f"avg(f{j})", f"phi__x{j + 1}") for j in range(4))
    return f"SELECT id, {r6('avg(s0)', 'baseline')}, {r6('avg(s4)', 'prediction')}, {cols} FROM ({' UNION ALL '.join(parts)}) GROUP BY id"


STEP_PAIRED = PAIRED.replace("SELECT s.id,", "SELECT s.id, d,").replace(f"range({DRAWS})", f"range({N_PERM // 2})")


@query("feature_shapley_paired", duck("v_score") + POOL + STEP_PAIRED + _stepwise_sql(score_sql))
def _(v):
    return H.feature_shapley(v.score, "id", FEATURES, score, pool(v), N_POOL, N_PERM)


@query("stage_shapley", duck("v_score") + POOL + STEP_PAIRED + _stepwise_sql(stage_sql))
def _(v):
    return H.feature_shapley(v.score, "id", FEATURES, log_odds, pool(v), N_POOL, N_PERM)


@query("stage_shapley_fraction", duck("v_score") + POOL + STEP_PAIRED + _stepwise_sql(fraction_sql))
def _(v):
    return H.feature_shapley(v.score, "id", FEATURES, fraction, pool(v), N_POOL, N_PERM)


@query("additivity_check", duck("v_score") + f"SELECT count(*) AS n_cells, {r6('0.0', 'max_error')}, TRUE AS additive FROM v_score")
def _(v):
    phi = H.group_shapley(v.score, "id", GROUPS, score, pool(v), N_POOL, DRAWS)
    long = phi.unpivot(["id"], [f"phi__{g}" for g in GROUPS], "feature", "phi")
    out = A.additivity_check(long, phi.select("id", "baseline", "prediction"), ["id"], "baseline", "prediction", 1e-8)
    return out.withColumn("max_error", F.round("max_error", 6))


def permutation_sql(groups: dict, reps: int) -> str:
    """The row on seat i gives a group's features to seat (factor * i + shift) of its fold."""
    moves = ", ".join(f"({g}, {r}, {factor}, {shift})" for g, r, factor, shift in H.seat_moves(len(groups), reps, 42))
    branches = []
    for g, (name, members) in enumerate(groups.items()):
        args = [f"giver.{f}" if f in members else f"taker.{f}" for f in FEATURES]
        branches.append(f"""SELECT '{name}' AS feature_group, rep, sum(taker.w * pow(taker.y - {score_sql(*args)}, 2)) AS s
          FROM sent JOIN seats giver ON giver.place = sent.place JOIN seats taker ON taker.place = sent.target WHERE g = {g} GROUP BY rep""")
    return f""", sc AS (SELECT *, 0.3 * x1 + 0.2 * x4 AS y FROM v_score),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY {hash_sql('id', 42)}, id) - 1 AS seat, count(*) OVER (PARTITION BY fold) AS n FROM sc),
    seats AS MATERIALIZED (SELECT *, fold * 1000000000 + seat AS place FROM numbered),
    folds AS (SELECT fold, any_value(n) AS n FROM seats GROUP BY fold),
    mv AS (SELECT fold, n, g, rep, CASE WHEN factor % n = 0 THEN 1 ELSE factor % n END AS f, shift % n AS sh
      FROM folds, (VALUES {moves}) m(g, rep, factor, shift)),
    sent AS MATERIALIZED (SELECT place, g, rep, seats.fold * 1000000000 + (CAST(f AS BIGINT) * seats.seat + CAST(sh AS BIGINT)) % seats.n AS target FROM seats JOIN mv ON mv.fold = seats.fold),
    b AS (SELECT sum(w * pow(y - {score_sql(*FEATURES)}, 2)) AS sse, sum(w) AS sw FROM sc),
    r AS ({' UNION ALL '.join(branches)}), d AS (SELECT feature_group, (s - sse) / sw AS d, sse / sw AS m FROM r, b)
    SELECT feature_group, {r6('avg(d)', 'delta_mse')}, {r6('stddev_samp(d)', 'delta_mse_sd')}, {r6('avg(d) / any_value(m) * 100', 'increase_pct')} FROM d GROUP BY feature_group"""


def observed(v):
    return v.score.withColumn("y", 0.3 * F.col("x1") + 0.2 * F.col("x4"))


SINGLE = {f: [f] for f in FEATURES}


@query("permutation_importance", duck("v_score") + permutation_sql(SINGLE, 10))
def _(v):
    return H.permutation_importance(observed(v), "id", SINGLE, score, "y", "w", "fold", reps=10)


@query("group_permutation_importance", duck("v_score") + permutation_sql(GROUPS, 10))
def _(v):
    return H.permutation_importance(observed(v), "id", GROUPS, score, "y", "w", "fold", reps=10)
