"""Significance tests, associations and score diagnostics over the supplied tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.catalog.roles import ROLES, null_if, r6, rounded, table, with_roles
from creditspark.functions import columns as C
from creditspark.operators import stats
from creditspark.operators.profile import histogram
from creditspark.operators.ranks import roc_auc
from creditspark.plans.modelling import soft_vote, weight_search
from creditspark.sources.schemas import TARGET

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a binary class and two numeric predictors, one with gaps and ties."""
    return table(spark, sf, "orders").select(
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderpriority") != "5-LOW", (F.col("o_custkey") % 50).cast("double")).alias("tied"))


def _results(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df.select("column", *columns), 4)


def mann_whitney(spark, sf):
    found = stats.numeric_tests(_orders(spark, sf), ["price", "tied"], "label")
    return _results(found, "statistic", "p_value", "effect_size", "group0_median", "group1_median", "group0_size", "group1_size")


def moods_median(spark, sf):
    found = stats.numeric_tests(_orders(spark, sf), ["price", "tied"], "label", "moods_median")
    return _results(found, "statistic", "p_value", "effect_size", "group0_median", "group1_median", "group0_size", "group1_size")


def mann_whitney_imputed(spark, sf):
    found = stats.numeric_tests(_orders(spark, sf), ["tied"], "label", missing="median_impute")
    return _results(found, "statistic", "effect_size", "group0_median", "group1_median")


def numeric_significance(spark, sf):
    found = stats.numeric_tests(_orders(spark, sf), ["price", "tied"], "label")
    return stats.interpret_numeric(found).select("column", "test_name", "statistic", "effect_size", "significance",
                                                 "effect_magnitude")


def chi_squared(spark, sf):
    found = stats.chi_squared_tests(ROLES["client"](spark, sf),
                                    ["OCCUPATION_TYPE", "ORGANIZATION_TYPE", "FLAG_OWN_CAR"], TARGET)
    return rounded(found.select("column", "chi2_statistic", F.col("degrees_of_freedom").cast("long")
                                .alias("degrees_of_freedom"), "p_value", "effect_size"))


def chi_squared_imputed(spark, sf):
    found = stats.chi_squared_tests(ROLES["client"](spark, sf), ["OCCUPATION_TYPE"], TARGET, "most_frequent")
    return rounded(found.select("column", "chi2_statistic", "effect_size"))


def categorical_significance(spark, sf):
    found = stats.chi_squared_tests(ROLES["client"](spark, sf), ["OCCUPATION_TYPE", "FLAG_OWN_CAR"], TARGET)
    return stats.interpret_categorical(found).select(
        "column", "test_name", "chi2_statistic", "effect_size", "significance", "effect_magnitude")


def feature_pairs(spark, sf):
    return rounded(stats.correlation_pairs(table(spark, sf, "lineitem"), LINE_NUMBERS))


def _mixed_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount", null_if("l_linenumber", 7).alias("line"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


MIXED = ["l_quantity", "l_extendedprice", "l_discount", "line", "flag", "status"]
MIXED_INTERVAL = ["l_quantity", "l_extendedprice", "l_discount"]
FLAGS = {
    "big": "l_quantity > 25", "dear": "l_extendedprice > 40000", "net": "l_extendedprice * (1 - l_discount) > 40000",
    "first": "l_linenumber <= 2", "open": "l_linestatus = 'O'", "returned": "l_returnflag = 'R'",
}


def phik_contingency(spark, sf):
    return stats.pair_cells(_mixed_lines(spark, sf), MIXED, MIXED_INTERVAL)


def phik_chi2(spark, sf):
    cells = stats.pair_cells(_mixed_lines(spark, sf), MIXED, MIXED_INTERVAL)
    return rounded(stats.chi2_from_cells(cells, ["f1", "f2"], "b1", "b2", False), 4)


def phik_pairs(spark, sf):
    return stats.phik_pairs(_mixed_lines(spark, sf), MIXED, MIXED_INTERVAL)


def phik_flags(spark, sf):
    """phi_k of two-valued columns, where it has a closed form."""
    lines = table(spark, sf, "lineitem").select(*[F.expr(e).cast("int").alias(c) for c, e in FLAGS.items()])
    return rounded(stats.phik_pairs(lines, list(FLAGS)), 4)


def phik_top_target(spark, sf):
    return stats.top_with_target(stats.phik_pairs(_mixed_lines(spark, sf), MIXED, MIXED_INTERVAL), "flag")


def phik_top_pairs(spark, sf):
    return stats.top_interactions(stats.phik_pairs(_mixed_lines(spark, sf), MIXED, MIXED_INTERVAL))


def collinearity(spark, sf):
    """Strongly related columns, with their correlation to the price as importance."""
    lines = table(spark, sf, "lineitem").withColumn("net", F.col("l_extendedprice") * (1 - F.col("l_discount")))
    columns = ["l_extendedprice", "net", "l_quantity", "l_discount", "l_tax"]
    pairs = stats.phik_pairs(lines.select(*columns), columns, columns)
    with_price = stats.correlation_pairs(lines, ["l_extendedprice", *columns[1:]])
    importances = with_price.filter(F.col("feature1") == "l_extendedprice").select(
        F.col("feature2").alias("feature"), F.abs("coefficient").alias("importance"))
    return stats.collinear_pairs(pairs, importances)


def _scored(spark, sf) -> DataFrame:
    """Two scores per order, one of them tied, with the class."""
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") / 500000.0).alias("p1"), ((F.col("o_custkey") % 64) / 64.0).alias("p2"))


def roc_auc_(spark, sf):
    scored = _scored(spark, sf)
    first = roc_auc(scored, "p1", "label").select(F.lit("p1").alias("score"), "auc", "n0", "n1")
    second = roc_auc(scored, "p2", "label").select(F.lit("p2").alias("score"), "auc", "n0", "n1")
    return rounded(first.unionByName(second))


def roc_points(spark, sf):
    return rounded(stats.roc_points(_scored(spark, sf), "p1", "label"), 9)


def pr_points(spark, sf):
    return rounded(stats.pr_points(_scored(spark, sf), "p1", "label"), 9)


def confusion(spark, sf):
    decided = _scored(spark, sf).withColumn("predicted", C.decision("p1"))
    return rounded(stats.confusion(decided, "label", "predicted"))


def cv_stability(spark, sf):
    folds = roc_auc(_scored(spark, sf), "p1", "label", ["o_orderpriority"])
    found = stats.cv_stability(folds)
    return rounded(found.select("n_folds", "mean_score", "std_score", "ci_lower", "ci_upper", "cv", "stability"))


def soft_vote_(spark, sf):
    return rounded(_scored(spark, sf).select("o_orderkey", soft_vote(["p1", "p2"]).alias("p")), 10)


def weighted_vote(spark, sf):
    return rounded(_scored(spark, sf).select("o_orderkey", C.weighted_mean([0.7, 0.2], ["p1", "p2"]).alias("p")), 10)


def weight_search_(spark, sf):
    return rounded(weight_search(_scored(spark, sf), ["p1", "p2"], "label", 10).drop("candidate"))


def risk_tiers(spark, sf):
    return _scored(spark, sf).select("o_orderkey", C.risk_tier("p1").alias("risk_score"))


def score_split(spark, sf):
    """Histogram of a score for each true class."""
    return rounded(histogram(_scored(spark, sf), "p1", "label", 20))


QUERIES = {
    "roc_auc": roc_auc_, "soft_vote": soft_vote_, "weight_search": weight_search_,
    **{f.__name__: f for f in (
        mann_whitney, moods_median, mann_whitney_imputed, numeric_significance, chi_squared, chi_squared_imputed,
        categorical_significance, feature_pairs, phik_contingency, phik_chi2, phik_pairs, phik_flags, phik_top_target,
        phik_top_pairs, collinearity, roc_points, pr_points, confusion, cv_stability, weighted_vote, risk_tiers,
        score_split,
    )},
}


# ---- SQL -----------------------------------------------------------------------------------

ORDERS = """  select cast(o_orderstatus = 'F' as integer) as label, o_totalprice as price,
    case when o_orderpriority <> '5-LOW' then cast(o_custkey % 50 as double) end as tied from orders"""
LONG = """  select 'price' as col, price as v, label from o union all
  select 'tied', tied, label from o where tied is not null"""
IMPUTED = """  select 'tied' as col, coalesce(tied, (select quantile_cont(tied, 0.5) from o)) as v, label from o"""
RANKED = """  select col, v, label, rank() over (partition by col order by v)
    + (count(*) over (partition by col, v) - 1) / 2.0e0 as mid, count(*) over (partition by col, v) as t from x"""
U_TEST = """  select col, count(*) filter (where label = 0) as n0, count(*) filter (where label = 1) as n1,
    sum(mid) filter (where label = 0) - count(*) filter (where label = 0)
      * (count(*) filter (where label = 0) + 1) / 2.0e0 as u, sum(cast(t as double) * t - 1) as ties,
    quantile_cont(v, 0.5) filter (where label = 0) as m0, quantile_cont(v, 0.5) filter (where label = 1) as m1
  from ranked group by col"""
U_COLUMNS = f"""col as "column", {r6('u', 4)} as statistic, {r6('2 * u / (cast(n0 as double) * n1) - 1', 4)} as effect_size,
  {r6('m0', 4)} as group0_median, {r6('m1', 4)} as group1_median"""
Z = """(greatest(u, cast(n0 as double) * n1 - u) - cast(n0 as double) * n1 / 2 - 0.5e0) / sqrt(cast(n0 as double) * n1 / 12
  * ((n0 + n1 + 1) - ties / (cast(n0 + n1 as double) * (n0 + n1 - 1))))"""

MOOD = """pow(abs(a0 - n0 * (a0 + a1) / n) - least(0.5e0, abs(a0 - n0 * (a0 + a1) / n)), 2)
    * n * (1 / n0 + 1 / n1) * (1 / (a0 + a1) + 1 / (n - a0 - a1))"""


def _tail(chi2: str, dof: str) -> str:
    """P(X >= chi2): one minus the series of the lower incomplete gamma function, all of whose terms are positive."""
    term = f"exp(({dof} / 2.0e0 + i) * ln({chi2} / 2) - {chi2} / 2 - lgamma({dof} / 2.0e0 + i + 1))"
    return (f"case when {chi2} <= 0 then 1.0e0 when {chi2} > 2000 then 0.0e0 "
            f"else 1 - list_sum([{term} for i in range(2000)]) end")


CELLS = """  select col, value, TARGET, count(*) as n from (
    select 'OCCUPATION_TYPE' as col, OCCUPATION_TYPE as value, TARGET from client
    union all select 'ORGANIZATION_TYPE', ORGANIZATION_TYPE, TARGET from client
    union all select 'FLAG_OWN_CAR', FLAG_OWN_CAR, TARGET from client) where value is not null group by 1, 2, 3"""
IMPUTED_CELLS = """  select 'OCCUPATION_TYPE' as col, coalesce(OCCUPATION_TYPE, (select OCCUPATION_TYPE from client
    where OCCUPATION_TYPE is not null group by 1 order by count(*) desc, 1 limit 1)) as value, TARGET, count(*) as n
  from client group by 2, 3"""
CHI2 = """  select col, count(distinct value) as r, count(distinct TARGET) as k, cast(max(total) as double) as n,
    sum(case when rs = 2 and ks = 2 then pow(abs(o - e) - least(0.5e0, abs(o - e)), 2) else pow(o - e, 2) end / e) as chi2
  from (select g.col, g.value, g.TARGET, coalesce(cells.n, 0) as o, ra.n * cb.n / cast(s.n as double) as e, s.n as total,
      s.rs, s.ks
    from (select distinct c.col, c.value, t.TARGET from cells c join (select distinct col, TARGET from cells) t
      on c.col = t.col) g
    left join cells on cells.col = g.col and cells.value = g.value and cells.TARGET = g.TARGET
    join (select col, value, sum(n) as n from cells group by 1, 2) ra on ra.col = g.col and ra.value = g.value
    join (select col, TARGET, sum(n) as n from cells group by 1, 2) cb on cb.col = g.col and cb.TARGET = g.TARGET
    join (select col, sum(n) as n, count(distinct value) as rs, count(distinct TARGET) as ks from cells group by 1) s
      on s.col = g.col) group by col"""
V = "sqrt(chi2 / (n * (least(r, k) - 1)))"


def _bin(c: str) -> str:
    return (f"cast(cast(least(floor(({c} - (select min({c}) from lineitem)) / ((select max({c}) from lineitem) "
            f"- (select min({c}) from lineitem)) * 10), 9) as integer) as varchar) as {c}")


BINNED = f"""  select {", ".join(_bin(c) for c in MIXED_INTERVAL)}, cast(nullif(l_linenumber, 7) as varchar) as line,
    l_returnflag as flag, l_linestatus as status from lineitem"""
PAIRS = [(a, b) for i, a in enumerate(sorted(MIXED)) for b in sorted(MIXED)[i + 1:]]
PAIR_CELLS = "\n  union all ".join(
    f"select '{a}' as f1, {a} as b1, '{b}' as f2, {b} as b2, count(*) as n from binned "
    f"where {a} is not null and {b} is not null group by {a}, {b}" for a, b in PAIRS)
CORRELATIONS = [(a, b) for i, a in enumerate(sorted(LINE_NUMBERS)) for b in sorted(LINE_NUMBERS)[i + 1:]]

SCORED = """  select o_orderkey, o_orderpriority, cast(o_orderstatus = 'F' as integer) as label,
    o_totalprice / 500000.0e0 as p1, (o_custkey % 64) / 64.0e0 as p2 from orders"""


def _auc(source: str, keys: str) -> str:
    part = f"partition by {keys} " if keys else ""
    group = f"group by {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    n1 = "count(*) filter (where label = 1)"
    return f"""  select {lead}(sum(mid) filter (where label = 1) - {n1} * ({n1} + 1) / 2.0e0)
      / (cast({n1} as double) * count(*) filter (where label = 0)) as auc,
    count(*) filter (where label = 0) as n0, {n1} as n1
  from (select *, rank() over ({part}order by s) + (count(*) over (partition by {keys + ', ' if keys else ''}s) - 1) / 2.0e0
    as mid from {source}) {group}"""


POINTS = """  select p1 as threshold, sum(count(*) filter (where label = 1)) over (order by p1 desc) as tp,
    sum(count(*) filter (where label = 0)) over (order by p1 desc) as fp,
    (select count(*) from scored where label = 1) as all1, (select count(*) from scored where label = 0) as all0
  from scored group by p1"""
T_975_4 = "2.7764451051977987e0"

SQL = {
    "mann_whitney": with_roles("", f"""select {U_COLUMNS}, n0 as group0_size, n1 as group1_size,
  {r6(_tail('z2', '1'), 4)} as p_value from (select *, pow(greatest({Z}, 0), 2) as z2 from u)""",
                               o=ORDERS, x=LONG, ranked=RANKED, u=U_TEST),
    "mann_whitney_imputed": with_roles("", f"select {U_COLUMNS} from u", o=ORDERS, x=IMPUTED, ranked=RANKED, u=U_TEST),
    "numeric_significance": with_roles("", f"""select col as "column", 'Mann-Whitney U test' as test_name,
  round_even(u, 2) as statistic, round_even(2 * u / (cast(n0 as double) * n1) - 1, 4) as effect_size,
  case when {Z} > 1.959963984540054e0 then 'Statistically significant' else 'Not statistically significant' end as significance,
  case when abs(2 * u / (cast(n0 as double) * n1) - 1) < 0.2 then 'negligible'
    when abs(2 * u / (cast(n0 as double) * n1) - 1) < 0.5 then 'small'
    when abs(2 * u / (cast(n0 as double) * n1) - 1) < 0.8 then 'medium' else 'large' end as effect_magnitude
from u""", o=ORDERS, x=LONG, ranked=RANKED, u=U_TEST),
    "moods_median": with_roles("", f"""select col as "column", {r6(MOOD, 4)} as statistic,
  {r6(_tail(f"({MOOD})", '1'), 4)} as p_value, {r6('(mean0 - mean1) / sqrt((s0 * s0 + s1 * s1) / 2)', 4)} as effect_size,
  {r6('m0', 4)} as group0_median, {r6('m1', 4)} as group1_median, cast(n0 as bigint) as group0_size,
  cast(n1 as bigint) as group1_size
from (select x.col, cast(count(*) as double) as n, cast(count(*) filter (where label = 0) as double) as n0,
    cast(count(*) filter (where label = 1) as double) as n1,
    cast(count(*) filter (where label = 0 and v > g.m) as double) as a0,
    cast(count(*) filter (where label = 1 and v > g.m) as double) as a1,
    avg(v) filter (where label = 0) as mean0, avg(v) filter (where label = 1) as mean1,
    stddev_samp(v) filter (where label = 0) as s0, stddev_samp(v) filter (where label = 1) as s1,
    quantile_cont(v, 0.5) filter (where label = 0) as m0, quantile_cont(v, 0.5) filter (where label = 1) as m1
  from x join (select col, quantile_cont(v, 0.5) as m from x group by col) g on x.col = g.col group by x.col)""",
                               o=ORDERS, x=LONG),
    "chi_squared": with_roles("client", f"""select col as "column", {r6('chi2')} as chi2_statistic,
  (r - 1) * (k - 1) as degrees_of_freedom, {r6(_tail('chi2', '((r - 1) * (k - 1))'))} as p_value,
  {r6(V)} as effect_size from c""", cells=CELLS, c=CHI2),
    "chi_squared_imputed": with_roles("client", f"""select col as "column", {r6('chi2')} as chi2_statistic,
  {r6(V)} as effect_size from c""", cells=IMPUTED_CELLS, c=CHI2),
    # fixed values: 5 % points of chi-squared with 1 and 3 degrees of freedom
    "categorical_significance": with_roles("client", f"""select col as "column", 'Chi-squared test' as test_name,
  round_even(chi2, 2) as chi2_statistic, round_even({V}, 4) as effect_size,
  case when chi2 > case when r = 2 then 3.841458820694124e0 else 7.814727903251179e0 end
    then 'Statistically significant' else 'Not statistically significant' end as significance,
  case when {V} < 0.1 then 'negligible' when {V} < 0.3 then 'small' when {V} < 0.5 then 'medium' else 'large' end
    as effect_magnitude from c where col <> 'ORGANIZATION_TYPE'""", cells=CELLS, c=CHI2),
    "feature_pairs": "\nunion all\n".join(
        f"select '{a}' as feature1, '{b}' as feature2, {r6(f'corr({a}, {b})')} as coefficient from lineitem"
        for a, b in CORRELATIONS),
    "phik_contingency": with_roles("", f"select f1, b1, f2, b2, n from (\n{PAIR_CELLS})", binned=BINNED),
    "phik_chi2": with_roles("", f"""select f1, f2, {r6('(sum(n * n / (cast(ra as double) * cb)) - 1) * max(total)', 4)} as chi2,
  (count(distinct b1) - 1) * (count(distinct b2) - 1) as dof, cast(max(total) as double) as n,
  count(distinct b1) as r, count(distinct b2) as k
from (select *, sum(n) over (partition by f1, f2, b1) as ra, sum(n) over (partition by f1, f2, b2) as cb,
  sum(n) over (partition by f1, f2) as total from cells) group by f1, f2""", binned=BINNED, cells=PAIR_CELLS),
    "phik_flags": with_roles("", f"""select f1 as feature1, f2 as feature2,
  round(sin(pi() / 2 * sqrt(greatest(chi2 - 1, 0) / (n - 1))), 4) as coefficient from t""", flags="select "
                             + ", ".join(f"cast({e} as integer) as \"{c}\"" for c, e in FLAGS.items()) + " from lineitem",
                             t="\nunion all\n".join(f"""select '{a}' as f1, '{b}' as f2, regr_count("{a}", "{b}") as n,
  regr_count("{a}", "{b}") * pow(corr("{a}", "{b}"), 2) as chi2 from flags""" for a, b in combinations(sorted(FLAGS), 2))),
    "roc_auc": with_roles("", f"""select 'p1' as score, {r6('auc')} as auc, n0, n1 from a1
union all select 'p2', {r6('auc')}, n0, n1 from a2""", scored=SCORED,
                          s1="select p1 as s, label from scored", a1=_auc("s1", ""),
                          s2="select p2 as s, label from scored", a2=_auc("s2", "")),
    "roc_points": with_roles("", f"""select {r6('threshold', 9)} as threshold, {r6('fp / cast(all0 as double)', 9)} as fpr,
  {r6('tp / cast(all1 as double)', 9)} as tpr from points union all select null, 0.0e0, 0.0e0""",
                             scored=SCORED, points=POINTS),
    "pr_points": with_roles("", f"""select {r6('threshold', 9)} as threshold, {r6('tp / cast(tp + fp as double)', 9)} as precision,
  {r6('tp / cast(all1 as double)', 9)} as recall from points union all select null, 1.0e0, 0.0e0""",
                            scored=SCORED, points=POINTS),
    "confusion": with_roles("", f"""select y.y as label, p.p as predicted, count(label) as n,
  {r6('count(label) / cast((select count(*) from scored) as double)')} as share
from (values (0), (1)) y(y) cross join (values (0), (1)) p(p)
left join scored on label = y.y and cast(p1 > 0.5 as integer) = p.p group by 1, 2""", scored=SCORED),
    "cv_stability": with_roles("", f"""select count(*) as n_folds, {r6('avg(auc)')} as mean_score,
  {r6('stddev_pop(auc)')} as std_score, {r6(f'avg(auc) - {T_975_4} * stddev_samp(auc) / sqrt(count(*))')} as ci_lower,
  {r6(f'avg(auc) + {T_975_4} * stddev_samp(auc) / sqrt(count(*))')} as ci_upper,
  {r6('stddev_pop(auc) / avg(auc)')} as cv, case when stddev_pop(auc) / avg(auc) < 0.05 then 'very stable'
    when stddev_pop(auc) / avg(auc) < 0.1 then 'reasonably stable' else 'significant variation' end as stability
from a""", scored=SCORED, s="select o_orderpriority, p1 as s, label from scored", a=_auc("s", "o_orderpriority")),
    "soft_vote": with_roles("", f"select o_orderkey, {r6('(p1 + p2) / 2', 10)} as p from scored", scored=SCORED),
    "weighted_vote": with_roles("", f"select o_orderkey, {r6('(0.7e0 * p1 + 0.2e0 * p2) / 0.9e0', 10)} as p from scored",
                                scored=SCORED),
    "weight_search": with_roles("", f"select {r6('auc')} as auc, {r6('w')} as w_p1, {r6('1 - w')} as w_p2 from a",
                                scored=SCORED, g="select unnest(range(11)) / 10.0e0 as w",
                                s="select w, (w * p1 + (1 - w) * p2) as s, label from scored, g", a=_auc("s", "w")),
    "risk_tiers": with_roles("", """select o_orderkey, case when p1 > 0.7 then 'high' when p1 > 0.3 then 'moderate'
  else 'low' end as risk_score from scored""", scored=SCORED),
    "score_split": with_roles("", f"""select cast(least(floor((p1 - lo) / w), 19) as integer) as bin,
  label, {r6('max(lo) + cast(least(floor((p1 - lo) / w), 19) as integer) * max(w)')}
  as bin_start, count(*) as n from scored, e group by bin, label, lo, w""", scored=SCORED,
                              e="select min(p1) as lo, (max(p1) - min(p1)) / 20 as w from scored"),
}
