"""Data-quality, distribution and preparation reports over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.catalog.roles import ROLES, null_if, r6, rounded, table, with_roles
from creditspark.functions import columns as C
from creditspark.operators import align, profile
from creditspark.operators.encode import EncodingModel, dummies, fit_levels, indicator_columns
from creditspark.operators.joins import keep_listed
from creditspark.operators.ranks import holdout_flag, stratified_folds
from creditspark.operators.scale import ScaleModel
from creditspark.session import shared_dir
from creditspark.sources import files
from creditspark.sources.schemas import KEY, TARGET

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_TEXT = ["p_name", "p_brand", "p_type"]


def _gappy_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with missing values put in."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        null_if("c_nationkey", 3).alias("nation"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        null_if("c_mktsegment", "MACHINERY").alias("segment"))


def _gappy_supplier(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") < 10, F.col("s_nationkey")).alias("nation"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance"))


def duplicates(spark, sf):
    return profile.duplicate_census(table(spark, sf, "lineitem"))


def duplicate_rows_top10(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


def missing_report(spark, sf):
    return rounded(profile.missing_report(_gappy_customer(spark, sf), _gappy_supplier(spark, sf), True))


def missing_tiers(spark, sf):
    report = profile.missing_report(_gappy_customer(spark, sf), _gappy_supplier(spark, sf))
    return profile.missing_tier_census(report)


def missing_importances(spark, sf):
    """Gappy customer columns with the size of their correlation to the client number as importance."""
    customers = _gappy_customer(spark, sf)
    measured = customers.agg(*[F.abs(F.corr("id", F.col(c).cast("double"))).alias(c) for c in ("nation", "balance")])
    importances = align.to_long(measured, ["nation", "balance"], name="feature", value="importance")
    report = profile.missing_report(customers, _gappy_supplier(spark, sf))
    return rounded(profile.missing_importances(report, importances))


def describe_numeric(spark, sf):
    return rounded(profile.describe_numeric(table(spark, sf, "lineitem"), LINE_NUMBERS), 4)


def describe_categorical(spark, sf):
    return profile.describe_categorical(table(spark, sf, "part"), PART_TEXT)


def distinct_listing(spark, sf):
    part = table(spark, sf, "part").withColumn("p_type", null_if("p_type", "SMALL"))
    return profile.distinct_listing(part, PART_TEXT)


def cardinality_split(spark, sf):
    part = table(spark, sf, "part").withColumn("p_type", null_if("p_type", "SMALL"))
    return profile.cardinality_split(part, PART_TEXT)


def value_counts_pct(spark, sf):
    orders = table(spark, sf, "orders").select(null_if("o_orderpriority", "5-LOW").alias("priority"))
    return rounded(profile.value_counts_percent(orders, "priority"))


def proportions(spark, sf):
    orders = table(spark, sf, "orders").select(
        null_if("o_orderpriority", "5-LOW").alias("priority"), F.col("o_orderstatus").alias("status"))
    return rounded(profile.proportions(orders, "priority", "status", ["F", "O", "P"]))


def crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def unpivot_stats(spark, sf):
    """Sums of every numeric column per return flag, wide to long."""
    wide = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        *[F.avg(c).alias(c) for c in LINE_NUMBERS])
    return rounded(align.to_long(wide, LINE_NUMBERS, ["l_returnflag"], name="variable"))


def class_weights(spark, sf):
    return rounded(profile.class_weights(ROLES["client"](spark, sf), TARGET))


def skewed_features(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("l_squared", F.col("l_extendedprice") * F.col("l_extendedprice"))
    return rounded(profile.skewness_report(lines, [*LINE_NUMBERS, "l_squared"]))


def _variants(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Three statistics of the part prices per type, as variants of one measure each, and their importances."""
    by_type = table(spark, sf, "part").groupBy("p_type").agg(
        F.avg("p_retailprice").alias("AVG"), F.max("p_retailprice").alias("MEDI"),
        (F.min("p_retailprice") + F.avg("p_size") * 20).alias("MODE"))
    long = align.to_long(by_type, ["AVG", "MEDI", "MODE"], ["p_type"], name="variant", value="importance")
    position = F.when(F.col("variant") == "AVG", 1).when(F.col("variant") == "MEDI", 2).otherwise(3)
    named = long.select(F.concat_ws("_", "p_type", "variant").alias("feature"), "importance",
                        position.alias("position"))
    # the first type's statistics stay unknown, so they count 0 and the first listed is kept
    known = named.filter(~F.col("feature").startswith("ECONOMY"))
    return named.select("feature", "position"), known.select("feature", "importance")


def best_variant(spark, sf):
    return rounded(profile.variants_to_remove(*_variants(spark, sf)))


def stratified_folds_(spark, sf):
    rows = ROLES["client"](spark, sf).select(KEY, TARGET)
    return stratified_folds(rows, KEY, TARGET, 5, 3)


def holdout_split(spark, sf):
    return ROLES["client"](spark, sf).select(KEY, holdout_flag(KEY).alias("in_train"))


def _nation_means(spark, sf) -> DataFrame:
    customers = table(spark, sf, "customer")
    means = customers.groupBy("c_nationkey").agg((F.avg("c_acctbal") - 4500.0).alias("score"))
    names = table(spark, sf, "nation")
    return means.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("feature"), "score")


def topk_abs(spark, sf):
    return rounded(profile.ranked(_nation_means(spark, sf), "score", "feature", 10, absolute=True))


def top_fraction(spark, sf):
    return rounded(profile.top_fraction(_nation_means(spark, sf), "score", "feature"))


def semi_filter(spark, sf):
    """Customers that have an urgent order."""
    urgent = table(spark, sf, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(
        F.col("o_custkey").alias("c_custkey"))
    return keep_listed(table(spark, sf, "customer"), urgent, "c_custkey").select("c_custkey", "c_mktsegment")


def schema_align(spark, sf):
    """Customers and suppliers reduced to common columns, then to a list with an unknown column."""
    left, right = align.keep_common(_gappy_customer(spark, sf), _gappy_supplier(spark, sf))
    stacked = align.append_rows(align.prune(left, ["name"]), align.prune(right, ["name"]))
    return rounded(align.align_to(stacked, ["balance", "id", "unseen"]))


def append_results(spark, sf):
    """Result rows with different columns stacked by name."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    first = orders.agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price")).select(
        F.lit("orders").alias("source"), "n", "mean_price")
    second = lines.agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean_quantity")).select(
        F.lit("lineitem").alias("source"), "n", "mean_quantity")
    return rounded(align.append_rows(first, second), 4)


def fill_mean_median_mode(spark, sf):
    rows = _gappy_customer(spark, sf).withColumn("nation", F.col("nation").cast("double"))
    values = {**profile.column_means(rows, ["balance"]), **profile.column_medians(rows, ["nation"]),
              **profile.column_modes(rows, ["segment"])}
    return rounded(profile.fill(rows, values).select("id", "balance", "nation", "segment"))


def drop_missing(spark, sf):
    return rounded(_gappy_customer(spark, sf).dropna(subset=["balance", "segment"]).select("id", "balance", "segment"))


def format_and_clean(spark, sf):
    part = table(spark, sf, "part")
    return part.select(
        "p_partkey", C.number_text("p_retailprice").alias("price_text"), C.clean_value("p_brand").alias("brand"),
        C.title_text("p_name").alias("title"),
        C.variant_base(F.concat("p_type", F.lit("_AVG"))).alias("base"),
        F.col("p_brand").startswith("Brand#1").cast("int").alias("has_prefix"))


def _signed(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_quantity") - 10.0).alias("x"))


def box_cox(spark, sf):
    return rounded(_signed(spark, sf).select(
        "l_orderkey", C.box_cox("x").alias("moved"), C.box_cox("x", 0).alias("moved_log"),
        F.log1p(F.abs("x")).alias("log1p")))


def box_cox_inverse(spark, sf):
    return rounded(_signed(spark, sf).select(
        "l_orderkey", C.box_cox_inverse(C.box_cox("x")).alias("back"),
        C.box_cox_inverse(F.col("x") / 10).alias("inverse"),
        C.box_cox_inverse(F.col("x") / 10, 0).alias("inverse_log")))


def one_hot(spark, sf):
    client = ROLES["client"](spark, sf)
    levels = fit_levels(client, ["OCCUPATION_TYPE", "FLAG_OWN_CAR"])
    return client.select(KEY, *indicator_columns(levels))


def dummies_drop_first(spark, sf):
    client = ROLES["client"](spark, sf).select(KEY, "OCCUPATION_TYPE", "FLAG_OWN_CAR", "AMT_CREDIT")
    return rounded(dummies(client, fit_levels(client, ["OCCUPATION_TYPE", "FLAG_OWN_CAR"]), keep=[KEY]))


def m_estimate(spark, sf):
    client = ROLES["client"](spark, sf).select(KEY, TARGET, "ORGANIZATION_TYPE", "OCCUPATION_TYPE")
    encoded = EncodingModel.fit(client, TARGET, keep=[KEY, TARGET]).transform(client)
    return rounded(encoded)


def standard_scale(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", *LINE_NUMBERS)
    return rounded(ScaleModel.fit(lines, keep=["l_orderkey"], threshold=None).transform(lines), 5)


def skew_scale(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_tax", (F.col("l_extendedprice") * F.col("l_extendedprice") / 1000000).alias("l_squared"))
    return rounded(ScaleModel.fit(lines, keep=["l_orderkey"]).transform(lines), 5)


def box_stats(spark, sf):
    return rounded(profile.box_stats(table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 4)


def histogram(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "orders"), "o_totalprice", "o_orderstatus", 20), 4)


def histogram_log(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "orders"), F.log1p("o_totalprice"), None, 20), 4)


def density(spark, sf):
    """Kernel density of prices in thousands per order status."""
    orders = table(spark, sf, "orders").select("o_orderstatus", (F.col("o_totalprice") / 1000).alias("price"))
    return rounded(profile.density(orders, "price", "o_orderstatus"))


def csv_round_trip(spark, sf):
    """Clients written as CSV to the shared folder and scanned back with their declared schema."""
    import uuid

    client = ROLES["client"](spark, sf)
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    client.write.csv(path, header=True)
    return rounded(files.read_csv(spark, path, client.schema).select(
        KEY, "AMT_ANNUITY", "OCCUPATION_TYPE", "DEF_30_CNT_SOCIAL_CIRCLE"))


def table_shapes(spark, sf):
    """Rows, columns and columns per type of the lending tables."""
    shapes = []
    for name in ("client", "bureau", "credit_card_balance", "pos_cash_balance"):
        df = ROLES[name](spark, sf)
        kinds = [k for _, k in df.dtypes]
        shapes.append(df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(kinds)).alias("n_columns"),
            *[F.lit(kinds.count(k)).alias(f"n_{k}") for k in ("bigint", "double", "string")]))
    return reduce(DataFrame.unionByName, shapes)


QUERIES = {
    "stratified_folds": stratified_folds_,
    **{f.__name__: f for f in (
        duplicates, duplicate_rows_top10, missing_report, missing_tiers, missing_importances, describe_numeric, describe_categorical,
        distinct_listing, cardinality_split, value_counts_pct, proportions, crosstab, unpivot_stats, class_weights,
        skewed_features, best_variant, holdout_split, topk_abs, top_fraction, semi_filter, schema_align,
        append_results, fill_mean_median_mode, drop_missing, format_and_clean, box_cox, box_cox_inverse, one_hot,
        dummies_drop_first, m_estimate, standard_scale, skew_scale, box_stats, histogram, histogram_log, density,
        csv_round_trip, table_shapes,
    )},
}


# ---- SQL -----------------------------------------------------------------------------------

CUSTOMER_GAPS = """  select c_custkey as id, c_name as name, nullif(c_nationkey, 3) as nation,
    case when c_acctbal >= 0 then c_acctbal end as balance, nullif(c_mktsegment, 'MACHINERY') as segment from customer"""
SUPPLIER_GAPS = """  select s_suppkey as id, s_name as name, case when s_nationkey < 10 then s_nationkey end as nation,
    case when s_acctbal >= 0 then s_acctbal end as balance from supplier"""


def _missing_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select '{c}' as col, count(*) - count({c}) as missing, "
        f"round_even((count(*) - count({c})) * 100.0e0 / count(*), 1) as pct from {source}" for c in columns)


MISSING = dict(
    train=CUSTOMER_GAPS, test=SUPPLIER_GAPS,
    a=_missing_sql("train", ["id", "name", "nation", "balance", "segment"]),
    b=_missing_sql("test", ["id", "name", "nation", "balance"]))
NATIONS = """  select n_name as feature, avg(c_acctbal) - 4500.0e0 as score
  from customer join nation on c_nationkey = n_nationkey group by n_name"""
CENSUS = """select count(*) as n from lineitem group by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"""
PART_LONG = " union all ".join(f"select '{c}' as col, {c} as value from part" for c in PART_TEXT)
PART_LONG_GAPS = PART_LONG.replace("p_type as value", "nullif(p_type, 'SMALL') as value")


def _describe_sql(c: str) -> str:
    return f"""select '{c}' as "column", count({c}) as "count", {r6(f'avg({c})', 4)} as mean,
  {r6(f'stddev_samp({c})', 4)} as std, {r6(f'min({c})', 4)} as min, {r6(f'quantile_cont({c}, 0.25)', 4)} as q25,
  {r6(f'quantile_cont({c}, 0.5)', 4)} as q50, {r6(f'quantile_cont({c}, 0.75)', 4)} as q75,
  {r6(f'max({c})', 4)} as max from lineitem"""


def _fold_sql(seed: int, name: str) -> str:
    return (f"cast((row_number() over (partition by TARGET order by md5(SK_ID_CURR || '-{seed}'), SK_ID_CURR) - 1) "
            f"% 5 as integer) as {name}")


def _bc(x: str) -> str:
    return f"case when {x} > 0 then (pow(1 + {x}, 0.15e0) - 1) / 0.15e0 else {x} end"


def _skew_sql(c: str, source: str) -> str:
    value = f"skewness({c})"
    return (f"select '{c}' as \"column\", {r6(value)} as skewness, cast(abs({value}) > 0.5 as integer) as skewed "
            f"from {source}")


def _scaled_sql(c: str, alias: str, digits: int = 5) -> str:
    return f"{r6(f'({c} - avg({c}) over ()) / stddev_pop({c}) over ()', digits)} as {alias}"


def _histogram_sql(value: str, group: str | None) -> str:
    g = f", {group}" if group else ""
    return f"""with x as (select {value} as v{g} from orders), e as (select min(v) as lo, (max(v) - min(v)) / 20 as w from x)
select cast(least(floor((v - lo) / w), 19) as integer) as bin{g},
  {r6('max(lo) + cast(least(floor((v - lo) / w), 19) as integer) * max(w)', 4)} as bin_start, count(*) as n
from x, e group by bin{g}, lo, w"""


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

SQL = {
    "duplicates": f"""select cast(sum(n) as bigint) as total_rows, cast(sum(n - 1) as bigint) as duplicate_rows,
  cast(coalesce(sum(n) filter (where n > 1), 0) as bigint) as duplicate_members from ({CENSUS})""",
    "duplicate_rows_top10": """select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber,
  count(*) over (partition by l_orderkey, l_linenumber) as n from lineitem) where n > 1
order by l_orderkey, l_linenumber limit 10""",
    "missing_report": with_roles("", """select a.col as "column", t.kind as data_type, a.missing as train_count,
  a.pct + 0.0 as train_percent, b.missing as test_count, b.pct + 0.0 as test_percent
from a left join b on a.col = b.col join (values ('id', 'bigint'), ('name', 'string'), ('nation', 'int'),
  ('balance', 'double'), ('segment', 'string')) t(name, kind) on t.name = a.col
where a.missing > 0 or b.missing > 0""", **MISSING),
    "missing_tiers": with_roles("", """select category, count(*) as n_columns from (
  select case when greatest(coalesce(a.pct, 0), coalesce(b.pct, 0)) > 50 then 'High'
    when greatest(coalesce(a.pct, 0), coalesce(b.pct, 0)) > 10 then 'Medium' else 'Low' end as category
  from a left join b on a.col = b.col) group by category""", **MISSING),
    "missing_importances": with_roles("", f"""select a.col as "column", a.pct + 0.0 as train_percent,
  b.pct + 0.0 as test_percent, case when greatest(a.pct, b.pct) > 50 then 'High'
    when greatest(a.pct, b.pct) > 10 then 'Medium' else 'Low' end as category, {r6('i.importance')} as importance
from a join b on a.col = b.col join (select 'nation' as col, abs(corr(id, nation)) as importance from train
  union all select 'balance', abs(corr(id, balance)) from train) i on i.col = a.col""", **MISSING),
    "describe_numeric": "\nunion all\n".join(_describe_sql(c) for c in LINE_NUMBERS),
    "describe_categorical": f"""select col as "column", cast(sum(n) as bigint) as "count", count(*) as n_unique,
  arg_max(value, (n, rnk)) as top, max(n) as freq
from (select col, value, count(*) as n, -row_number() over (partition by col order by value) as rnk
  from ({PART_LONG}) group by col, value) group by col""",
    "distinct_listing": f"""select col as "column", count(*) over (partition by col) as unique_values_count, value
from (select distinct col, value from ({PART_LONG_GAPS}))""",
    "cardinality_split": f"""select col as "column", count(distinct value) as n_unique,
  case when count(distinct value) > 10 then 'high' else 'low' end as cardinality
from ({PART_LONG_GAPS}) group by col""",
    "value_counts_pct": """select priority, n as value_count, round_even(n * 100.0e0 / sum(n) over (), 2) + 0.0
  as percent_of_total from (select nullif(o_orderpriority, '5-LOW') as priority, count(*) as n from orders
  where nullif(o_orderpriority, '5-LOW') is not null group by 1)""",
    "proportions": f"""with o as (select o_orderpriority as priority, o_orderstatus as status from orders
  where o_orderpriority <> '5-LOW'), n as (select priority, status, count(*) as n from o group by 1, 2)
select p.priority, s.status, {r6('n.n / cast(a.n as double)')} as proportion
from (select distinct priority from o) p cross join (select distinct status from o) s
left join n on n.priority = p.priority and n.status = s.status
join (select priority, count(*) as n from o group by 1) a on a.priority = p.priority""",
    "crosstab": """select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as F,
  count(*) filter (where o_orderstatus = 'O') as O, count(*) filter (where o_orderstatus = 'P') as P
from orders group by o_orderpriority""",
    "unpivot_stats": "\nunion all\n".join(
        f"select l_returnflag, '{c}' as variable, {r6(f'avg({c})')} as value from lineitem group by l_returnflag"
        for c in LINE_NUMBERS),
    "class_weights": with_roles("client", f"""select TARGET, n, {r6('sum(n) over () / (count(*) over () * cast(n as double))')}
  as weight, {r6('max(n) over () / cast(min(n) over () as double)')} as weight_ratio
from (select TARGET, count(*) as n from client group by TARGET)"""),
    "skewed_features": "\nunion all\n".join(
        _skew_sql(c, "(select *, l_extendedprice * l_extendedprice as l_squared from lineitem)")
        for c in [*LINE_NUMBERS, "l_squared"]),
    "best_variant": f"""with t as (select p_type, avg(p_retailprice) as a, max(p_retailprice) as b,
  min(p_retailprice) + avg(p_size) * 20 as c from part group by p_type),
v as (select p_type || '_AVG' as feature, p_type as base, a as s, 1 as position from t
  union all select p_type || '_MEDI', p_type, b, 2 from t union all select p_type || '_MODE', p_type, c, 3 from t),
w as (select feature, base, position, case when base = 'ECONOMY' then 0.0e0 else s end as importance from v)
select feature, base, {r6('importance')} as importance from (select *, row_number() over (
  partition by base order by importance desc, position) as rn from w) where rn > 1""",
    "stratified_folds": with_roles("client", f"""select SK_ID_CURR, TARGET, {_fold_sql(98, 'fold_0')},
  {_fold_sql(99, 'fold_1')}, {_fold_sql(100, 'fold_2')} from client"""),
    "holdout_split": with_roles("client", """select SK_ID_CURR,
  cast(cast('0x' || substr(md5(SK_ID_CURR || '-98'), 1, 8) as bigint) % 100 < 80 as integer) as in_train from client"""),
    "topk_abs": f"select feature, {r6('score')} as score from ({NATIONS}) order by abs(score) desc, feature limit 10",
    "top_fraction": f"""with t as ({NATIONS}) select feature, {r6('score')} as score from (
  select *, row_number() over (order by score desc, feature) as rn from t)
where rn <= floor((select count(*) from t) * 0.90)""",
    "semi_filter": """select c_custkey, c_mktsegment from customer where c_custkey in (
  select o_custkey from orders where o_orderpriority = '1-URGENT')""",
    "schema_align": with_roles("", f"""select {r6('balance')} as balance, id, cast(null as double) as unseen
from (select id, balance from a union all select id, balance from b)""", a=CUSTOMER_GAPS, b=SUPPLIER_GAPS),
    "append_results": f"""select 'orders' as source, count(*) as n, {r6('avg(o_totalprice)', 4)} as mean_price,
  cast(null as double) as mean_quantity from orders
union all select 'lineitem', count(*), null, {r6('avg(l_quantity)', 4)} from lineitem""",
    "fill_mean_median_mode": with_roles("", f"""select id,
  {r6('coalesce(balance, (select avg(balance) from t))')} as balance,
  {r6('coalesce(nation, (select quantile_cont(cast(nation as double), 0.5) from t))')} as nation,
  coalesce(segment, (select segment from t where segment is not null group by segment
    order by count(*) desc, segment limit 1)) as segment from t""", t=CUSTOMER_GAPS),
    "drop_missing": with_roles("", f"""select id, {r6('balance')} as balance, segment from t
where balance is not null and segment is not null""", t=CUSTOMER_GAPS),
    "format_and_clean": r"""select p_partkey, case when p_retailprice = floor(p_retailprice)
  then printf('%.0f', p_retailprice) else printf('%.2f', p_retailprice) end as price_text,
  regexp_replace(p_brand, '[^\w]+', '_', 'g') as brand,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') as title,
  p_type as base, cast(starts_with(p_brand, 'Brand#1') as integer) as has_prefix from part""",
    "box_cox": f"""with t as (select l_orderkey, l_quantity - 10.0e0 as x from lineitem)
select l_orderkey, {r6(_bc('x'))} as moved, {r6('case when x > 0 then ln(1 + x) else x end')} as moved_log,
  {r6('ln(1 + abs(x))')} as log1p from t""",
    "box_cox_inverse": f"""with t as (select l_orderkey, l_quantity - 10.0e0 as x from lineitem)
select l_orderkey, {r6('x')} as back,
  {r6('case when x > 0 then pow(x / 10 * 0.15e0 + 1, 1 / 0.15e0) - 1 else x / 10 end')} as inverse,
  {r6('case when x > 0 then exp(x / 10) - 1 else x / 10 end')} as inverse_log from t""",
    "one_hot": with_roles("client", "select SK_ID_CURR, " + ", ".join(
        f"cast(coalesce(OCCUPATION_TYPE = '{s}', false) as bigint) as OCCUPATION_TYPE_{s}"
        for s in SEGMENTS if s != "MACHINERY") + """,
  cast(FLAG_OWN_CAR = 'N' as bigint) as FLAG_OWN_CAR_N, cast(FLAG_OWN_CAR = 'Y' as bigint) as FLAG_OWN_CAR_Y
from client"""),
    "dummies_drop_first": with_roles("client", f"select SK_ID_CURR, {r6('AMT_CREDIT')} as AMT_CREDIT, " + ", ".join(
        f"cast(coalesce(OCCUPATION_TYPE = '{s}', false) as bigint) as OCCUPATION_TYPE_{s}"
        for s in SEGMENTS if s not in ("MACHINERY", "AUTOMOBILE")) + """,
  cast(FLAG_OWN_CAR = 'Y' as bigint) as FLAG_OWN_CAR_Y from client"""),
    "m_estimate": with_roles("client", f"""select SK_ID_CURR, TARGET, {r6('''(sum(TARGET) over (partition by ORGANIZATION_TYPE)
    + avg(TARGET) over ()) / (count(*) over (partition by ORGANIZATION_TYPE) + 1)''')} as ORGANIZATION_TYPE, """
        + ", ".join(f"cast(coalesce(OCCUPATION_TYPE = '{s}', false) as bigint) as OCCUPATION_TYPE_{s}"
                    for s in SEGMENTS if s != "MACHINERY") + " from client"),
    "standard_scale": "select l_orderkey, " + ", ".join(_scaled_sql(c, c) for c in LINE_NUMBERS) + " from lineitem",
    "skew_scale": f"""with t as (select l_orderkey, l_tax, {_bc('l_extendedprice * l_extendedprice / 1000000')} as s
  from lineitem) select l_orderkey, {_scaled_sql('s', 'l_squared_box_cox')}, {_scaled_sql('l_tax', 'l_tax')} from t""",
    "box_stats": f"""with q as (select o_orderpriority, quantile_cont(o_totalprice, 0.25) as q25,
  quantile_cont(o_totalprice, 0.5) as q50, quantile_cont(o_totalprice, 0.75) as q75 from orders group by 1),
t as (select *, o_totalprice >= q25 - 1.5e0 * (q75 - q25) and o_totalprice <= q75 + 1.5e0 * (q75 - q25) as inside
  from orders join q using (o_orderpriority))
select o_orderpriority, {r6('max(q25)', 4)} as q25, {r6('max(q50)', 4)} as q50, {r6('max(q75)', 4)} as q75,
  {r6('min(o_totalprice) filter (where inside)', 4)} as whisker_low,
  {r6('max(o_totalprice) filter (where inside)', 4)} as whisker_high, count(*) filter (where not inside) as n_outliers
from t group by o_orderpriority""",
    "histogram": _histogram_sql("o_totalprice", "o_orderstatus"),
    "histogram_log": _histogram_sql("ln(1 + o_totalprice)", None),
    "density": f"""with t as (select o_orderstatus, o_totalprice / 1000 as v from orders),
s as (select o_orderstatus, count(*) as n, min(v) as lo, max(v) as hi,
  stddev_samp(v) * pow(count(*), -0.2e0) as h from t group by 1),
g as (select o_orderstatus, n, h, point, lo - 3 * h + point * ((hi - lo + 6 * h) / 49) as x
  from s, (select cast(unnest(range(50)) as integer) as point))
select o_orderstatus, point, {r6('max(x)')} as x,
  {r6('sum(exp(-0.5e0 * pow((x - v) / h, 2))) / max(n * h * sqrt(2 * pi()))')} as density
from t join g using (o_orderstatus) group by o_orderstatus, point""",
    "csv_round_trip": with_roles("client", f"""select SK_ID_CURR, {r6('AMT_ANNUITY')} as AMT_ANNUITY, OCCUPATION_TYPE,
  {r6('DEF_30_CNT_SOCIAL_CIRCLE')} as DEF_30_CNT_SOCIAL_CIRCLE from client"""),
    "table_shapes": """select 'client' as table_name, count(*) as n_rows, 20 as n_columns, 5 as n_bigint, 11 as n_double,
  4 as n_string from customer
union all select 'bureau', count(*), 6, 3, 3, 0 from orders
union all select 'credit_card_balance', count(*), 7, 4, 3, 0 from lineitem join orders on l_orderkey = o_orderkey
union all select 'pos_cash_balance', count(*), 5, 4, 1, 0 from events""",
}
SQL = {name: sql.replace("with \n", "with ") for name, sql in SQL.items()}
