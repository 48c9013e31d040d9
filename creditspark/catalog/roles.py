"""The supplied tables in the roles of the lending tables, as Spark projections and as SQL of the same meaning.

customer is the client table, orders are earlier applications and external credits, lineitem with orders are
card months and instalments, lineitem alone is the credit status history, events are point-of-sale months.
NULLs, zero limits and sentinels are put in by expressions, since the supplied tables hold none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def null_if(c: str, value) -> Column:
    return F.nullif(F.col(c), F.lit(value))


def _number(factor: int, size: int) -> Column:
    return F.pmod(F.col("c_custkey") * factor, F.lit(size))


DAY_ZERO = "2002-01-01"
EVENT_DAY_ZERO = "2025-01-01"
INQUIRIES = {"HOUR": 2, "DAY": 3, "WEEK": 4, "MON": 5, "QRT": 6, "YEAR": 7}


def client(spark: SparkSession, sf: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf, "customer").select(
        key.alias("SK_ID_CURR"),
        (F.col("c_acctbal") < 0).cast("long").alias("TARGET"),
        (nation.cast("double") * 997.0).alias("AMT_INCOME_TOTAL"),
        (_number(31, 9973).cast("double") * 25.0).alias("AMT_CREDIT"),
        F.when(key % 13 == 0, None).otherwise(_number(17, 1009).cast("double") * 10.0).alias("AMT_ANNUITY"),
        F.when(key % 11 == 0, 365243).otherwise(-_number(37, 4000)).cast("long").alias("DAYS_EMPLOYED"),
        (-(_number(53, 16000) + 7000)).cast("long").alias("DAYS_BIRTH"),
        F.when(key % 3 == 0, "Y").otherwise("N").alias("FLAG_OWN_CAR"),
        F.when(nation % 2 == 0, "Y").otherwise("N").alias("FLAG_OWN_REALTY"),
        null_if("c_mktsegment", "MACHINERY").alias("OCCUPATION_TYPE"),
        F.when(nation < 23, nation % 5).cast("long").alias("REGION_RATING_CLIENT_W_CITY"),
        F.concat(F.lit("Type "), nation.cast("string")).alias("ORGANIZATION_TYPE"),
        (key % 4).cast("double").alias("OBS_30_CNT_SOCIAL_CIRCLE"),
        F.when(key % 7 == 0, None).otherwise(key % 3).cast("double").alias("DEF_30_CNT_SOCIAL_CIRCLE"),
        *[F.nullif(key % k, F.lit(0)).cast("double").alias(f"AMT_REQ_CREDIT_BUREAU_{p}")
          for p, k in INQUIRIES.items()],
    )


def bureau(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.col("o_orderkey").alias("SK_ID_BUREAU"),
        F.datediff("o_orderdate", F.lit(DAY_ZERO).cast("date")).cast("long").alias("DAYS_CREDIT"),
        F.when(F.col("o_orderpriority") == "5-LOW", 0.0)
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", None).otherwise(price).alias("AMT_CREDIT_SUM"),
        F.when(F.col("o_orderkey") % 9 == 0, None).otherwise(price * 0.4).alias("AMT_CREDIT_SUM_DEBT"),
        F.when(F.col("o_orderstatus") == "F", 0.0).when(F.col("o_orderstatus") == "O", price * 0.01)
        .alias("AMT_CREDIT_SUM_OVERDUE"),
    )


def bureau_balance(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("SK_ID_BUREAU"),
        (-F.col("l_linenumber")).cast("long").alias("MONTHS_BALANCE"),
        F.when(flag == "R", "C").when(flag == "A", "0").alias("STATUS"),
    )


def previous_application(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("SK_ID_PREV"),
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.when(priority.isin("1-URGENT", "2-HIGH"), "Cash loans").when(priority == "3-MEDIUM", None)
        .otherwise("Consumer loans").alias("NAME_CONTRACT_TYPE"),
    )


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").join(
        table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))


def credit_card_balance(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("l_extendedprice")
    return _lines(spark, sf).select(
        F.col("l_orderkey").alias("SK_ID_PREV"),
        F.col("o_custkey").alias("SK_ID_CURR"),
        (-F.col("l_linenumber")).cast("long").alias("MONTHS_BALANCE"),
        (price * (1 - F.col("l_discount"))).alias("AMT_BALANCE"),
        F.when(F.col("l_tax") == 0, 0).otherwise(F.col("l_quantity").cast("long") * 1000)
        .alias("AMT_CREDIT_LIMIT_ACTUAL"),
        (price * F.col("l_tax")).alias("AMT_DRAWINGS_ATM_CURRENT"),
        (price * F.col("l_discount")).alias("AMT_DRAWINGS_CURRENT"),
    )


def installments_payments(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(DAY_ZERO).cast("date")
    paid = F.datediff("l_shipdate", zero).cast("double")
    return _lines(spark, sf).select(
        F.col("l_orderkey").alias("SK_ID_PREV"),
        F.col("o_custkey").alias("SK_ID_CURR"),
        F.datediff("o_orderdate", zero).cast("double").alias("DAYS_INSTALMENT"),
        F.when(F.col("l_linenumber") == 7, None).otherwise(paid).alias("DAYS_ENTRY_PAYMENT"),
    )


def pos_cash_balance(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("SK_ID_PREV"),
        F.col("user_id").alias("SK_ID_CURR"),
        F.datediff("ts", F.lit(EVENT_DAY_ZERO).cast("date")).cast("long").alias("MONTHS_BALANCE"),
        F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("value")).alias("CNT_INSTALMENT_FUTURE"),
        F.when(kind == "error", 1).when(kind == "view", None).otherwise(0).cast("long").alias("SK_DPD"),
    )


ROLES = {
    "client": client,
    "bureau": bureau,
    "bureau_balance": bureau_balance,
    "previous_application": previous_application,
    "credit_card_balance": credit_card_balance,
    "installments_payments": installments_payments,
    "pos_cash_balance": pos_cash_balance,
}


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {name: role(spark, sf) for name, role in ROLES.items()}


def rounded(df: DataFrame, digits: int = 6, **finer: int) -> DataFrame:
    """Doubles rounded for comparison, without negative zero; ``finer`` gives single columns more digits."""
    return df.select(*[
        (F.round(F.col(f"`{name}`"), finer.get(name, digits)) + F.lit(0.0)).alias(name) if kind == "double" else F.col(f"`{name}`")
        for name, kind in df.dtypes
    ])


# ---- the same roles in SQL -----------------------------------------------------------------

ROLE_SQL = {
    "client": """
  select c_custkey as SK_ID_CURR, cast(c_acctbal < 0 as bigint) as TARGET,
    cast(c_nationkey as double) * 997.0e0 as AMT_INCOME_TOTAL,
    cast((c_custkey * 31) % 9973 as double) * 25.0 as AMT_CREDIT,
    case when c_custkey % 13 = 0 then null else cast((c_custkey * 17) % 1009 as double) * 10.0 end as AMT_ANNUITY,
    case when c_custkey % 11 = 0 then 365243 else -((c_custkey * 37) % 4000) end as DAYS_EMPLOYED,
    -((c_custkey * 53) % 16000 + 7000) as DAYS_BIRTH,
    case when c_custkey % 3 = 0 then 'Y' else 'N' end as FLAG_OWN_CAR,
    case when c_nationkey % 2 = 0 then 'Y' else 'N' end as FLAG_OWN_REALTY,
    nullif(c_mktsegment, 'MACHINERY') as OCCUPATION_TYPE,
    cast(case when c_nationkey < 23 then c_nationkey % 5 end as bigint) as REGION_RATING_CLIENT_W_CITY,
    'Type ' || c_nationkey as ORGANIZATION_TYPE,
    cast(c_custkey % 4 as double) as OBS_30_CNT_SOCIAL_CIRCLE,
    cast(case when c_custkey % 7 = 0 then null else c_custkey % 3 end as double) as DEF_30_CNT_SOCIAL_CIRCLE,
    """ + ",\n    ".join(
        f"cast(nullif(c_custkey % {k}, 0) as double) as AMT_REQ_CREDIT_BUREAU_{p}" for p, k in INQUIRIES.items()
    ) + """
  from customer""",
    "bureau": f"""
  select o_custkey as SK_ID_CURR, o_orderkey as SK_ID_BUREAU,
    date_diff('day', date '{DAY_ZERO}', cast(o_orderdate as date)) as DAYS_CREDIT,
    case when o_orderpriority = '5-LOW' then 0.0e0 when o_orderpriority = '4-NOT SPECIFIED' then null
      else o_totalprice end as AMT_CREDIT_SUM,
    case when o_orderkey % 9 = 0 then null else o_totalprice * 0.4e0 end as AMT_CREDIT_SUM_DEBT,
    case when o_orderstatus = 'F' then 0.0e0 when o_orderstatus = 'O' then o_totalprice * 0.01e0 end
      as AMT_CREDIT_SUM_OVERDUE
  from orders""",
    "bureau_balance": """
  select l_orderkey as SK_ID_BUREAU, cast(-l_linenumber as bigint) as MONTHS_BALANCE,
    case when l_returnflag = 'R' then 'C' when l_returnflag = 'A' then '0' end as STATUS
  from lineitem""",
    "previous_application": """
  select o_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR,
    case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'Cash loans'
      when o_orderpriority = '3-MEDIUM' then null else 'Consumer loans' end as NAME_CONTRACT_TYPE
  from orders""",
    "credit_card_balance": """
  select l_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR, cast(-l_linenumber as bigint) as MONTHS_BALANCE,
    l_extendedprice * (1 - l_discount) as AMT_BALANCE,
    case when l_tax = 0 then 0 else cast(l_quantity as bigint) * 1000 end as AMT_CREDIT_LIMIT_ACTUAL,
    l_extendedprice * l_tax as AMT_DRAWINGS_ATM_CURRENT,
    l_extendedprice * l_discount as AMT_DRAWINGS_CURRENT
  from lineitem join orders on l_orderkey = o_orderkey""",
    "installments_payments": f"""
  select l_orderkey as SK_ID_PREV, o_custkey as SK_ID_CURR,
    cast(date_diff('day', date '{DAY_ZERO}', cast(o_orderdate as date)) as double) as DAYS_INSTALMENT,
    case when l_linenumber = 7 then null
      else cast(date_diff('day', date '{DAY_ZERO}', cast(l_shipdate as date)) as double) end as DAYS_ENTRY_PAYMENT
  from lineitem join orders on l_orderkey = o_orderkey""",
    "pos_cash_balance": f"""
  select event_id as SK_ID_PREV, user_id as SK_ID_CURR,
    date_diff('day', date '{EVENT_DAY_ZERO}', cast(ts as date)) as MONTHS_BALANCE,
    case when event_id % 10 = 0 then null else value end as CNT_INSTALMENT_FUTURE,
    case when event_type = 'error' then 1 when event_type = 'view' then null else 0 end as SK_DPD
  from events""",
}


def with_roles(names: str, body: str, **more: str) -> str:
    """A query over the named roles (and further named subqueries), all as common table expressions."""
    parts = [f"{n} as ({ROLE_SQL[n]}\n)" for n in names.split()]
    parts += [f"{n} as (\n{text}\n)" for n, text in more.items()]
    return "with " + ",\n".join(parts) + "\n" + body


def r6(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"
