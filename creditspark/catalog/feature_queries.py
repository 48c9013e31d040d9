"""Client features over the supplied tables in their lending roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.catalog.roles import ROLES, r6, rounded, table, tables, with_roles
from creditspark.functions import columns as C
from creditspark.operators.align import columns_with_prefix
from creditspark.operators.joins import attach_one_per_key
from creditspark.plans import features as P
from creditspark.session import materialize
from creditspark.sources.schemas import KEY


def _client(spark: SparkSession, sf: str) -> DataFrame:
    return ROLES["client"](spark, sf)


# means of two-decimal values over few rows often end on a rounding tie at six digits
FINER = {"POS_CASH_INSTALLMENT_TREND": 8}


def _attached(spark: SparkSession, sf: str, features: DataFrame, *columns: str) -> DataFrame:
    """Client keys with the given per-client features."""
    out = attach_one_per_key(_client(spark, sf).select(KEY), features, KEY)
    return rounded(out.select(KEY, *(columns or features.drop(KEY).columns)), **FINER)


def debt_ratio(spark, sf):
    cards = P.card_features(ROLES["credit_card_balance"](spark, sf)).select(KEY, "AVG_CREDIT_LIMIT")
    out = attach_one_per_key(P.client_features(_client(spark, sf)), cards, KEY)
    return rounded(out.select(
        KEY, "DEBT_TO_INCOME", "PAYMENT_TO_INCOME",
        C.ratio("AMT_INCOME_TOTAL", "AVG_CREDIT_LIMIT").alias("INCOME_TO_CREDIT_LIMIT")))


def card_features(spark, sf):
    return _attached(spark, sf, P.card_features(ROLES["credit_card_balance"](spark, sf)))


def bins_right_closed(spark, sf):
    return _client(spark, sf).select(
        KEY, C.employment_band("DAYS_EMPLOYED").alias("EMPLOYMENT_STABILITY"),
        C.age_band("DAYS_BIRTH").alias("AGE_GROUP"))


def sentinel_null(spark, sf):
    cleaned = C.null_above("DAYS_EMPLOYED", C.EMPLOYMENT_SENTINEL_ABOVE)
    return _client(spark, sf).select(KEY, cleaned.alias("DAYS_EMPLOYED"))


def recode_flags(spark, sf):
    return P.client_features(_client(spark, sf)).select(
        KEY, "FLAG_OWN_CAR", "FLAG_OWN_REALTY", "ASSET_OWNERSHIP_SCORE")


def row_sum_nulls(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("part_line", F.nullif("l_linenumber", F.lit(7))).select(
        "l_orderkey", F.nullif("l_tax", F.lit(0.0)).alias("part_tax"),
        F.nullif("l_discount", F.lit(0.0)).alias("part_discount"), "part_line")
    return rounded(lines.select("l_orderkey", C.row_sum(columns_with_prefix(lines, "part_")).alias("total")))


def inquiry_intensity(spark, sf):
    return rounded(P.client_features(_client(spark, sf)).select(KEY, "RECENT_INQUIRY_INTENSITY"))


def social_rate(spark, sf):
    return rounded(P.client_features(_client(spark, sf)).select(KEY, "SOCIAL_CIRCLE_DEFAULT_RATE"))


def fill_indicator(spark, sf):
    return P.clean_client(_client(spark, sf)).select(KEY, "OCCUPATION_TYPE", "OCCUPATION_TYPE_missing")


def _bureau(spark, sf) -> DataFrame:
    return P.bureau_features(ROLES["bureau"](spark, sf), ROLES["bureau_balance"](spark, sf))


def history_years(spark, sf):
    return _attached(spark, sf, _bureau(spark, sf), "CREDIT_HISTORY_YEARS")


def loan_performance(spark, sf):
    return _attached(spark, sf, _bureau(spark, sf), "PREV_LOAN_PERFORMANCE")


def active_ratio_mean(spark, sf):
    return _attached(spark, sf, _bureau(spark, sf), "BUREAU_ACTIVE_LOANS_RATIO_MEAN")


def application_frequency(spark, sf):
    previous = P.previous_features(ROLES["previous_application"](spark, sf))
    return _attached(spark, sf, previous, "LOAN_APPLICATION_FREQUENCY")


def cash_proportion(spark, sf):
    previous = P.previous_features(ROLES["previous_application"](spark, sf))
    return _attached(spark, sf, previous, "CASH_LOAN_PROPORTION")


def payment_delay(spark, sf):
    return _attached(spark, sf, P.instalment_features(ROLES["installments_payments"](spark, sf)))


def dpd_ratio(spark, sf):
    return _attached(spark, sf, P.overdue_share(ROLES["pos_cash_balance"](spark, sf)))


def ordered_half_trend(spark, sf):
    return _attached(spark, sf, P.instalment_trend(ROLES["pos_cash_balance"](spark, sf)))


def risk_lookup(spark, sf):
    client = _client(spark, sf)
    risks = P.risk_tables(client, [P.OCCUPATION, P.REGION])
    out = P.apply_risk(client, risks[P.OCCUPATION], P.OCCUPATION, "OCCUPATION_RISK_SCORE", fill=True)
    out = P.apply_risk(out, risks[P.REGION], P.REGION, "REGION_RISK_SCORE")
    return rounded(out.select(KEY, "OCCUPATION_RISK_SCORE", "REGION_RISK_SCORE"))


FEATURES = [
    "DEBT_TO_INCOME", "CREDIT_UTILIZATION", "PAYMENT_TO_INCOME", "EMPLOYMENT_STABILITY", "AGE_GROUP",
    "CREDIT_HISTORY_YEARS", "RECENT_INQUIRY_INTENSITY", "ASSET_OWNERSHIP_SCORE", "PREV_LOAN_PERFORMANCE",
    "SOCIAL_CIRCLE_DEFAULT_RATE", "CC_SPENDING_RATIO", "LOAN_APPLICATION_FREQUENCY", "AVG_PAYMENT_DELAY",
    "AVG_CREDIT_LIMIT", "INCOME_TO_CREDIT_LIMIT", "OCCUPATION_RISK_SCORE", "REGION_RISK_SCORE",
    "CASH_LOAN_PROPORTION", "BEHAVIORAL_SCORE", "POS_CASH_DPD_RATIO", "POS_CASH_INSTALLMENT_TREND",
    "BUREAU_ACTIVE_LOANS_RATIO_MEAN",
]


def feature_frame(spark, sf):
    return rounded(P.FeatureModel.fit_transform(tables(spark, sf))[1].select(KEY, "TARGET", *FEATURES), **FINER)


def behavioral_score(spark, sf):
    """Score from the application, card and credit tables alone."""
    client = _client(spark, sf)
    risks = P.risk_tables(client, [P.OCCUPATION, P.REGION])
    out = attach_one_per_key(P.client_features(client), P.card_features(
        ROLES["credit_card_balance"](spark, sf)).select(KEY, "CREDIT_UTILIZATION"), KEY)
    out = attach_one_per_key(out, _bureau(spark, sf).select(KEY, "PREV_LOAN_PERFORMANCE"), KEY)
    out = P.apply_risk(out, risks[P.OCCUPATION], P.OCCUPATION, "OCCUPATION_RISK_SCORE", fill=True)
    out = materialize(P.apply_risk(out, risks[P.REGION], P.REGION, "REGION_RISK_SCORE"))
    state = P.fit_behaviour(out)
    return rounded(out.select(KEY, P.behavioural_score(state).alias("BEHAVIORAL_SCORE")))


QUERIES = {f.__name__: f for f in (
    card_features, debt_ratio, bins_right_closed, sentinel_null, recode_flags, row_sum_nulls, inquiry_intensity,
    social_rate, fill_indicator, history_years, loan_performance, active_ratio_mean, application_frequency,
    cash_proportion, payment_delay, dpd_ratio, ordered_half_trend, risk_lookup, behavioral_score, feature_frame,
)}


# ---- SQL -----------------------------------------------------------------------------------

CARD = """  select SK_ID_CURR,
    coalesce(avg(AMT_BALANCE / nullif(AMT_CREDIT_LIMIT_ACTUAL, 0)), 0) as CREDIT_UTILIZATION,
    coalesce(avg(AMT_DRAWINGS_ATM_CURRENT) / nullif(avg(AMT_DRAWINGS_CURRENT), 0), 0) as CC_SPENDING_RATIO,
    avg(AMT_CREDIT_LIMIT_ACTUAL) as AVG_CREDIT_LIMIT
  from credit_card_balance group by SK_ID_CURR"""
OPEN = """  select SK_ID_BUREAU, 1 - avg(case when STATUS = 'C' then 1.0e0 else 0.0e0 end) as open_share
  from bureau_balance group by SK_ID_BUREAU"""
BUREAU = """  select SK_ID_CURR, abs(min(DAYS_CREDIT)) / 365.0e0 as CREDIT_HISTORY_YEARS,
    0.7e0 * avg(case when AMT_CREDIT_SUM_OVERDUE = 0 then 1.0e0 else 0.0e0 end)
      + 0.3e0 * (1 - coalesce(avg(case when AMT_CREDIT_SUM = 0 then 1.0e0
          else AMT_CREDIT_SUM_DEBT / nullif(AMT_CREDIT_SUM, 0) end), 1)) as PREV_LOAN_PERFORMANCE,
    avg(open_share) as BUREAU_ACTIVE_LOANS_RATIO_MEAN
  from bureau left join open_f using (SK_ID_BUREAU) group by SK_ID_CURR"""
PREVIOUS = """  select SK_ID_CURR, count(*) as LOAN_APPLICATION_FREQUENCY,
    avg(case when NAME_CONTRACT_TYPE = 'Cash loans' then 1.0e0 else 0.0e0 end) as CASH_LOAN_PROPORTION
  from previous_application group by SK_ID_CURR"""
INSTALMENT = """  select SK_ID_CURR, avg(DAYS_ENTRY_PAYMENT - DAYS_INSTALMENT) as AVG_PAYMENT_DELAY
  from installments_payments group by SK_ID_CURR"""
OVERDUE = """  select SK_ID_CURR, avg(case when SK_DPD > 0 then 1.0e0 else 0.0e0 end) as POS_CASH_DPD_RATIO
  from pos_cash_balance group by SK_ID_CURR"""
TREND = """  select SK_ID_CURR, case when max(n) < 2 then 0 else avg(case when rn > n // 2 then CNT_INSTALMENT_FUTURE end)
      - avg(case when rn <= n // 2 then CNT_INSTALMENT_FUTURE end) end as POS_CASH_INSTALLMENT_TREND
  from (select SK_ID_CURR, CNT_INSTALMENT_FUTURE, count(*) over (partition by SK_ID_CURR) as n,
      row_number() over (partition by SK_ID_CURR order by MONTHS_BALANCE, SK_ID_PREV) as rn
    from pos_cash_balance) group by SK_ID_CURR"""
OCCUPATION = "  select OCCUPATION_TYPE, avg(TARGET) as risk from client where OCCUPATION_TYPE is not null group by 1"
REGION = """  select REGION_RATING_CLIENT_W_CITY, avg(TARGET) as risk from client
  where REGION_RATING_CLIENT_W_CITY is not null group by 1"""
BANDS = """case when DAYS_EMPLOYED <= -1825 then '>5y' when DAYS_EMPLOYED <= -1095 then '3-5y'
      when DAYS_EMPLOYED <= -365 then '1-3y' when DAYS_EMPLOYED <= 0 then '<1y' end as EMPLOYMENT_STABILITY,
    case when -DAYS_BIRTH / 365.0e0 <= 0 then null when -DAYS_BIRTH / 365.0e0 <= 25 then '<25'
      when -DAYS_BIRTH / 365.0e0 <= 35 then '25-35' when -DAYS_BIRTH / 365.0e0 <= 45 then '35-45'
      when -DAYS_BIRTH / 365.0e0 <= 55 then '45-55' else '55+' end as AGE_GROUP"""
INQUIRY = " + ".join(f"coalesce(AMT_REQ_CREDIT_BUREAU_{p}, 0)" for p in
                     ("HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR"))
SOCIAL = "coalesce(DEF_30_CNT_SOCIAL_CIRCLE / nullif(OBS_30_CNT_SOCIAL_CIRCLE, 0), 0)"
OCC_SCORE = "coalesce(o.risk, (select avg(risk) from occupation))"


def _attach_sql(roles: str, column: str, integer: bool = False, **more: str) -> str:
    last = list(more)[-1]
    value = column if integer else f"{r6(column, FINER.get(column, 6))} as {column}"
    return with_roles(f"client {roles}", f"select SK_ID_CURR, {value} from client left join {last} using (SK_ID_CURR)",
                      **more)


BASE = f"""  select c.*, CREDIT_UTILIZATION, CC_SPENDING_RATIO, AVG_CREDIT_LIMIT, CREDIT_HISTORY_YEARS,
    PREV_LOAN_PERFORMANCE, BUREAU_ACTIVE_LOANS_RATIO_MEAN,
    AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0) as DEBT_TO_INCOME,
    {OCC_SCORE} as OCCUPATION_RISK_SCORE, r.risk as REGION_RISK_SCORE
  from client c left join card_f using (SK_ID_CURR) left join bureau_f using (SK_ID_CURR)
    left join occupation o using (OCCUPATION_TYPE) left join region_risk r using (REGION_RATING_CLIENT_W_CITY)"""


def _filled(c: str) -> str:
    return f"coalesce({c}, (select avg({c}) from base))"


SCORE = f"""  select SK_ID_CURR, {_filled('OCCUPATION_RISK_SCORE')} * 0.2e0 + {_filled('REGION_RISK_SCORE')} * 0.2e0
    + {_filled('PREV_LOAN_PERFORMANCE')} * 0.3e0 + (1 - {_filled('CREDIT_UTILIZATION')}) * 0.15e0
    + (1 - {_filled('DEBT_TO_INCOME')}) * 0.15e0 as score
  from base"""
SCALED = "(score - (select min(score) from scores)) / (select max(score) - min(score) from scores)"
SCORE_PARTS = dict(card_f=CARD, open_f=OPEN, bureau_f=BUREAU, occupation=OCCUPATION, region_risk=REGION,
                   base=BASE, scores=SCORE)

SQL = {
    "card_features": with_roles(
        "client credit_card_balance",
        f"""select SK_ID_CURR, {r6('CREDIT_UTILIZATION')} as CREDIT_UTILIZATION,
  {r6('CC_SPENDING_RATIO')} as CC_SPENDING_RATIO, {r6('AVG_CREDIT_LIMIT')} as AVG_CREDIT_LIMIT
from client left join card_f using (SK_ID_CURR)""", card_f=CARD),
    "debt_ratio": with_roles(
        "client credit_card_balance",
        f"""select SK_ID_CURR, {r6('AMT_CREDIT / nullif(AMT_INCOME_TOTAL, 0)')} as DEBT_TO_INCOME,
  {r6('AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0)')} as PAYMENT_TO_INCOME,
  {r6('AMT_INCOME_TOTAL / nullif(AVG_CREDIT_LIMIT, 0)')} as INCOME_TO_CREDIT_LIMIT
from client left join card_f using (SK_ID_CURR)""", card_f=CARD),
    "bins_right_closed": with_roles("client", f"select SK_ID_CURR, {BANDS} from client"),
    "sentinel_null": with_roles(
        "client", "select SK_ID_CURR, case when DAYS_EMPLOYED > 36500 then null else DAYS_EMPLOYED end "
        "as DAYS_EMPLOYED from client"),
    "recode_flags": with_roles(
        "client", """select SK_ID_CURR, cast(FLAG_OWN_CAR = 'Y' as bigint) as FLAG_OWN_CAR,
  cast(FLAG_OWN_REALTY = 'Y' as bigint) as FLAG_OWN_REALTY,
  cast(FLAG_OWN_CAR = 'Y' as bigint) + cast(FLAG_OWN_REALTY = 'Y' as bigint) as ASSET_OWNERSHIP_SCORE from client"""),
    "row_sum_nulls": f"""select l_orderkey, {r6("coalesce(nullif(l_tax, 0), 0) + coalesce(nullif(l_discount, 0), 0) "
                                               "+ coalesce(nullif(l_linenumber, 7), 0)")} as total from lineitem""",
    "inquiry_intensity": with_roles(
        "client", f"select SK_ID_CURR, {r6(INQUIRY)} as RECENT_INQUIRY_INTENSITY from client"),
    "social_rate": with_roles(
        "client", f"select SK_ID_CURR, {r6(SOCIAL)} as SOCIAL_CIRCLE_DEFAULT_RATE from client"),
    "fill_indicator": with_roles(
        "client", """select SK_ID_CURR, coalesce(OCCUPATION_TYPE, 'Unknown') as OCCUPATION_TYPE,
  cast(OCCUPATION_TYPE is null as bigint) as OCCUPATION_TYPE_missing from client"""),
    "history_years": _attach_sql("bureau bureau_balance", "CREDIT_HISTORY_YEARS", open_f=OPEN, bureau_f=BUREAU),
    "loan_performance": _attach_sql("bureau bureau_balance", "PREV_LOAN_PERFORMANCE", open_f=OPEN, bureau_f=BUREAU),
    "active_ratio_mean": _attach_sql("bureau bureau_balance", "BUREAU_ACTIVE_LOANS_RATIO_MEAN",
                                     open_f=OPEN, bureau_f=BUREAU),
    "application_frequency": _attach_sql("previous_application", "LOAN_APPLICATION_FREQUENCY", True,
                                         previous_f=PREVIOUS),
    "cash_proportion": _attach_sql("previous_application", "CASH_LOAN_PROPORTION", previous_f=PREVIOUS),
    "payment_delay": _attach_sql("installments_payments", "AVG_PAYMENT_DELAY", instalment_f=INSTALMENT),
    "dpd_ratio": _attach_sql("pos_cash_balance", "POS_CASH_DPD_RATIO", overdue_f=OVERDUE),
    "ordered_half_trend": _attach_sql("pos_cash_balance", "POS_CASH_INSTALLMENT_TREND", trend_f=TREND),
    "risk_lookup": with_roles(
        "client", f"""select SK_ID_CURR, {r6(OCC_SCORE)} as OCCUPATION_RISK_SCORE, {r6('r.risk')} as REGION_RISK_SCORE
from client left join occupation o using (OCCUPATION_TYPE)
  left join region_risk r using (REGION_RATING_CLIENT_W_CITY)""", occupation=OCCUPATION, region_risk=REGION),
    "behavioral_score": with_roles(
        "client credit_card_balance bureau bureau_balance",
        f"select SK_ID_CURR, {r6(SCALED)} as BEHAVIORAL_SCORE from scores", **SCORE_PARTS),
    "feature_frame": with_roles(
        "client bureau bureau_balance previous_application credit_card_balance installments_payments pos_cash_balance",
        f"""select SK_ID_CURR, TARGET, {BANDS}, {r6('DEBT_TO_INCOME')} as DEBT_TO_INCOME,
  {r6('AMT_ANNUITY / nullif(AMT_INCOME_TOTAL, 0)')} as PAYMENT_TO_INCOME,
  {r6(INQUIRY)} as RECENT_INQUIRY_INTENSITY, {r6(SOCIAL)} as SOCIAL_CIRCLE_DEFAULT_RATE,
  cast(FLAG_OWN_CAR = 'Y' as bigint) + cast(FLAG_OWN_REALTY = 'Y' as bigint) as ASSET_OWNERSHIP_SCORE,
  {r6('AMT_INCOME_TOTAL / nullif(AVG_CREDIT_LIMIT, 0)')} as INCOME_TO_CREDIT_LIMIT,
  {r6(SCALED)} as BEHAVIORAL_SCORE, LOAN_APPLICATION_FREQUENCY, """ + ", ".join(
            f"{r6(c, FINER.get(c, 6))} as {c}" for c in (
                "CREDIT_UTILIZATION", "CC_SPENDING_RATIO", "AVG_CREDIT_LIMIT", "CREDIT_HISTORY_YEARS",
                "PREV_LOAN_PERFORMANCE", "BUREAU_ACTIVE_LOANS_RATIO_MEAN", "OCCUPATION_RISK_SCORE",
                "REGION_RISK_SCORE", "CASH_LOAN_PROPORTION", "AVG_PAYMENT_DELAY", "POS_CASH_DPD_RATIO",
                "POS_CASH_INSTALLMENT_TREND")) + """
from base join scores using (SK_ID_CURR) left join previous_f using (SK_ID_CURR)
  left join instalment_f using (SK_ID_CURR) left join overdue_f using (SK_ID_CURR)
  left join trend_f using (SK_ID_CURR)""",
        **SCORE_PARTS, previous_f=PREVIOUS, instalment_f=INSTALMENT, overdue_f=OVERDUE, trend_f=TREND),
}
