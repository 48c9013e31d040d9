"""Fixed schemas of the eight source tables. Types are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "SK_ID_CURR"
TARGET = "TARGET"

# Building measures, each stored as average, mode and median.
BUILDING_MEASURES = [
    "APARTMENTS", "BASEMENTAREA", "YEARS_BEGINEXPLUATATION", "YEARS_BUILD", "COMMONAREA", "ELEVATORS",
    "ENTRANCES", "FLOORSMAX", "FLOORSMIN", "LANDAREA", "LIVINGAPARTMENTS", "LIVINGAREA",
    "NONLIVINGAPARTMENTS", "NONLIVINGAREA",
]
VARIANTS = ["AVG", "MODE", "MEDI"]
INQUIRY_PERIODS = ["HOUR", "DAY", "WEEK", "MON", "QRT", "YEAR"]
INQUIRY_COLUMNS = [f"AMT_REQ_CREDIT_BUREAU_{p}" for p in INQUIRY_PERIODS]
BUILDING_COLUMNS = [f"{m}_{v}" for v in VARIANTS for m in BUILDING_MEASURES]

# Columns dropped before modelling, by reason.
LOW_IMPORTANCE_COLUMNS = [
    "AMT_REQ_CREDIT_BUREAU_HOUR", "AMT_REQ_CREDIT_BUREAU_DAY", "AMT_REQ_CREDIT_BUREAU_WEEK",
]
COLLINEAR_COLUMNS = [
    "FLAG_EMP_PHONE", "OBS_60_CNT_SOCIAL_CIRCLE", "REGION_RATING_CLIENT", "CNT_CHILDREN",
    "REG_REGION_NOT_WORK_REGION", "REG_CITY_NOT_WORK_CITY", "DEF_60_CNT_SOCIAL_CIRCLE",
]


def _struct(spec: str) -> T.StructType:
    """``name:code`` words to a schema; codes are l (long), d (double), s (string)."""
    kinds = {"l": T.LongType(), "d": T.DoubleType(), "s": T.StringType()}
    pairs = (word.split(":") for word in spec.split())
    return T.StructType([T.StructField(name, kinds[code], True) for name, code in pairs])


# Header order and type of each file.
CLIENT = _struct(
    "SK_ID_CURR:l NAME_CONTRACT_TYPE:s CODE_GENDER:s FLAG_OWN_CAR:s FLAG_OWN_REALTY:s CNT_CHILDREN:l "
    "AMT_INCOME_TOTAL:d AMT_CREDIT:d AMT_ANNUITY:d AMT_GOODS_PRICE:d NAME_TYPE_SUITE:s NAME_INCOME_TYPE:s "
    "NAME_EDUCATION_TYPE:s NAME_FAMILY_STATUS:s NAME_HOUSING_TYPE:s REGION_POPULATION_RELATIVE:d DAYS_BIRTH:l "
    "DAYS_EMPLOYED:l DAYS_REGISTRATION:d DAYS_ID_PUBLISH:l OWN_CAR_AGE:d FLAG_MOBIL:l FLAG_EMP_PHONE:l "
    "FLAG_WORK_PHONE:l FLAG_CONT_MOBILE:l FLAG_PHONE:l FLAG_EMAIL:l OCCUPATION_TYPE:s CNT_FAM_MEMBERS:d "
    "REGION_RATING_CLIENT:l REGION_RATING_CLIENT_W_CITY:l WEEKDAY_APPR_PROCESS_START:s "
    "HOUR_APPR_PROCESS_START:l REG_REGION_NOT_LIVE_REGION:l REG_REGION_NOT_WORK_REGION:l "
    "LIVE_REGION_NOT_WORK_REGION:l REG_CITY_NOT_LIVE_CITY:l REG_CITY_NOT_WORK_CITY:l "
    "LIVE_CITY_NOT_WORK_CITY:l ORGANIZATION_TYPE:s EXT_SOURCE_1:d EXT_SOURCE_2:d EXT_SOURCE_3:d "
    + " ".join(f"{name}:d" for name in BUILDING_COLUMNS)
    + " FONDKAPREMONT_MODE:s HOUSETYPE_MODE:s TOTALAREA_MODE:d WALLSMATERIAL_MODE:s EMERGENCYSTATE_MODE:s "
    "OBS_30_CNT_SOCIAL_CIRCLE:d DEF_30_CNT_SOCIAL_CIRCLE:d OBS_60_CNT_SOCIAL_CIRCLE:d "
    "DEF_60_CNT_SOCIAL_CIRCLE:d DAYS_LAST_PHONE_CHANGE:d "
    + " ".join(f"FLAG_DOCUMENT_{n}:l" for n in range(2, 22)) + " "
    + " ".join(f"{name}:d" for name in INQUIRY_COLUMNS)
)
CLIENT_TRAIN = T.StructType(
    [CLIENT.fields[0], T.StructField(TARGET, T.LongType(), True), *CLIENT.fields[1:]]
)
BUREAU = _struct(
    "SK_ID_CURR:l SK_ID_BUREAU:l CREDIT_ACTIVE:s CREDIT_CURRENCY:s DAYS_CREDIT:l CREDIT_DAY_OVERDUE:l "
    "DAYS_CREDIT_ENDDATE:d DAYS_ENDDATE_FACT:d AMT_CREDIT_MAX_OVERDUE:d CNT_CREDIT_PROLONG:l "
    "AMT_CREDIT_SUM:d AMT_CREDIT_SUM_DEBT:d AMT_CREDIT_SUM_LIMIT:d AMT_CREDIT_SUM_OVERDUE:d CREDIT_TYPE:s "
    "DAYS_CREDIT_UPDATE:l AMT_ANNUITY:d"
)
BUREAU_BALANCE = _struct("SK_ID_BUREAU:l MONTHS_BALANCE:l STATUS:s")
PREVIOUS = _struct(
    "SK_ID_PREV:l SK_ID_CURR:l NAME_CONTRACT_TYPE:s AMT_ANNUITY:d AMT_APPLICATION:d AMT_CREDIT:d "
    "AMT_DOWN_PAYMENT:d AMT_GOODS_PRICE:d WEEKDAY_APPR_PROCESS_START:s HOUR_APPR_PROCESS_START:l "
    "FLAG_LAST_APPL_PER_CONTRACT:s NFLAG_LAST_APPL_IN_DAY:l RATE_DOWN_PAYMENT:d RATE_INTEREST_PRIMARY:d "
    "RATE_INTEREST_PRIVILEGED:d NAME_CASH_LOAN_PURPOSE:s NAME_CONTRACT_STATUS:s DAYS_DECISION:l "
    "NAME_PAYMENT_TYPE:s CODE_REJECT_REASON:s NAME_TYPE_SUITE:s NAME_CLIENT_TYPE:s NAME_GOODS_CATEGORY:s "
    "NAME_PORTFOLIO:s NAME_PRODUCT_TYPE:s CHANNEL_TYPE:s SELLERPLACE_AREA:l NAME_SELLER_INDUSTRY:s "
    "CNT_PAYMENT:d NAME_YIELD_GROUP:s PRODUCT_COMBINATION:s DAYS_FIRST_DRAWING:d DAYS_FIRST_DUE:d "
    "DAYS_LAST_DUE_1ST_VERSION:d DAYS_LAST_DUE:d DAYS_TERMINATION:d NFLAG_INSURED_ON_APPROVAL:d"
)
POS = _struct(
    "SK_ID_PREV:l SK_ID_CURR:l MONTHS_BALANCE:l CNT_INSTALMENT:d CNT_INSTALMENT_FUTURE:d "
    "NAME_CONTRACT_STATUS:s SK_DPD:l SK_DPD_DEF:l"
)
CARDS = _struct(
    "SK_ID_PREV:l SK_ID_CURR:l MONTHS_BALANCE:l AMT_BALANCE:d AMT_CREDIT_LIMIT_ACTUAL:l "
    "AMT_DRAWINGS_ATM_CURRENT:d AMT_DRAWINGS_CURRENT:d AMT_DRAWINGS_OTHER_CURRENT:d "
    "AMT_DRAWINGS_POS_CURRENT:d AMT_INST_MIN_REGULARITY:d AMT_PAYMENT_CURRENT:d AMT_PAYMENT_TOTAL_CURRENT:d "
    "AMT_RECEIVABLE_PRINCIPAL:d AMT_RECIVABLE:d AMT_TOTAL_RECEIVABLE:d CNT_DRAWINGS_ATM_CURRENT:d "
    "CNT_DRAWINGS_CURRENT:l CNT_DRAWINGS_OTHER_CURRENT:d CNT_DRAWINGS_POS_CURRENT:d "
    "CNT_INSTALMENT_MATURE_CUM:d NAME_CONTRACT_STATUS:s SK_DPD:l SK_DPD_DEF:l"
)
INSTALMENTS = _struct(
    "SK_ID_PREV:l SK_ID_CURR:l NUM_INSTALMENT_VERSION:d NUM_INSTALMENT_NUMBER:l DAYS_INSTALMENT:d "
    "DAYS_ENTRY_PAYMENT:d AMT_INSTALMENT:d AMT_PAYMENT:d"
)

# Bundle table name -> schema. File names match case-insensitively.
TABLES = {
    "client": CLIENT,
    "bureau": BUREAU,
    "bureau_balance": BUREAU_BALANCE,
    "previous_application": PREVIOUS,
    "credit_card_balance": CARDS,
    "installments_payments": INSTALMENTS,
    "pos_cash_balance": POS,
}
