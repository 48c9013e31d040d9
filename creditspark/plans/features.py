"""Client features: one aggregate per history table, one left join each, fitted tables for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.functions import columns as C
from creditspark.operators.align import columns_with_prefix
from creditspark.operators.encode import category_sums
from creditspark.operators.joins import attach_one_per_key, byte_estimate, lookup_join
from creditspark.operators.ranks import ordered_halves
from creditspark.session import materialize
from creditspark.sources import files
from creditspark.sources.schemas import KEY, TARGET

INQUIRY_PREFIX = "AMT_REQ_CREDIT_BUREAU_"
OCCUPATION = "OCCUPATION_TYPE"
REGION = "REGION_RATING_CLIENT_W_CITY"

# Weight of each part of the behavioural score; parts marked True enter as 1 - x.
BEHAVIOUR_PARTS = [
    ("OCCUPATION_RISK_SCORE", 0.20, False),
    ("REGION_RISK_SCORE", 0.20, False),
    ("PREV_LOAN_PERFORMANCE", 0.30, False),
    ("CREDIT_UTILIZATION", 0.15, True),
    ("DEBT_TO_INCOME", 0.15, True),
]


def _by_client(df: DataFrame):
    return df.filter(F.col(KEY).isNotNull()).groupBy(KEY)


# ---- one aggregate per history table -------------------------------------------------------

def card_features(cards: DataFrame) -> DataFrame:
    """Mean balance-to-limit ratio, cash share of mean drawings and mean limit per client."""
    return _by_client(cards).agg(
        F.coalesce(F.avg(C.ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")), F.lit(0.0))
        .alias("CREDIT_UTILIZATION"),
        F.coalesce(C.ratio(F.avg("AMT_DRAWINGS_ATM_CURRENT"), F.avg("AMT_DRAWINGS_CURRENT")), F.lit(0.0))
        .alias("CC_SPENDING_RATIO"),
        F.avg("AMT_CREDIT_LIMIT_ACTUAL").alias("AVG_CREDIT_LIMIT"),
    )


def loan_performance() -> Column:
    """0.7 x share of credits never overdue + 0.3 x (1 - mean debt share), worst debt share when unknown."""
    debt_share = F.when(F.col("AMT_CREDIT_SUM") == 0, 1.0).otherwise(
        C.ratio("AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM"))
    on_time = C.share(F.col("AMT_CREDIT_SUM_OVERDUE") == 0)
    return 0.7 * on_time + 0.3 * (1 - F.coalesce(F.avg(debt_share), F.lit(1.0)))


def open_share(bureau_balance: DataFrame) -> DataFrame:
    """Share of months in which each external credit was not closed."""
    return bureau_balance.filter(F.col("SK_ID_BUREAU").isNotNull()).groupBy("SK_ID_BUREAU").agg(
        (1 - C.share(F.col("STATUS") == "C")).alias("open_share"))


def bureau_features(bureau: DataFrame, bureau_balance: DataFrame) -> DataFrame:
    """Length of credit history, loan performance and mean open share per client."""
    return _by_client(bureau.join(open_share(bureau_balance), "SK_ID_BUREAU", "left")).agg(
        (F.abs(F.min("DAYS_CREDIT")) / F.lit(C.DAYS_PER_YEAR)).alias("CREDIT_HISTORY_YEARS"),
        loan_performance().alias("PREV_LOAN_PERFORMANCE"),
        F.avg("open_share").alias("BUREAU_ACTIVE_LOANS_RATIO_MEAN"),
    )


def previous_features(previous: DataFrame) -> DataFrame:
    """Number of earlier applications and the share that asked for cash."""
    return _by_client(previous).agg(
        F.count("*").alias("LOAN_APPLICATION_FREQUENCY"),
        C.share(F.col("NAME_CONTRACT_TYPE") == "Cash loans").alias("CASH_LOAN_PROPORTION"))


def instalment_features(instalments: DataFrame) -> DataFrame:
    """Mean days between due and paid; early payments are negative, missed ones skipped."""
    late = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    return _by_client(instalments).agg(F.avg(late).alias("AVG_PAYMENT_DELAY"))


def overdue_share(pos: DataFrame) -> DataFrame:
    return _by_client(pos).agg(C.share(F.col("SK_DPD") > 0).alias("POS_CASH_DPD_RATIO"))


def instalment_trend(pos: DataFrame) -> DataFrame:
    """Later minus earlier half of the future instalment counts, in month order."""
    order = ["MONTHS_BALANCE", "SK_ID_PREV"]
    trend = ordered_halves(pos, KEY, order, "CNT_INSTALMENT_FUTURE")
    return trend.withColumnRenamed("trend", "POS_CASH_INSTALLMENT_TREND")


def pos_features(pos: DataFrame) -> DataFrame:
    """Overdue share and instalment trend."""
    return overdue_share(pos).join(instalment_trend(pos), KEY)


# ---- client rows ---------------------------------------------------------------------------

def client_features(client: DataFrame, inquiry: Sequence[str] | None = None) -> DataFrame:
    """Features that need only the application row."""
    inquiry = columns_with_prefix(client, INQUIRY_PREFIX) if inquiry is None else list(inquiry)
    present = [c for c in inquiry if c in client.columns]
    return client.withColumns({
        "FLAG_OWN_CAR": C.yes_no("FLAG_OWN_CAR"),
        "FLAG_OWN_REALTY": C.yes_no("FLAG_OWN_REALTY"),
        "DEBT_TO_INCOME": C.ratio("AMT_CREDIT", "AMT_INCOME_TOTAL"),
        "PAYMENT_TO_INCOME": C.ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL"),
        "EMPLOYMENT_STABILITY": C.employment_band("DAYS_EMPLOYED"),
        "AGE_GROUP": C.age_band("DAYS_BIRTH"),
        "RECENT_INQUIRY_INTENSITY": C.row_sum(present),
        "SOCIAL_CIRCLE_DEFAULT_RATE": F.coalesce(
            C.ratio("DEF_30_CNT_SOCIAL_CIRCLE", "OBS_30_CNT_SOCIAL_CIRCLE"), F.lit(0.0)),
    }).withColumns({
        "FLAG_OWN_CAR": F.col("FLAG_OWN_CAR").cast("long"),
        "FLAG_OWN_REALTY": F.col("FLAG_OWN_REALTY").cast("long"),
        "ASSET_OWNERSHIP_SCORE": (F.col("FLAG_OWN_CAR") + F.col("FLAG_OWN_REALTY")).cast("long"),
    })


def flag_violations(client: DataFrame) -> DataFrame:
    """Ownership flags that are neither Y nor N, counted per column."""
    flags = ["FLAG_OWN_CAR", "FLAG_OWN_REALTY"]
    return client.agg(*[F.count(F.when(C.yes_no(c).isNull(), 1)).alias(c) for c in flags])


def history_features(tables: dict[str, DataFrame]) -> list[DataFrame]:
    """One frame per history table, each with one row per client."""
    return [
        card_features(tables["credit_card_balance"]),
        bureau_features(tables["bureau"], tables["bureau_balance"]),
        previous_features(tables["previous_application"]),
        instalment_features(tables["installments_payments"]),
        pos_features(tables["pos_cash_balance"]),
    ]


HISTORY = "history"


def history_frame(tables: dict[str, DataFrame]) -> DataFrame:
    """All history features of every client found in any history, one row each.

    Stored once, it stands in for the history tables (as ``tables["history"]``), so that small batches are
    scored without reading the histories again.
    """
    frames = history_features(tables)
    names = [c for f in frames for c in f.columns if c != KEY]
    # every feature comes from one frame, so of the stacked rows of a client at most one holds it
    stacked = frames[0]
    for features in frames[1:]:
        stacked = stacked.unionByName(features, allowMissingColumns=True)
    return stacked.groupBy(KEY).agg(*[F.max(c).alias(c) for c in names])


HISTORY_BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(KEY), F.lit(buckets)).cast("int")


class HistoryStore:
    """A stored :func:`history_frame` in folders by a hash of the client, so that a batch reads its clients' folders only."""

    def __init__(self, spark: SparkSession, path: str):
        self.buckets = files.read_params(spark, f"{path}/params")["buckets"]
        self.rows = files.read_table(spark, f"{path}/rows")

    @classmethod
    def write(cls, history: DataFrame, path: str, buckets: int = HISTORY_BUCKETS) -> HistoryStore:
        """Pick ``buckets`` so that a folder is a few files of good size; a batch lists at most that many folders."""
        spark = history.sparkSession
        placed = history.withColumn("bucket", _bucket(buckets))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
        files.write_params(spark, {"buckets": buckets}, f"{path}/params")
        return cls(spark, path)

    def of(self, clients: DataFrame) -> DataFrame:
        """History rows in the folders of ``clients``: all of theirs, and those of others in the same folders."""
        wanted = [r[0] for r in clients.select(_bucket(self.buckets)).distinct().collect()]
        return self.rows.filter(F.col("bucket").isin(wanted)).drop("bucket")


def join_histories(client: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One left join per history table, all on the client key; the row count does not change."""
    out = client
    for features in [tables[HISTORY]] if HISTORY in tables else history_features(tables):
        out = attach_one_per_key(out, features, KEY)
    return out.withColumn("INCOME_TO_CREDIT_LIMIT", C.ratio("AMT_INCOME_TOTAL", "AVG_CREDIT_LIMIT"))


# ---- fitted lookups ------------------------------------------------------------------------

@dataclass
class RiskTable:
    """Mean label per known category of one column, the unweighted mean of those means, and its size."""

    table: DataFrame
    default: float | None
    size: int


def risk_tables(client: DataFrame, columns: Sequence[str], label: str = TARGET) -> dict[str, RiskTable]:
    """Risk tables of several columns from one pass over the clients."""
    known = category_sums(client, columns, label).filter(F.col("value").isNotNull())
    means = materialize(known.select("column", "value", C.ratio("label_sum", "n").alias("risk")))
    facts = {r["column"]: r for r in means.groupBy("column").agg(
        F.avg("risk").alias("m"), byte_estimate(means).alias("bytes")).collect()}
    return {
        c: RiskTable(
            means.filter(F.col("column") == c).select(
                F.col("value").cast(client.schema[c].dataType).alias(c), "risk"),
            facts[c]["m"] if c in facts else None, facts[c]["bytes"] if c in facts else 0)
        for c in columns
    }


def apply_risk(df: DataFrame, risk: RiskTable, column: str, name: str, fill: bool = False) -> DataFrame:
    """Attach the fitted mean of ``column`` as ``name``; with ``fill``, unknown categories get the default."""
    out = lookup_join(df, risk.table.withColumnRenamed("risk", name), column, size=risk.size)
    if fill and risk.default is not None:
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(risk.default)))
    return out


# ---- behavioural score ---------------------------------------------------------------------

def _behaviour(means: dict[str, float | None] | None) -> Column:
    """Weighted score; with ``means`` None, missing parts count 0."""
    total = F.lit(0.0)
    for name, weight, inverted in BEHAVIOUR_PARTS:
        x = F.col(name).cast("double")
        part = (1 - x) if inverted else x
        if means is None:
            part = F.coalesce(part, F.lit(0.0))
        else:
            mean = means[name]
            fallback = F.lit(None) if mean is None else F.lit(1 - mean if inverted else mean)
            part = F.coalesce(part, fallback.cast("double"))
        total = total + weight * part
    return total


def fit_behaviour(df: DataFrame) -> dict:
    """Means of the parts and the range of the score, in one pass.

    Rows are grouped by which parts are missing (at most 32 groups). Within a group the filled-in parts are
    constants, so its extreme scores follow from the extremes of the known parts once the means are known.
    """
    names = [name for name, _, _ in BEHAVIOUR_PARTS]
    gaps = [F.col(name).isNull().alias(f"_gap_{name}") for name in names]
    groups = df.groupBy(*gaps).agg(
        F.min(_behaviour(None)).alias("lo"), F.max(_behaviour(None)).alias("hi"),
        *[F.sum(F.col(n).cast("double")).alias(f"s_{n}") for n in names],
        *[F.count(n).alias(f"n_{n}") for n in names],
    ).collect()
    means = {}
    for n in names:
        count = sum(g[f"n_{n}"] for g in groups)
        means[n] = sum(g[f"s_{n}"] or 0.0 for g in groups) / count if count else None

    lows, highs = [], []
    for g in groups:
        filled = 0.0
        for name, weight, inverted in BEHAVIOUR_PARTS:
            if g[f"_gap_{name}"]:
                if means[name] is None:
                    filled = None
                    break
                filled += weight * ((1 - means[name]) if inverted else means[name])
        if filled is not None:
            lows.append(g["lo"] + filled)
            highs.append(g["hi"] + filled)
    return {"means": means, "low": min(lows, default=None), "high": max(highs, default=None)}


def fold_scores(state: dict) -> dict[str, Column]:
    """Risk scores and behavioural score for every training set, over the label means ``_risk_<column>`` per set.

    Other parts of the score, and its range, do not depend on labels outside the means, and stay as fitted.
    """
    risks = {"OCCUPATION_RISK_SCORE": F.col(f"_risk_{OCCUPATION}"), "REGION_RISK_SCORE": F.col(f"_risk_{REGION}")}
    others = state["means"]

    def score(occupation: Column, region: Column) -> Column:
        at = {"OCCUPATION_RISK_SCORE": occupation, "REGION_RISK_SCORE": region}
        total = F.lit(0.0)
        for name, weight, inverted in BEHAVIOUR_PARTS:
            x = at[name] if name in at else F.coalesce(F.col(name).cast("double"), F.lit(others[name]).cast("double"))
            total = total + weight * ((1 - x) if inverted else x)
        low, high = state["low"], state["high"]
        return total if low is None or high == low else (total - F.lit(low)) / F.lit(high - low)

    return {**risks, "BEHAVIORAL_SCORE": F.zip_with(*risks.values(), score)}


def behavioural_score(state: dict) -> Column:
    """Score scaled by the fitted range; NULL when the range is empty."""
    if state["low"] is None:
        return F.lit(None).cast("double")
    return C.ratio(_behaviour(state["means"]) - F.lit(state["low"]), F.lit(state["high"] - state["low"]))


# ---- the model -----------------------------------------------------------------------------

def clean_client(client: DataFrame) -> DataFrame:
    """Employment sentinel to NULL; unknown occupation flagged, then named."""
    return client.withColumns({
        "DAYS_EMPLOYED": C.null_above("DAYS_EMPLOYED", C.EMPLOYMENT_SENTINEL_ABOVE),
        f"{OCCUPATION}_missing": C.missing_flag(OCCUPATION).cast("long"),
        OCCUPATION: F.coalesce(F.col(OCCUPATION), F.lit("Unknown")),
    })


@dataclass
class FeatureModel:
    """Fitted state of the client features: risk tables, their mean, score means and range."""

    occupation: RiskTable
    region: RiskTable
    inquiry: list[str]
    behaviour: dict = field(default_factory=dict)
    fill_region: bool = False
    compat: bool = False

    @classmethod
    def fit_transform(cls, tables: dict[str, DataFrame], label: str = TARGET, fill_region: bool = False,
                      compat: bool = False) -> tuple[FeatureModel, DataFrame]:
        """Fit on the training client table and return its features.

        ``fill_region`` gives unknown regions the mean risk; ``compat`` puts that mean into the region
        rating instead and leaves the score missing.
        """
        client = tables["client"]
        risks = risk_tables(client, [OCCUPATION, REGION], label)
        model = cls(risks[OCCUPATION], risks[REGION], columns_with_prefix(client, INQUIRY_PREFIX), {},
                    fill_region, compat)
        # histories are far larger than the client table; their join is stored, then read twice
        base = materialize(model._base(tables))
        model.behaviour = fit_behaviour(base)
        return model, model._finish(base)

    @classmethod
    def fit(cls, tables: dict[str, DataFrame], **options) -> FeatureModel:
        return cls.fit_transform(tables, **options)[0]

    def transform(self, tables: dict[str, DataFrame]) -> DataFrame:
        return self._finish(self._base(tables))

    def _base(self, tables: dict[str, DataFrame]) -> DataFrame:
        out = join_histories(client_features(tables["client"], self.inquiry), tables)
        out = apply_risk(out, self.occupation, OCCUPATION, "OCCUPATION_RISK_SCORE", fill=True)
        out = apply_risk(out, self.region, REGION, "REGION_RISK_SCORE", fill=self.fill_region)
        if self.compat:
            out = out.withColumn(REGION, F.coalesce(F.col(REGION).cast("double"), F.lit(self.region.default)))
        return out

    def _finish(self, base: DataFrame) -> DataFrame:
        return base.withColumn("BEHAVIORAL_SCORE", behavioural_score(self.behaviour))

    def save(self, spark: SparkSession, path: str) -> None:
        files.write_table(self.occupation.table, f"{path}/occupation")
        files.write_table(self.region.table, f"{path}/region")
        files.write_params(spark, {
            "occupation": [self.occupation.default, self.occupation.size],
            "region": [self.region.default, self.region.size],
            "inquiry": self.inquiry, "behaviour": self.behaviour, "fill_region": self.fill_region,
            "compat": self.compat}, f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FeatureModel:
        p = files.read_params(spark, f"{path}/params")
        return cls(RiskTable(files.read_table(spark, f"{path}/occupation"), *p["occupation"]),
                   RiskTable(files.read_table(spark, f"{path}/region"), *p["region"]),
                   p["inquiry"], p["behaviour"], p["fill_region"], p["compat"])
