from __future__ import annotations

import pytest

from creditspark.plans import features as P
from tests.frames import client, histories, many_clients, one_client, only, rows_by_client, without_target


def test_application_row_features(spark):
    df = client(spark, [
        one_client(AMT_REQ_CREDIT_BUREAU_QRT=1.0, AMT_REQ_CREDIT_BUREAU_YEAR=3.0, OBS_30_CNT_SOCIAL_CIRCLE=2.0,
                   DEF_30_CNT_SOCIAL_CIRCLE=0.0),
        one_client(SK_ID_CURR=2, AMT_INCOME_TOTAL=0.0, DAYS_EMPLOYED=365243, FLAG_OWN_CAR="N", FLAG_OWN_REALTY="X",
                   OBS_30_CNT_SOCIAL_CIRCLE=0.0, DEF_30_CNT_SOCIAL_CIRCLE=1.0),
    ])
    got = rows_by_client(P.client_features(df))
    one, two = got[1], got[2]
    assert one["DEBT_TO_INCOME"] == pytest.approx(1.646) and one["PAYMENT_TO_INCOME"] == pytest.approx(0.1205)
    assert one["EMPLOYMENT_STABILITY"] == "1-3y" and one["AGE_GROUP"] == "35-45"
    assert one["RECENT_INQUIRY_INTENSITY"] == 4.0 and one["ASSET_OWNERSHIP_SCORE"] == 2
    assert one["SOCIAL_CIRCLE_DEFAULT_RATE"] == 0.0 and one["FLAG_OWN_CAR"] == 1
    assert two["DEBT_TO_INCOME"] is None and two["EMPLOYMENT_STABILITY"] is None
    assert two["RECENT_INQUIRY_INTENSITY"] == 0.0 and two["ASSET_OWNERSHIP_SCORE"] is None
    assert two["SOCIAL_CIRCLE_DEFAULT_RATE"] == 0.0
    assert P.flag_violations(df).first().asDict() == {"FLAG_OWN_CAR": 0, "FLAG_OWN_REALTY": 1}


def test_card_features(spark):
    cards = [dict(SK_ID_CURR=1, AMT_BALANCE=0.0, AMT_CREDIT_LIMIT_ACTUAL=45000, AMT_DRAWINGS_ATM_CURRENT=2.0,
                  AMT_DRAWINGS_CURRENT=8.0),
             dict(SK_ID_CURR=1, AMT_BALANCE=67500.0, AMT_CREDIT_LIMIT_ACTUAL=135000, AMT_DRAWINGS_CURRENT=0.0),
             dict(SK_ID_CURR=2, AMT_BALANCE=5.0, AMT_CREDIT_LIMIT_ACTUAL=0), dict(SK_ID_CURR=2, AMT_BALANCE=5.0),
             dict(AMT_BALANCE=9.0, AMT_CREDIT_LIMIT_ACTUAL=1)]
    got = rows_by_client(P.card_features(histories(spark, cards=cards)["credit_card_balance"]))
    assert got[1]["CREDIT_UTILIZATION"] == 0.25 and got[1]["AVG_CREDIT_LIMIT"] == 90000.0
    assert got[1]["CC_SPENDING_RATIO"] == 0.5  # 2 over the mean of 8 and 0
    assert got[2]["CREDIT_UTILIZATION"] == 0.0 and got[2]["CC_SPENDING_RATIO"] == 0.0
    assert set(got) == {1, 2}


def test_bureau_features(spark):
    bureau = [dict(SK_ID_CURR=1, SK_ID_BUREAU=10, DAYS_CREDIT=-17, AMT_CREDIT_SUM=100.0, AMT_CREDIT_SUM_DEBT=100.0,
                   AMT_CREDIT_SUM_OVERDUE=0.0),
              dict(SK_ID_CURR=2, SK_ID_BUREAU=20, DAYS_CREDIT=-10, AMT_CREDIT_SUM=0.0, AMT_CREDIT_SUM_OVERDUE=0.0),
              dict(SK_ID_CURR=2, SK_ID_BUREAU=21, DAYS_CREDIT=-730, AMT_CREDIT_SUM_DEBT=5.0),
              dict(SK_ID_CURR=2, SK_ID_BUREAU=22, DAYS_CREDIT=-3, AMT_CREDIT_SUM=10.0, AMT_CREDIT_SUM_DEBT=2.0,
                   AMT_CREDIT_SUM_OVERDUE=1.0),
              dict(SK_ID_CURR=3, SK_ID_BUREAU=30, AMT_CREDIT_SUM_OVERDUE=None)]
    balance = [dict(SK_ID_BUREAU=10, STATUS="0"), dict(SK_ID_BUREAU=20, STATUS="C"), dict(SK_ID_BUREAU=20),
               dict(SK_ID_BUREAU=22, STATUS="0"), dict(STATUS="C")]
    tables = histories(spark, bureau=bureau, balance=balance)
    got = rows_by_client(P.bureau_features(tables["bureau"], tables["bureau_balance"]))
    assert got[1]["CREDIT_HISTORY_YEARS"] == pytest.approx(17 / 365)
    assert got[1]["PREV_LOAN_PERFORMANCE"] == pytest.approx(0.7)
    assert got[1]["BUREAU_ACTIVE_LOANS_RATIO_MEAN"] == 1.0
    # a NULL overdue counts as not on time; debt shares are 1 (zero sum), skipped (NULL sum) and 0.2
    assert got[2]["PREV_LOAN_PERFORMANCE"] == pytest.approx(0.7 / 3 + 0.3 * (1 - 0.6))
    assert got[2]["CREDIT_HISTORY_YEARS"] == 2.0
    assert got[2]["BUREAU_ACTIVE_LOANS_RATIO_MEAN"] == pytest.approx(0.75)
    assert got[3]["PREV_LOAN_PERFORMANCE"] == 0.0 and got[3]["CREDIT_HISTORY_YEARS"] is None
    assert got[3]["BUREAU_ACTIVE_LOANS_RATIO_MEAN"] is None


def test_other_histories(spark):
    previous = [dict(SK_ID_CURR=1, NAME_CONTRACT_TYPE="Cash loans"), dict(SK_ID_CURR=1), dict(SK_ID_CURR=None)]
    instalments = [dict(SK_ID_CURR=1, DAYS_INSTALMENT=-10.0, DAYS_ENTRY_PAYMENT=-14.0),
                   dict(SK_ID_CURR=1, DAYS_INSTALMENT=-10.0, DAYS_ENTRY_PAYMENT=-9.0),
                   dict(SK_ID_CURR=1, DAYS_INSTALMENT=-10.0)]
    pos = [dict(SK_ID_CURR=1, SK_ID_PREV=p, MONTHS_BALANCE=m, CNT_INSTALMENT_FUTURE=v, SK_DPD=d)
           for p, m, v, d in ((2, -1, 4.0, 0), (1, -1, 6.0, None), (1, -2, 10.0, 3))]
    pos.append(dict(SK_ID_CURR=2, SK_ID_PREV=5, MONTHS_BALANCE=0, CNT_INSTALMENT_FUTURE=3.0, SK_DPD=0))
    t = histories(spark, previous=previous, instalments=instalments, pos=pos)
    assert rows_by_client(P.previous_features(t["previous_application"]))[1] == {
        "SK_ID_CURR": 1, "LOAN_APPLICATION_FREQUENCY": 2, "CASH_LOAN_PROPORTION": 0.5}
    assert rows_by_client(P.instalment_features(t["installments_payments"]))[1]["AVG_PAYMENT_DELAY"] == -1.5
    got = rows_by_client(P.pos_features(t["pos_cash_balance"]))
    assert got[1]["POS_CASH_DPD_RATIO"] == pytest.approx(1 / 3)
    assert got[1]["POS_CASH_INSTALLMENT_TREND"] == 5.0 - 10.0
    assert got[2]["POS_CASH_INSTALLMENT_TREND"] == 0.0


def test_clients_without_histories_stay_null(spark):
    tables = {"client": client(spark, [one_client(), one_client(SK_ID_CURR=2, TARGET=1)]), **histories(spark)}
    _, frame = P.FeatureModel.fit_transform(tables)
    got = rows_by_client(frame)
    assert set(got) == {1, 2}
    for name in ("CREDIT_UTILIZATION", "CC_SPENDING_RATIO", "CREDIT_HISTORY_YEARS", "PREV_LOAN_PERFORMANCE",
                 "LOAN_APPLICATION_FREQUENCY", "CASH_LOAN_PROPORTION", "AVG_PAYMENT_DELAY", "POS_CASH_DPD_RATIO",
                 "POS_CASH_INSTALLMENT_TREND", "BUREAU_ACTIVE_LOANS_RATIO_MEAN", "BEHAVIORAL_SCORE"):
        assert got[1][name] is None, name


def test_risk_tables_and_defaults(spark):
    rows = [one_client(SK_ID_CURR=i, TARGET=t, OCCUPATION_TYPE=o, REGION_RATING_CLIENT_W_CITY=r)
            for i, (t, o, r) in enumerate([(1, "a", 1), (0, "a", 1), (0, "b", 2), (0, "b", None), (1, None, 1)])]
    tables = {"client": client(spark, rows), **histories(spark)}
    got = rows_by_client(P.FeatureModel.fit_transform(tables)[1])
    assert got[0]["OCCUPATION_RISK_SCORE"] == 0.5 and got[2]["OCCUPATION_RISK_SCORE"] == 0.0
    assert got[4]["OCCUPATION_RISK_SCORE"] == 0.25  # mean of the category means
    assert got[0]["REGION_RISK_SCORE"] == pytest.approx(2 / 3) and got[3]["REGION_RISK_SCORE"] is None
    filled = rows_by_client(P.FeatureModel.fit_transform(tables, fill_region=True)[1])
    assert filled[3]["REGION_RISK_SCORE"] == pytest.approx(1 / 3)
    compat = rows_by_client(P.FeatureModel.fit_transform(tables, compat=True)[1])
    assert compat[3]["REGION_RATING_CLIENT_W_CITY"] == pytest.approx(1 / 3)
    assert compat[3]["REGION_RISK_SCORE"] is None


def brute_behaviour(rows):
    parts = [("OCCUPATION_RISK_SCORE", 0.2, 0), ("REGION_RISK_SCORE", 0.2, 0), ("PREV_LOAN_PERFORMANCE", 0.3, 0),
             ("CREDIT_UTILIZATION", 0.15, 1), ("DEBT_TO_INCOME", 0.15, 1)]
    means = {}
    for name, _, _ in parts:
        known = [r[name] for r in rows.values() if r[name] is not None]
        means[name] = sum(known) / len(known)
    raw = {}
    for key, r in rows.items():
        x = {n: means[n] if r[n] is None else r[n] for n, _, _ in parts}
        raw[key] = sum(w * (1 - x[n] if inverted else x[n]) for n, w, inverted in parts)
    low, high = min(raw.values()), max(raw.values())
    return {k: (v - low) / (high - low) for k, v in raw.items()}


def test_behavioural_score_on_train_equals_the_two_pass_definition(spark):
    _, frame = P.FeatureModel.fit_transform(many_clients(spark, 80))
    got = rows_by_client(frame)
    for key, value in brute_behaviour(got).items():
        assert got[key]["BEHAVIORAL_SCORE"] == pytest.approx(value, abs=1e-12)


def test_saved_model_scores_one_client_as_in_the_full_batch(spark, tmp_path):
    tables = many_clients(spark, 60)
    model, frame = P.FeatureModel.fit_transform(tables)
    model.save(spark, str(tmp_path / "features"))
    loaded = P.FeatureModel.load(spark, str(tmp_path / "features"))
    whole = rows_by_client(frame.drop("TARGET"))
    alone = rows_by_client(loaded.transform(only(without_target(tables), 17)))
    assert set(alone) == {17} and alone[17].keys() == whole[17].keys()
    for name, value in alone[17].items():
        want = whole[17][name]
        assert value == (pytest.approx(want) if isinstance(want, float) else want), name


def test_clean_client_flags_before_filling(spark):
    df = client(spark, [one_client(OCCUPATION_TYPE=None, DAYS_EMPLOYED=365243), one_client(SK_ID_CURR=2)])
    got = rows_by_client(P.clean_client(df))
    assert (got[1]["OCCUPATION_TYPE"], got[1]["OCCUPATION_TYPE_missing"], got[1]["DAYS_EMPLOYED"]) == ("Unknown", 1, None)
    assert got[2]["OCCUPATION_TYPE_missing"] == 0
