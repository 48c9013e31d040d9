"""Small hand-made lending tables with the edge rows every feature must handle."""

from __future__ import annotations

from pyspark.sql import functions as F

from creditspark.operators.align import align_to
from creditspark.sources import schemas as S


def frame(spark, schema, rows):
    """Rows given as dictionaries; absent columns are NULL."""
    names = sorted({k for r in rows for k in r}) or [schema.fields[0].name]
    kinds = {f.name: f.dataType.simpleString() for f in schema.fields}
    ddl = ", ".join(f"{n} {kinds[n]}" for n in names)
    return align_to(spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ddl), schema)


def client(spark, rows):
    return frame(spark, S.CLIENT_TRAIN, rows)


def histories(spark, cards=(), bureau=(), balance=(), previous=(), instalments=(), pos=()):
    return {
        "credit_card_balance": frame(spark, S.CARDS, list(cards)),
        "bureau": frame(spark, S.BUREAU, list(bureau)),
        "bureau_balance": frame(spark, S.BUREAU_BALANCE, list(balance)),
        "previous_application": frame(spark, S.PREVIOUS, list(previous)),
        "installments_payments": frame(spark, S.INSTALMENTS, list(instalments)),
        "pos_cash_balance": frame(spark, S.POS, list(pos)),
    }


def one_client(**values):
    base = dict(SK_ID_CURR=1, TARGET=0, AMT_INCOME_TOTAL=180000.0, AMT_CREDIT=296280.0, AMT_ANNUITY=21690.0,
                DAYS_EMPLOYED=-1007, DAYS_BIRTH=-13563, FLAG_OWN_CAR="Y", FLAG_OWN_REALTY="Y",
                OCCUPATION_TYPE="Drivers", REGION_RATING_CLIENT_W_CITY=2)
    return {**base, **values}


def many_clients(spark, n=200):
    """Clients whose debt separates the classes, with every history."""
    rows, cards, bureau, balance, previous, instalments, pos = [], [], [], [], [], [], []
    for i in range(n):
        bad = i % 4 == 0
        rows.append(one_client(
            SK_ID_CURR=i, TARGET=int(bad), AMT_CREDIT=float(500000 + 100 * i if bad else 90000 + 50 * i),
            OCCUPATION_TYPE=[None, "Drivers", "Managers", "Cooks"][i % 4 if i % 9 else 0],
            REGION_RATING_CLIENT_W_CITY=1 + i % 3, DAYS_EMPLOYED=365243 if i % 10 == 0 else -100 * (i % 30),
            ORGANIZATION_TYPE=f"Type {i % 13}", CNT_CHILDREN=i % 3, EXT_SOURCE_1=None if i % 5 else i / n))
        cards += [dict(SK_ID_CURR=i, SK_ID_PREV=i, AMT_BALANCE=100.0 * i, AMT_CREDIT_LIMIT_ACTUAL=1000 * (m % 3),
                       AMT_DRAWINGS_ATM_CURRENT=5.0, AMT_DRAWINGS_CURRENT=10.0) for m in range(i % 4)]
        bureau += [dict(SK_ID_CURR=i, SK_ID_BUREAU=10 * i + b, DAYS_CREDIT=-400 * (b + 1), AMT_CREDIT_SUM=1000.0,
                        AMT_CREDIT_SUM_DEBT=900.0 if bad else 100.0, AMT_CREDIT_SUM_OVERDUE=50.0 * bad)
                   for b in range(i % 3)]
        balance += [dict(SK_ID_BUREAU=10 * i, MONTHS_BALANCE=-m, STATUS="C" if m % 2 else "0") for m in range(3)]
        previous.append(dict(SK_ID_CURR=i, SK_ID_PREV=i, NAME_CONTRACT_TYPE="Cash loans" if i % 2 else None))
        instalments.append(dict(SK_ID_CURR=i, SK_ID_PREV=i, DAYS_INSTALMENT=-10.0,
                                DAYS_ENTRY_PAYMENT=-12.0 + 5 * bad))
        pos += [dict(SK_ID_CURR=i, SK_ID_PREV=i, MONTHS_BALANCE=-m, CNT_INSTALMENT_FUTURE=float(m), SK_DPD=m % 2)
                for m in range(i % 5)]
    return {"client": client(spark, rows), **histories(spark, cards, bureau, balance, previous, instalments, pos)}


def rows_by_client(df):
    return {r[S.KEY]: r.asDict() for r in df.collect()}


def without_target(tables):
    return {**tables, "client": tables["client"].drop(S.TARGET)}


def only(tables, key):
    return {**tables, "client": tables["client"].filter(F.col(S.KEY) == key)}
