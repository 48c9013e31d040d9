"""Scoring of arriving client files against stored history tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from creditspark.functions.columns import nan_to_null
from creditspark.operators.joins import lookup_join
from creditspark.plans.features import HISTORY, HistoryStore
from creditspark.plans.scoring import ScoringModel
from creditspark.session import materialize
from creditspark.sources import files
from creditspark.sources.schemas import CLIENT, KEY


def client_stream(spark: SparkSession, folder: str, schema: T.StructType = CLIENT, form: str = "csv",
                  files_per_trigger: int | None = None) -> DataFrame:
    """Stream of client rows from files dropped into ``folder``."""
    reader = spark.readStream.format(form).schema(schema)
    if form == "csv":
        reader = reader.options(header=True, mode="FAILFAST")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def score_stream(clients: DataFrame, history: HistoryStore, model: ScoringModel, out: str,
                 checkpoint: str, once: bool = True) -> StreamingQuery:
    """Score every micro-batch with fitted values and write JSON records under ``out``.

    ``history`` holds one row per client in folders by a hash of the client, so a batch reads neither the raw
    histories nor the folders of other clients. No state is kept between batches. Each batch writes its own folder, so a batch replayed after a
    failure replaces its records instead of repeating them.
    """
    def one(batch: DataFrame, number: int) -> None:
        rows = materialize(nan_to_null(batch))
        # the batch decides which history rows are needed; measured small, its keys are broadcast
        mine = lookup_join(history.of(rows), rows.select(KEY).distinct(), KEY, "left_semi")
        files.write_scores(model.score({"client": rows, HISTORY: mine}), f"{out}/batch={number}")

    writer = clients.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_scores(spark: SparkSession, out: str) -> DataFrame:
    """All records written so far."""
    schema = "client_id long, default_probability double, risk_score string"
    return spark.read.schema(schema).json(f"{out}/batch=*")
