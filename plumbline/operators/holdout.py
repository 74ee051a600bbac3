"""Joint holdout: a row is tested by a model that saw neither its speaker nor its fold in training."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import GateError
from .many_models import fit, tested_probabilities

#: The names of the protocols: model numbers below speakers * folds belong to the first.
JOINT, SHARED = "joint", "shared"


@dataclass(frozen=True)
class Holdout:
    """A design of many_models over rows (speaker: from 0, fold, label): a model for each speaker and fold, which trains on rows of neither, then one for each fold that trains on the other folds' rows of all speakers."""

    speakers: int
    folds: int

    @property
    def models(self) -> int:
        return self.speakers * self.folds + self.folds

    def labels(self, batch):
        return batch.column("label").to_numpy().astype(float)[:, None]

    def _same(self, batch):
        speaker = batch.column("speaker").to_numpy()[:, None] == np.arange(self.speakers)
        return speaker[:, :, None], (batch.column("fold").to_numpy()[:, None] == np.arange(self.folds))

    def training(self, batch):
        speaker, fold = self._same(batch)
        return np.concatenate([(~speaker & ~fold[:, None]).reshape(batch.num_rows, -1), ~fold], 1)

    def tested(self, batch):
        speaker, fold = self._same(batch)
        return np.concatenate([(speaker & fold[:, None]).reshape(batch.num_rows, -1), fold], 1)


def holdout_predictions(rows: DataFrame, key: str, width: int, speaker: str = "speaker_id", fold: str = "outer_fold", folds: int = 5) -> DataFrame:
    """(key, speaker, fold, label, protocol, prob) for rows with x (array of width doubles): of each row one prediction by the model without its speaker and its
    fold, and one by the model without its fold. All models are fitted together; the number of speakers times folds bounds a task's memory."""
    names = sorted(r[0] for r in rows.select(speaker).distinct().collect())
    # a row's speaker as its place in the list
    placed = rows.withColumn("speaker", (F.array_position(F.array(*map(F.lit, names)), F.col(speaker)) - 1).cast("int")).withColumn("fold", F.col(fold))
    design = Holdout(len(names), folds)
    fits = fit(placed, width, design)
    said = tested_probabilities(placed, fits, design, [key, speaker, fold, "label"])
    return said.withColumn("protocol", F.when(F.col("model") < len(names) * folds, JOINT).otherwise(SHARED)).drop("model")


def assert_one_prediction(rows: DataFrame, said: DataFrame, key: str) -> DataFrame:
    """(protocol, recordings, predictions, least, most), if each protocol has exactly one prediction of every row; an error otherwise."""
    per = rows.select(key).crossJoin(F.broadcast(said.sparkSession.createDataFrame([(JOINT,), (SHARED,)], "protocol string"))).join(said.groupBy(key, "protocol").agg(F.count("*").alias("k")), [key, "protocol"], "left")
    k = F.coalesce("k", F.lit(0))
    out = per.groupBy("protocol").agg(F.count("*").alias("recordings"), F.sum(k).alias("predictions"), F.min(k).alias("least"), F.max(k).alias("most"))
    bad = out.where("least <> 1 or most <> 1").collect()
    if bad:
        raise GateError(f"not one prediction of every row: {bad[0].asDict()}")
    return out
