"""Word error rates: by utterance, over a corpus, by class and bin, and audits of decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .quantiles import wide_quantiles


def utterance_rates(errors: DataFrame) -> DataFrame:
    """Adds wer (errors over reference words, one at least) and is_empty."""
    return errors.withColumn("wer", F.col("errors") / F.greatest("n_ref", F.lit(1))).withColumn("is_empty", F.col("n_hyp") == 0)


def corpus_rates(rows: DataFrame, system: str, speaker: str) -> DataFrame:
    """Ratios of sums by system and speaker, and by system as speaker 'all', in one grouping-sets pass."""
    both = rows.groupingSets([[system, speaker], [system]], system, speaker).agg(
        F.sum("errors").alias("errors"), F.sum("n_ref").alias("n_ref"), F.round(F.sum("errors") / F.sum("n_ref"), 9).alias("wer"), F.count_if(F.col("errors") == 0).alias("exact"), F.percentile("wer", 0.5).alias("median_wer")
    )
    return both.withColumn(speaker, F.coalesce(speaker, F.lit("all")))


def corpus_char_rates(rows: DataFrame, system: str, speaker: str) -> DataFrame:
    """Character error rates by system and speaker, and by system as speaker 'all'."""
    both = rows.groupingSets([[system, speaker], [system]], system, speaker).agg(
        F.sum("char_errors").alias("char_errors"), F.sum("n_chars").alias("n_chars"), F.round(F.sum("char_errors") / F.sum("n_chars"), 9).alias("cer")
    )
    return both.withColumn(speaker, F.coalesce(speaker, F.lit("all")))


def score(rows: DataFrame, keys: list[str]) -> DataFrame:
    rate = lambda c: F.round(F.avg(c.cast("double")), 9)
    return rows.groupBy(*keys).agg(F.round(F.sum("errors") / F.sum("n_ref"), 9).alias("wer"), rate(F.col("n_hyp") == 0).alias("empty_rate"), rate(F.array_join("hyp", " ").rlike("[A-Za-z]")).alias("latin_rate"))


def class_gap(rows: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Rates of both classes by system, their difference and whether it is clear."""
    wide = rows.groupBy("system", "label").agg((F.sum("errors") / F.sum("n_ref")).alias("wer")).groupBy("system").pivot("label", [1, 0]).agg(F.first("wer"))
    gap = F.col("1") - F.col("0")
    return wide.select("system", F.round("1", 9).alias("positive"), F.round("0", 9).alias("negative"), F.round(gap, 9).alias("gap"), (F.abs(gap) >= threshold).alias("clear"))


def tertile_bins(rows: DataFrame) -> DataFrame:
    """Adds bin: zero, or low, middle, high by the tertiles of a system's positive rates, right-closed. A system without errors has zero only."""
    edges = wide_quantiles(rows.where("errors > 0"), ["system"], "wer", {"e1_": 1 / 3, "e2_": 2 / 3}).select("system", F.array("e1_", "e2_").alias("edges"))
    bins = F.when(F.col("errors") == 0, "zero").when(F.col("wer") <= F.col("edges")[0], "low").when(F.col("wer") <= F.col("edges")[1], "middle").otherwise("high")
    return rows.join(F.broadcast(edges), "system", "left").withColumn("bin", bins).drop("edges")


def decoding_facts(rows: DataFrame, compressed: float | None = 2.4, longer: float = 1.5, cap: int | None = None, text_: str = "hyp", operations: str | None = None) -> DataFrame:
    """rows (system, gold, hyp, n_ref, n_hyp) as (system, n_ref, n_hyp, insertions, loop, compressible, flagged, long, latin, empty, capped, ratio).

    A row is flagged for a loop or, unless compressed is None, for a text that zlib makes more than that many times smaller. capped: as many
    tokens as cap, or one less; false without a cap. operations names a column of edit_operations that is there already."""
    joined = F.array_join(text_, " ")
    loop = text.has_repetition_loop(F.col(text_))
    compressible = text.compression_ratio(joined) > compressed if compressed is not None else F.lit(False)
    made = rows.withColumn("e_", F.col(operations) if operations else text.edit_operations("gold", text_)).withColumn("loop", loop).withColumn("compressible", compressible)
    ratio = F.col("n_hyp") / F.greatest("n_ref", F.lit(1))
    return made.select(
        "system", "n_ref", "n_hyp", F.col("e_.insertions").alias("insertions"), "loop", "compressible", (F.col("loop") | F.col("compressible")).alias("flagged"),
        (F.col("n_hyp") > longer * F.col("n_ref")).alias("long"), joined.rlike("[A-Za-z]").alias("latin"), (F.col("n_hyp") == 0).alias("empty"),
        (F.col("n_hyp") >= cap - 1 if cap is not None else F.lit(False)).alias("capped"), ratio.alias("ratio"),
    )


def decoding_audit(facts: DataFrame, defect: float = 0.01, digits: int = 9) -> DataFrame:
    """decoding_facts() by system: flags, insertion rates of all and of unflagged rows, the share of insertions that flagged rows hold, quantiles of the length ratio, and
    truncation_defect, which is a share of at least defect of the rows at the cap. facts should be stored, as its ratios are read a few times."""
    share = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), digits)
    clean = F.when(~F.col("flagged"), F.col("insertions")), F.when(~F.col("flagged"), F.col("n_ref"))
    inserted = F.sum("insertions")
    ranks = {f"ratio_p{round(100 * q)}": q for q in (0.5, 0.9, 0.99, 1.0)}
    found = wide_quantiles(facts, ["system"], "ratio", ranks).select("system", *(F.round(k, digits).alias(k) for k in ranks))
    out = facts.groupBy("system").agg(
        F.count("*").alias("n"), *(F.count_if(c).alias(name) for c, name in (("loop", "loops"), ("compressible", "compressible"), ("flagged", "flagged"), ("long", "long"), ("latin", "latin"), ("empty", "empty"), ("capped", "capped"))),
        share(inserted, F.sum("n_ref")).alias("insertion_rate"), share(F.sum(clean[0]), F.sum(clean[1])).alias("unflagged_insertion_rate"),
        share(F.sum(F.when(F.col("flagged"), F.col("insertions")).otherwise(0)), F.greatest(inserted, F.lit(1))).alias("flagged_insertion_share"),
        (F.count_if("capped") >= defect * F.count("*")).alias("truncation_defect"),
    )
    return out.join(F.broadcast(found), "system")

