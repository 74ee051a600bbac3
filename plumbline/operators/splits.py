"""Grouped folds without leakage, and the checks that say so."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .windows import by_hash


def group_labels(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label) of groups whose rows agree on the label."""
    return df.groupBy(group).agg(F.min(label).alias(label), F.max(label).alias("other_")).where(F.col(label) == F.col("other_")).drop("other_")


def grouped_folds(groups: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42, out: str = "outer_fold") -> DataFrame:
    """Folds dealt round robin within each label in the order of a hash: whole groups, stratified to within one."""
    ranked = by_hash(groups, [label], F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")), group)
    return ranked.withColumn(out, (F.col("rank_") % folds).cast("int")).drop("rank_", "total_")


def inner_validation(folds: DataFrame, group: str, label: str, n_folds: int = 5, share: float = 0.1, seed: int = 1000, fold: str = "outer_fold") -> DataFrame:
    """(outer_fold, group, label, is_inner_validation) over each fold's training groups: the first share of each label by a hash."""
    each = folds.sparkSession.range(n_folds).select(F.col("id").cast("int").alias("fold_"))
    rows = folds.crossJoin(F.broadcast(each)).where(F.col(fold) != F.col("fold_")).drop(fold).withColumnRenamed("fold_", fold)
    ranked = by_hash(rows, [fold, label], F.concat_ws("|", (F.lit(seed) + F.col(fold)).cast("string"), F.col(group).cast("string")), group)
    return ranked.select(fold, group, label, (F.col("rank_") < F.floor(F.col("total_") * share)).cast("int").alias("is_inner_validation"))


def leakage_checks(rows: DataFrame, folds: DataFrame, inner: DataFrame, group: str, label: str, n_folds: int = 5, fold: str = "outer_fold", row_id: str | None = None, text: str | None = None) -> DataFrame:
    """(name, passed): structure, disjointness, inner splits, coverage and balance, one row for each check. All in a few aggregates.

    row_id names what is unique in rows, text what rows of equal texts share; without them their checks are left out."""
    placed = rows.join(folds.select(group, fold), group)

    def disjoint(df, key, name):
        of = df.groupBy(key).agg(F.collect_set(fold).alias("of_"))  # n_folds values at most
        return of.select(F.explode("of_").alias(fold), (F.size("of_") > 1).alias("bad_")).groupBy(fold).agg(F.count_if("bad_").alias("n_")).select(F.concat(F.lit(name), F.col(fold).cast("string")).alias("name"), (F.col("n_") == 0).alias("passed"))

    apart = disjoint(folds, group, "groups_disjoint_")
    if text:
        apart = apart.unionByName(disjoint(placed, text, "texts_disjoint_"))
    sizes = rows.agg(F.count("*").alias("all_"), (F.count_distinct(row_id) if row_id else F.lit(None)).alias("ids_")).crossJoin(placed.agg(F.count("*").alias("placed_"))).crossJoin(folds.groupBy(group).count().agg(F.min("count").alias("least_")))
    covered = sizes.select(
        F.inline(
            F.array(
                *(
                    F.struct(F.lit(name).alias("name"), ok.alias("passed"))
                    for name, ok in (("every_group_is_tested", F.col("least_") >= 1), ("fold_counts_sum_to_all", F.col("placed_") == F.col("all_")), ("utterances_unique", F.col("ids_") == F.col("all_")))
                    if row_id or name != "utterances_unique"
                )
            )
        )
    )
    facts = folds.agg(F.count("*").alias("n"), F.count_distinct(group).alias("groups"), F.count_distinct(fold).alias("folds"), F.min(fold).alias("first"), F.max(fold).alias("last"))
    lost = rows.select(group).distinct().join(folds, group, "left_anti").agg(F.count("*").alias("lost"))
    strange = folds.join(rows.select(group).distinct(), group, "left_anti").agg(F.count("*").alias("strange"))
    mixed = rows.groupBy(group).agg(F.count_distinct(label).alias("k")).agg(F.count_if(F.col("k") > 1).alias("mixed"))
    leaks = inner.join(folds.select(group, F.col(fold).alias("own_")), group).groupBy(fold).agg(F.count_if(F.col("own_") == F.col(fold)).alias("leaks"), F.count_if(F.col("is_inner_validation") == 1).alias("held"), F.count("*").alias("size"), F.count_distinct(group).alias("distinct"))
    named = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("passed"))
    whole = facts.crossJoin(lost).crossJoin(strange).crossJoin(mixed)
    first = whole.select(
        F.explode(
            F.array(
                named("one_fold_per_group", F.col("n") == F.col("groups")),
                named("fold_count", F.col("folds") == n_folds),
                named("fold_range", (F.col("first") == 0) & (F.col("last") == n_folds - 1)),
                named("every_group_has_a_fold", F.col("lost") == 0),
                named("no_unknown_group", F.col("strange") == 0),
                named("groups_agree_on_label", F.col("mixed") == 0),
            )
        ).alias("x")
    ).select("x.*")
    per = leaks.select(
        F.explode(
            F.array(
                *(
                    F.struct(F.concat(F.lit(name), F.col(fold).cast("string")).alias("name"), ok.alias("passed"))
                    for name, ok in (("inner_without_test_groups_", F.col("leaks") == 0), ("inner_has_validation_", F.col("held") > 0), ("inner_keeps_training_", F.col("held") < F.col("size")), ("inner_groups_once_", F.col("size") == F.col("distinct")))
                )
            )
        ).alias("x")
    ).select("x.*")
    overall = folds.agg(F.avg(label).alias("all_"))
    balance = folds.groupBy(fold).agg(F.avg(label).alias("own_")).crossJoin(overall).select(F.concat(F.lit("balance_"), F.col(fold).cast("string")).alias("name"), (F.abs(F.col("own_") - F.col("all_")) <= 0.1).alias("passed"))
    return first.unionByName(apart).unionByName(per).unionByName(covered).unionByName(balance)
