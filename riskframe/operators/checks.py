"""Validation and comparison. Checks return counts of violations; ``require_none`` raises on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.scalars import exact_cents, hash_draw, safe_divide
from riskframe.operators.history import history_provenance


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("bigint")), F.lit(0))


def stacked(row: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """One row of numbers as (metric, value) rows."""
    columns = row.columns
    return row.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, name, value)


def require_none(violations: DataFrame, column: str = "violations") -> DataFrame:
    """Raise if any check found a violation (check tables have a handful of rows)."""
    found = [r.asDict() for r in violations.where(F.col(column) > 0).limit(20).collect()]
    if found:
        raise ValueError(f"integrity checks failed: {found}")
    return violations


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def validate_transactions(df: DataFrame, time: str, amount: str, label: str) -> DataFrame:
    """Non-empty, both classes, binary label, non-negative non-null time and amount."""
    require_columns(df, [time, amount, label])
    t, a, y = F.col(time), F.col(amount), F.col(label)
    row = df.agg(
        (F.count("*") == 0).cast("bigint").alias("empty"),
        _count(t.isNull() | (t < 0)).alias("bad_time"),
        _count(a.isNull() | (a < 0)).alias("bad_amount"),
        _count(y.isNull() | ~y.isin(0, 1)).alias("bad_label"),
        F.when((_count(y == 1) == 0) | (_count(y == 0) == 0), 1).otherwise(0).alias("one_class"),
    )
    return stacked(row, "check", "violations")


def profile(df: DataFrame, time: str, label: str, core: Sequence[str]) -> DataFrame:
    """Rows, positives, rate, time span, rows with a null core field, invalid labels, columns."""
    empty = F.lit(False)
    for c in core:
        empty = empty | F.col(c).isNull()
    y = F.col(label)
    return df.agg(
        F.count("*").alias("rows"), F.sum(y).cast("bigint").alias("positives"), F.avg(y).alias("rate"), F.min(time).alias("min_time"),
        F.max(time).alias("max_time"), _count(empty).alias("null_rows"), _count(~y.isin(0, 1)).alias("invalid_labels"),
    ).withColumn("columns", F.lit(len(df.columns)))


def key_integrity(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, missing keys and uniqueness; a key with a null part counts as missing."""
    missing = F.lit(False)
    for c in key:
        missing = missing | F.col(c).isNull()
    grouped = df.groupBy(*key).agg(F.count("*").alias("n")).withColumn("_missing", missing)
    return grouped.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        _count(~F.col("_missing")).alias("distinct_keys"),
        F.coalesce(F.sum(F.when(F.col("_missing"), F.col("n"))), F.lit(0)).alias("missing_keys"),
        _count(~F.col("_missing") & (F.col("n") > 1)).alias("repeated_keys"),
    ).withColumn("is_unique", ((F.col("missing_keys") == 0) & (F.col("repeated_keys") == 0)).cast("int"))


def label_audit(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label)
    row = df.agg(
        F.count("*").alias("rows"), _count(y == 1).alias("positives"), _count(y == 0).alias("negatives"),
        _count(y.isNull()).alias("missing"), _count(~y.isin(0, 1)).alias("invalid"), F.avg(y).alias("rate"),
    )
    return stacked(row)


def integrity_violations(df: DataFrame, key: Sequence[str], label: str, time: str, amount: str) -> DataFrame:
    keys = key_integrity(df, key).select(
        F.explode(
            F.array(
                F.struct(F.lit("missing_key").alias("check"), F.col("missing_keys").cast("double").alias("violations")),
                F.struct(F.lit("repeated_key").alias("check"), F.col("repeated_keys").cast("double").alias("violations")),
            )
        ).alias("e")
    ).select("e.*")
    return keys.unionByName(validate_transactions(df, time, amount, label))


def require_integrity(df: DataFrame, key: Sequence[str], label: str, time: str, amount: str) -> DataFrame:
    require_none(integrity_violations(df, key, label, time, amount))
    return df


def require_fields(df: DataFrame, text: Sequence[str], step: str, identity: str, low: int, high: int) -> DataFrame:
    """Empty required text, non-digit or out-of-range step text, missing or negative id; plus repeated ids."""
    checks = [_count(F.col(c).isNull() | (F.trim(F.col(c)) == "")).alias(f"empty_{c}") for c in text]
    digits = F.coalesce(F.col(step).rlike("^[0-9]{1,18}$"), F.lit(False))
    number = F.when(digits, F.col(step)).cast("bigint")
    row = df.agg(
        *checks,
        _count(~digits).alias("bad_step"),
        _count(number.isNotNull() & ~number.between(low, high)).alias("step_out_of_range"),
        _count(F.col(identity).isNull() | (F.col(identity) < 0)).alias("bad_id"),
    )
    repeated = df.groupBy(identity).agg(F.count("*").alias("n")).agg(_count(F.col("n") > 1).cast("double").alias("violations"))
    return stacked(row, "check", "violations").unionByName(repeated.select(F.lit("repeated_id").alias("check"), "violations"))


def cents_audit(df: DataFrame, text: str) -> DataFrame:
    """Accepted and rejected decimal texts, and the exact total in cents."""
    cents = exact_cents(F.col(text))
    return df.agg(
        F.count("*").alias("rows"), F.count(cents).alias("accepted"), _count(F.col(text).isNotNull() & cents.isNull()).alias("rejected"),
        F.sum(cents.cast("decimal(38,0)")).cast("bigint").alias("total_cents"),
    )


def moment_overflow_guard(df: DataFrame, cents: str) -> DataFrame:
    """(n max)^2 must stay inside a 38-digit decimal before exact second moments are taken."""
    reach = F.count("*").cast("double") * F.max(F.abs(F.col(cents))).cast("double")
    return df.agg(F.count("*").alias("rows"), F.max(F.abs(F.col(cents))).alias("largest"), (reach * reach < F.lit(1e38)).cast("int").alias("safe"))


# ---- comparisons -------------------------------------------------------------------------------


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose number of copies differs between the two tables, with the signed difference.

    The same answer as ``exceptAll`` both ways, in one shuffle with map-side sums; nulls match.
    """
    both = a.select(*columns, F.lit(1).cast("bigint").alias("_d")).unionByName(b.select(*columns, F.lit(-1).cast("bigint").alias("_d")))
    return both.groupBy(*columns).agg(F.sum("_d").alias("difference")).where(F.col("difference") != 0)


def one_to_one(a: DataFrame, b: DataFrame, keys: Sequence[str], equal: Sequence[str]) -> DataFrame:
    """Unmatched, repeated and unequal rows of two tables that should pair exactly."""
    left = a.groupBy(*keys).agg(F.count("*").alias("_na"), *[F.min(c).alias(f"_a_{c}") for c in equal])
    right = b.groupBy(*keys).agg(F.count("*").alias("_nb"), *[F.min(c).alias(f"_b_{c}") for c in equal])
    differ = F.lit(False)
    for c in equal:
        differ = differ | ~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}"))
    here = F.col("_na").isNotNull() & F.col("_nb").isNotNull()
    return left.join(right, list(keys), "full").agg(
        F.count("*").alias("keys"), _count(F.col("_nb").isNull()).alias("left_only"), _count(F.col("_na").isNull()).alias("right_only"),
        _count((F.col("_na") > 1) | (F.col("_nb") > 1)).alias("repeated"), _count(here & differ).alias("unequal"),
    )


def assert_aligned(reference: DataFrame, other: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Same population in both tables: number of rows on which they differ."""
    return multiset_difference(reference, other, columns).agg(F.coalesce(F.sum(F.abs("difference")), F.lit(0)).alias("violations"))


def table_difference(old: DataFrame, new: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Long per-cell difference with an exact-change flag; cells without a partner are marked."""
    long = lambda df, name: df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", name)
    a = long(old, "old").withColumn("_a", F.lit(1))
    b = long(new, "new").withColumn("_b", F.lit(1))
    return a.join(b, [*keys, "metric"], "full").select(
        *keys, "metric", "old", "new", (F.col("new") - F.col("old")).alias("difference"),
        (~F.col("new").eqNullSafe(F.col("old"))).cast("int").alias("changed"),
        (F.col("_a").isNotNull() & F.col("_b").isNotNull()).cast("int").alias("matched"),
    )


def compare_exact(a: DataFrame, b: DataFrame) -> DataFrame:
    """Same schema and the same rows, whatever their order."""
    if a.dtypes != b.dtypes:
        raise ValueError(f"schemas differ: {a.dtypes} and {b.dtypes}")
    return assert_aligned(a, b, a.columns)


def bound_identity(reference: DataFrame, candidate: DataFrame, key: str, public: Sequence[str]) -> DataFrame:
    """Ids missing on either side, and shared ids whose public content differs."""
    return one_to_one(reference, candidate, [key], public).select(
        F.col("left_only").alias("missing_ids"), F.col("right_only").alias("extra_ids"), F.col("repeated").alias("repeated_ids"), F.col("unequal").alias("changed_content")
    )


def aligned_history(
    rows: DataFrame, reference: DataFrame, candidate: DataFrame, provenance: DataFrame, features: Sequence[str],
    identity: str = "id", entity: str = "merchant", time: str = "step", window: int = 7, tolerance: float = 1e-12,
) -> DataFrame:
    """Features agree, and every used-history row is legal: same entity, earlier, inside the window; none is missing."""
    far = close_features(reference, candidate, features, identity, tolerance)
    facts = rows.select(F.col(identity).alias("used_id"), F.col(entity).alias("_ue"), F.col(time).alias("_ut"))
    owners = rows.select(identity, F.col(entity).alias("_e"), F.col(time).alias("_t"))
    used = provenance.select(identity, "used_id").join(facts, "used_id", "left").join(owners, identity, "left")
    legal = F.coalesce((F.col("_ue") == F.col("_e")) & (F.col("_ut") < F.col("_t")) & (F.col("_ut") >= F.col("_t") - window), F.lit(False))
    illegal = used.agg(_count(~legal).alias("v")).select(F.lit("history_legal").alias("check"), F.col("v").alias("violations"))
    expected = history_provenance(rows, entity, time, identity, window)
    gaps = assert_aligned(expected, provenance, [identity, "used_id"]).select(F.lit("history_complete").alias("check"), "violations")
    return far.unionByName(illegal).unionByName(gaps)


def aligned_sets(expected: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Used-history sets of every row against the legal ones: (check, violations) without a pair being listed.

    Both sides hold (keys, used, id_sum, id_xor), the expected one with ``rows`` that share it. A row whose set is
    larger than legal, or of legal size but with other ids, or that the expected side does not know, used what it
    must not; what a smaller set lacks is counted in ids. A smaller set with foreign ids counts as incomplete.
    """
    right = found.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("used", "id_sum", "id_xor")])
    both = expected.select(*keys, "rows", "used", "id_sum", "id_xor").join(right, list(keys), "full")
    total = both.agg(*_set_violations(F.coalesce("rows", F.lit(1)), "", "_"))
    return stacked(total, "check", "violations").withColumn("violations", F.col("violations").cast("bigint"))


def _set_violations(rows: Column, expected: str, found: str) -> list[Column]:
    """The two sums of ``aligned_sets`` over lines that hold both sides, told by the prefix of their columns."""
    used, seen = F.coalesce(f"{expected}used", F.lit(0)), F.coalesce(f"{found}used", F.lit(0))
    same = [F.coalesce(f"{expected}{c}", F.lit(0)).eqNullSafe(F.coalesce(f"{found}{c}", F.lit(0))) for c in ("id_sum", "id_xor")]
    foreign = (seen > used) | ((seen == used) & ~(same[0] & same[1]))
    return [
        F.coalesce(F.sum(F.when(foreign, rows)), F.lit(0)).alias("history_legal"),
        F.coalesce(F.sum(F.when(seen < used, rows * (used - seen))), F.lit(0)).alias("history_complete"),
    ]


def aligned_builds(both: DataFrame, features: Sequence[str] = ("count", "mean", "std"), tolerance: float = 1e-12) -> DataFrame:
    """``close_shared_features`` and ``aligned_sets`` of the two ``history_builds`` in one pass: (check, violations).

    The first build is the reference and holds the legal sets. A step that only one build has counts with all its rows.
    """
    gaps = [g for f in features for g in (F.col(f"a_hi_{f}") - F.col(f"b_lo_{f}"), F.col(f"b_hi_{f}") - F.col(f"a_lo_{f}"))]
    close = F.coalesce((F.greatest(*gaps) <= tolerance) & F.col("a_known") & F.col("b_known"), F.lit(False))
    a, b = F.coalesce("a_rows", F.lit(0)), F.coalesce("b_rows", F.lit(0))
    far = F.coalesce(F.sum(F.when(close, F.abs(a - b)).otherwise(F.greatest(a, b))), F.lit(0)).alias("features_close")
    total = both.agg(far, *_set_violations(F.greatest(a, b), "a_", "b_"))
    return stacked(total, "check", "violations").withColumn("violations", F.col("violations").cast("bigint"))


def close_features(reference: DataFrame, candidate: DataFrame, features: Sequence[str], identity: str = "id", tolerance: float = 1e-12) -> DataFrame:
    """Rows whose features differ between two builds, or that only one of them has: (check, violations)."""
    gap = F.lit(0.0)
    for f in features:
        gap = F.greatest(gap, F.abs(F.col(f"_a_{f}") - F.col(f"_b_{f}")))
    a = reference.select(identity, *[F.col(f).cast("double").alias(f"_a_{f}") for f in features])
    b = candidate.select(identity, *[F.col(f).cast("double").alias(f"_b_{f}") for f in features])
    far = a.join(b, identity, "full").agg(_count(~F.coalesce(gap <= tolerance, F.lit(False))).alias("v"))
    return far.select(F.lit("features_close").alias("check"), F.col("v").alias("violations"))


def close_shared_features(reference: DataFrame, candidate: DataFrame, features: Sequence[str], keys: Sequence[str], tolerance: float = 1e-12) -> DataFrame:
    """``close_features`` of builds whose rows share their features by ``keys``: (check, violations), without a join of rows.

    Each build is reduced to its row count and the least and largest value of every feature per key, so rows that do
    not share it are seen too: then, or where the builds differ, all rows of the key count; surplus rows count alone.
    """
    def reduced(df: DataFrame, side: str) -> DataFrame:
        ends = [e for f in features for e in (F.min(F.col(f).cast("double")).alias(f"{side}l_{f}"), F.max(F.col(f).cast("double")).alias(f"{side}h_{f}"))]
        whole = F.bool_and(reduce(Column.__and__, [F.col(f).isNotNull() for f in features])).alias(f"{side}known")
        return df.groupBy(*[F.col(k).alias(f"{side}k_{k}") for k in keys]).agg(F.count("*").alias(f"{side}n"), whole, *ends)

    same = reduce(Column.__and__, [F.col(f"_ak_{k}").eqNullSafe(F.col(f"_bk_{k}")) for k in keys])  # a null key is a key
    both = reduced(reference, "_a").join(reduced(candidate, "_b"), same, "full")
    gap = F.lit(0.0)
    for f in features:
        gap = F.greatest(gap, F.col(f"_ah_{f}") - F.col(f"_bl_{f}"), F.col(f"_bh_{f}") - F.col(f"_al_{f}"))
    close = F.coalesce((gap <= tolerance) & F.col("_aknown") & F.col("_bknown"), F.lit(False))
    a, b = F.coalesce("_an", F.lit(0)), F.coalesce("_bn", F.lit(0))
    far = both.agg(F.coalesce(F.sum(F.when(close, F.abs(a - b)).otherwise(F.greatest(a, b))), F.lit(0)).cast("bigint").alias("v"))
    return far.select(F.lit("features_close").alias("check"), F.col("v").alias("violations"))


def fingerprint(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), portable: bool = False) -> DataFrame:
    """Order-free fingerprint: row count and the sum of row hashes.

    ``portable`` hashes with SHA-256 so another engine can repeat it; otherwise xxhash64 is used.
    """
    if portable:
        value = hash_draw(*[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    else:
        value = F.xxhash64(*[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(value.cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def _rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return stacked(df.agg(*[_count(v).alias(k) for k, v in rules.items()]), "check", "violations")


def _near(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a - b) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(b), F.lit(False))


def _key_repeats(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).agg(_count(F.col("n") > 1).cast("double").alias("violations")).select(
        F.lit("repeated_key").alias("check"), "violations"
    )


def validate_results(results: DataFrame, key: Sequence[str], expected_rows: int, ranking_group: Sequence[str]) -> DataFrame:
    """Grid size, repeated keys, nulls, ranges, cost and confusion identities, constant AP over scenarios."""
    c = F.col
    nulls = F.lit(False)
    for name in results.columns:
        if name != "cost_saving_rate":
            nulls = nulls | c(name).isNull()
    outside = F.lit(False)
    for name in ("pr_auc", "precision", "recall", "f1", "alert_rate"):
        outside = outside | ~c(name).between(0, 1)
    rules = {
        "nulls": nulls,
        "out_of_range": outside,
        "negative_cost": (c("business_cost") < 0) | (c("all_normal_cost") < 0),
        "bad_threshold": c("threshold") < 0,
        "cost_identity": ~_near(c("business_cost"), c("false_negative_cost") + c("false_positive_cost")),
        "confusion_total": c("tp") + c("fp") + c("tn") + c("fn") != c("rows"),
        "positive_total": c("tp") + c("fn") != c("positives"),
        "alert_rate": ~_near(c("alert_rate"), c("alert_count") / c("rows")),
        "all_normal": ~_near(c("all_normal_cost"), c("positives") * c("fn_cost")),
    }
    size = results.agg((F.count("*") != expected_rows).cast("double").alias("violations")).select(F.lit("row_count").alias("check"), "violations")
    steady = results.groupBy(*ranking_group).agg(F.countDistinct("pr_auc").alias("n")).agg(_count(F.col("n") > 1).cast("double").alias("violations"))
    return (
        _rules(results, rules).unionByName(size).unionByName(_key_repeats(results, key))
        .unionByName(steady.select(F.lit("ap_constant").alias("check"), "violations"))
    )


def validate_seed_grid(results: DataFrame, scheme: Sequence[str], seeds: Sequence[int], schemes: int, fixed: Sequence[str]) -> DataFrame:
    """Every fold and scheme has every seed; partitions do not change between seeds."""
    per = results.groupBy("fold", *scheme).agg(F.countDistinct("seed").alias("n"), _count(~F.col("seed").isin(list(seeds))).alias("x"))
    grid = per.agg(
        _count(F.col("n") != len(seeds)).cast("double").alias("incomplete"), F.sum("x").cast("double").alias("unknown_seed"),
        (F.count_distinct(F.struct(*scheme)) != schemes).cast("double").alias("scheme_count"),
    )
    moved = F.lit(False)
    for f in fixed:
        moved = moved | (F.col(f"_{f}") > 1)
    steady = results.groupBy("fold").agg(*[F.countDistinct(f).alias(f"_{f}") for f in fixed]).agg(_count(moved).cast("double").alias("violations"))
    return (
        stacked(grid, "check", "violations")
        .unionByName(steady.select(F.lit("partition_moved").alias("check"), "violations"))
        .unionByName(_key_repeats(results, ["fold", *scheme, "seed"]))
    )


def validate_calibration_grid(results: DataFrame, keys: Sequence[str], methods: Sequence[str], raw_fingerprints: DataFrame, capacity_rows: DataFrame) -> DataFrame:
    """Each model has every method, methods share one raw score vector, no capacity is exceeded."""
    per = results.groupBy(*keys).agg(F.collect_set("method").alias("m"), F.count("*").alias("n"))
    whole = F.sort_array("m") == F.array(*[F.lit(m) for m in sorted(methods)])
    grid = per.agg(_count(~whole | (F.col("n") != len(methods))).cast("double").alias("violations")).select(F.lit("methods_complete").alias("check"), "violations")
    shared = raw_fingerprints.groupBy(*keys).agg(F.countDistinct("fingerprint").alias("n")).agg(_count(F.col("n") > 1).cast("double").alias("violations"))
    over = capacity_rows.agg(_count(F.col("alerts") > F.col("slots")).cast("double").alias("violations"))
    return grid.unionByName(shared.select(F.lit("shared_raw_scores").alias("check"), "violations")).unionByName(
        over.select(F.lit("capacity_exceeded").alias("check"), "violations")
    )


def validate_replicates(table: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """Replicate counts, cost identity and paired populations of an effect ledger."""
    per = table.groupBy(*keys).agg(F.countDistinct("replicate_id").alias("d"), F.count("*").alias("n"))
    size = per.agg(_count((F.col("d") != replicates) | (F.col("n") != replicates)).cast("double").alias("violations"))
    rules = {
        "unpaired": F.col("paired_ok") != 1,
        "cost_identity": ~_near(F.col("cost_reduction"), F.lit(101.0) * F.col("delta_tp")),
        "too_many_found": F.col("delta_tp") > F.col("positives"),
    }
    return _rules(table, rules).unionByName(size.select(F.lit("replicate_count").alias("check"), "violations"))


def metric_regression(
    history: DataFrame, new: DataFrame, keys: Sequence[str], exact: Sequence[str], close: Sequence[str], tolerance: float = 1e-12
) -> DataFrame:
    """Per metric: largest absolute and relative difference and whether it passes; plus the overall verdict."""
    long = table_difference(history, new, keys, [*exact, *close])
    size = F.abs(F.col("difference"))
    must = F.col("metric").isin(list(exact))
    good = F.when(must, (F.col("changed") == 0)).otherwise(size <= tolerance) & (F.col("matched") == 1)
    ok = F.coalesce(good, F.col("changed") == 0)
    per = long.groupBy("metric").agg(
        F.count("*").alias("cells"), F.max(size).alias("max_difference"), F.max(safe_divide(size, F.abs(F.col("old")))).alias("max_relative"),
        F.bool_and(ok).cast("int").alias("passed"),
    )
    overall = per.agg(
        F.lit("overall").alias("metric"), F.sum("cells").alias("cells"), F.max("max_difference").alias("max_difference"),
        F.max("max_relative").alias("max_relative"), F.min("passed").alias("passed"),
    )
    return per.unionByName(overall)


def result_structure_audit(ledger: DataFrame, metrics: DataFrame, keys: Sequence[str], folds: int, models: int, seeds: int) -> DataFrame:
    """Grid of a finished run: ledger tasks, their sizes, one population per fold, metrics for each task."""
    tasks = ledger.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    grid = tasks.agg((F.count("*") != folds * models * seeds).cast("double").alias("violations")).select(F.lit("task_count").alias("check"), "violations")
    per = tasks.groupBy("fold").agg(F.countDistinct("n", "p").alias("k")).agg(_count(F.col("k") > 1).cast("double").alias("violations"))
    joined = tasks.join(metrics.select(*keys, "rows", "positives"), list(keys), "full")
    bad = ~(F.col("n").eqNullSafe(F.col("rows")) & F.col("p").eqNullSafe(F.col("positives")))
    match = joined.agg(_count(bad).cast("double").alias("violations"))
    return grid.unionByName(per.select(F.lit("fold_population").alias("check"), "violations")).unionByName(
        match.select(F.lit("metric_match").alias("check"), "violations")
    )


def contrast_coverage(outputs: DataFrame, contrasts: Sequence[tuple[str, str, str]], folds: Sequence[int]) -> DataFrame:
    """Which contrasts can be estimated per fold, and which components are missing."""
    spark = outputs.sparkSession
    grid = spark.createDataFrame(
        [(f, c, a, b) for f in folds for c, a, b in contrasts], "fold int, contrast string, baseline string, candidate string"
    )
    there = outputs.select(F.col("fold").cast("int").alias("fold"), "model").distinct()
    a = there.select("fold", F.col("model").alias("baseline"), F.lit(1).alias("_a"))
    b = there.select("fold", F.col("model").alias("candidate"), F.lit(1).alias("_b"))
    joined = grid.join(a, ["fold", "baseline"], "left").join(b, ["fold", "candidate"], "left")
    missing = F.array_compact(
        F.array(F.when(F.col("_a").isNull(), F.col("baseline")), F.when(F.col("_b").isNull(), F.col("candidate")))
    )
    return joined.select(
        "fold", "contrast", (F.size(missing) == 0).cast("int").alias("estimable"), F.array_join(missing, ";").alias("unavailable"),
        F.when(F.size(missing) == 0, "").otherwise("missing component").alias("reason"),
    )
