"""Column expressions: calendar, ratios, clipping, exact cents, capacities, hash order."""

from __future__ import annotations

from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Clipping bound of scores, and the ratio offset of the float path.
CLIP = 1e-6
RATIO_EPSILON = 1e-6
# Bounds of a signed 64-bit integer in cents.
MAX_CENTS = 2**63 - 1


def hour_of_day(step: Column) -> Column:
    """Hour 0..23; the sign follows the dividend for steps below one."""
    return ((step - F.lit(1)) % F.lit(24)).cast("int")


def day_index(step: Column) -> Column:
    return F.floor((step - F.lit(1)) / F.lit(24)).cast("int")


def ratio_offset(amount: Column, mean: Column, epsilon: float = RATIO_EPSILON) -> Column:
    """amount / (mean + epsilon): null mean stays null."""
    return F.try_divide(amount, mean + F.lit(epsilon))


def ratio_or_zero(amount: Column, mean: Column) -> Column:
    """amount / mean, zero where the mean is zero or missing."""
    return F.coalesce(F.try_divide(amount, mean), F.lit(0.0))


def finite_or_null(value: Column) -> Column:
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(None)).otherwise(value)


def fill_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Infinities, NaN and nulls of the named double columns become zero."""
    return df.withColumns(
        {c: F.coalesce(finite_or_null(F.col(c).cast("double")), F.lit(0.0)) for c in columns}
    )


def cast_matrix(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Float32 model matrix; infinities become null."""
    return df.withColumns({c: finite_or_null(F.col(c).cast("float")) for c in columns})


def defined(score: Column) -> Column:
    """True for finite numbers; false, never null, for null, NaN and the infinities."""
    return F.coalesce(~(F.isnan(score) | (F.abs(score) == F.lit(float("inf")))), F.lit(False))


def checked_score(score: Column) -> Column:
    """The score; an undefined one is an error, since no ranking or probability holds it."""
    return F.when(defined(score), score).otherwise(F.raise_error(F.lit("undefined score: null, NaN or infinite")).cast("double"))


def bounded(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """The score moved into [low, high]; undefined scores become null, never a bound."""
    return F.when(defined(score), F.greatest(F.lit(low), F.least(F.lit(high), score)))


def clip_score(score: Column, bound: float = CLIP) -> Column:
    return bounded(score, bound, 1.0 - bound)


def logit(probability: Column) -> Column:
    return F.ln(probability / (F.lit(1.0) - probability))


def expit(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value))


def platt_score(raw: Column, slope: float, intercept: float) -> Column:
    return expit(F.lit(float(slope)) * logit(clip_score(raw)) + F.lit(float(intercept)))


def safe_divide(a: Column, b: Column) -> Column:
    """Undefined quotients are null, never NaN."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def strict_sign(value: Column) -> Column:
    return (
        F.when(value > 0, F.lit("positive"))
        .when(value < 0, F.lit("negative"))
        .when(value == 0, F.lit("zero"))
    )


def review_slots(n: Column, q: float | str) -> Column:
    """ceil(q*n) in exact rational arithmetic, so 3% of 198,311 is 5,950."""
    share = Fraction(str(q))
    if not 0 < share <= 1:
        raise ValueError("capacity must lie in (0, 1]")
    num, den = share.numerator, share.denominator
    return F.call_function("div", n.cast("bigint") * F.lit(num) + F.lit(den - 1), F.lit(den).cast("bigint"))


def hash_priority(prefix: str, identity: Column) -> Column:
    """Label-free SHA-256 tie key of ``prefix + id``."""
    return F.sha2(F.concat(F.lit(prefix), identity.cast("string")), 256)


def hash_draw(*parts: Column | str) -> Column:
    """Non-negative integer drawn from a hashed counter: the same in every engine."""
    columns = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 8), 16, 10).cast("bigint")


def exact_cents(text: Column) -> Column:
    """Decimal text to integer cents; null where malformed, sub-cent or out of range."""
    clean = F.when(text.rlike(r"^[+-]?[0-9]{1,17}(\.[0-9]{1,18})?$"), text)
    scaled = clean.cast("decimal(38,18)") * F.lit(100).cast("decimal(3,0)")
    whole = F.floor(scaled)
    ok = (scaled == whole) & (F.abs(whole) <= F.lit(MAX_CENTS).cast("decimal(20,0)"))
    return F.when(ok, whole.cast("bigint"))


def std_from_moments(n: Column, total: Column, square: Column) -> Column:
    """Sample deviation from exact integer moments, in money units; null below two rows.

    The numerator n*square - total^2 is taken in 64-bit integers where it fits and in 38-digit
    decimals elsewhere; both are exact.
    """
    small = n.cast("double") * square.cast("double") < F.lit(4e18)
    short = (n * F.when(small, square).cast("bigint") - F.when(small, total) * F.when(small, total)).cast("double")
    wide = n.cast("decimal(38,0)") * square - total.cast("decimal(38,0)") * total.cast("decimal(38,0)")
    numerator = F.when(small, short).otherwise(wide.cast("double"))
    denominator = n.cast("double") * (n - 1).cast("double")
    return F.when(n > 1, F.sqrt(F.try_divide(numerator, denominator)) / F.lit(100.0))


def composition(df: DataFrame, keys: list[str], category: str, missing: str = "<MISSING>") -> DataFrame:
    """JSON map of count and share per category, in category order, for every key group.

    Counting happens before the map is built, so only one entry per category is gathered.
    """
    counted = (
        df.withColumn("_cat", F.coalesce(F.col(category).cast("string"), F.lit(missing)))
        .groupBy(*keys, "_cat")
        .agg(F.count("*").alias("_n"))
    )
    entry = F.struct(F.col("_cat").alias("key"), F.col("_n").alias("n"))
    grouped = counted.groupBy(*keys).agg(
        F.sort_array(F.collect_list(entry)).alias("_e"), F.sum("_n").alias("_total")
    )
    body = F.map_from_entries(
        F.transform(
            "_e",
            lambda e: F.struct(
                e["key"],
                F.struct(e["n"].alias("count"), F.round(e["n"] / F.col("_total"), 6).alias("ratio")),
            ),
        )
    )
    return grouped.select(*keys, F.to_json(body).alias("composition"))
