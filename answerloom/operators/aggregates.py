"""Aggregates over named columns, cutoff sums, and answering tables of questions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from answerloom.functions import questions as Q
from answerloom.plans.ranges import quantiles, running
from answerloom.plans.staging import cut_lineage


def first_numeric_column(df: DataFrame) -> str:
    for field in df.schema:
        if isinstance(field.dataType, T.NumericType):
            return field.name
    raise ValueError("the table has no numeric column")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def known(df: DataFrame, column: str) -> Column:
    """The column's values, NaN as null."""
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return F.nanvl(F.col(column), F.lit(None)) if floating else F.col(column)


def column_sum(df: DataFrame, column: str | None = None) -> DataFrame:
    """Sum that is 0, not null, when there is nothing to add."""
    name = column or first_numeric_column(df)
    return df.agg(F.coalesce(F.sum(known(df, name)), F.lit(0)).alias("answer"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("answer"))


def column_mean(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.agg(F.avg(known(df, column or first_numeric_column(df))).alias("answer"))


def column_max(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.agg(F.max(known(df, column or first_numeric_column(df))).alias("answer"))


def column_min(df: DataFrame, column: str | None = None) -> DataFrame:
    return df.agg(F.min(known(df, column or first_numeric_column(df))).alias("answer"))


def first_value(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """The column's value in the first row by a stated order, null values included."""
    first = F.min_by(F.struct(F.col(column).alias("v")), F.struct(*order))
    return df.agg(first.alias("__first")).select(F.col("__first.v").alias("answer"))


def cutoff_sum(df: DataFrame, column: str, cutoff: float, inclusive: bool) -> DataFrame:
    """Sum of the values above (or at) a cutoff, cut to a whole number."""
    value = known(df, column)
    keep = value >= cutoff if inclusive else value > cutoff
    return df.where(keep).agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("answer"))


def _sum_kind(df: DataFrame, column: str) -> str:
    """The type in which a column's values add up: exact for whole numbers and decimals."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.DecimalType):
        return f"decimal(38,{kind.scale})"
    return "decimal(38,0)" if isinstance(kind, T.IntegralType) else "double"


def _cutoff_lines(questions: DataFrame, values: DataFrame, of: str, cutoff: str, inclusive: str, ranges: int | None, kind: str) -> DataFrame:
    """Adds ``answer`` to questions with a cutoff; ``values`` has (of, value), ``of`` names a question's column.

    Values and cutoffs of a column are put on one line, largest first, and a running sum
    over the line is read off at the cutoffs. So the work is one sort of the
    distinct values, whatever the number of questions, and no pair of question
    and value is ever formed. Questions without a cutoff never meet the line. Sums are of ``kind``; values and
    cutoffs are compared in it too, unless cutoffs are floating, which are compared as doubles.
    """
    floating = isinstance(questions.schema[cutoff].dataType, (T.DoubleType, T.FloatType))
    place = "double" if floating else kind
    values = (
        values.where("value IS NOT NULL")
        .groupBy("of", (-F.col("value").cast(place)).alias("__at"))
        .agg(F.sum(F.col("value").cast(kind)).cast(kind).alias("__sum"))
        .select("of", "__at", F.lit(1).alias("__turn"), "__sum")
    )
    keyed = questions.withColumns(
        {"__at": -F.col(cutoff).cast(place), "__turn": F.when(F.col(inclusive), 2).otherwise(0), "__of": F.col(of)}
    )
    asking = keyed.where(F.col(cutoff).isNotNull())
    marks = asking.select(F.col("__of").alias("of"), "__at", "__turn", F.lit(None).cast(kind).alias("__sum")).distinct()
    line = running(values.unionByName(marks), ["of"], ["__at", "__turn"], {"__upto": ("sum", F.col("__sum"))}, ranges)
    sums = line.where(F.col("__turn") != 1).select(
        F.col("of").alias("__of"), "__at", "__turn", F.coalesce(F.col("__upto"), F.lit(0)).cast("bigint").alias("answer")
    )
    answered = asking.join(sums, ["__of", "__at", "__turn"], "left")
    rest = keyed.where(F.col(cutoff).isNull()).withColumn("answer", F.lit(None).cast("bigint"))
    return answered.unionByName(rest).drop("__at", "__turn", "__of")


def cutoff_sums(
    questions: DataFrame,
    df: DataFrame,
    column: str,
    cutoff: str = "cutoff",
    inclusive: str = "inclusive",
    ranges: int | None = None,
) -> DataFrame:
    """Adds ``answer``: each question's cutoff sum over one column, exact for whole numbers and decimals, cut to a whole number."""
    values = df.select(F.lit(column).alias("of"), known(df, column).alias("value"))
    asked = questions.withColumn("__column", F.lit(column))
    return _cutoff_lines(asked, values, "__column", cutoff, inclusive, ranges, _sum_kind(df, column)).drop("__column")


def _named(text: Column, names: Sequence[str]) -> Column:
    """The first of the names that the text has as whole words, in any case; else the first name."""
    found = F.lit(names[0])
    for name in reversed(names):
        pattern = r"(?iu)(?<!\w)" + "".join(rf"\{c}" if not c.isalnum() and c != "_" else c for c in name) + r"(?!\w)"
        found = F.when(text.rlike(pattern), F.lit(name)).otherwise(found)
    return found


def answer_questions(
    questions: DataFrame,
    df: DataFrame,
    order: Sequence[str],
    text: str = "text",
    column: str | None = None,
) -> DataFrame:
    """Adds ``metric``, ``column``, ``answer`` (double) and ``answer_text`` to question texts about ``df``.

    A question is about the numeric column it names as whole words (of several, the first in the table), else the first
    numeric column, or always about ``column`` if that is given. ``order`` says which row is first; the first cell is
    that of the table's first column, or of ``column``, of any type. ``answer_text`` keeps whole numbers exact and holds a
    first cell that is no number; ``answer`` is null then. NaN counts as null.

    The questions are taken apart once and written. All plain metrics of all columns come from one pass over the table; cutoff sums come
    from one more, which reads only the columns that questions with a cutoff name. They are exact for whole numbers and decimals.
    """
    names = [column] if column else numeric_columns(df)
    if not names:
        raise ValueError("the table has no numeric column")
    asked = questions.select(
        "*",
        Q.metric(F.col(text)).alias("metric"),
        F.coalesce(_named(F.col(text), names), F.lit(names[0])).alias("column"),
        Q.cutoff(F.col(text)).alias("__cutoff"),
        Q.cutoff_inclusive(F.col(text)).alias("__inclusive"),
    )
    is_cutoff = F.col("metric") == "cutoff_sum"
    asked = cut_lineage(asked.withColumn("__cutoff", F.when(is_cutoff, F.col("__cutoff"))))
    corner = column or df.columns[0]
    measures = [F.min_by(F.struct(known(df, corner).cast("string").alias("v")), F.struct(*order))["v"].alias("first")]
    for i, name in enumerate(names):
        value = known(df, name)
        measures.append(
            F.struct(
                F.coalesce(F.sum(value), F.lit(0)).cast("string").alias("sum"),
                F.count(F.lit(1)).cast("string").alias("count"),
                F.avg(value.cast("double")).cast("string").alias("mean"),
                F.max(value).cast("string").alias("max"),
                F.min(value).cast("string").alias("min"),
            ).alias(f"m{i}")
        )
    plain = df.agg(*measures)
    # Six rows per numeric column of the table.
    each = F.array(
        *(
            F.struct(F.lit(metric).alias("metric"), F.lit(name).alias("column"), (F.col("first") if metric == "first" else F.col(f"m{i}.{metric}")).alias("__plain"))
            for i, name in enumerate(names)
            for metric in ("sum", "count", "mean", "max", "min", "first")
        )
    )
    by_metric = plain.select(F.inline(each))
    with_plain = asked.join(F.broadcast(by_metric), ["metric", "column"], "left")
    named = {r.column for r in asked.where("__cutoff IS NOT NULL").select("column").distinct().collect()}  # of the table's columns
    kinds: dict[str, list[str]] = {}
    for name in names:
        if name in named:
            kinds.setdefault(_sum_kind(df, name), []).append(name)
    summed = with_plain.where("__cutoff IS NULL").withColumn("answer", F.lit(None).cast("bigint"))
    for kind, columns in kinds.items():
        values = df.select(F.inline(F.array(*(F.struct(F.lit(n).alias("of"), known(df, n).cast(kind).alias("value")) for n in columns))))
        cutoffs = with_plain.where(F.col("__cutoff").isNotNull() & F.col("column").isin(columns))
        summed = summed.unionByName(_cutoff_lines(cutoffs, values, "column", "__cutoff", "__inclusive", None, kind))
    said = F.when(is_cutoff, F.col("answer").cast("string")).otherwise(F.col("__plain"))
    return summed.select(
        *questions.columns, "metric", "column", said.try_cast("double").alias("answer"), said.alias("answer_text")
    )


def group_aggregate(df: DataFrame, keys: Sequence[str], measures: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def filter_aggregate(df: DataFrame, condition: Column, measures: Mapping[str, Column]) -> DataFrame:
    return df.where(condition).agg(*[c.alias(n) for n, c in measures.items()])


def share(df: DataFrame, keys: Sequence[str], condition: Column, measure: str | None = None) -> DataFrame:
    """Per group: part that meets the condition, ratio within the group, percentage of all."""
    unit = F.lit(1) if measure is None else F.col(measure)
    groups = df.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(condition, unit)), F.lit(0)).cast("double").alias("part"),
        F.sum(unit).cast("double").alias("whole"),
    )
    everything = df.agg(F.sum(unit).cast("double")).scalar()
    return groups.select(
        *keys,
        "part",
        F.try_divide("part", "whole").alias("ratio"),
        F.try_divide(100.0 * F.col("part"), everything).alias("percentage"),
    )


def statistics(
    df: DataFrame, keys: Sequence[str], column: str, other: str | None = None, ranges: int | None = None
) -> DataFrame:
    """Count, mean, standard deviation, minimum, exact quartiles, maximum, correlation."""
    for name in [column] if other is None else [column, other]:
        df = df.withColumn(name, known(df, name))
    measures = [
        F.count(column).alias("n"),
        F.avg(column).alias("mean"),
        F.stddev_samp(column).alias("stddev"),
        F.min(column).alias("minimum"),
        F.max(column).alias("maximum"),
    ]
    if other is not None:
        measures.append(F.corr(column, other).alias("correlation"))
    moments = df.groupBy(*keys).agg(*measures)
    quartiles = quantiles(df, keys, column, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ranges)
    renamed = quartiles.select(*[F.col(k).alias(f"__{k}") for k in keys], "q1", "median", "q3")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    if not keys:
        one = quartiles.select(F.struct("q1", "median", "q3").alias("q")).scalar()
        return moments.withColumn("__q", one).select("*", "__q.*").drop("__q")
    return moments.join(renamed, same, "left").drop(*[f"__{k}" for k in keys])


def distinct_count(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(c).alias(f"{c}_distinct") for c in columns])


def value_frequencies(df: DataFrame, column: str) -> DataFrame:
    """Every value and how often it occurs, most common first."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("frequency"))
    return counts.orderBy(F.desc("frequency"), column)


def apply_offset(
    answers: DataFrame, users: DataFrame, user: str, answer: str, rule: str, personalised: str
) -> DataFrame:
    """Adds each user's offset to numeric answers of personalised questions.

    ``users`` has one row per user with its ``offset``. Whole numbers stay whole.
    """
    whole = isinstance(answers.schema[answer].dataType, T.IntegralType)
    offset = F.coalesce(F.col("offset"), F.lit(0))
    moved = F.col(answer) + (offset if whole else offset.cast("double"))
    joined = answers.join(users.select(user, rule, "offset"), user, "left")
    return joined.withColumn(
        answer, F.when(F.col(personalised) & F.col(answer).isNotNull(), moved).otherwise(F.col(answer))
    )


def hash_columns(text: Column) -> list[Column]:
    """md5, sha1, sha256 and crc32 of a text."""
    return [
        F.md5(text).alias("md5"),
        F.sha1(text).alias("sha1"),
        F.sha2(text, 256).alias("sha256"),
        F.crc32(text).alias("crc32"),
    ]
