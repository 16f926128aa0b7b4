"""Table schemas, column checks, null handling and row identity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIPLET_COLUMNS = ("anchor", "positive", "negative")

COPY_SLOTS = 1 << 22
"""Slots that tell which rows may have copies; half a megabyte of bits."""

LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("line", T.StringType()),
    ]
)


class MissingColumnsError(ValueError):
    """Raised while the plan is built, before any job runs."""

    def __init__(self, missing: Iterable[str], where: str = "input"):
        self.missing = sorted(missing)
        super().__init__(f"{where} lacks required columns: {', '.join(self.missing)}")


def require_columns(df: DataFrame, required: Iterable[str], where: str = "input") -> DataFrame:
    missing = set(required) - set(df.columns)
    if missing:
        raise MissingColumnsError(missing, where)
    return df


def null_as_text(column: Column | str) -> Column:
    """Text form of a value; a missing one becomes the word `nan`."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("nan"))


def apply_null_policy(
    df: DataFrame, policy: str = "drop", columns: Iterable[str] = TRIPLET_COLUMNS
) -> DataFrame:
    """`drop` removes rows with a missing text, `literal` writes the word `nan`."""
    columns = list(columns)
    require_columns(df, columns)
    if policy == "drop":
        return df.dropna(subset=columns)
    if policy == "literal":
        return df.withColumns({name: null_as_text(name) for name in columns})
    raise ValueError(f"unknown null policy: {policy}")


def null_report(df: DataFrame, columns: Iterable[str] = TRIPLET_COLUMNS) -> DataFrame:
    """Rows kept and dropped by the `drop` policy."""
    missing = F.lit(False)
    for name in columns:
        missing = missing | F.col(name).isNull()
    return df.agg(
        F.count_if(~missing).alias("kept"),
        F.count_if(missing).alias("dropped"),
    )


def with_row_key(df: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """Add `occurrence` and a content-based unique `row_key` to raw triplets.

    Equal rows cannot be told apart, so they are counted and written out again with numbers
    1..copies. The count is combined before the shuffle, hence a group of copies arrives as
    one row however large it is, and groups above `chunk` are expanded in several tasks.
    """
    return _keyed(_numbered(df, chunk), df.columns)


def with_row_key_in_place(df: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """The same as `with_row_key`, for a table that is cheap to read again: rows without a copy
    stay where they are.

    Only hashes are shuffled to find the rows that may have copies: those whose slot of
    `COPY_SLOTS` is that of a hash that occurs twice. They alone are grouped as a whole, so a
    row that got there by chance has one copy.
    """
    columns = df.columns
    slot = F.pmod(F.xxhash64(*columns), F.lit(COPY_SLOTS)).cast("int")
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(63)
    hashes = df.select(F.xxhash64(*columns).alias("_hash"), word.alias("_word"), bit.alias("_bit"))
    repeated = hashes.groupBy("_hash", "_word", "_bit").agg(F.count(F.lit(1)).alias("_copies")).where(F.col("_copies") > 1)
    words = repeated.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    every = df.sparkSession.range(0, COPY_SLOTS // 64, 1, 1).withColumn("_word", F.col("id").cast("int"))
    table = every.join(words, "_word", "left").agg(
        F.sort_array(F.collect_list(F.struct("_word", F.coalesce("_bits", F.lit(0).cast("bigint")).alias("_bits")))).alias("words")
    ).select(F.col("words._bits")).scalar()
    has_copies = F.bit_get(F.get(table, word), bit) == 1
    single = df.where(~has_copies).withColumn("occurrence", F.lit(1).cast("bigint"))
    return _keyed(single.unionByName(_numbered(df.where(has_copies), chunk)), columns)


def _numbered(df: DataFrame, chunk: int) -> DataFrame:
    columns = df.columns
    copies = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
    few = (
        copies.where(F.col("_copies") <= chunk)
        .withColumn("occurrence", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies")))
        .drop("_copies")
    )
    last_part = F.floor((F.col("_copies") - 1) / chunk)
    many = (
        copies.where(F.col("_copies") > chunk)
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), last_part)))
        .repartition(*columns, "_part")
        .withColumn(
            "occurrence",
            F.explode(
                F.sequence(
                    F.col("_part") * chunk + 1,
                    F.least((F.col("_part") + 1) * chunk, F.col("_copies")),
                )
            ),
        )
        .drop("_copies", "_part")
    )
    return few.unionByName(many)


def _keyed(numbered: DataFrame, columns: list[str]) -> DataFrame:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in sorted(columns)]
    key = F.md5(F.concat_ws("\u0001", *parts, F.col("occurrence").cast("string")))
    return numbered.withColumn("row_key", key)
