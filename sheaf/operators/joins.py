"""Lookups that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
SALT = "_salt"
#: Keys are counted in so many buckets; one that holds more than this share of all rows has its keys spread.
BUCKETS, HOT = 4096, 1024


def salt_of(column: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def salts_asked(column: str, salts: int = SALTS) -> Column:
    """The aggregate of a key's rows that tells which of its salts occur, a bit for each. ``column`` may be the salt itself."""
    salt = F.col(SALT) if column == SALT else salt_of(column, salts)
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))


def spread_rows(rows: DataFrame, on: str, spread: str, salts: int = SALTS) -> DataFrame:
    """``rows`` with their salt, dealt by ``on`` and salt, so that grouping and looking up take one shuffle between them.

    Only keys in buckets with a large share of the rows get several salts, those of the hash of ``spread``; which buckets
    these are is a subquery's value of ``HOT`` numbers at most. A key of few rows stays together and is looked up once.
    """
    bucket = F.pmod(F.xxhash64(on), F.lit(BUCKETS)).cast("int")
    counts = rows.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    each = counts.agg(F.collect_list(F.struct("_bucket", "_n")).alias("_each"), F.sum("_n").alias("_all")).select(F.inline("_each"), "_all")
    hot = each.where(F.col("_n") * HOT > F.col("_all")).agg(F.collect_list("_bucket").alias("_hot"))
    salt = F.coalesce(F.when(F.array_contains(hot.scalar(), bucket), salt_of(spread, salts)), F.lit(0))  # never null: no reader filters it
    return rows.withColumn(SALT, salt).repartition(on, SALT)


def salted_lookup(
    rows: DataFrame,
    dimension: DataFrame,
    on: str,
    how: str = "left",
    spread: str | None = None,
    salts: int = SALTS,
    asked: str | None = None,
) -> DataFrame:
    """Join ``rows`` with a ``dimension`` that has few rows per key.

    The rows of a key are spread over ``salts`` partitions by the hash of ``spread``
    and the dimension is repeated as often, so a hot key is dealt to that many tasks;
    adaptive execution splits what is still skewed then. ``asked`` names a column of the dimension
    with the ``salts_asked`` of each key; only these copies are made then, no more than there are rows.
    Rows of ``spread_rows`` keep the salt that they have and are not dealt again.

    The join is a shuffled one by hint. Spark's estimates take an ``explode``, here or in the rows, for no growth and
    sizes on disk for sizes in memory, so by them it would send many times its broadcast threshold through the driver.
    """
    left = rows if SALT in rows.columns else rows.withColumn(SALT, salt_of(spread or on, salts))
    copies = F.sequence(F.lit(0), F.lit(salts - 1))
    if asked is None:
        right = dimension.withColumn(SALT, F.explode(copies))
    else:
        right = dimension.withColumn(SALT, F.explode(F.when(F.col(asked) == 1, F.array(F.lit(0))).otherwise(copies)))
        right = right.where(F.call_function("shiftright", F.col(asked), F.col(SALT)).bitwiseAND(F.lit(1)) == 1).drop(asked)
    return left.join(right.hint("merge"), [on, SALT], how).drop(SALT)
