"""Mixing sources to target weights with Efraimidis-Spirakis keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.common import SPACE, running_total, text_or_empty
from sheaf.session import store_table

WEIGHTS = (3, 1, 2)
#: What the mix takes in all, and the most a source may be repeated, as multiples of the size.
SHARE, REPEATS = 1.5, 2.0


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("bigint")


def prose_weight(text: Column, size: Column) -> Column:
    """A quality weight in (0, 1]: highest where words have the mean length of prose, 5 or 6 letters."""
    mean = F.char_length(text) / F.greatest(size, F.lit(1))
    return F.exp(-F.pow((mean - 6.0) / 4.0, 2)) + 0.05


def exponential_key(weight: Column, *identity: Column, seed: int = 17) -> Column:
    """-ln(u) / weight, where u in (0, 1) is a hash of the row's identity, so that reruns agree."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / weight


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """``_source, _source_size, _target`` from ``_source, _source_size``.

    Sources by code point, null last, weigh ``weights`` in turn. They divide ``share`` times all sizes;
    a target stops at ``repeats`` times its source's size and the excess is divided again by weight
    until none is above. Each round is one aggregate over the sources.
    """
    ranked = running_total(sources.withColumn("_one", F.lit(1)), [], ["_source"], "_one", "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = store_table(ranked.select("_source", "_source_size", weight.alias("_weight"), (F.col("_source_size") * repeats).alias("_most")))
    total = ranked.agg(F.sum("_source_size")).first()[0] or 0
    level = None
    while True:
        # Sources at their most under the level so far; there is none before the first round.
        full = F.lit(False) if level is None else F.col("_weight") * level > F.col("_most")
        held, open_ = ranked.agg(F.sum(F.when(full, F.col("_most"))), F.sum(F.when(~full, F.col("_weight")))).first()
        if not open_:
            break
        new = (total * share - (held or 0.0)) / open_
        if level is not None and new <= level:
            break
        level = new
    return ranked.select("_source", "_source_size", F.least(F.col("_most"), F.col("_weight") * F.lit(float(level or 0))).alias("_target"))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    whole_documents: bool = False,
    weights=WEIGHTS,
    share: float = SHARE,
    repeats: float = REPEATS,
) -> DataFrame:
    """One row per row of ``docs``: ``<id>, size, source_size, target, taken, epochs, source, row_hash``.

    ``size`` counts the words of the text (null: 0). Complete epochs come first: a target of k times
    the source takes every document k times. The rest of the budget is a weighted sample without
    replacement: documents by exponential key, added up until the budget is met. The document
    on the line is cut to the words left, or with ``whole_documents`` taken when at least half of it fits.

    Null sources are one source. Documents without words take nothing. Repeated rows are documents
    of their own; rows equal in id and text are interchangeable, so ties between them change no result
    but which of them is which. An empty table gives no rows; other columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        words(text).alias("_size"),
        F.char_length(text).alias("_points"),
        F.xxhash64(F.col(id_col), text).alias("_row"),
        (weight if weight is not None else prose_weight(text, words(text))).alias("_quality"),
    )
    rows = rows.select("_id", "_source", "_size", "_row", exponential_key(F.col("_quality"), F.col("_row")).alias("_key"))
    ordered = store_table(running_total(rows, ["_source"], ["_key", "_id", "_row"], "_size", "_before"))
    sources = ordered.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    targets = source_targets(sources, weights, share, repeats).withColumnRenamed("_source", "_s")
    joined = ordered.join(targets, F.col("_source").eqNullSafe(F.col("_s")))
    epochs = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    rest = F.round(F.col("_target") - F.col("_epochs") * F.col("_source_size")).cast("bigint")
    if whole_documents:
        fits = (F.col("_size") > 0) & (F.col("_before") + F.col("_size") / 2 <= F.col("_rest"))
        part = F.when(fits, F.col("_size")).otherwise(0)
    else:
        part = F.least(F.greatest(F.col("_rest") - F.col("_before"), F.lit(0)), F.col("_size"))
    return (
        joined.withColumn("_epochs", epochs.cast("bigint"))
        .withColumn("_rest", rest)
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").cast("double").alias("target"),
            (F.col("_epochs") * F.col("_size") + part).cast("bigint").alias("taken"),
            F.col("_epochs").alias("epochs"),
            F.col("_source").alias(source_col),
            F.col("_row").alias("row_hash"),
        )
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: whole rows of ``docs``, as often as the mix takes them.

    Documents without words are not part of a mix. Rows equal in id and text are taken as often as
    all of them together.
    """
    taken = mix_sources(docs, id_col, text_col, source_col, whole_documents=True, **options)
    times = (F.col("taken") / F.col("size")).cast("int")
    plan = (
        taken.where("taken > 0")
        .select(F.col(id_col).alias("_id"), F.col("row_hash").alias("_row"), F.col(source_col).alias("_source"), times.alias("_times"))
        .groupBy("_id", "_row", "_source")
        .agg(F.sum("_times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    )
    rows = docs.select(
        F.struct("*").alias("_doc"),
        F.col(id_col).alias("_i"),
        F.col(source_col).alias("_s"),
        F.xxhash64(F.col(id_col), text_or_empty(text_col)).alias("_hash"),
    )
    met = (F.col("_hash") == F.col("_row")) & F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source"))
    # Equal rows share what they take: the same for each, the remainder to the first ones.
    nth = F.row_number().over(Window.partitionBy("_hash", "_i", "_s").orderBy("_times"))
    joined = rows.join(plan, met).withColumn("_nth", nth)
    own = F.floor(F.col("_times") / F.col("_rows")) + F.when(F.col("_nth") <= F.col("_times") % F.col("_rows"), 1).otherwise(0)
    return joined.withColumn("_own", own.cast("int")).where("_own > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_own")))).select("_doc.*")
