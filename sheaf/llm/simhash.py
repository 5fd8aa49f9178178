"""SimHash fingerprints and covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import components, forest, text_or_empty
from sheaf.session import store_table

BITS, WORDS, RADIUS, SEED = 64, 4, 4, 42
#: Members of a bucket that are compared as one block; larger buckets are compared block against block.
BLOCK = 4096
CHUNK = 1 << 16
_BIT = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


# Fingerprints -----------------------------------------------------------------------------


def fingerprint(text: bytes) -> int:
    """The 64-bit SimHash of UTF-8 text: lower-cased words, shingles with repeats, XXH64; no words: zero."""
    words = text.lower().split()  # for bytes: A-Z, and white space as in [\x20\x09-\x0D]
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, total = np.zeros(BITS, np.int64), len(words) - WORDS + 1
    for at in range(0, total, CHUNK):
        part = words[at : at + CHUNK + WORDS - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(WORDS))))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)
        places = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8) * 256)
        counts += (np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BIT).ravel()
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id, _hash, _fp`` of every row: its id, a hash of its text and its fingerprint as a signed number."""

    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints)], names=["_id", "_hash", "_fp"])

    text = text_or_empty(text_col)
    sent = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_hash"), text.cast("binary").alias("_text"))
    schema = T.StructType([sent.schema["_id"], T.StructField("_hash", T.LongType()), T.StructField("_fp", T.LongType())])
    return sent.mapInArrow(run, schema)


# Covering hashing -------------------------------------------------------------------------


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """2^(radius+1) - 1 masks, such that any ``radius`` positions are outside one of them.

    Position i has a non-zero vector m(i) of radius+1 bits; mask v holds the positions where the product of
    m(i) and v is odd. ``radius`` positions give as many linear equations <m(i), v> = 0 in radius+1
    unknowns, so some v other than zero solves them: two fingerprints that differ in these positions
    agree under mask v. Each mask holds half of the positions.
    """
    top = 1 << (radius + 1)
    vectors = [i % (top - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bucket_keys(fp: Column, masks: list[int]) -> Column:
    """One bucket name per mask: a hash of the mask's number and the bits under it."""
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])


def _near(key: np.ndarray, fp: np.ndarray, side: np.ndarray, radius: int):
    """Forest of the pairs within ``radius`` of equal key; rows sorted by key. Across blocks only pairs of both sides count."""
    found_a, found_b, size = [], [], 0
    at, step, bits = np.arange(len(key)), 1, fp.view(np.uint64)
    while True:
        at = at[at + step < len(key)]
        at = at[key[at + step] == key[at]]
        if not len(at):
            break
        hit = at[(np.bitwise_count(bits[at] ^ bits[at + step]) <= radius) & ((side[at] < 0) | (side[at] != side[at + step]))]
        found_a.append(fp[hit])
        found_b.append(fp[hit + step])
        size += len(hit)
        if size > 1_000_000:
            a, b = forest(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, size = [a], [b], len(a)
        step += 1
    none = [np.empty(0, np.int64)]
    return forest(np.concatenate(found_a or none), np.concatenate(found_b or none))


def near_edges(prints: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """``a, b``: edges that connect whatever distinct fingerprints (column ``_fp``) lie within ``radius`` of each other.

    Every pair within the radius meets in a bucket. Buckets of one are dropped before Python sees them.
    The members of a bucket are dealt to blocks, and every two blocks are one piece of work, so that no task
    holds a whole bucket; a piece returns a spanning forest of its links, never all pairs.
    The join is a shuffled one by hint: Spark takes the explode for no growth and would send all its rows through the driver.
    """
    rows = prints.select("_fp", F.explode(bucket_keys(F.col("_fp"), covering_masks(BITS, radius))).alias("_key"))
    shared = rows.groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    members = rows.join(shared.hint("merge"), "_key").select("_key", "_fp", blocks.alias("_blocks"))
    own = F.pmod(F.xxhash64("_fp"), F.col("_blocks")).cast("int")
    members = members.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    # side -1: a piece within one block, where all pairs count.
    work = members.select(
        F.xxhash64("_key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("_piece"),
        "_fp",
        F.when(F.col("_own") == F.col("_other"), -1).otherwise(F.col("_own")).alias("_side"),
    )
    dealt = work.repartition("_piece").sortWithinPartitions("_piece")

    def run(batches):
        held, size = [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size < 100_000:
                continue
            pdf = pd.concat(held)
            last = pdf["_piece"].to_numpy() == pdf["_piece"].iloc[-1]  # may go on in the next batch
            if not last.all():
                yield edges(pdf[~last])
                pdf = pdf[last]
            held, size = [pdf], len(pdf)
        if held:
            yield edges(pd.concat(held))

    def edges(pdf):
        a, b = _near(pdf["_piece"].to_numpy(np.int64), pdf["_fp"].to_numpy(np.int64), pdf["_side"].to_numpy(np.int64), radius)
        return pd.DataFrame({"a": a, "b": b})

    return dealt.mapInPandas(run, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, links: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``<id>, text_hash, fingerprint, component_id, first_hash``.

    ``fingerprint`` is 16 hex digits; fingerprints link at ``radius`` or fewer differing bits and
    ``component_id`` is the smallest id reachable (null only if no row of the component has an id).
    Texts without words, null among them, have fingerprint zero and link like any others. Repeated
    rows share a fingerprint. No rows give no rows; other columns are ignored.
    ``first_hash`` is the ``text_hash`` of the row that stands for the component. ``links`` (``a, b``) connects
    further fingerprints.
    """
    # Stored tables are joined by hint: their size on disk is no measure of what a broadcast takes in the driver.
    prints = store_table(fingerprints(docs, id_col, text_col))
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    distinct = store_table(prints.groupBy("_fp").agg(F.min(order).alias("_first")))
    edges = store_table(near_edges(distinct, radius))  # else their tasks would each hold two Python workers
    roots = components(edges if links is None else edges.union(links))
    rooted = distinct.join(roots.hint("merge"), distinct["_fp"] == roots["node"], "left").select("_fp", "_first", F.coalesce("root", "_fp").alias("_root"))
    groups = rooted.groupBy("_root").agg(F.min("_first").alias("_least"))
    named = rooted.join(groups, "_root").select(F.col("_fp").alias("_of"), "_least")
    return prints.join(named.hint("merge"), F.col("_fp") == F.col("_of")).select(
        F.col("_id").alias(id_col),
        F.col("_hash").alias("text_hash"),
        F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"),
        F.col("_least.id").alias("component_id"),
        F.col("_least.hash").alias("first_hash"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, links: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each component, that with the smallest id."""
    found = simhash_groups(docs, id_col, text_col, radius, links)
    stay = found.where(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash")))
    stay = stay.select(F.col(id_col).alias("_keep"), F.col("first_hash").alias("_keep_hash")).distinct()
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_or_empty(text_col)).alias("_hash"))
    joined = rows.join(stay, (F.col("_hash") == F.col("_keep_hash")) & F.col("_id").eqNullSafe(F.col("_keep")))
    nth = F.row_number().over(Window.partitionBy("_hash", "_id").orderBy("_keep"))
    return joined.withColumn("_nth", nth).where("_nth = 1").select("_row.*")
