"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.common import text_or_empty

WORD_SLOTS = 1 << 16
BINS = 12
#: The model is fitted on at most so many labelled rows, those with the smallest hash of their id.
TRAIN_ROWS = 12_000
FACTORS = 8

_CLASS = np.zeros((256, 8))
for _i, _chars in enumerate(
    (
        range(97, 123),  # small letters
        range(65, 91),  # capital letters
        range(48, 58),  # digits
        (32, 9, 11, 12, 13),
        (10,),
        b".,;:'\"-()?!",
        b"#$%&*+/<=>@[\\]^_`{|}~",
        range(128, 256),
    )
):
    _CLASS[list(_chars), _i] = 1

#: Statistics and the borders of their bins.
STATISTICS = {
    "words": np.geomspace(4, 8000, BINS - 1),
    "mean word": np.linspace(2.5, 12, BINS - 1),
    "longest word": np.geomspace(6, 300, BINS - 1),
    "small letters": np.linspace(0.05, 0.95, BINS - 1),
    "capital letters": np.linspace(0.01, 0.6, BINS - 1),
    "digits": np.linspace(0.005, 0.3, BINS - 1),
    "punctuation": np.linspace(0.005, 0.2, BINS - 1),
    "symbols": np.linspace(0.002, 0.2, BINS - 1),
    "other bytes": np.linspace(0.005, 0.4, BINS - 1),
    "distinct words": np.linspace(0.05, 0.95, BINS - 1),
    "commonest word": np.linspace(0.02, 0.5, BINS - 1),
    "words per line": np.geomspace(1, 500, BINS - 1),
    "repeated lines": np.linspace(0.02, 0.9, BINS - 1),
    "repeated pairs": np.linspace(0.02, 0.9, BINS - 1),
}


def statistics(text: bytes, words: list[bytes], distinct: set[bytes]) -> list[float]:
    n, size = max(1, len(words)), max(1, len(text))
    share = (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS) / size
    lines = text.split(b"\n")
    lengths = list(map(len, words))
    # The share of the commonest word, found among sorted slots rather than by counting strings.
    slots = np.sort(np.fromiter(map(hash, words), np.int64, len(words))) if words else np.zeros(1, np.int64)
    ends = np.flatnonzero(np.append(slots[1:] != slots[:-1], True))
    return [
        len(words),
        sum(lengths) / n,
        max(lengths, default=0),
        *share[[0, 1, 2, 5, 6, 7]],
        len(distinct) / n,
        np.diff(ends, prepend=-1).max() / n,
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
    ]


def width(metadata: int) -> int:
    return WORD_SLOTS + (len(STATISTICS) + metadata) * (BINS + 1)


def features(text: bytes, metadata: list[float | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a whole text: distinct words share a norm of one; every statistic and metadatum is one bin of its own range."""
    words = text.lower().split()
    distinct, crc = set(words), zlib.crc32
    slots = np.fromiter({crc(w) % WORD_SLOTS for w in distinct}, np.int32)
    figures = statistics(text, words, distinct)
    bins = [int(np.searchsorted(e, x)) for e, x in zip(STATISTICS.values(), figures)]
    # Metadata are numbers: bins of their logarithm, the last one for a null.
    bins += [BINS if x is None or x != x else min(BINS - 1, max(0, int(np.log2(max(x, 1)) * 0.75))) for x in metadata]
    own = WORD_SLOTS + np.arange(len(bins)) * (BINS + 1) + np.array(bins)
    values = np.full(len(slots), 1 / np.sqrt(max(1, len(slots))), np.float32)
    return np.concatenate([slots, own]).astype(np.int32), np.concatenate([values, np.full(len(bins), 0.3, np.float32)])


def _rows(texts: pa.Array, *metadata: pa.Array):
    """Features of texts and the columns of their metadata."""
    for text, *figures in zip(texts.to_pylist(), *[m.to_pylist() for m in metadata]):
        yield features(text, figures)


# Model ------------------------------------------------------------------------------------


@dataclass
class Machine:
    """score = bias + sum w x + 1/2 sum_f [(sum v x)^2 - sum v^2 x^2]: linear in the features that a row has."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, slots: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vx = self.factors[slots] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat((vx * vx).sum(1), starts)
        return self.bias + np.add.reduceat(self.linear[slots] * values, starts) + 0.5 * ((sums * sums).sum(1) - squares)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.empty(0)
        starts = np.cumsum([0, *(len(s) for s, _ in rows[:-1])])
        z = self.raw(np.concatenate([s for s, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, updates: int = 1500, rate: float = 0.15, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over about ``updates`` batches of 64 rows, at least 8 rounds over all of them. Labels of one kind only, or none, give their smoothed share as bias."""
    good, bad = int((labels == 1).sum()), int((labels == 0).sum())
    rng = np.random.default_rng(seed)
    bias = float(np.log((good + 1) / (bad + 1)))
    m = Machine(bias, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32))
    if not good or not bad:
        m.factors[:] = 0
        return m
    seen_w, seen_v, seen_b = np.full(size, 1e-3, np.float32), np.full((size, FACTORS), 1e-3, np.float32), 1e-3
    for _ in range(max(8, updates // -(-len(rows) // 64))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 64):
            part = order[at : at + 64]
            lengths = np.array([len(rows[i][0]) for i in part])
            slots = np.concatenate([rows[i][0] for i in part])
            x = np.concatenate([rows[i][1] for i in part])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            p = 1 / (1 + np.exp(-np.clip(m.raw(slots, x, starts), -35, 35)))
            error = ((p - labels[part]) / len(part)).astype(np.float32)
            e = np.repeat(error, lengths) * x
            vx = m.factors[slots] * x[:, None]
            gradient_v = e[:, None] * (np.repeat(np.add.reduceat(vx, starts), lengths, axis=0) - vx)
            # Slots that rows share add up.
            kept, place = np.unique(slots, return_inverse=True)
            gw = np.bincount(place, e, len(kept)).astype(np.float32) + 1e-5 * m.linear[kept]
            gv = np.stack([np.bincount(place, gradient_v[:, f], len(kept)) for f in range(FACTORS)], 1).astype(np.float32) + 1e-5 * m.factors[kept]
            seen_w[kept] += gw * gw
            seen_v[kept] += gv * gv
            m.linear[kept] -= rate * gw / np.sqrt(seen_w[kept])
            m.factors[kept] -= 0.3 * rate * gv / np.sqrt(seen_v[kept])
            seen_b += float(error.sum()) ** 2
            m.bias -= rate * float(error.sum()) / seen_b**0.5
    return m


# Spark ------------------------------------------------------------------------------------


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, usable, limit: int) -> DataFrame:
    """``_id, _label`` of at most ``limit`` ids, the same ones at every run. Labels of an id that disagree are averaged; null labels teach nothing."""
    votes = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable)
    votes = votes.groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_label"))
    return votes.orderBy(F.xxhash64(F.lit(3), "_id"), "_id").limit(limit)


def train(docs: DataFrame, labels: DataFrame, usable, id_col="doc_id", text_col="text", label_col="quality", metadata_cols=("n_chars",), limit: int = TRAIN_ROWS) -> Machine:
    """Fit on the labelled documents that ``usable`` admits; their features, not their texts, come to the driver, ``limit`` rows at most."""
    sample = labelled_sample(labels, id_col, label_col, usable, limit)
    sent = docs.select(F.col(id_col).alias("_doc"), text_or_empty(text_col).cast("binary").alias("_text"), *_metadata(docs, metadata_cols))
    # The sample is limited, so its broadcast is too.
    sent = sent.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).drop("_doc", "_id")
    sent = sent.select("_label", "_text", *[c for c in sent.columns if c.startswith("_m")])

    def run(batches):
        for b in batches:
            rows = list(_rows(*b.columns[1:]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s.tobytes() for s, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                names=["label", "slots", "values"],
            )

    # A repeated id brings more rows than the sample has ids: the limit holds for rows too.
    got = sent.mapInArrow(run, "label int, slots binary, values binary").limit(limit).toArrow()
    got = sorted(zip(*(got.column(c).to_pylist() for c in got.column_names)), key=lambda r: (r[1], r[2], r[0]))
    rows = [(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for _, s, v in got]
    return fit(rows, np.array([x for x, _, _ in got]), width(len(metadata_cols)))


def _metadata(docs: DataFrame, names) -> list:
    return [F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(names)]


def score(docs: DataFrame, model: Machine, text_col: str | int = "text", metadata_cols=("n_chars",), keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` (0 to 1) of every row. A null text scores as an empty one; every row gets a score.

    A number as ``text_col`` is the place of a string field in the first kept column: the text is sent once.
    """
    kept = [F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)]
    inside, n = isinstance(text_col, int), len(keep)
    text = [] if inside else [text_or_empty(text_col).cast("binary").alias("_text")]
    sent = docs.select(*kept, *_metadata(docs, metadata_cols), *text)
    held = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    names = [*(f"_k{i}" for i in range(n)), "score"]

    def run(batches):
        step = 512
        for b in batches:
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                columns, metadata = part.columns[:n], part.columns[n : n + len(metadata_cols)]
                texts = pc.fill_null(columns[0].field(text_col).cast(pa.large_binary()), b"") if inside else part.columns[-1]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(held.value.score(list(_rows(texts, *metadata))), pa.float64())], names=names)

    schema = T.StructType([*(sent.schema[f"_k{i}"] for i in range(n)), T.StructField("score", T.DoubleType())])
    return sent.mapInArrow(run, schema).toDF(*keep, "score")


def held_out(id_col: str, parts: int, part: int):
    """Whether crc32 of the id as text leaves the remainder ``part``; a null id does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", metadata_cols=("n_chars",), parts: int = 3, part: int = 1) -> DataFrame:
    """One row per row of ``docs``: ``<id>, held_out, score, predicted``.

    The model learns only from labels whose id is not held out, and never sees id, language or source.
    Inputs of a score are the words of the whole text, its statistics and ``metadata_cols`` (a null or missing
    figure has a bin of its own). Null and empty texts are scored like any others, repeated rows alike. Without
    labels of both kinds the score is their smoothed share, 0.5 for none. No rows give no rows.
    """
    metadata_cols = tuple(c for c in metadata_cols if c in docs.columns)
    model = train(docs, labels, ~held_out(id_col, parts, part), id_col, text_col, label_col, metadata_cols)
    scored = score(docs, model, text_col, metadata_cols, (id_col,))
    return scored.select(id_col, held_out(id_col, parts, part).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col="text", metadata_cols=("n_chars",), **options) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns; one pass, nothing is joined."""
    metadata_cols = tuple(c for c in metadata_cols if c in docs.columns)
    id_col = options.pop("id_col", "doc_id")
    model = train(docs, labels, ~held_out(id_col, 3, 1), id_col, text_col, metadata_cols=metadata_cols, **options)
    packed = docs.select(F.struct("*").alias("_row"), *_metadata(docs, metadata_cols))
    # A text is as large as all else of its row: it goes to Python as a part of the row, not once more beside it.
    if docs.schema[text_col].dataType == T.StringType():
        text = docs.columns.index(text_col)
    else:
        packed, text = packed.withColumn("_text", F.col("_row")[text_col]), "_text"
    scored = score(packed, model, text, [f"_m{i}" for i in range(len(metadata_cols))], ("_row",))
    return scored.where("score >= 0.5").select("_row.*")
