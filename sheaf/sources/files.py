"""Directory trees as corpora.

Directories are listed by executors, one level per round, so neither the driver nor
one task ever holds a whole tree, and a lopsided tree is spread anew on every level.
Directories that stated patterns or the ignore files above them exclude are not listed, and file contents are read
last, only for files that every other rule has let through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf import fixed_values as fv
from sheaf.functions.text import base_name, has_ext
from sheaf.operators import select
from sheaf.operators.status import skip_status
from sheaf.session import cut_lineage, qualified, store_table, task_count
from sheaf.sources.storage import absolute, file_size, list_dir, read_file

_ENTRY = "root string, rel_path string, is_dir boolean, bytes bigint"
_CONTENT = "abs_path string, rel_path string, bytes bigint, raw binary, read_error string"
_READ_BATCH = 32 << 20
_BYTES_PER_TASK = 256 << 20
_FILES_PER_TASK = 5000
_DIRS_PER_TASK = 200
_ENTRIES_PER_BATCH = 20_000


def _join(root: str, rel_path: str) -> str:
    return f"{root.rstrip('/')}/{rel_path}" if rel_path else root


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            prefix = f"{row['rel_path']}/" if row["rel_path"] else ""
            listed = list_dir(_join(row["root"], row["rel_path"]))
            while found := list(islice(listed, _ENTRIES_PER_BATCH)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "root": pa.array([row["root"]] * len(found), pa.string()),
                        "rel_path": pa.array([prefix + name for name, _, _ in found], pa.string()),
                        "is_dir": pa.array([d for _, d, _ in found], pa.bool_()),
                        "bytes": pa.array([size for _, _, size in found], pa.int64()),
                    }
                )


def walk(spark: SparkSession, root: str, patterns: list[str] = (), tool_name: str = select.TOOL_NAME, **names: bool) -> tuple[DataFrame, DataFrame | None]:
    """All files below a directory, ``root, rel_path, is_dir, bytes``, and the rules of the ignore files among them.

    Directories that stated patterns or rules found on the way ignore are not listed, so nothing below them
    is seen. ``names`` says which ignore files count; no rules are read, and None is returned, where there are none.
    """
    stated, wanted = list(patterns), select.ignore_file_names(tool_name, **names)
    frontier = spark.createDataFrame([(root, "")], "root string, rel_path string")
    files = rules = None
    waiting = 1
    while waiting:
        # a stated number of tasks: by the size of its rows a listing looks too small to spread
        spread = frontier.repartition(min(waiting, task_count(spark, waiting, _DIRS_PER_TASK)), "rel_path")
        level = cut_lineage(spread.mapInArrow(_list, _ENTRY))
        here = level.where("not is_dir")
        files = here if files is None else files.unionByName(here)
        found = _located(here.where(base_name("rel_path").isin(wanted)))
        if wanted and not found.isEmpty():
            texts = read_contents(found).select("rel_path", F.col("raw").cast("string").alias("content"))
            own = store_table(select.scan_ignore_rules(texts, tool_name, **names))
            rules = own if rules is None else rules.unionByName(own)
        frontier = level.where("is_dir").select("root", "rel_path")
        if rules is None:
            frontier = frontier.where(~select.is_ignored("rel_path", stated, True))
        else:
            frontier = cut_lineage(select.unignored_dirs(frontier, rules, stated))
        waiting = frontier.count()
    return files, rules


def _located(listed: DataFrame) -> DataFrame:
    return listed.select(F.concat(F.regexp_replace("root", r"/\z", ""), F.lit("/"), "rel_path").alias("abs_path"), "rel_path", "bytes")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("abs_path", pa.string()), ("rel_path", pa.string()), ("bytes", pa.int64()), ("raw", pa.binary()),
         ("read_error", pa.string())]
    )
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for row in batch.to_pylist():
            raw, error = read_file(row["abs_path"])
            if raw is None and error is None:
                continue
            rows.append((row["abs_path"], row["rel_path"], row["bytes"], raw or b"", error))
            held += len(raw or b"")
            if held >= _READ_BATCH:
                yield _batch(rows, schema)
                rows, held = [], 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_contents(files: DataFrame) -> DataFrame:
    """Add ``raw`` and ``read_error`` to ``abs_path, rel_path, bytes``; files that have vanished are dropped.

    The list is stored, measured and dealt out by path before any file is read: tasks
    follow the bytes to read, a directory of large files does not stay in one task, and
    contents never travel. Extensions that mean binary are not read.
    """
    listed = store_table(files.select("abs_path", "rel_path", "bytes"))
    work = listed.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    tasks = max(
        task_count(files.sparkSession, work["size"], _BYTES_PER_TASK), task_count(files.sparkSession, work["n"], _FILES_PER_TASK)
    )
    by_ext = has_ext("rel_path", fv.BINARY_EXTENSIONS)
    unread = listed.where(by_ext).select(
        "*", F.lit(None).cast("binary").alias("raw"), F.lit(None).cast("string").alias("read_error")
    )
    dealt = listed.where(~by_ext).repartition(min(tasks, max(1, work["n"])), "abs_path")
    return dealt.mapInArrow(_read, _CONTENT).unionByName(unread)


def select_files(
    spark: SparkSession,
    root: str,
    *,
    include: list[str] = (),
    custom_ignores: list[str] = (),
    use_default_patterns: bool = True,
    use_gitignore: bool = True,
    use_dot_ignore: bool = True,
    max_file_bytes: int = fv.MAX_FILE_BYTES,
    tool_name: str = select.TOOL_NAME,
) -> DataFrame:
    """The files of a tree that a pack shows: ``abs_path, rel_path, bytes``. Contents are not read.

    A root that is a file is that file, whatever the rules say.
    """
    root = absolute(qualified(spark, root))
    size = file_size(root)
    if size is not None:
        row = [(root, root.rstrip("/").rsplit("/", 1)[-1], size)]
        return spark.createDataFrame(row, "abs_path string, rel_path string, bytes bigint")
    stated = (select.default_ignores(tool_name) if use_default_patterns else []) + list(custom_ignores)
    listed, rules = walk(spark, root, stated, tool_name, gitignore=use_gitignore, dot_ignore=use_dot_ignore)
    files = _located(listed)
    if rules is None:  # ignored directories were not listed
        files = select.ignore_filter(files, stated)
    else:
        files = select.nested_ignores(files, rules, stated)
    return select.max_size_filter(select.include_filter(files, list(include)), max_file_bytes)


def scan_corpus_files(spark: SparkSession, root: str, **options) -> DataFrame:
    """A directory tree in the corpus schema; the options are those of ``select_files``."""
    read = read_contents(select_files(spark, root, **options))
    return skip_status(read).select("abs_path", "rel_path", "bytes", "is_binary", "content", "skip_reason")


def scan_roots(spark: SparkSession, roots: list[str], **options) -> DataFrame:
    """Several roots as one corpus; a file reached from more than one root belongs to the first.

    The lists are united before any content is read, so every file is read once.
    """
    listed = select.union_roots([select_files(spark, root, **options) for root in roots or ["."]])
    return skip_status(read_contents(listed)).select("abs_path", "rel_path", "bytes", "is_binary", "content", "skip_reason")
