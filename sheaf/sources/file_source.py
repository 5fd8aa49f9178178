"""Files as a Spark data source: ``spark.read.format("corpus_files")``.

``load(root)`` reads every file below a directory; ``option("listing", folder)`` reads the files of a listing that
``store_listing`` wrote, for example those that ``select_files`` chose by rules. Columns are those of a read,
``abs_path, rel_path, bytes, raw, read_error``; a schema that names fewer of them asks for fewer, and without ``raw`` and
``read_error`` no file is opened. Filters on paths and sizes are taken before files are opened, and on ``rel_path``
before directories are listed. Every task reads about ``bytes_per_task`` bytes, less where that makes too few tasks.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheaf import fixed_values as fv
from sheaf.operators.ranks import with_offsets
from sheaf.session import qualified, shared_folder, store_table
from sheaf.sources.storage import absolute, file_size, list_dir, open_storage, read_file

NAME = "corpus_files"
SCHEMA = "abs_path string, rel_path string, bytes bigint, raw binary, read_error string"
BYTES_PER_TASK = 256 << 20
#: What a file costs besides its bytes, in bytes.
FILE_COST = 64 << 10
#: Tasks that planned files are dealt to at least, as far as there are as many files.
LEAST_TASKS = 64
#: Directories that planning lists itself; those below are listed by the tasks that read them.
PLANNED_DIRS = 2_000
_BATCH_BYTES = 32 << 20
_BATCH_FILES = 10_000
_ARROW = {"abs_path": pa.string(), "rel_path": pa.string(), "bytes": pa.int64(), "raw": pa.binary(), "read_error": pa.string()}

File = tuple[str, str, int]
_COLUMNS = {"abs_path": 0, "rel_path": 1, "bytes": 2}


def register(spark: SparkSession) -> None:
    """Make the source known to this session and let it see filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusFiles)


def store_listing(files: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> str:
    """Write ``abs_path, rel_path, bytes`` as a listing, one folder per task that will read it; returns its place.

    Files are dealt in the order of their paths by a running sum of their bytes, so a task exceeds
    ``bytes_per_task``, or what gives every core a task, by less than one file. A size that is null counts as 0.
    """
    cost = F.coalesce(F.col("bytes"), F.lit(0)) + FILE_COST
    dealt = store_table(with_offsets(files.select("abs_path", "rel_path", "bytes"), ["abs_path", "rel_path"], cost, "at"))
    total = dealt.agg(F.max(F.col("at") + cost)).first()[0] or 0
    per_task = min(bytes_per_task, total // files.sparkSession.sparkContext.defaultParallelism + 1)
    dealt = dealt.withColumn("task", F.floor(F.col("at") / per_task)).drop("at")
    location = f"{shared_folder(files.sparkSession)}/listing-{uuid.uuid4().hex}"
    dealt.repartition(min(total // per_task + 1, 2_000), "task").sortWithinPartitions("task").write.partitionBy("task").parquet(location)
    return location


def read_listed(files: DataFrame, schema: str = SCHEMA, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """The contents of listed files through the data source."""
    spark = files.sparkSession
    register(spark)
    listing = qualified(spark, store_listing(files, bytes_per_task))
    return spark.read.format(NAME).schema(schema).option("listing", listing).load()


# Filters --------------------------------------------------------------------------------------

_COMPARED: dict[type, Callable] = {
    ds.EqualTo: lambda a, b: a == b,
    ds.EqualNullSafe: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.In: lambda a, b: a in b,
    ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b),
    ds.StringContains: lambda a, b: b in a,
}
_ORDERED = (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


def understood(f: ds.Filter) -> bool:
    """Whether ``passes`` decides this filter as Spark would. Strings are ordered by Spark, which compares their bytes."""
    if isinstance(f, ds.Not):
        return understood(f.child)
    if type(f) not in _COMPARED or len(f.attribute) != 1 or f.attribute[0] not in _COLUMNS:
        return False
    values = f.value if isinstance(f, ds.In) else (f.value,)
    kind = int if f.attribute[0] == "bytes" else str
    return all(isinstance(v, kind) for v in values) and not (kind is str and isinstance(f, _ORDERED))


def passes(f: ds.Filter, file: File) -> bool | None:
    """The filter's value for a file; None, which keeps no row, where the size is unknown."""
    if isinstance(f, ds.Not):
        inner = passes(f.child, file)
        return None if inner is None else not inner
    held = file[_COLUMNS[f.attribute[0]]]
    if held is None:
        return False if isinstance(f, ds.EqualNullSafe) else None
    return _COMPARED[type(f)](held, f.value)


def may_hold(f: ds.Filter, folder: str) -> bool:
    """Whether a file below this folder (its path from the root and a slash) can pass."""
    if getattr(f, "attribute", None) != ("rel_path",):
        return True
    if isinstance(f, (ds.EqualTo, ds.EqualNullSafe)):
        return f.value.startswith(folder)
    if isinstance(f, ds.In):
        return any(v.startswith(folder) for v in f.value)
    if isinstance(f, ds.StringStartsWith):
        return f.value.startswith(folder) or folder.startswith(f.value)
    return True


# Reader ---------------------------------------------------------------------------------------


@dataclass
class Files(ds.InputPartition):
    """Files that planning has found."""

    files: list[File]


@dataclass
class Folder(ds.InputPartition):
    """A directory below the root, listed by the task that reads it."""

    rel_path: str


@dataclass
class Listed(ds.InputPartition):
    """One task of a stored listing."""

    location: str


def is_binary_name(rel_path: str) -> bool:
    """By its last extension, as ``has_ext`` tells; such files are not opened."""
    name = rel_path.rsplit("/", 1)[-1]
    at = name.rfind(".")
    return at >= 0 and name[at:].lower() in fv.BINARY_EXTENSIONS


class CorpusFilesReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.listing, self.root = options.get("listing"), options.get("path")
        if not (self.listing or self.root):
            raise ValueError("give a root to load, or a listing")
        self.root = self.root and absolute(self.root)
        self.per_task = int(options.get("bytes_per_task", BYTES_PER_TASK))
        self.least_tasks = int(options.get("least_tasks", LEAST_TASKS))
        self.planned_dirs = int(options.get("planned_dirs", PLANNED_DIRS))
        self.columns, self.filters = columns, []
        self.opens = bool({"raw", "read_error"} & set(columns))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            if understood(f):
                self.filters.append(f)
            else:
                yield f

    def wanted(self, file: File) -> bool:
        return all(passes(f, file) for f in self.filters)

    # Planning

    def partitions(self) -> list[ds.InputPartition]:
        if self.listing:
            tasks = [Listed(f"{self.listing}/{name}") for name, is_dir, _ in list_dir(self.listing) if is_dir and name.startswith("task=")]
            return tasks or [Files([])]
        size = file_size(self.root)
        if size is not None:
            own = (self.root, self.root.rsplit("/", 1)[-1], size)
            return self.dealt([own] if self.wanted(own) else [])
        found: list[File] = []
        waiting, seen = deque([""]), 0
        while waiting and seen < self.planned_dirs:
            files, below = self.listed(waiting.popleft())
            found += files
            waiting += below
            seen += 1
        return [*self.dealt(sorted(found)), *map(Folder, waiting)]

    def listed(self, folder: str) -> tuple[list[File], list[str]]:
        """The wanted files of a directory and the directories in it that may hold some."""
        files, below = [], []
        prefix = f"{folder}/" if folder else ""
        for name, is_dir, size in list_dir(f"{self.root}/{folder}" if folder else self.root):
            path = prefix + name
            if is_dir:
                if all(may_hold(f, path + "/") for f in self.filters):
                    below.append(path)
            elif self.wanted(file := (f"{self.root.rstrip('/')}/{path}", path, size)):
                files.append(file)
        return files, below

    def dealt(self, files: list[File]) -> list[Files]:
        """Runs of files of about ``bytes_per_task`` or less; one at least, since Spark asks for a partition."""
        made, held = [Files([])], 0
        per_task = min(self.per_task, sum(size + FILE_COST for _, _, size in files) // self.least_tasks + 1)
        for file in files:
            if held >= per_task:
                made.append(Files([]))
                held = 0
            made[-1].files.append(file)
            held += file[2] + FILE_COST
        return made

    # Reading

    def files_of(self, part: ds.InputPartition) -> Iterator[File]:
        if isinstance(part, Files):
            yield from part.files
        elif isinstance(part, Folder):
            waiting = [part.rel_path]
            while waiting:
                files, below = self.listed(waiting.pop())
                yield from files
                waiting += below
        else:
            for name, is_dir, _ in list_dir(part.location):
                if not is_dir and name.endswith(".parquet"):
                    system, path = open_storage(f"{part.location}/{name}")
                    with system.open_input_file(path) as f:
                        for batch in pq.ParquetFile(f).iter_batches(_BATCH_FILES, columns=list(_COLUMNS)):
                            rows = zip(*(batch.column(c).to_pylist() for c in _COLUMNS))
                            yield from filter(self.wanted, rows)

    def read(self, part: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for file in self.files_of(part):
            raw = error = None
            if self.opens and not is_binary_name(file[1]):
                raw, error = read_file(file[0])
                if raw is None and error is None:  # it has vanished
                    continue
                raw = raw or b""
            rows.append((*file, raw, error))
            held += len(raw or b"")
            if held >= _BATCH_BYTES or len(rows) >= _BATCH_FILES:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        values = dict(zip(_ARROW, zip(*rows)))
        return pa.RecordBatch.from_arrays([pa.array(values[c], _ARROW[c]) for c in self.columns], names=self.columns)


class CorpusFiles(ds.DataSource):
    """Options: ``path`` (what ``load`` is given) or ``listing``, ``bytes_per_task``, ``least_tasks``, ``planned_dirs``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CorpusFilesReader:
        unknown = set(schema.names) - set(_ARROW)
        if unknown:
            raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
        return CorpusFilesReader(dict(self.options), list(schema.names))
