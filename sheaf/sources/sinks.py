"""Write packs: numbered part files, or one document as a row of files in order."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.markup import part_filename
from sheaf.operators.render import EXTENSIONS, ORDER
from sheaf.operators.split import ranges_for
from sheaf.session import hadoop_path, qualified, store_table
from sheaf.sources.storage import PassingFile, chunks_of, is_local, move_file, remove_file, write_at

_WRITTEN = "file string, bytes bigint"
_STAGED = "file string, staged string, bytes bigint"
_STAGED_ARROW = pa.schema([("file", pa.string()), ("staged", pa.string()), ("bytes", pa.int64())])


def default_filename(style: str, tool_name: str = "sheaf") -> str:
    return f"{tool_name}-output{EXTENSIONS.get(style, '.xml')}"


def named_parts(parts: DataFrame, base: str) -> DataFrame:
    """Add ``file``: ``base`` itself for a pack of one part, else ``stem.N.ext``; named packs get a folder."""
    name = F.when(F.col("n_parts") > 1, part_filename(F.lit(base), F.col("part_no"))).otherwise(base)
    folder = F.when(F.col("pack") == "", "").otherwise(
        F.concat(F.replace(F.url_encode("pack"), F.lit("+"), F.lit("%20")), F.lit("/"))
    )
    return parts.withColumn("file", F.concat(folder, name))


def _write_named(staging: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, staged, sizes = [], [], []
            for row in batch.to_pylist():
                out = PassingFile(staging)
                out.write(row["content"])
                out.close()
                names.append(row["file"])
                staged.append(out.location)
                sizes.append(len(row["content"]))
            yield pa.RecordBatch.from_pydict({"file": names, "staged": staged, "bytes": pa.array(sizes, pa.int64())}, _STAGED_ARROW)

    return run


def _delete(location: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                remove_file(f"{location}/{name}")
            yield batch

    return run


def _move(location: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                move_file(row["staged"], f"{location}/{row['file']}")
            yield batch

    return run


def _run(rows: DataFrame, work) -> None:
    rows.mapInArrow(work, rows.schema).write.format("noop").mode("overwrite").save()


class PackFolder:
    """A folder whose files are those of one whole run: the last that was committed.

    Tasks write under passing names in a folder of the run (``_staged-...``). The list of these, ``_pending``, is written
    when all of them are done; that it is complete is the commit. Only then the files get their names, what the run
    before wrote and this one did not is deleted, and the list becomes ``_written``. Each of these steps may be
    repeated: a driver lost before the commit leaves the old files as they were, one lost after it leaves
    work that the next run (or ``recover``) ends first. Two runs must not write to one folder at a time.
    """

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, qualified(spark, location)
        self.staging = f"{self.location}/_staged-{uuid.uuid4().hex}"
        self.files = hadoop_path(spark, self.location).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.files.exists(hadoop_path(self.spark, f"{self.location}/{name}"))

    def drop(self, name: str) -> None:
        self.files.delete(hadoop_path(self.spark, f"{self.location}/{name}"), True)

    def write(self, staged: DataFrame) -> DataFrame:
        """Run the job behind ``staged`` (``file, staged, bytes``) and make its files those of the folder; ``file, bytes``."""
        self.recover()
        return self.publish_staged(staged)

    def publish_staged(self, staged: DataFrame) -> DataFrame:
        try:
            staged.write.mode("overwrite").parquet(f"{self.location}/_pending")
        except Exception:
            self.recover()
            raise
        return self.publish()

    def recover(self) -> None:
        """End a committed run that was cut short; remove what one that was not committed left."""
        if self.exists("_pending/_SUCCESS"):
            self.publish()
        self.clean()

    def clean(self) -> None:
        self.drop("_pending")
        for place in self.files.globStatus(hadoop_path(self.spark, f"{self.location}/_staged-*")) or []:
            self.files.delete(place.getPath(), True)

    def publish(self) -> DataFrame:
        pending = self.spark.read.schema(_STAGED).parquet(f"{self.location}/_pending")
        _run(pending.select("staged", "file"), _move(self.location))
        if self.exists("_written"):
            before = self.spark.read.schema(_WRITTEN).parquet(f"{self.location}/_written")
            _run(before.join(pending, "file", "left_anti").select("file"), _delete(self.location))
        pending.select("file", "bytes").write.mode("overwrite").parquet(f"{self.location}/_written")
        self.clean()
        return self.spark.read.schema(_WRITTEN).parquet(f"{self.location}/_written")


def write_packs(parts: DataFrame, location: str, base: str) -> DataFrame:
    """Write the result of ``split_packs``; returns ``file, bytes`` of what was written.

    Every part is one file written by the task that holds it; all of them become visible once every one is
    written (``PackFolder``). Parts that an earlier run wrote here and this one did not are deleted; a
    location without a scheme is on the default file system.
    """
    folder = PackFolder(parts.sparkSession, location)
    named = named_parts(parts, base).select("file", "content")
    return folder.write(named.mapInArrow(_write_named(folder.staging), _STAGED))


def file_digests(written: DataFrame, location: str) -> DataFrame:
    """``file, bytes, digest`` of listed files as they are on storage now: size and MD5, read in chunks."""
    location = qualified(written.sparkSession, location)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for name in batch.column("file").to_pylist():
                digest, size = hashlib.md5(usedforsecurity=False), 0
                for chunk in chunks_of(f"{location}/{name}"):
                    digest.update(chunk)
                    size += len(chunk)
                sizes.append(size)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_pydict({"file": batch.column("file").cast(pa.string()), "bytes": pa.array(sizes, pa.int64()), "digest": digests})

    return written.select("file").mapInArrow(run, "file string, bytes bigint, digest string")


def _write_range(staging: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size, name = None, 0, ""
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{row['range']:05d}"
                    out = PassingFile(staging)
                out.write(row["body"])
                size += len(row["body"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "staged": [out.location], "bytes": pa.array([size], pa.int64())}, _STAGED_ARROW)

    return run


def _staged_ranges(sections: DataFrame, staging: str, ranges: int | None) -> DataFrame:
    ranged = sections.repartitionByRange(ranges or ranges_for(sections), *ORDER)
    bodies = ranged.sortWithinPartitions(*ORDER).select(
        F.spark_partition_id().alias("range"), F.col("body").cast("binary").alias("body")
    )
    return bodies.mapInArrow(_write_range(staging), _STAGED)


def write_document(sections: DataFrame, location: str, ranges: int | None = None) -> DataFrame:
    """Write a document unsplit as sorted ranges, one file each, whose concatenation is the document."""
    folder = PackFolder(sections.sparkSession, location)
    return folder.write(_staged_ranges(sections, folder.staging, ranges))


def _copy_at(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                write_at(target, row["at"], chunks_of(row["staged"]))
            yield batch

    return run


def _append(target: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]  # one short row per range
        out = PassingFile(target.rpartition("/")[0], target.rpartition("/")[2])
        for row in sorted(rows, key=lambda r: r["at"]):
            for chunk in chunks_of(row["staged"]):
                out.write(chunk)
        out.close()
        yield from ()

    return run


def write_file(sections: DataFrame, location: str, base: str, ranges: int | None = None) -> DataFrame:
    """Write a document unsplit as the one file ``base``; returns ``file, bytes``.

    Sorted ranges are written first, by as many tasks. Where each begins in the file is the sum of the sizes before it;
    there is one such number per task, summed on the driver. On storage that can be written at a place every range is
    then copied to its own; elsewhere one task streams the ranges in order. No task holds more than a chunk. The
    file becomes visible as ``write_packs``' parts do. No sections give an empty file.
    """
    spark = sections.sparkSession
    folder = PackFolder(spark, location)
    folder.recover()
    written = sorted(store_table(_staged_ranges(sections, folder.staging, ranges)).collect(), key=lambda r: int(r.file[5:]))
    ends = list(accumulate(r.bytes for r in written))
    total = ends[-1] if ends else 0
    rows = [(r.staged, end - r.bytes) for r, end in zip(written, ends)]
    target = f"{folder.staging}/whole"
    at_place = is_local(target)
    places = spark.createDataFrame(rows, "staged string, at bigint")
    places = places.repartition(max(1, len(rows)) if at_place else 1)
    if at_place:
        write_at(target, 0, [])
        _run(places, _copy_at(target))
    else:
        _run(places, _append(target))
    one = spark.createDataFrame([(base, target, total)], _STAGED)
    return folder.publish_staged(one)
