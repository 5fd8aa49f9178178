import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from sheaf.operators.status import skip_status
from sheaf.sources import file_source, files

CORPUS = ["abs_path", "rel_path", "bytes", "is_binary", "content", "skip_reason"]
NAMES = ["a.py", "b/c.md", "b/deep/er/d.py", "b/deep/e.PNG", "z/empty", "z/.hidden", "z/f.py", "no dot/x", "ü/ß.txt"]


@pytest.fixture
def root(tmp_path):
    for k, name in enumerate(NAMES):
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"" if name.endswith("empty") else f"line of {name}\n".encode() * (k + 1))
    (tmp_path / "tree" / "latin").write_bytes(b"caf\xe9\n")
    os.symlink(tmp_path / "tree" / "a.py", tmp_path / "tree" / "link.py")
    return str(tmp_path / "tree")


def load(spark, root, **options):
    file_source.register(spark)
    return spark.read.format(file_source.NAME).options(**options).load(root)


def key(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("options", [{}, {"planned_dirs": "1"}, {"planned_dirs": "2", "bytes_per_task": "1"}])
def test_rows_are_those_of_the_scan(spark, root, options):
    want = files.scan_corpus_files(spark, root, use_default_patterns=False, max_file_bytes=0)
    got = skip_status(load(spark, root, **options)).select(CORPUS)
    assert key(got.collect()) == key(want.collect()) and got.count() == len(NAMES) + 1


def test_a_listing_chosen_by_rules(spark, root):
    chosen = files.select_files(spark, root, include=["*.py"])
    got = skip_status(file_source.read_listed(chosen, bytes_per_task=100_000))
    assert got.rdd.getNumPartitions() == 3  # a file for each core that can have one
    assert key(got.select(CORPUS).collect()) == key(files.scan_corpus_files(spark, root, include=["*.py"]).collect())
    assert file_source.read_listed(chosen.where("false")).collect() == []


def test_filters_give_what_spark_gives(spark, root):
    every = spark.createDataFrame(load(spark, root).collect(), file_source.SCHEMA)
    for condition in (
        "rel_path = 'b/c.md'", "rel_path in ('a.py', 'z/f.py', 'gone')", "rel_path like 'b/%'", "rel_path like '%.py'", "rel_path like '%/e%'",
        "bytes > 30", "bytes >= 42 and bytes < 90", "not (bytes <= 30)", "rel_path <> 'a.py'", "rel_path not like 'b/%'", "rel_path > 'b'", "bytes <=> 0",
        "rel_path is not null", "bytes = null", "raw like '%er%'", "read_error is null", "bytes > 30 or rel_path = 'a.py'", "length(rel_path) = 4",
    ):
        assert key(load(spark, root).where(condition).collect()) == key(every.where(condition).collect()), condition
    plan = load(spark, root).where("rel_path like 'b/%'")._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "StartsWith" not in plan


def reader(root, columns, *filters, **options):
    made = file_source.CorpusFilesReader({"path": root, **options}, columns)
    return made, list(made.pushFilters(list(filters)))


def read_all(made):
    return [r for p in made.partitions() for b in made.read(p) for r in b.to_pylist()]


def test_opened_files_are_counted(root, monkeypatch):
    opened, looked = [], []
    monkeypatch.setattr(file_source, "read_file", lambda f: (opened.append(f), (b"", None))[1])
    plain = file_source.list_dir
    monkeypatch.setattr(file_source, "list_dir", lambda d: (looked.append(d), plain(d))[1])
    made, left = reader(root, ["rel_path", "bytes"])
    assert len(read_all(made)) == len(NAMES) + 1 and not opened
    made, left = reader(root, ["rel_path", "raw"])
    assert len(read_all(made)) == len(NAMES) + 1 and len(opened) == len(NAMES)  # not the picture
    opened.clear(), looked.clear()
    made, left = reader(root, ["raw"], ds.StringStartsWith(("rel_path",), "b/deep/"), ds.GreaterThan(("bytes",), 10), ds.IsNotNull(("raw",)))
    assert [type(f) for f in left] == [ds.IsNotNull]
    read_all(made)
    assert [os.path.relpath(f, root) for f in opened] == ["b/deep/er/d.py"]
    assert sorted(os.path.relpath(d, root) for d in looked) == [".", "b", "b/deep", "b/deep/er"]


def test_columns_that_are_not_asked_for_are_not_read(spark, root):
    file_source.register(spark)
    chosen = files.select_files(spark, root, use_default_patterns=False, max_file_bytes=0)
    narrow = file_source.read_listed(chosen, "bytes bigint, rel_path string")
    whole = file_source.read_listed(chosen)
    os.remove(f"{root}/a.py")
    assert narrow.agg(F.sum("bytes")).first()[0] == chosen.agg(F.sum("bytes")).first()[0] and narrow.count() == len(NAMES) + 1
    assert whole.count() == len(NAMES)  # a vanished file is dropped when it is opened


def test_tasks_are_dealt_by_bytes(root):
    made, _ = reader(root, ["bytes"], bytes_per_task=str(3 * file_source.FILE_COST), least_tasks="1")
    parts = made.partitions()
    assert [len(p.files) for p in parts] == [3, 3, 3, 1]
    assert [len(p.files) for p in reader(root, ["bytes"], least_tasks="64")[0].partitions()] == [1] * 10
    single, _ = reader(f"{root}/a.py", ["rel_path", "raw"])
    assert read_all(single) == [{"rel_path": "a.py", "raw": b"line of a.py\n"}]


def test_what_it_cannot_read(spark, root):
    file_source.register(spark)
    with pytest.raises(PySparkException):
        spark.read.format(file_source.NAME).schema("other string").load(root).collect()
    with pytest.raises(PySparkException):
        load(spark, f"{root}/nowhere").collect()
