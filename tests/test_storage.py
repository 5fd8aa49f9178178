from sheaf.sources import storage


def test_local_names(tmp_path):
    (tmp_path / "a").write_bytes(b"xyz")
    plain = f"{tmp_path}/a"
    for name in (plain, f"file:{plain}", f"file://{plain}"):
        assert storage.is_local(name) and storage.absolute(name) == plain
        assert storage.file_size(name) == 3 and storage.read_file(name) == (b"xyz", None)
    for name in ("s3://bucket/a", "hdfs:/a", "gs://b/c"):
        assert not storage.is_local(name)
    assert storage.file_size(str(tmp_path)) is None
    assert list(storage.list_dir(str(tmp_path))) == [("a", False, 3)]


def test_staged_file(tmp_path):
    out = storage.StagedFile(f"file:{tmp_path}/sub/b")
    out.write(b"12")
    assert not (tmp_path / "sub" / "b").exists()
    out.commit()
    assert (tmp_path / "sub" / "b").read_bytes() == b"12"
    assert [p.name for p in (tmp_path / "sub").iterdir()] == ["b"]
