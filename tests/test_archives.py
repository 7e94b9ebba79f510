"""Listings of archives: names, sizes, errors, and memory that doesn't grow with an archive."""

import io
import os
import resource
import zipfile

import pytest

from mulberry.sources import archives as a
from mulberry.sources.files import archive_members


@pytest.fixture
def folder(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("dir/", "")
        z.writestr("dir/무협.txt", "x" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("b 100%.txt", "yy")
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr(zipfile.ZipInfo("OLDNAME.txt", (2020, 5, 6, 7, 8, 10)), "z")
    (tmp_path / "옛 것 100% #1.ZIP").write_bytes(raw.getvalue().replace(b"OLDNAME", "소설k".encode("cp949").ljust(7, b"k")))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "broken.zip").write_bytes(b"PK no archive")
    (tmp_path / "sub" / "other.7z").write_bytes(b"7z")
    (tmp_path / "sub" / "plain.txt").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    return tmp_path


def test_members(spark, folder):
    got = sorted((os.path.basename(r.archive), r.name, r.size, r.is_dir, r.error) for r in archive_members(spark, str(folder)).collect() if not r.error)
    assert got == [("a.zip", "b 100%.txt", 2, False, None), ("a.zip", "dir/", 0, True, None), ("a.zip", "dir/무협.txt", 1000, False, None), ("옛 것 100% #1.ZIP", "소설kkk.txt", 1, False, None)]
    errors = {os.path.basename(r.archive): r.error for r in archive_members(spark, str(folder)).filter("error is not null").collect()}
    assert errors == {"broken.zip": "File is not a zip file", "other.7z": "unsupported"}
    row = a.list_archives(a.archive_paths(spark, str(folder))).filter("name like '%kkk%'").first()
    assert str(row.modified) == "2020-05-06 07:08:10" and row.packed == 1


def test_contents_are_not_scanned(spark, folder):
    plan = a.archive_paths(spark, str(folder))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.partition("ReadSchema")[2]


def test_missing_and_null_paths(spark, tmp_path):
    df = spark.createDataFrame([(f"file:{tmp_path}/gone.zip",), (None,)], "path string")
    (row,) = a.list_archives(df).collect()
    assert row.name is None and "gone.zip" in row.error
    assert a.list_archives(df.limit(0)).collect() == []


def test_three_gigabytes_in_constant_memory(spark, tmp_path):
    """A hole of 3 GB before the archive's end: it is never read."""
    path = tmp_path / "large.zip"
    small = io.BytesIO()
    with zipfile.ZipFile(small, "w") as z:
        for i in range(12_000):
            z.writestr(f"{i}.txt", "x")
    with path.open("wb") as f:
        f.seek(3 << 30)
        f.write(small.getvalue())
    assert path.stat().st_size > 3 << 30
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert sum(1 for _ in a._members(f"file:{path}")) == 12_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # KB
    assert archive_members(spark, str(tmp_path)).count() == 12_000
