"""The archive data source: ranges, kinds of compression, long names, damage, unsafe paths, writing."""

import io
import tarfile
import zipfile

import pytest

from runloom.sources import archives, packed

CONTENT = {f"w/p__q-{i % 7}_a/run/f{i}{'x' * (120 if i % 5 == 0 else 0)}.txt": f"text {i} é\n" * (i % 40) for i in range(300)}


def zipped(path, method=zipfile.ZIP_DEFLATED, before=b""):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as z:
        for n, x in CONTENT.items():
            z.writestr(n, x)
        z.writestr("loose.txt", "no sample")
        z.mkdir("w/p__q-0_a/empty")
    path.write_bytes(before + buffer.getvalue())


def tarred(path, kind=tarfile.PAX_FORMAT, mode="w"):
    with tarfile.open(path, mode, format=kind) as t:
        for n, x in CONTENT.items():
            raw = x.encode()
            info = tarfile.TarInfo(n)
            info.size = len(raw)
            t.addfile(info, io.BytesIO(raw))
        link = tarfile.TarInfo("w/p__q-0_a/link")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)


def read(spark, path, **options):
    rows = archives.archive(spark, str(path), **options).collect()
    assert len({(r["sample"], r["path"]) for r in rows}) == len(rows)
    return {f"w/{r['sample']}/{r['path']}": r["content"] for r in rows}


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_zip_by_ranges(spark, tmp_path, method):
    at = tmp_path / "r.zip"
    zipped(at, method, b"#!/bin/sh\n")
    assert len(list(packed.planned(str(at), 4096))) > 5 and len(list(packed.planned(str(at)))) == 1
    assert read(spark, at, partition_bytes=4096) == CONTENT and read(spark, f"file://{at}") == CONTENT


@pytest.mark.parametrize("kind", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT])
def test_tar_by_ranges(spark, tmp_path, kind):
    tarred(tmp_path / "r.tar", kind)
    tarred(tmp_path / "r.tgz", kind, "w:gz")
    assert len(list(packed.planned(str(tmp_path / "r.tar"), 8192))) > 5 and len(list(packed.planned(str(tmp_path / "r.tgz"), 8192))) == 1
    assert read(spark, tmp_path / "r.tar", partition_bytes=8192) == CONTENT and read(spark, tmp_path / "r.tgz") == CONTENT


def test_only_what_is_wanted(spark, tmp_path):
    zipped(tmp_path / "r.zip")
    assert set(read(spark, tmp_path / "r.zip", subpath="w/p__q-3_a/")) == {n for n in CONTENT if "q-3_" in n}
    assert set(read(spark, tmp_path / "r.zip", members=("f1.txt", "f2?.txt"))) == {n for n in CONTENT if n.rsplit("/", 1)[-1] in {"f1.txt", *(f"f2{i}.txt" for i in range(10))}}
    with pytest.raises(Exception, match="nothing-here"):
        read(spark, tmp_path / "nothing-here.zip")


def test_unsafe_paths_by_load(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        for n in ("a__b-1_x/ok.txt", "a__b-1_x/../../out.txt", "/a__b-1_x/root.txt", "a__b-1_x/c\\d.txt"):
            z.writestr(n, "x")
    assert [r["path"] for r in archives.load(spark, str(tmp_path / "r.zip")).collect()] == ["ok.txt"]
    with pytest.raises(Exception, match="unsafe path"):
        archives.load(spark, str(tmp_path / "r.zip"), unsafe="reject").count()


def test_damaged_archives_are_errors(spark, tmp_path):
    zipped(tmp_path / "r.zip", zipfile.ZIP_STORED)
    raw = bytearray((tmp_path / "r.zip").read_bytes())
    at = raw.index(b"text 7 ")
    raw[at] ^= 1
    (tmp_path / "bad.zip").write_bytes(raw)
    with pytest.raises(Exception, match="is damaged"):
        read(spark, tmp_path / "bad.zip")
    (tmp_path / "not.zip").write_bytes(b"x" * 50)
    with pytest.raises(Exception, match="no directory"):
        read(spark, tmp_path / "not.zip")


@pytest.mark.parametrize("kind", ["zip", "tar", "tar.gz"])
def test_archives_are_written_and_read_back(spark, tmp_path, kind):
    rows = [(f"a__b-{i % 3}_s", f"d/{i}.txt", "é" * i if i % 4 else None) for i in range(50)] + [(None, "x", "y"), ("a__b-9_s", None, "y")]
    files = spark.createDataFrame(rows, "sample string, path string, content string").repartition(4)
    archives.pack(files, str(tmp_path / "out"), kind)
    archives.pack(files.where("path = 'd/1.txt'").withColumn("sample", packed_name("c__d-1_s")), str(tmp_path / "out"), kind)
    assert not list((tmp_path / "out").glob("_pending*")) and len(list((tmp_path / "out").glob(f"*.{kind}"))) in range(2, 6)
    got = {(r["sample"], r["path"]): r["content"] for r in archives.archive(spark, str(tmp_path / "out")).collect()}
    assert got == {(s, p): c or "" for s, p, c in rows if s and p} | {("c__d-1_s", "d/1.txt"): "é"}


def packed_name(x):
    from pyspark.sql import functions as F

    return F.lit(x)
