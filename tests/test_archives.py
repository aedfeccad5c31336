import zipfile

from codelake.sources import archives as A
from conftest import rows


def make(path, entries):
    with zipfile.ZipFile(path, "w") as z:
        for name, body in entries:
            z.writestr(name, body)


def test_reader(spark, tmp_path):
    make(tmp_path / "one.zip", [
        ("p/A.java", "x" * 10), ("p/B.java", "äöü"), ("p/test/T.java", "t"), ("p/pom.xml", "<p/>"), ("p/logo.png", b"\x89"), ("p/c.yml", " ")])
    z = A.open_archives(spark, str(tmp_path))
    assert rows(A.read_archives(z), "path") == [("p/A.java",), ("p/B.java",), ("p/c.yml",), ("p/pom.xml",)]
    assert rows(A.read_archives(z, max_files=2), "path") == [("p/A.java",), ("p/B.java",)]
    # The cap counts bytes: a cut character becomes the replacement character.
    assert dict(rows(A.read_archives(z, cap=3), "path", "content"))["p/B.java"] == "ä�"
    assert rows(A.read_archives(z, mode="all"), "path") == [("p/A.java",), ("p/B.java",), ("p/logo.png",), ("p/pom.xml",)]
    assert A.list_paths(z).count() == 6


def test_batches_of_archives_are_bounded_by_bytes(spark):
    from codelake.session import BATCH_BYTES, small_batches
    from codelake.sources.archives import list_paths, read_archives

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    archives = spark.createDataFrame([("a", b"")], "archive string, content binary")
    for read in (read_archives, list_paths):
        spark.conf.set(name, str(1 << 30))
        read(archives)
        assert int(spark.conf.get(name)) == BATCH_BYTES
    spark.conf.set(name, "1MB")
    small_batches(spark)
    assert spark.conf.get(name) == "1MB"
    spark.conf.unset(name)
