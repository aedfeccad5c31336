"""Session defaults and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def get_spark(app: str = "codelake", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the library relies on.

    ``master`` is only for tests and the bench; on a cluster spark-submit sets it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g")
    builder = (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> None:
    """All day and month boundaries of the library are UTC boundaries."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A local master without that setting gets a temporary folder; a cluster without it
    is an error, because executors could not read each other's files after a loss.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage by writing the rows to the shared folder and reading them back.

    A read table carries its true size and none of the old plan's constraints, which
    in a loop of joins would make planning slower round by round.  The files go when
    the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/codelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to Python, where texts are long or workers of earlier stages still live.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of a batch for Python, unless it's lower already."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if _bytes(spark.conf.get(name, "2147483647")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _bytes(text: str) -> int:
    """A size setting such as 64MB in bytes."""
    number = text.lower().rstrip("b").strip()
    return int(number[:-1]) << {"k": 10, "m": 20, "g": 30}[number[-1]] if number[-1].isalpha() else int(number)


_STORED: dict[tuple, object] = {}


def stored(spark: SparkSession, name: str, source: str, build):
    """What ``build()`` has written for ``source`` in this session; built again when the source's files changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(source)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration())
    status = folder.getFileStatus(path)
    size = folder.getContentSummary(path).getLength()
    key = (spark.sparkContext.applicationId, name, source)
    version = (status.getModificationTime(), size)
    known = _STORED.get(key)
    if known is None or known[0] != version:
        known = _STORED[key] = (version, build())
    return known[1]
