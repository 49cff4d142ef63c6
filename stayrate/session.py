"""Session settings and staging of intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stayrate.errors import StorageError

_local_folders: dict[str, str] = {}
_kept: dict[tuple, DataFrame] = {}


# Java compiles no method above 8,000 bytes of code. Below this limit Spark splits a wide projection
# into small methods instead of running one large one uncompiled, which is several times slower.
_METHOD_LIMIT, _METHOD_LIMIT_DEFAULT = "8000", "65535"


def tuned(spark: SparkSession) -> SparkSession:
    """Set what the wide projections here need, unless the session has its own value."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == _METHOD_LIMIT_DEFAULT:
        spark.conf.set(key, _METHOD_LIMIT)
    return spark


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session for one machine: tests and the benchmark. A cluster brings its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.bindAddress": "127.0.0.1",
        "spark.driver.host": "127.0.0.1",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName("stayrate")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tuned(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can reach, as named by the cluster.

    A temporary folder of this machine is used only when the master itself is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise StorageError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        folder = tempfile.mkdtemp(prefix="stayrate-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        _local_folders[app] = folder
    return _local_folders[app]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later passes then scan only the columns they need instead of repeating the joins and shuffles
    before them, and a lost executor costs one re-read of its files.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """Stage ``build()`` the first time a session asks for ``key``; input tables are immutable."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _kept:
        _kept[full] = stage(build(), str(key[0]))
    return _kept[full]


def drop_staged(spark: SparkSession) -> None:
    """Delete the tables this session staged; frames that read them cannot be used afterwards."""
    app = spark.sparkContext.applicationId
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/staged/{app}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    for key in [k for k in _kept if k[0] == app]:
        del _kept[key]


def keep(spark: SparkSession, key: tuple, build: Callable[[], object]) -> object:
    """Like :func:`once` for small driver-side objects such as fitted parameters."""
    full = (spark.sparkContext.applicationId, *key)
    if full not in _kept:
        _kept[full] = build()
    return _kept[full]
