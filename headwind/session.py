"""Session settings, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Naive wall-clock arithmetic needs a zone without shifts; AQE re-plans partition counts and skewed joins.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}

#: Share of its heap's bound that the driver's JVM holds before give_back() collects its garbage.
HELD = 0.5

_own_dir: list[str] = []
_shipped: set[str] = set()
_made: list[str] = []


def build_session(app: str = "headwind", master: str | None = None, **conf: str) -> SparkSession:
    """A session with SETTINGS; conf overrides, with dots written as two underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Add the package's sources to the application once, so that Python workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="headwind-sources-")  # the driver serves it to executors until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, f"headwind_sources_{app.replace('-', '_')}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on one machine (master local), a temporary one.

    On a cluster a temporary folder would be another one on every machine, so RuntimeError is raised instead.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="headwind-"))
        atexit.register(shutil.rmtree, _own_dir[0], ignore_errors=True)
    return f"file://{_own_dir[0]}"


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below shared_dir() that nothing else uses."""
    _made.append(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many paths new_path() has given out that release() has not deleted: a mark for release()."""
    return len(_made)


def release(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Delete what new_path() gave out after the mark `since`, once no DataFrame needs it any more, but for the files that
    keep reads; returns how many paths were deleted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = keep.inputFiles() if keep is not None else []
    stay = [p for p in _made[since:] if any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]
    gone = [p for p in _made[since:] if p not in stay]
    _made[since:] = stay
    for path in map(jvm.org.apache.hadoop.fs.Path, gone):
        path.getFileSystem(conf).delete(path, True)
    return len(gone)


def tasks_for(table: DataFrame, mb: float) -> int:
    """How many tasks a table's rows are to be dealt to, so that a task's share does not grow with the table: one for each
    mb of its files, or for each MB as far as the cores go. Where Spark knows no size, as many as it takes by default.

    Spark coalesces its own exchanges to 64 MB as packed for sending, which sorts unpack to a multiple in memory; a number
    of tasks that is given stays.
    """
    spark = table.sparkSession
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / (1 << 20)
    if size > 1 << 30:  # MB; rows that come from no file count as all that a number can hold
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(size / mb), min(spark.sparkContext.defaultParallelism, math.ceil(size)))


def give_back(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM holds and does not use to the system; whether its JVM can trim what is no heap.

    Plans and events of many small steps leave garbage, for which the heap grows up to its bound, and freed native memory,
    which malloc keeps for each thread. Garbage is collected once the heap holds HELD of its bound. JVMs before
    17.0.9, or elsewhere than on Linux, don't trim.
    """
    sc = spark.sparkContext
    jvm = sc._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() >= HELD * heap.maxMemory():
        jvm.java.lang.System.gc()
    # The server's own class is not open to reflection, its interface is.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    args = sc._gateway.new_array(jvm.java.lang.Object, 4)
    try:
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        return False
    return True


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet below shared_dir() and read it back.

    This cuts the lineage: a lost executor costs the tasks at hand, not the whole history. The files stay
    until release(). What planning and running df took of the driver's memory is given back.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)
