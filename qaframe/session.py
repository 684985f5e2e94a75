"""Session construction and shared-folder helpers.

On a cluster the session comes from the launcher; these helpers only fill
in settings that are absent, so cluster configuration always wins.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we rely on; applied only when the caller builds the session here.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Broadcast joins only below 32 MB; bigger sides shuffle.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


# number of partitions for text tables; unset: the input's own splits
TEXT_PARTITIONS = "spark.qaframe.textPartitions"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "qaframe", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if master.startswith("local["):
        # the test tables are single row groups, that is one task each
        cores = master[6:-1].split(",")[0]
        conf[TEXT_PARTITIONS] = str(4 * (os.cpu_count() or 1 if cores == "*" else int(cores)))
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    bound_batches(spark)
    ship_package(spark)
    return spark


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch where the session has not: 10,000 rows of long texts
    are many times the memory of 10,000 short ones."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(16 * 1024 * 1024))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets this to a shared file system.  Only when it is unset on a
    local master (tests) do we create a private scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf_dir = tempfile.mkdtemp(prefix="qaframe-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_SHIPPED: set[str] = set()
_ZIP: list[str] = []


def ship_package(spark: SparkSession) -> None:
    """Make `qaframe` importable in the Python workers (Arrow UDFs,
    mapInPandas, state functions) of a session this process did not start
    with the package on its path: the package is zipped once per process and
    added with addPyFile, which Spark distributes to every executor."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    if not _ZIP:
        import zipfile
        pkg = os.path.dirname(os.path.abspath(__file__))
        out = os.path.join(tempfile.mkdtemp(prefix="qaframe-py-"), "qaframe.zip")
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for root, _dirs, files in os.walk(pkg):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(root, f)
                        z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
        _ZIP.append(out)
    sc.addPyFile(_ZIP[0])
    _SHIPPED.add(app)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    # checkpoint dirs are returned as URIs (file:/..., hdfs://...); keep them as is
    suffix = f"{name}-{os.getpid()}-{next(_counter)}"
    return base.rstrip("/") + "/" + suffix


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()
