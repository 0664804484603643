"""Helpers about the running session: checkpoints, table access and size-checked broadcasts."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its counted rows stay under this bound (about 64 MB of narrow rows).
BROADCAST_ROWS = 2_000_000


def is_local(sc) -> bool:
    """Whether driver and executors are one machine's processes, so that a folder of this machine is shared by all."""
    return sc.master == "local" or sc.master.startswith("local[")


def shared_folder(sc) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only in local mode one of our own is made where
    that setting is absent; a cluster without it is an error, as its executors share no folder of this machine."""
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not is_local(sc):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="larkspan-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def archive() -> bytes:
    """The package's sources as a zip, built in memory: nothing is compiled into the installed tree."""
    package, out = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Makes this package known to the Python workers, once for a session: in local mode where they wouldn't find it by
    themselves, on a cluster always. Spark hands the archive to every executor, also to one that comes later; there it
    lies in the shared folder."""
    sc = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    if getattr(sc, "_larkspan_shipped", False):
        return
    found = root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == root
    if not (found and is_local(sc)):
        raw = archive()
        name = f"larkspan-{hashlib.sha256(raw).hexdigest()[:12]}.zip"
        if is_local(sc):
            at = str(Path(tempfile.mkdtemp(prefix="larkspan-")) / name)
            Path(at).write_bytes(raw)
        else:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(sc)}/{name}")
            stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
            stream.write(bytearray(raw))
            stream.close()
            at = str(path.toString())
        sc.addPyFile(at)
    sc._larkspan_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and returns a frame that reads it back."""
    shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint when it has at most ``limit`` rows, else unchanged (a shuffled join then).

    ``df`` should be a checkpoint or a scan: its rows are counted unless the caller knows ``rows``.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


#: Session setting: into how many partitions costly maps spread what they scan. Unset, a scan stays as it is.
SPREAD = "spark.larkspan.spread"


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many partitions as the caller's setting ``SPREAD`` names, for a session whose few files are only a
    split or two while the work costs far more than moving their rows. Without the setting nothing is moved, whatever
    the input's size."""
    n = df.sparkSession.conf.get(SPREAD, "")
    return df.repartition(int(n), key) if n else df


def default_parallelism(df: DataFrame) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, os.cpu_count() or 1)
