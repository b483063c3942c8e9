"""Shared plumbing: where intermediate tables go, and Arrow helpers for map-style operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace, the separators of words in every operator here (space, tab, LF, VT, FF, CR).
WHITESPACE = "\x20\x09-\x0d"
WORD_PATTERN = f"[^{WHITESPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local master may go without it; then a temporary folder of this process is set and
    removed at exit. A cluster without the setting is an error, as a machine-local folder would
    lose data there.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or (sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if configured:
        return configured.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="ledgerloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def _hadoop(spark: SparkSession, path: str):
    """The Hadoop path of ``path`` and its file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


_SWEPT: set[str] = set()


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path, as a full URI, in this application's part of the shared folder, which goes when the driver ends."""
    p, store = _hadoop(spark, f"{shared_dir(spark)}/ledgerloom/{spark.sparkContext.applicationId}")
    top = store.makeQualified(p).toString()
    if top.startswith("file:/") and not top.startswith("file://"):  # Hadoop's way to write it; others want three slashes
        top = "file://" + top[5:]
    if top not in _SWEPT:
        _SWEPT.add(top)

        def sweep() -> None:
            with contextlib.suppress(Exception):  # the JVM may have gone first
                store.delete(p, True)

        atexit.register(sweep)
    return f"{top}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: the lineage ends there, and a lost executor costs nothing.

    As both sides of a join of two such tables are shuffled for it, a hot key on either can be split at run time.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``saved`` wrote, once nothing reads it any more."""
    for df in tables:
        if path := getattr(df, "_ledgerloom_path", None):
            p, store = _hadoop(df.sparkSession, path)
            store.delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from clashing with a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def row_hash(df: DataFrame) -> F.Column:
    """A 64-bit hash of all columns: rows that agree in it are taken to be copies of one row."""
    return F.xxhash64(*[F.col(f"`{f.name}`").cast("string") if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields])


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the Python worker, which later tasks use again, gives free memory back."""

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(it)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only the GNU C library has it
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def held_out(doc_id) -> F.Column:
    """Rows that no classifier may learn from: crc32 of the id as text, modulo 5, is 0 (a null id counts as held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
