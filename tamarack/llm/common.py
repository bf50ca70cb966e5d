"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that part words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"
MAX_LONG = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs in one JVM (as in tests) a
    temporary folder of this machine is set instead; on a cluster that is an
    error, as executors would not see each other's files.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="tamarack-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Folders that ``materialise`` wrote and nothing has deleted yet.
_written: dict[str, SparkSession] = {}


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    It cuts lineage: what is read later survives the loss of any executor and
    is never computed twice.  ``drop`` removes the files, ``scratch`` those of
    a whole stretch of work.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamarack/{name}-{uuid.uuid4().hex}"
    _written[path] = spark
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tamarack_path = path
    return out


def _delete(path: str) -> None:
    context = _written.pop(path).sparkContext
    p = context._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the files behind a result of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_tamarack_path", None)
    if path in _written:
        _delete(path)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """On leaving, deletes what ``materialise`` wrote inside, but for the tables that were put into the list."""
    before, kept = set(_written), []
    try:
        yield kept
    finally:
        held = {getattr(df, "_tamarack_path", None) for df in kept}
        for path in set(_written) - before - held:
            _delete(path)


def utf8_bytes(col) -> "F.Column":
    """Length in UTF-8 bytes; null counts none."""
    return F.coalesce(F.octet_length(col), F.lit(0)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that no column of ``df`` has."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def row_of(df: DataFrame) -> "F.Column":
    """All columns of ``df`` as one struct: what is then added beside it can't clash with a column of the caller."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def word_count(col) -> "F.Column":
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_RE)), F.lit(0)).cast("long")


def row_key() -> "F.Column":
    """A digest of ``doc_id`` and ``text``, nulls told apart: 128 bits, so that no two rows of any corpus share one by chance."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("n")), F.coalesce(F.concat(F.lit(":"), "text"), F.lit("n")))))
