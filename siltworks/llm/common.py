"""Shared helpers of the training-data operators.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LETTERS_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS_LOWER = LETTERS_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: documents can hold 100 kB and more, and batches exist in the JVM and in Python at once.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and bound their batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all executors are threads of this process (tests, notebooks), a temporary folder is
    made and put into the session's setting. On a cluster an unset folder is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors of {master} share")
        path = f"file://{tempfile.mkdtemp(prefix='siltworks-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Makes Spark remove a write's shuffle files as soon as it ends; nothing reads them again.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_AREAS: list[dict[str, DataFrame]] = []


@contextmanager
def scratch_area() -> Iterator[dict[str, DataFrame]]:
    """Within it, the tables that ``materialise`` writes are counted; those left at its end are deleted.

    What operators return may read such tables, so results must be written before it ends. ``keep`` takes a table out.
    """
    _AREAS.append({})
    try:
        yield _AREAS[-1]
    finally:
        discard(*_AREAS.pop().values())


def keep(df: DataFrame) -> DataFrame:
    """Hand a written table from the innermost area to the one around it, if there is one."""
    if _AREAS:
        _AREAS[-1].pop(df._scratch_path, None)
        if len(_AREAS) > 1:
            _AREAS[-2][df._scratch_path] = df
    return df


def materialise(df: DataFrame, merge: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return a reader of it.

    It cuts the lineage like ``checkpoint()`` does, without computing the plan twice; the files survive
    the loss of any executor. With ``merge`` joins with it always merge, as is right for tables that grow with the
    corpus: the plan is the same at every size, and a hot key of the other side can be split.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/siltworks-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out = out.hint("merge") if merge else out
    out._scratch_path = path
    if _AREAS:
        _AREAS[-1][path] = out
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing will read again."""
    for df in tables:
        if _AREAS:
            _AREAS[-1].pop(df._scratch_path, None)
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def col(name: str) -> Column:
    """The column of exactly this name, dots, back quotes and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def other_columns(df: DataFrame, *outputs: str) -> list[str]:
    """The columns of ``df`` but those that are called like an output, in any case."""
    own = {c.lower() for c in outputs}
    return [c for c in df.columns if c.lower() not in own]


def add_columns(df: DataFrame, source: str, outputs: dict[str, T.DataType], compute: Callable[[Iterator[pa.Array]], Iterator[list[pa.Array]]]) -> DataFrame:
    """Add the ``outputs`` that ``compute`` makes, batch by batch, of the column ``source``, beside the other columns.

    Columns called like an output, in any case, are replaced; names are free.
    """
    ship(df.sparkSession)
    kept = other_columns(df, *outputs)
    at, names = kept.index(source), [f"c{i}" for i in range(len(kept) + len(outputs))]
    plain = df.select(*[col(c).alias(n) for c, n in zip(kept, names)])
    schema = T.StructType([*plain.schema, *[T.StructField(n, kind) for n, kind in zip(names[len(kept) :], outputs.values())]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: list[pa.RecordBatch] = []

        def values() -> Iterator[pa.Array]:
            for batch in batches:
                here.append(batch)
                yield batch.column(at)

        for new in compute(values()):
            yield pa.RecordBatch.from_arrays([*here.pop(0).columns, *new], names=names)

    return plain.mapInArrow(run, schema).toDF(*kept, *outputs)


def word_count(text: Column) -> Column:
    """Number of words as long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)
