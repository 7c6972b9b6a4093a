"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from spark.checkpoint.dir.

    Only a local session, which has no cluster to name one, gets a temporary folder instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidegrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch: what a task holds of its rows beside Spark's own copy, on either side of the worker.
BATCH = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> SparkSession:
    """The session, with this package on the path of its Python workers wherever the driver was started.

    Where it doesn't say how large Arrow batches may be, they get BATCH bytes (a longer text is a batch of its own).
    """
    import tidegrid

    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH))
    context = spark.sparkContext
    if not getattr(context, "_tidegrid_shipped", False):
        top = os.path.dirname(os.path.abspath(tidegrid.__file__))
        at = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidegrid-")), "tidegrid.zip")
        with zipfile.ZipFile(at, "w") as out:
            for folder, _, names in os.walk(top):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(top)))
        context.addPyFile(at)
        context._tidegrid_shipped = True
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidegrid/{name}-{uuid.uuid4().hex}"


#: Paths of the tables that written() has made and dropped() has not deleted.
_made: list[str] = []


#: Rows of a file of narrow rows, at least, where there are as many.
FILE_ROWS = 50_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that written_alone() deletes like tables of written()."""
    path = new_path(spark, name)
    _made.append(path)
    return path


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors.

    rows: about how many narrow rows it has at most. Few of them are written by few tasks, so that loops over small tables
    don't make hundreds of files in every round.
    """
    path = new_path(df.sparkSession, name)
    tasks = parallelism(df.sparkSession)
    if rows is not None and (files := rows // FILE_ROWS + 1) < tasks:
        df = df.coalesce(files)
    df.write.parquet(path)
    _made.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidegrid_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that no later result reads."""
    for df in tables:
        deleted(df.sparkSession, df._tidegrid_path)


def deleted(spark: SparkSession, path: str) -> None:
    """Deletes what written() or scratch() named so."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in _made:
        _made.remove(path)


def written_alone(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives as a table; the tables that were written on the way to it are deleted."""
    before = set(_made)
    out = written(make(), name)
    for path in [p for p in _made if p not in before and p != out._tidegrid_path]:
        deleted(out.sparkSession, path)
    return out


def store(uri: str):
    """(file system, path) for reads and writes of plain files by executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def put(uri: str, data: bytes) -> None:
    """Writes a whole file under a name of this attempt, then renames it: a repeated task replaces, never mixes."""
    system, path = store(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own, compression=None) as out:
        out.write(data)
    system.move(own, path)


def got(uri: str) -> bytes:
    system, path = store(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read()


def there(uri: str) -> bool:
    from pyarrow import fs

    system, path = store(uri)
    return system.get_file_info(path).type == fs.FileType.File


def over_batches(f: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: f on every batch that has rows."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield f(batch)

    return run


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, ...]:
    """docs with columns called by their number, and what the named ones are called now: own columns can't clash with them."""
    return docs.toDF(*(f"given_{i}" for i in range(len(docs.columns)))), *(f"given_{docs.columns.index(c)}" for c in columns)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
