"""Metric stores: partitioned Parquet of rolled-up cells, written as deltas and added up when read.

A store is a folder:

    params.json                             its parameters
    cells/epoch=<ns>/batch=<name>/*.parquet  cells (depth, f0, fields, bucket, total, count) of one write
    compactions/<name>.pending, .done        which batches of which epochs don't count: before a compaction is done its own
                                             new batch, from then on those that the new one has taken in
    compactions/<name>.absorbed              the last batch of each stream that was taken in, by epoch

A write only ever adds a batch, and a repeated write of a batch replaces it, so retries don't count twice; where a
compaction has taken the batch in, its rows are left out. Readers leave out what a compaction lists. The files it lists
stay until the next compaction or vacuum(), so readers that began before it end well.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.errors import InvalidParams, ReadOnly
from tidegrid.functions.paths import checked_pattern
from tidegrid.functions.timeaxis import Range, ns_range
from tidegrid.operators import fetch, rollup
from tidegrid.params import Params
from tidegrid.sources.files import Files

CELLS = T.StructType(
    [
        T.StructField("depth", T.IntegerType()),
        T.StructField("f0", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
        T.StructField("bucket", T.LongType()),
        T.StructField("total", T.DoubleType()),
        T.StructField("count", T.DoubleType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("batch", T.StringType()),
    ]
)


#: Names of a stream's batches: the stream, if it has a name, and the batch's number. They must be written in order.
STREAMED = re.compile(r"s-(?:(.*)-)?(\d+)")
#: Cells of a file, at most.
FILE_CELLS = 8_000_000


class MetricStore:
    """Tracks measurements into a folder and fetches series from it; read_only: only fetches."""

    def __init__(self, spark: SparkSession, path: str, params: Params, read_only: bool = False):
        self.spark, self.path, self.params, self.files, self.read_only = spark, path.rstrip("/"), params, Files(spark), read_only
        self.streams: list = []

    @classmethod
    def open(cls, spark: SparkSession, path: str, params: Params | None) -> MetricStore:
        """A store at a path, made if it isn't there; the parameters must be those it was made with."""
        if params is None:
            raise InvalidParams("no parameters")
        out = cls(spark, path, params)
        there = out.files.read(f"{out.path}/params.json")
        if there is None:
            out.files.write(f"{out.path}/params.json", params.to_json())
        elif (kept := Params.from_json(there)) != params:
            raise InvalidParams(f"{path} was made with {kept}")
        return out

    def _writes(self) -> None:
        if self.read_only:
            raise ReadOnly(f"{self.path} is open for reading only")

    # writing

    def track(self, events: DataFrame, drop_invalid: bool = False) -> str:
        """Adds measurements (ts_ns, fields, total, count) to every prefix of their fields; returns the batch's name."""
        return self.write_batch(rollup.measurements(events, drop_invalid), f"b-{uuid.uuid4().hex}")

    def write_batch(self, rows: DataFrame, batch: str) -> str:
        """Adds measurements under a batch's name; what compactions have taken in of a batch of that name stays out."""
        self._writes()
        cells = rollup.rollup(rows, self.params)
        taken = [e for e, names in self._absorbed().items() if self._is_absorbed(batch, names)]
        if taken:
            cells = cells.where(~F.col("epoch").isin(taken))
        self._put(cells, batch)
        return batch

    def _absorbed(self) -> dict[int, dict[str, int]]:
        """For each epoch the highest number, taken in by a compaction, of each stream."""
        out: dict[int, dict[str, int]] = {}
        for name, read in self._compactions().items():
            if name.endswith(".absorbed"):
                for epoch, streams in read.items():
                    for stream, n in streams.items():
                        own = out.setdefault(int(epoch), {})
                        own[stream] = max(own.get(stream, -1), n)
            elif name.endswith(".done"):
                for epoch, batches in read.items():
                    for m in filter(None, map(STREAMED.fullmatch, batches)):
                        own = out.setdefault(int(epoch), {})
                        own[m[1] or ""] = max(own.get(m[1] or "", -1), int(m[2]))
        return out

    @staticmethod
    def _is_absorbed(batch: str, streams: dict[str, int]) -> bool:
        m = STREAMED.fullmatch(batch)
        return bool(m) and streams.get(m[1] or "", -1) >= int(m[2])

    def _compactions(self) -> dict[str, dict]:
        """What the files about compactions hold; read again if one goes while they are read."""
        while True:
            names = self.files.files(f"{self.path}/compactions")
            read = {n: self.files.read(f"{self.path}/compactions/{n}") for n in names if n.endswith((".pending", ".done", ".absorbed"))}
            if None not in read.values():
                return {n: json.loads(x) for n, x in read.items()}

    def _put(self, cells: DataFrame, batch: str) -> None:
        """Writes cells as a batch. Partitions are rebalanced by epoch: a large epoch is split, small ones share a task."""
        rows = cells.hint("rebalance", "epoch").sortWithinPartitions("epoch", "depth", "f0", "fields", "bucket").withColumn("batch", F.lit(batch))
        rows.select(*CELLS.names).write.mode("overwrite").option("maxRecordsPerFile", FILE_CELLS).option("partitionOverwriteMode", "dynamic").partitionBy("epoch", "batch").parquet(f"{self.path}/cells")

    # reading

    def cells(self) -> DataFrame:
        """The cells of all live batches; the same cell may stand in several."""
        try:
            rows = self.spark.read.schema(CELLS).parquet(f"{self.path}/cells")
        except AnalysisException:  # nothing has been written yet
            return self.spark.createDataFrame([], CELLS)
        for batch, epochs in self._gone().items():
            rows = rows.where(~((F.col("batch") == batch) & F.col("epoch").isin(sorted(epochs))))
        return rows

    def _gone(self) -> dict[str, set[int]]:
        """The epochs in which a batch doesn't count."""
        gone: dict[str, set[int]] = {}
        read = self._compactions()
        for name, listed in read.items():
            if name.endswith(".done") or name.endswith(".pending") and name.replace(".pending", ".done") not in read and name.replace(".pending", ".absorbed") not in read:
                for epoch, batches in listed.items():
                    for batch in batches:
                        gone.setdefault(batch, set()).add(int(epoch))
        return gone

    def range(self, start: int, end: int) -> Range:
        return ns_range(start, end, self.params)

    def _at(self, start: int, end: int, pattern: Sequence[str], now: int | None) -> tuple[DataFrame, Range]:
        cells = rollup.cells_at(self.cells(), checked_pattern(pattern))
        return (cells if now is None else self.retained(cells, now)), self.range(start, end)

    def fetch(self, start: int, end: int, pattern: Sequence[str], now: int | None = None) -> DataFrame:
        """(epoch, fields, bucket, pos, total, count): the dense points of the matching series in [start, end)."""
        return fetch.points(*self._at(start, end, pattern, now), self.params)

    def fetch_chunks(self, start: int, end: int, pattern: Sequence[str], now: int | None = None) -> DataFrame:
        """(from, to, series): the same, one row an epoch."""
        return fetch.chunks(*self._at(start, end, pattern, now), self.params)

    def fetch_sparse(self, start: int, end: int, pattern: Sequence[str], now: int | None = None) -> DataFrame:
        """Only the points that were tracked."""
        return fetch.sparse(*self._at(start, end, pattern, now))

    def deliver(self, start: int, end: int, pattern: Sequence[str], handler: Callable[[int, int, Iterator[tuple[list[str], list]]], None], now: int | None = None) -> None:
        """Calls handler(from, to, series) for each epoch of a range in order of time; series: (fields, points) one by one.

        An epoch is read when its turn comes, and the driver holds one partition of it at a time, so a result may be larger
        than its memory.
        """
        cells, span = self._at(start, end, pattern, now)
        for epoch in range(span.first_epoch, span.last_epoch + 1, self.params.duration) if not span.empty else ():
            lo, hi = max(epoch, span.lo), min(epoch + self.params.duration, span.hi)
            rows = fetch.dense(cells, ns_range(lo, hi, self.params), self.params)
            handler(lo, hi, ((list(r.fields), r.points) for r in rows.select("fields", "points").toLocalIterator()))

    def series(self, start: int, end: int, pattern: Sequence[str]) -> DataFrame:
        """(epoch, fields) of the matching series."""
        return fetch.series(*self._at(start, end, pattern, None))

    # life cycle

    def epochs(self) -> list[int]:
        return sorted(int(x.removeprefix("epoch=")) for x in self.files.folders(f"{self.path}/cells") or [] if x.startswith("epoch="))

    def expire(self, before: int) -> list[int]:
        """Deletes every epoch that starts before a time, also one that reaches over it; returns those."""
        self._writes()
        out = [e for e in self.epochs() if e < before]
        for e in out:
            self.files.delete(f"{self.path}/cells/epoch={e}")
        return out

    def retained(self, cells: DataFrame, now: int) -> DataFrame:
        """The cells of epochs that start within the retention before a time."""
        return cells.where(F.col("epoch") >= max(0, now - self.params.retention))

    def expire_retention(self, now: int) -> list[int]:
        return self.expire(max(0, now - self.params.retention))

    def compact(self, epochs: Sequence[int] | None = None) -> str | None:
        """Adds up the batches of epochs into one; returns its name, None if there is nothing to do.

        The new batch is first marked as pending and written; one renaming of a file then makes the old batches stop and the
        new one begin to count. A compaction that breaks off leaves a batch that never counts.
        """
        self.vacuum()
        chosen = set(self.epochs() if epochs is None else epochs)
        gone = self._gone()
        old = {e: [b for x in self.files.folders(f"{self.path}/cells/epoch={e}") or [] if e not in gone.get(b := x.removeprefix("batch="), ())] for e in self.epochs() if e in chosen}
        old = {e: b for e, b in old.items() if len(b) > 1}
        if not old:
            return None
        batch = f"c-{uuid.uuid4().hex}"
        listed = f"{self.path}/compactions/{batch}"
        self.files.write(f"{listed}.pending", json.dumps({e: [batch] for e in old}))
        read = F.lit(False)
        for e, batches in old.items():
            read |= (F.col("epoch") == e) & F.col("batch").isin(batches)
        self._put(rollup.with_keys(rollup.summed(self.cells().where(read))), batch)
        self.files.write(f"{listed}.done", json.dumps(old))
        return batch

    def vacuum(self) -> None:
        """Deletes what earlier compactions have taken in; readers that began before them must have ended.

        The last batch of each stream stays known, so a micro-batch that is repeated later doesn't count twice.
        """
        self._writes()
        read = self._compactions()
        done = {n: x for n, x in read.items() if n.endswith(".done")}
        if not done:
            return
        live = set(self.epochs())
        self.files.write(f"{self.path}/compactions/{sorted(done)[-1].removesuffix('.done')}.absorbed", json.dumps({e: x for e, x in self._absorbed().items() if e in live}))
        for n, listed in done.items():
            for e, batches in listed.items():
                for b in batches:
                    self.files.delete(f"{self.path}/cells/epoch={e}/batch={b}")
            self.files.delete(f"{self.path}/compactions/{n.removesuffix('.done')}.pending")
            self.files.delete(f"{self.path}/compactions/{n}")
        for n in read:
            if n.endswith(".absorbed") and n.removesuffix(".absorbed") != sorted(done)[-1].removesuffix(".done"):
                self.files.delete(f"{self.path}/compactions/{n}")

    def sync(self) -> None:
        """Waits until the store's streams have written all that has come in; batch writes are done when they return."""
        for q in self.streams:
            q.processAllAvailable()

    def close(self) -> None:
        for q in self.streams:
            q.stop()
        self.streams.clear()


def load_all(spark: SparkSession, root: str, read_only: bool = False) -> dict[str, MetricStore] | None:
    """The stores in a folder by name, on demand for reading only; folders without valid parameters are left out, with a word where they have any.

    None if the folder can't be read.
    """
    files = Files(spark)
    names = files.folders(root)
    if names is None:
        return None
    out = {}
    for name in names:
        path = f"{root.rstrip('/')}/{name}"
        text = files.read(f"{path}/params.json")
        if text is None:
            continue
        try:
            out[name] = MetricStore(spark, path, Params.from_json(text), read_only)
        except InvalidParams as e:
            print(f"{name} is left out: {e}")
    return out
