"""Token ids in flat binary shards, with a minimal perfect hash index from document keys to places.

A store is a folder of plain files, written by the executors into the shared folder:

    payload-<shard>.bin   the ids of a range of documents in ascending doc_id order, end ids included, nothing else:
                          little-endian unsigned integers of 2 bytes (4, if the vocabulary has more than 65,536 ids)
    index-<part>.tgx      for the keys of one hash part: b"TGIX", entries and width (<u4 each), the perfect hash, then entries
                          in slot order: fingerprint <u4, shard <u4, ids before it in its shard <u8, ids <u8, ids of all
                          documents before it <u8

A lookup hashes the key to a part, the part's perfect hash to a slot, compares the stored fingerprint, and reads one
range of one payload file: constant time, whatever the number of documents.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm.common import dropped, got, new_path, put, store, written
from tidegrid.llm.mph import PerfectHash, mixed
from tidegrid.llm.words import END_ID, encoder, texts, vocabulary

#: Documents a shard and keys an index part, about. Beyond so many shards they hold more.
SHARD_ROWS = 10_000
PART_KEYS = 50_000
MOST_SHARDS = 65_536
#: Ids sampled for each shard, to find where shards end.
SAMPLED = 64
#: Bytes that a reader or writer holds at once, about.
HELD = 8 << 20
ENTRY = np.dtype([("mark", "<u4"), ("shard", "<u4"), ("at", "<u8"), ("n", "<u8"), ("start", "<u8")])
HEAD = "<4sII"
PART_SEED, MARK_SEED = 101, 102


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(keys.view(np.uint64), PART_SEED) % np.uint64(parts)).astype(np.int32)


def mark_of(keys: np.ndarray) -> np.ndarray:
    return (mixed(keys.view(np.uint64), MARK_SEED) >> np.uint64(32)).astype(np.uint32)


class TokenStore:
    """Keyed access to a store's payload."""

    def __init__(self, path: str, parts: int, width: int):
        self.path, self.parts, self.width = path, parts, width
        self._open: dict[int, tuple[PerfectHash, np.ndarray]] = {}

    def _part(self, part: int) -> tuple[PerfectHash, np.ndarray]:
        if part not in self._open:
            if len(self._open) >= 8:
                self._open.clear()
            data = got(f"{self.path}/index-{part:06d}.tgx")
            kind, n, _ = struct.unpack_from(HEAD, data)
            if kind != b"TGIX":
                raise ValueError("not an index part")
            index, at = PerfectHash.loaded(data, struct.calcsize(HEAD))
            self._open[part] = index, np.frombuffer(data, ENTRY, n, at)
        return self._open[part]

    def places(self, keys: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
        """The entries of keys that belong to a part, and which of them were found."""
        index, entries = self._part(part)
        slots = index.slots(keys)
        if not len(entries):
            return np.zeros(len(keys), ENTRY), np.zeros(len(keys), bool)
        out = entries[np.maximum(slots, 0)]
        return out, (slots >= 0) & (out["mark"] == mark_of(keys))

    def get(self, key: int) -> np.ndarray | None:
        """The ids of one document, its end id included; None for a key that is not stored."""
        keys = np.array([key], np.int64)
        entry, found = self.places(keys, int(part_of(keys, self.parts)[0]))
        return self.read(*(int(entry[0][k]) for k in ("shard", "at", "n"))) if found[0] else None

    def read(self, shard: int, at: int, n: int) -> np.ndarray:
        system, path = store(f"{self.path}/payload-{shard:06d}.bin")
        with system.open_input_file(path) as f:
            return np.frombuffer(f.read_at(n * self.width, at * self.width), f"<u{self.width}")


def ends(ids: DataFrame, rows: int, shards: int) -> tuple[int, np.ndarray]:
    """Where shards end: how many of them end among the null ids, which stand first, and the other ends, ascending ids.

    They are quantiles of a sample of at most about SAMPLED * MOST_SHARDS ids, exact integers; an id that many rows share
    is the end of several shards.
    """
    if shards < 2:
        return 0, np.zeros(0, np.int64)
    sample = ids.select("doc_id").sample(min(1.0, SAMPLED * shards / rows), seed=7).toArrow()["doc_id"].combine_chunks()
    known, nulls = np.sort(sample.drop_null().to_numpy()), sample.null_count
    at = np.unique(np.arange(1, shards) * len(sample) // shards) if len(sample) else np.zeros(0, np.int64)
    return int((at < nulls).sum()), known[at[at >= nulls] - nulls]


def write(docs: DataFrame, path: str | None = None, vocab: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> tuple[TokenStore, DataFrame]:
    """Encodes every text and writes a store; returns it with the table of its keys (doc_id, copy).

    A null text is an empty one: its ids are the end id alone. special: as for WordEncoder. Rows that repeat a doc_id are
    all stored, one after the other, as copies 0, 1, ... of the key, within a shard in order of their ids' bytes; copy 0
    has the key doc_id itself, later ones a mix of both. Rows with a null doc_id stand before all others, with keys of the
    same kind. An id (or null) that more rows have than a shard holds is spread over several shards. An empty table makes
    a store without shards. Texts of any length are encoded whole; other columns are not looked at.
    """
    spark = docs.sparkSession
    path, vocab = path or new_path(spark, "tokens"), vocab or vocabulary()
    width = encoder(vocab, special).dtype.itemsize
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = ids.select(F.count(F.lit(1))).first()[0]
    nameless, edges = ends(ids, rows, min(MOST_SHARDS, -(-rows // SHARD_ROWS)))
    shards = nameless + len(edges) + 1
    parts = max(1, -(-rows // PART_KEYS))

    def encoded(batches: Iterable[pa.RecordBatch]):
        of, times = encoder(vocab, special), Counter()
        end = np.array([end_id], of.dtype).tobytes()
        for batch in batches:
            column = batch.column(0)
            null = column.is_null().to_numpy(zero_copy_only=False)
            keys = column.fill_null(0).to_numpy()
            low, high = (np.where(null, x, nameless + np.searchsorted(edges, keys, side=side)).tolist() for x, side in ((0, "left"), (nameless, "right")))
            raw, shard, begin, size = [], [], 0, 0
            for k, (i, text) in enumerate(zip(column.to_pylist(), texts(batch.column(1)), strict=True)):
                raw.append(of.raw(text) + end)
                size += len(raw[-1])
                a, b = low[k], high[k]
                if b > a + (i is not None):  # spread evenly, rows alike as well; where one goes doesn't hang on the order of a task's rows
                    mark = zlib.crc32(raw[-1])
                    shard.append(a + (mark + times[i, mark]) % (b - a + 1))
                    times[i, mark] += 1
                else:
                    shard.append(b)
                if size >= HELD or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([column[begin : k + 1], pa.array(shard, pa.int32()), pa.array(raw, pa.binary())], names=["doc_id", "shard", "raw"])
                    raw, shard, begin, size = [], [], k + 1, 0

    dealt = ids.mapInArrow(encoded, "doc_id long, shard int, raw binary").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "raw")

    def stored(batches: Iterable[pa.RecordBatch]):
        """Writes each shard as its rows come, sorted, and yields where each document went."""
        out = None
        shard, at, last, copy, rows = -1, 0, "", 0, []

        def closed():
            if out is not None:
                out[1].close()
                out[0].move(out[2], out[3])

        for batch in batches:
            for key, to, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                if to != shard:
                    closed()
                    system, name = store(f"{path}/payload-{to:06d}.bin")
                    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                    own = f"{name}.{np.random.default_rng().integers(1 << 62):x}"
                    out = system, system.open_output_stream(own, compression=None), own, name
                    shard, at, last = to, 0, ""
                out[1].write(raw)
                copy = copy + 1 if key == last else 0
                last = key
                rows.append((key, copy, to, at, len(raw) // width))
                at += len(raw) // width
            yield table(rows)
            rows = []
        closed()

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "copy", "shard", "at", "n"])

    places = written(dealt.mapInArrow(stored, "doc_id long, copy int, shard int, at long, n long"), "places")
    shared = pa.table({"id": pa.array([*([None] * (nameless > 0)), *(x for x, n in Counter(edges.tolist()).items() if n > 1)], pa.int64())})
    if len(shared):  # copies are counted on from shard to shard; one row an id and shard, no more than two a shard
        held = places.join(F.broadcast(spark.createDataFrame(shared)), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").groupBy("doc_id", "shard").agg(F.count(F.lit(1)).alias("held"))
        before = held.selectExpr("doc_id as id", "shard as of", "sum(held) over (partition by doc_id order by shard) - held as before")
        numbered = places.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("shard") == F.col("of")), "left")
        places = written(numbered.select("doc_id", (F.col("copy") + F.coalesce("before", F.lit(0))).cast("int").alias("copy"), "shard", "at", "n"), "places")
    sums = places.groupBy("shard").agg(F.sum("n").alias("own"))  # one row a shard, MOST_SHARDS at most
    bases = sums.selectExpr("shard", "coalesce(sum(own) over (order by shard rows between unbounded preceding and 1 preceding), 0) as base")
    keyed = places.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("at")).withColumn("key", key_of())

    def parted(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part_of(batch.column(0).to_numpy(), parts))], names=[*batch.schema.names, "part"])

    def indexed(batches: Iterable[pa.RecordBatch]):
        """Builds each part's index from its rows, sorted by part: about PART_KEYS rows are held."""
        held: list[pa.RecordBatch] = []

        def flushed():
            part = pa.Table.from_batches(held)
            keys = part["key"].to_numpy()
            index = PerfectHash.build(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two rows have the same key")
            entries = np.zeros(len(keys), ENTRY)
            slots = index.slots(keys)
            entries["mark"][slots] = mark_of(keys)
            for name in ("shard", "at", "n", "start"):
                entries[name][slots] = part[name].to_numpy()
            put(f"{path}/index-{part['part'][0].as_py():06d}.tgx", struct.pack(HEAD, b"TGIX", len(entries), width) + index.dumped() + entries.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([len(entries)], pa.int64())], names=["keys"])

        for batch in batches:
            of = batch.column(batch.schema.get_field_index("part")).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and held[-1].column("part")[0].as_py() != of[a]:
                        yield flushed()
                        held.clear()
                    held.append(batch.slice(a, b - a))
        if held:
            yield flushed()

    rows = keyed.select("key", "shard", "at", "n", "start").mapInArrow(parted, "key long, shard int, at long, n long, start long, part int")
    dropped(written(rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(indexed, "keys long"), "keys"))
    return TokenStore(path, parts, width), places.select("doc_id", "copy")


def key_of():
    """The key of a row: its doc_id, or a mix of it with its copy number where that is not the first or the id is null."""
    return F.when(F.col("doc_id").isNotNull() & (F.col("copy") == 0), F.col("doc_id")).otherwise(F.xxhash64("doc_id", "copy"))


def read_back(spark: SparkSession, kept: TokenStore, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for every row of keys (doc_id, copy), from the store's files alone.

    Keys go to their index part, which gives their places; those go to their shard, whose payload is read range by range
    in order. A key that is not stored stops the job.
    """
    path, parts, width = kept.path, kept.parts, kept.width

    def parted(batches):
        for batch in batches:
            key = batch.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part_of(key, parts))], names=["doc_id", "key", "part"])

    def looked_up(batches):
        own = TokenStore(path, parts, width)
        for batch in batches:
            key, of = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    entries, found = own.places(key[a:b], int(of[a]))
                    if not found.all():
                        raise KeyError(f"{int((~found).sum())} keys are not stored, {key[a:b][~found][0]} among them")
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(entries[k].astype(np.int64)) for k in ("shard", "at", "n", "start"))], names=["doc_id", "shard", "at", "n", "start"])

    def summed(batches):
        own = TokenStore(path, parts, width)
        for batch in batches:
            shard, at, n = (batch.column(i).to_numpy() for i in (1, 2, 3))
            crc = np.zeros(len(at), np.int64)
            i = 0
            while i < len(at):  # neighbours in one shard are read at once, up to HELD bytes
                j = i + 1
                while j < len(at) and shard[j] == shard[i] and at[j] == at[j - 1] + n[j - 1] and (at[j] + n[j] - at[i]) * width <= HELD:
                    j += 1
                ids = own.read(int(shard[i]), int(at[i]), int(at[j - 1] + n[j - 1] - at[i]))
                for k in range(i, j):
                    crc[k] = zlib.crc32(ids[at[k] - at[i] : at[k] - at[i] + n[k]].astype("<u4"))
                i = j
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(3), pa.array(crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    asked = keys.withColumn("key", key_of()).select(F.col(id_col).alias("doc_id"), "key").mapInArrow(parted, "doc_id long, key long, part int")
    found = asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part").mapInArrow(looked_up, "doc_id long, shard long, at long, n long, start long")
    dealt = found.withColumn("stretch", F.floor(F.col("at") * width / (4 * HELD)))
    dealt = dealt.repartition(F.col("shard"), F.col("stretch")).sortWithinPartitions("shard", "at").select("doc_id", "shard", "at", "n", "start")
    return dealt.mapInArrow(summed, "doc_id long, start long, n_tokens long, ids_crc32 long")
