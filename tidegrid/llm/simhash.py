"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegrid.llm.common import dropped, numbered, over_batches, parallelism, written
from tidegrid.llm.components import connected_components, first_of_each

BITS = 64
SEED = 42
#: A fingerprint that at least one in so many rows have is joined by broadcast: there are at most as many such.
HEAVY = 512
#: Hashes whose bits are counted at once.
PART = 16_384


def hashes(text: str | None, shingle: int = 3) -> np.ndarray:
    """The unsigned 64-bit hash of every word shingle of a text, repeats included; none for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0d separate
    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), "<u8", n - shingle + 1)


def majority(rows: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without hashes."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(rows), PART):
        ones += np.unpackbits(rows[k : k + PART].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(rows), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included; zero for a text without words."""
    return majority(hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) for every row: the fingerprint's 64 bits as a signed long."""

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(over_batches(hashed), "doc_id long, fp long")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) at 2 or fewer differing bits, enough to join every such pair.

    Every fingerprint emits the 65 values at 0 or 1 bits from it; two within 2 bits share at least one. The members of a
    value lie within 1 bit of it, so it is summed up by a mask of the flipped bits: at most 65 members, in fixed space, with
    no list. All members of a value lie within 2 bits of each other, so each links to the smallest of them; links are
    deduplicated and verified.
    """
    flips = F.array(*[F.lit(0).cast("long")], *[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(BITS)])
    dealt = prints.select("fp").repartition(2 * parallelism(prints.sparkSession), "fp")  # each row makes 65
    spread = dealt.select("fp", F.explode(flips).alias("flip")).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("value"), "flip")
    met = spread.groupBy("value").agg(F.expr("bit_or(flip)").alias("mask"), F.max(F.expr("flip = 0")).alias("itself"))
    met = met.where(F.bit_count("mask") + F.col("itself").cast("int") >= 2)
    members = F.filter(F.transform(flips, lambda x: F.when((x == 0) & F.col("itself") | (F.col("mask").bitwiseAND(x) != 0), F.col("value").bitwiseXOR(x))), lambda x: x.isNotNull())
    near = met.select(members.alias("near")).select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
    return near.where(F.col("a") != F.col("b")).distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id is the smallest id of all rows whose fingerprints are linked, directly or through others, at 2 or fewer
    differing bits. A null text has no words, like an empty one: fingerprint zero, which links as any other. Repeated rows
    are all returned. Rows with a null id are returned and linked, but name a component only if it has no other row (then
    component_id is null). An empty table gives no rows. Texts of any length are read whole; other columns are not
    looked at, whatever they are called.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    rows = prints.count()
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "firsts", rows)
    roots = written(connected_components(ball_links(firsts)), "roots", rows)  # of distinct fingerprints only
    linked = roots.withColumnRenamed("node", "fp").join(firsts, "fp").select("fp", "component", "first")
    lowest = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    changed = linked.join(lowest, "component").select("fp", "component_id")
    named = written(firsts.join(changed, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), "n"), "named", rows)
    dropped(firsts, roots)
    least = (named.agg(F.sum("n")).first()[0] or 0) / HEAVY
    heavy = F.broadcast(named.where(F.col("n") > least).select("fp", "component_id"))  # under HEAVY rows, whatever the input
    rest = prints.join(heavy, "fp", "left_anti").join(named.where(F.col("n") <= least), "fp")
    return prints.join(heavy, "fp").unionByName(rest.select("fp", "doc_id", "component_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without near-duplicates: of each component one row stays, in the columns of docs.

    It is the row with the smallest id; a row with a null id stays only where the whole component has no other, then the one
    with the lowest fingerprint. Rows that repeat stay only once.
    """
    given, id_col, text_col = numbered(docs, id_col, text_col)
    at = given.columns.index(text_col)

    def named(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "_node"])

    schema = StructType([*given.schema.fields, StructField("_node", LongType())])
    rows = written(given.mapInArrow(over_batches(named), schema).withColumn("_mark", F.xxhash64(*given.columns)), "named")
    roots = written(connected_components(ball_links(written(rows.select(F.col("_node").alias("fp")).distinct(), "firsts"))), "roots")
    return first_of_each(rows, roots, id_col).select(*given.columns).toDF(*docs.columns)
