"""Quality by perplexity: an interpolated modified Kneser-Ney model of byte n-grams over trusted text.

Counts, contexts and probabilities are tables sharded by n-gram; they meet the documents in joins on n-grams. Documents
take part in blocks: a block asks once for each n-gram that it has, and gets its probabilities as one file in the shared
folder, so no text is shuffled for scoring and no model is held whole by anyone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import dropped, got, new_path, over_batches, parallelism, put, there, written
from tidegrid.llm.words import texts

ORDER = 5
#: Bytes of text in a block, and of text whose n-grams are listed at once.
BLOCK, PART = 20 << 20, 1 << 20
#: A document is kept up to this quantile of its language's trusted documents in one of so many folds, which are scored by a
#: model of the other folds.
QUANTILE, FOLDS = 0.99, 3
#: Times that rows are read again whose block came out otherwise.
TRIES = 5
#: Limits of up to so many languages are broadcast; more meet the documents in a shuffle.
LANGUAGES = 10_000


def codes(raw: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of texts, one after the other, as numbers whose lowest byte is the predicted one; and where each text's begin.

    Every text is preceded by order - 1 zero bytes and followed by one, which is predicted too.
    """
    pad = bytes(order - 1)
    data = np.frombuffer(b"".join(pad + t + b"\0" for t in raw), np.uint8).astype(np.int64)
    out = np.zeros(len(data) - order + 1, np.int64)
    for k in range(order):
        out = (out << 8) | data[k : len(data) - order + 1 + k]
    sizes = np.array([len(t) + 1 for t in raw])
    ends = np.cumsum(sizes + order - 1)
    keep = np.ones(len(out), bool)
    for e in ends[:-1]:  # those that reach over from one text into the next
        keep[e - order + 1 : e] = False
    return out[keep], np.concatenate(([0], np.cumsum(sizes)[:-1]))


def parts(raw: Iterable[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in raw:
        held.append(t)
        size += len(t)
        if size >= PART:
            yield held
            held, size = [], 0
    if held:
        yield held


def counts(trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): how often each n-gram of the highest order stands in the texts of packed_texts(), all of them."""

    def counted(batches: Iterable[pa.RecordBatch]):
        keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for raw in parts(zlib.decompress(t) for t in texts(batch.column(0))):
                found = pc.value_counts(pa.array(codes(raw, order)[0]))
                both = np.concatenate((keys, found.field(0).to_numpy()))
                n = np.concatenate((sums, found.field(1).to_numpy()))
                keys, at = np.unique(both, return_inverse=True)
                sums = np.zeros(len(keys), np.int64)
                np.add.at(sums, at, n)
            if len(keys) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["g", "c"])
                keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["g", "c"])

    return trusted.select("text").mapInArrow(counted, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(table: DataFrame) -> tuple[float, float, float]:
    """The three discounts of modified Kneser-Ney, from how many n-grams have counts 1 to 4; 0.5, 1, 1.5 where some are missing."""
    n1, n2, n3, n4 = (x or 0 for x in table.select(*(F.count_if(F.col("c") == k) for k in (1, 2, 3, 4))).first())
    if not n1 or not n2 or not n3:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return min(max(1 - 2 * y * n2 / n1, 0.0), 1.0), min(max(2 - 3 * y * n3 / n2, 0.0), 2.0), min(max(3 - 4 * y * n4 / n3, 0.0), 3.0)


def probabilities(model: DataFrame, asked: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, p) for every n-gram of asked (g, distinct), interpolated over all orders down to one in 256 for any byte.

    The highest order counts occurrences, lower ones the distinct bytes that stand before an n-gram. What the discounts
    leave of a context goes to the next lower order; an unseen context passes all of it on.
    """
    tables = {order: model}
    wanted = {order: written(asked, "wanted")}
    for k in range(order - 1, 0, -1):
        mask = (1 << 8 * k) - 1
        tables[k] = written(tables[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).agg(F.count(F.lit(1)).alias("c")), "counts")
        wanted[k] = written(wanted[k + 1].select(F.col("g").bitwiseAND(F.lit(mask)).alias("g")).distinct(), "wanted")
    known = None
    for k in range(1, order + 1):
        one, two, more = discounts(tables[k])
        context = tables[k].groupBy(F.shiftright("g", 8).alias("h")).agg(
            F.sum("c").alias("total"),
            (one * F.count_if(F.col("c") == 1) + two * F.count_if(F.col("c") == 2) + more * F.count_if(F.col("c") >= 3)).alias("rest"),
        )
        rows = wanted[k].join(tables[k], "g", "left").withColumn("h", F.shiftright("g", 8)).join(context, "h", "left")
        if known is None:
            rows = rows.withColumn("lower", F.lit(1 / 256))
        else:
            below = known.select(F.col("g").alias("tail"), F.col("p").alias("lower"))
            rows = rows.withColumn("tail", F.col("g").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "tail")
        own = F.col("c") - F.when(F.col("c") == 1, one).when(F.col("c") == 2, two).otherwise(more)
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise((F.coalesce(F.greatest(own, F.lit(0.0)), F.lit(0.0)) + F.col("rest") * F.col("lower")) / F.col("total"))
        before, known = known, written(rows.select("g", p.alias("p")), "known")
        dropped(wanted[k], *([before] if before is not None else []), *([tables[k]] if k < order else []))
    return known


def raw_of(text: str | bytes | None) -> bytes:
    """The bytes of a text, or of a compressed one."""
    return zlib.decompress(text) if isinstance(text, bytes) else (text or "").encode()


def blocks(batches: Iterable[pa.RecordBatch], at: int) -> Iterator[tuple[int, list[bytes], list[pa.RecordBatch]]]:
    """(key, texts, batches without texts): the rows in stretches of about BLOCK bytes; the key follows from the texts.

    The column of texts may hold compressed ones."""
    raw, rows, size = [], [], 0

    def whole():
        digest = xxhash.xxh64(seed=len(raw))
        for t in raw:
            digest.update(len(t).to_bytes(8, "little"))
            digest.update(t)
        return digest.intdigest() >> 1, raw, rows

    for batch in batches:
        begin, rest = 0, batch.select([k for k in range(batch.num_columns) if k != at])
        for i, text in enumerate(texts(batch.column(at))):
            raw.append(raw_of(text))
            size += len(raw[-1])
            if size >= BLOCK:
                rows.append(rest.slice(begin, i + 1 - begin))
                yield whole()
                raw, rows, size, begin = [], [], 0, i + 1
        if begin < batch.num_rows:
            rows.append(rest.slice(begin))
    if raw:
        yield whole()


def scored(docs: DataFrame, model: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_bytes, log_p) for every row: the log probability of its whole text's bytes and its end; written.

    The text is a string, or what packed_texts() makes of one.

    The rows are read twice and fall into the same blocks both times as long as partitions keep their order. Those of a
    block that comes out otherwise the second time, because docs is made anew in another order or by other executors, are
    put down and asked for again, so each row is scored once whatever happens. A null text is an empty one, of which only
    the end is predicted. Rows that repeat or have null ids or languages are scored like others, texts of any length whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    done = None
    for _ in range(TRIES):
        once = written(_asked_and_summed(rows, model, order), "scored")
        good = once.where("log_p is not null").select("doc_id", "lang", "n_bytes", "log_p")
        done = good if done is None else done.unionByName(good)
        left = once.where("log_p is null")
        if left.isEmpty():
            return done
        rows = left.select("doc_id", "lang", F.col("raw").cast("string").alias("text"))
    raise RuntimeError("rows fall into other blocks each time they are read")


def _asked_and_summed(rows: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """scored() of rows (doc_id, lang, text), with raw: the text of rows that got no answers, whose log_p is null."""
    path = new_path(rows.sparkSession, "answers")

    def asks(batches):
        for key, raw, _ in blocks(batches, 0):
            seen = np.zeros(0, np.int64)
            for part in parts(raw):
                seen = np.union1d(seen, pc.unique(pa.array(codes(part, order)[0])).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), key)), pa.array(seen)], names=["block", "g"])

    asked = written(rows.select("text").mapInArrow(asks, "block long, g long"), "asked")
    known = probabilities(model, asked.select("g").distinct(), order)
    tasks = parallelism(rows.sparkSession)

    def answers(batches):
        held, block = [], None

        def told():
            together = pa.Table.from_batches(held)
            g, p = together["g"].to_numpy(), together["p"].to_numpy()
            g, first = np.unique(g, return_index=True)
            put(f"{path}/{block:016x}.bin", g.astype("<i8").tobytes() + np.log(p[first]).astype("<f8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([len(g)], pa.int64())], names=["n"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and of[a] != block:
                        yield told()
                        held = []
                    block = int(of[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield told()

    met = asked.join(known, "g").select("block", "g", "p").repartition(tasks, "block").sortWithinPartitions("block")
    met.mapInArrow(answers, "n long").agg(F.sum("n")).collect()
    dropped(asked, known)

    def summed(batches):
        for key, raw, own in blocks(batches, 2):
            sums, texts_left = pa.nulls(len(raw), pa.float64()), None
            if there(f"{path}/{key:016x}.bin"):
                data = got(f"{path}/{key:016x}.bin")
                g, log_p = np.frombuffer(data, "<i8", len(data) // 16), np.frombuffer(data, "<f8", -1, len(data) // 2)
                found_sums = []
                for part in parts(raw):
                    found, starts = codes(part, order)
                    told = pc.dictionary_encode(pa.array(found))
                    at = np.searchsorted(g, told.dictionary.to_numpy())
                    found_sums.append(np.add.reduceat(log_p[at][told.indices.to_numpy()], starts))
                sums, texts_left = pa.array(np.concatenate(found_sums)), pa.nulls(len(raw), pa.binary())
                del data, g, log_p
            together = pa.Table.from_batches(own).combine_chunks()
            n = pa.array([len(t) + 1 for t in raw], pa.int64())
            one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            yield pa.RecordBatch.from_arrays([one(together["doc_id"]), one(together["lang"]), n, sums, pa.array(raw, pa.binary()) if texts_left is None else texts_left], names=["doc_id", "lang", "n_bytes", "log_p", "raw"])

    return rows.mapInArrow(summed, "doc_id long, lang string, n_bytes long, log_p double, raw binary")


def packed_texts(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, lang, fold, text): the texts compressed, for the shuffle that picks the trusted ones. Equal texts share a fold."""

    def packs(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in texts(batch.column(2))]
        folds = pa.array([xxhash.xxh64_intdigest(t, 10) % FOLDS for t in raw], pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), folds, pa.array([zlib.compress(t, 1) for t in raw], pa.binary())], names=["doc_id", "lang", "fold", "text"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(over_batches(packs), "doc_id long, lang string, fold int, text binary")


def judged(docs: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, threshold, kept) for every row of docs.

    The model is counted over the texts of all trusted_ids (doc_id); perplexity is a byte's. A language's threshold is the
    quantile of the perplexities of its trusted documents in one fold by a model of the others, so that no document vouches
    for itself; those to which the other folds give no probability at all (few and odd texts) set no limit. A trusted id that
    many rows share is split by the skew handling of the join that picks trusted rows. An empty table gives no rows.
    A language without trusted documents in the fold, null among them, takes that of all of the fold together. Without any
    trusted document all rows are kept.
    """
    trusted_ids = trusted_ids.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    trusted = written(packed_texts(docs, id_col, text_col, lang_col).join(trusted_ids.hint("merge"), "doc_id", "left_semi"), "trusted")  # one plan for all sizes
    kept_back = trusted.agg(F.min("fold")).first()[0] or 0  # the first fold that has any
    others, own = (written(counts(trusted.where(test), order), "counts") for test in (F.col("fold") != kept_back, F.col("fold") == kept_back))
    known = scored(trusted.where(F.col("fold") == kept_back), others, order, "doc_id", "text", "lang").select("lang", F.exp(-F.col("log_p") / F.col("n_bytes")).alias("perplexity"))
    model = written(others.unionByName(own).groupBy("g").agg(F.sum("c").alias("c")), "counts")
    dropped(others, own, trusted)
    rows = scored(docs, model, order, id_col, text_col, lang_col).withColumn("perplexity", F.exp(-F.col("log_p") / F.col("n_bytes")))
    dropped(model)
    of = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    known = known.where(F.col("perplexity") < float("inf"))
    limits = written(known.groupBy("lang").agg(of.alias("own")).where("lang is not null"), "limits")
    limits = F.broadcast(limits) if limits.count() <= LANGUAGES else limits
    for_all = known.agg(of.alias("for_all")).first()[0]
    limit = F.coalesce("own", F.lit(float("inf") if for_all is None else for_all))
    return rows.join(limits, "lang", "left").select("doc_id", "lang", "n_bytes", "perplexity", limit.alias("threshold"), (F.col("perplexity") <= limit).alias("kept"))
