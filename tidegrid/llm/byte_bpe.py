"""Byte-level BPE of whole texts by a rank file: long texts in overlapping chunks, decoding by concatenation."""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import over_batches, parallelism
from tidegrid.llm.words import texts

#: Characters of a chunk, and how far it reads into the next one. A text of fewer than two chunks is one piece.
CHUNK = 16_384
OVERLAP = 512
#: Bytes of ids that a batch of results holds, about.
HELD = 8 << 20

_encodings: dict = {}


def rank_file(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; kept by each worker process."""
    import tiktoken

    if (path, pattern) not in _encodings:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def ends(splitter, text: str) -> set[int]:
    """Where the pre-tokens of a text end, read from its beginning."""
    return {m.end() for m in splitter.finditer(text)}


def stitch(splitter, text: str, at: int, chunk_ends: set[int]) -> int:
    """The first place after `at` where two readings meet: the chunk's own and that of a chunk which begins at `at`; -1 if none.

    Only a visible character before a blank counts. No pre-token goes on over such a place, so the reading of the whole
    text has the boundary too, and a piece that ends there is split as within the whole.
    """
    meet = chunk_ends & {at + e for e in ends(splitter, text[at:])}
    return min((p for p in meet if p > at and p < len(text) and text[p] in " \t\r\n" and not text[p - 1].isspace()), default=-1)


def chunked(text: str, chunk: int, overlap: int) -> Iterable[tuple[int, bool, str]]:
    """(number, whether it is the last, text with the overlap): the last chunk holds up to two chunks' characters."""
    n = max(1, len(text) // chunk)
    for k in range(n):
        yield k, k == n - 1, text[k * chunk :] if k == n - 1 else text[k * chunk : (k + 1) * chunk + overlap]


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary) for every row: the ids of its whole text as little-endian unsigned 32-bit integers.

    A null text is an empty one and has no ids; repeated rows and rows with a null id are encoded each on their own. Texts of
    two chunks and more are cut into overlapping chunks dealt over all tasks, whatever document they belong to: each is
    pre-tokenised, the boundaries shared with its neighbour give the pieces, and pieces are encoded apart and put together
    in order. Where the overlap has no shared boundary (text without blanks), neighbouring pieces are joined before they
    are encoded, so results never depend on where the cuts fall. An empty table gives no rows; other columns are not
    looked at.
    """
    import public_tokenizers

    path, pattern = path or rank_file(), pattern or public_tokenizers.PATTERN
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tasks = parallelism(docs.sparkSession)

    def ids_of(text: str) -> bytes:
        return np.array(encoding(path, pattern).encode_ordinary(text), "<u4").tobytes()

    def whole(batches):
        for batch in batches:
            out, size = [], 0
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                out.append((i, ids_of(text)))
                size += len(out[-1][1])
                if size >= HELD:
                    yield _batch(out, ["doc_id", "ids"], [pa.int64(), pa.binary()])
                    out, size = [], 0
            if out:
                yield _batch(out, ["doc_id", "ids"], [pa.int64(), pa.binary()])

    def cut(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                row += 1
                for k, last, part in chunked(text, chunk, overlap):
                    yield _batch([(row, k, i, last, part)], ["row", "k", "doc_id", "last", "part"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()])

    linked = ["row", "k", "link", "meet", "doc_id", "last", "part"], [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]

    def pre_tokenised(batches):
        splitter = regex.compile(pattern)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                meet, text = len(row["part"]), row["part"]
                if not row["last"]:
                    meet = stitch(splitter, text, chunk, ends(splitter, text))
                    out.append((row["row"], row["k"] + 1, True, meet - chunk if meet >= 0 else -1, None, None, None))
                out.append((row["row"], row["k"], False, meet, row["doc_id"], row["last"], text))
            if out:
                yield _batch(out, *linked)

    def pieces(batches):
        before = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():  # a chunk's link stands right before it
                if row["link"]:
                    before = {(row["row"], row["k"]): row["meet"]}
                    continue
                begin, end = before.pop((row["row"], row["k"]), 0), row["meet"]
                text = row["part"][max(begin, 0) : end if end >= 0 else chunk]
                met = begin >= 0 and end >= 0
                out.append((row["row"], row["k"], row["doc_id"], row["last"], end >= 0, ids_of(text) if met else None, None if met else text))
            if out:
                yield _batch(out, ["row", "k", "doc_id", "last", "ended", "ids", "raw"], [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.string()])

    def joined(batches):
        ids, raw = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["ids"] is None:
                    raw.append(row["raw"])
                    if row["ended"]:
                        ids.append(ids_of("".join(raw)))
                        raw = []
                else:
                    ids.append(row["ids"])
                if row["last"]:
                    yield _batch([(row["doc_id"], b"".join(ids))], ["doc_id", "ids"], [pa.int64(), pa.binary()])
                    ids = []

    short = F.length("text") < 2 * chunk
    parts = rows.where(~short).mapInArrow(cut, "row long, k long, doc_id long, last boolean, part string").repartition(tasks, "row", "k")
    met = parts.mapInArrow(pre_tokenised, "row long, k long, link boolean, meet long, doc_id long, last boolean, part string")
    met = met.repartition(tasks, "row", "k").sortWithinPartitions("row", "k", F.desc("link"))
    done = met.mapInArrow(pieces, "row long, k long, doc_id long, last boolean, ended boolean, ids binary, raw string")
    done = done.repartition(tasks, "row").sortWithinPartitions("row", "k").mapInArrow(joined, "doc_id long, ids binary")
    return rows.where(short).mapInArrow(whole, "doc_id long, ids binary").union(done)


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded with a column decoded: the raw bytes of each row's ids, one after the other. Null ids decode to null.

    A column that is called decoded already is replaced; all others stay as they are.
    """
    import public_tokenizers

    path, pattern = path or rank_file(), pattern or public_tokenizers.PATTERN
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")

    def bytes_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        of = encoding(path, pattern)
        out = [None if ids is None else of.decode_bytes(np.frombuffer(ids, "<u4").tolist()) for ids in texts(batch.column(at))]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(over_batches(bytes_of), f"{fields}, decoded binary")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, encoded and decoded again."""
    back = decode(encode(docs))
    return back.select("doc_id", F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
