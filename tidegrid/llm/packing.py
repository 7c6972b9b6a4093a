"""Packing documents into few sequences by linear grouping, few-size configurations and best fit.

Everything that decides where documents go happens on the histogram of piece lengths, which has at most `capacity` entries
whatever the number of documents; the cluster only counts lengths, ranks pieces within a length and looks places up.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import over_batches, written
from tidegrid.llm.words import END_ID, encoder, texts, vocabulary

CAPACITY = 4096
#: Pieces longer than this share of a sequence are large: they are grouped and planned by configurations.
LARGE = 1 / 8
#: Numbers of groups that are tried: fewer leave more room to small pieces, more round less.
GROUPS = (24, 96)
#: Simplex steps without gain, one after the other, that end the column generation.
STALLED = 1_000
#: Shares of the configurations that are used: what they leave is free to fill the room that rounding leaves.
SHARES = (1.0, 0.9, 0.7, 0.4)


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[tuple[int, ...], float]]:
    """Configurations (how many of each size) and how often to use each, a number with fractions, to cover the counts.

    Column generation over the linear relaxation of cutting stock: the duals price the sizes, an unbounded knapsack finds
    the configuration worth most, a dense simplex step takes it in, until none is worth more than a sequence. sizes descend
    and are distinct. Steps that change nothing could go round in a circle: after STALLED such steps in a row it ends.
    """
    n = len(sizes)
    demand, widths = np.array(counts, float), np.array(sizes)
    largest, least = max(sizes), min(sizes)
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    use = demand / basis.diagonal()
    stalled = 0
    while stalled < STALLED:
        duals = np.linalg.solve(basis.T, np.ones(n))
        best, choice = np.zeros(largest + capacity + 1), np.full(capacity + 1, -1)  # room r stands at largest + r
        best[:largest] = -np.inf
        for room in range(least, capacity + 1):
            worth = best[largest + room - widths] + duals
            i = int(worth.argmax())
            best[largest + room] = best[largest + room - 1]
            if worth[i] > best[largest + room] + 1e-12:
                best[largest + room], choice[room] = worth[i], i
        if best[-1] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        while room > 0:
            i = choice[room]
            if i < 0:
                room -= 1
                continue
            column[i] += 1
            room -= sizes[i]
        step = np.linalg.solve(basis, column)
        ratios = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratios.argmin())
        if not np.isfinite(ratios[out]):
            break
        stalled = 0 if ratios[out] > 1e-9 else stalled + 1
        use = np.maximum(use - ratios[out] * step, 0)
        use[out] = ratios[out]
        basis[:, out] = column
    return [(tuple(int(x) for x in basis[:, j]), float(use[j])) for j in range(n)]


def grouped(histogram: dict[int, int], capacity: int, large: float, groups: int) -> dict[int, list[tuple[int, int]]]:
    """Linear grouping: the large lengths, in descending order, cut into groups of equal cardinality: for each group's largest
    length the (length, pieces) that are rounded up to it. With fewer large pieces than groups each is a group."""
    big = sorted((k for k, n in histogram.items() if n and k > capacity * large), reverse=True)
    total = sum(histogram[k] for k in big)
    out: dict[int, list[tuple[int, int]]] = {}
    if not total:
        return out
    share, filled, top = -(-total // groups), 0, 0
    for k in big:
        n = histogram[k]
        while n:
            top = top if filled else k
            take = min(n, share - filled)
            out.setdefault(top, []).append((k, take))
            n, filled = n - take, (filled + take) % share
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY, large: float = LARGE, groups: tuple[int, ...] = GROUPS, shares: tuple[float, ...] = SHARES) -> list[tuple[int, int, int, int, int]]:
    """The filled_plan() that needs the fewest sequences, over numbers of groups and shares of their configurations."""
    best: list[tuple[int, int, int, int, int]] | None = None
    least = 0
    for n in groups:
        members = grouped(histogram, capacity, large, n)
        sizes = list(members)
        used = configurations(sizes, [sum(n for _, n in members[s]) for s in sizes], capacity) if sizes else []
        for share in shares:
            runs = filled_plan(histogram, capacity, members, [(c, int(share * u + 1e-6)) for c, u in used])
            made = max((first + n for _, _, n, first, _ in runs), default=0)
            if best is None or made < least:
                best, least = runs, made
    return best or []


def filled_plan(histogram: dict[int, int], capacity: int, members: dict[int, list[tuple[int, int]]], configured: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset): piece number first rank + i of that length goes to sequence
    first sequence + i at that offset. Each length's runs cover its ranks from 0 on; sequences are numbered from 0.

    Configurations of the groups' sizes are filled with the groups' actual pieces, so every sequence keeps at least its
    planned room. The large pieces that they leave over and all small ones follow by best fit in descending order.
    Sequences alike in room stand together as runs, so the work follows the number of lengths, not that of documents.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    runs: list[tuple[int, int, int, int, int]] = []
    ranked = dict.fromkeys(left, 0)
    rooms: dict[int, list[list[int]]] = {}  # room: stretches [first sequence, sequences, offset]
    order: list[int] = []
    made = 0

    def free(room: int, first: int, n: int, offset: int) -> None:
        if room > 0 and n > 0:
            if room not in rooms:
                rooms[room] = []
                insort(order, room)
            rooms[room].append([first, n, offset])

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, ranked[length], n, first, offset))
        ranked[length] += n
        left[length] -= n

    merged = {k: [list(x) for x in v] for k, v in members.items()}
    sizes = list(merged)
    for config, times in configured:
        stretches = [[made, times, capacity, 0]]
        made += times
        for s, many in zip(sizes, config, strict=True):
            for _ in range(many):
                out = []
                for first, n, room, offset in stretches:
                    while n and merged[s]:
                        k, have = merged[s][0]
                        take = min(n, have)
                        place(k, take, first, offset)
                        out.append([first, take, room - k, offset + k])
                        first, n = first + take, n - take
                        merged[s][0][1] -= take
                        if not merged[s][0][1]:
                            merged[s].pop(0)
                    if n:
                        out.append([first, n, room, offset])
                stretches = out
        for first, n, room, offset in stretches:
            free(room, first, n, offset)
    for k in sorted(left, reverse=True):
        while left[k]:
            at = bisect_left(order, k)
            if at == len(order):
                n = -(-left[k] // (capacity // k))
                free(capacity, made, n, 0)
                made += n
                continue
            room = order[at]
            first, n, offset = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            each = min(room // k, max(1, -(-left[k] // n))) if room == capacity else 1
            full = min(n, left[k] // each)
            if not full:
                each, full = left[k], 1
            for i in range(each):
                place(k, full, first, offset + i * k)
            free(room - each * k, first, full, offset + each * k)
            free(room, first + full, n - full, offset)
    return runs


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, within) for every piece of every row's ids, the end id included.

    task is the number of the task that cut the piece, within its place among the task's pieces of that length; they hold
    for a table that is written once.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "within"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def cut(batches):
        of, seen, task = encoder(path, special), Counter(), TaskContext.get().partitionId()
        end = np.array([end_id], of.dtype).tobytes()
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.frombuffer(of.raw(text) + end, of.dtype)
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity].astype("<u4")
                    out.append((i, k, start, len(part), zlib.crc32(part), task, seen[len(part)]))
                    seen[len(part)] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, within long")


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", special: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a place for every piece of every row.

    A null text is an empty one: a single piece of the end id. special: as for WordEncoder. Repeated rows are packed each
    on its own; rows with a null id are packed too. An empty table gives no rows. Texts of any length are cut whole. Other
    columns are not looked at. Pieces of one length are interchangeable: a piece's rank among them is its place within its
    task after those of earlier tasks, so nothing is sorted and a length or id that most pieces share makes no large group.
    """
    cut = written(pieces(docs, path or vocabulary(), capacity, end_id, id_col, text_col, special), "pieces")
    sizes = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "sizes", cut.count())  # up to `capacity` rows a task
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = sorted(plan(histogram, capacity))
    before = sizes.selectExpr("length", "task", "sum(n) over (partition by length order by task) - n as before")
    ranked = cut.join(before, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("within")).alias("rank"))
    length, first, _, sequence, offset = (np.array(x, np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 5))
    key = length * (1 << 48) + first

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rank = (batch.column(i).to_numpy() for i in (3, 5))
        at = np.searchsorted(key, own * (1 << 48) + rank, side="right") - 1
        to = sequence[at] + rank - first[at]
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(to), pa.array(offset[at])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(over_batches(placed), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
