"""Near copies by similarity of word shingles: fingerprints and MinHash bands propose pairs, whole shingle sets decide.

Two SimHash fingerprints within two bits are found by operator 5's ball hashing. At similarity 0.8 fingerprints differ in about
ten of 64 bits, and a ball of half that radius has 8 million values, so pairs further apart are proposed by MinHash bands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tidegrid.llm.common import deleted, dropped, numbered, parallelism, written
from tidegrid.llm.components import connected_components, first_of_each
from tidegrid.llm.simhash import SEED, ball_links, hashes, majority
from tidegrid.llm.stored_sets import PLACE, Reader, stored
from tidegrid.llm.words import texts

SHINGLE, LEAST = 5, 0.8
#: Bands of so many minima each: a pair of similarity s shares one with probability 1 - (1 - s^MINIMA)^BANDS, 0.99995 at 0.8.
BANDS, MINIMA = 25, 5
#: Buckets that at least one in so many entries are in meet their members by broadcast: there are at most as many such.
HEAVY = 512
#: Pairs that are compared first between the same two components.
CENTRES = 8
#: Sets and bytes of a block of crossings(), about; shingles that are counted at once.
BLOCK, BLOCK_BYTES, WIDTH = 1024, 4 << 20, 2048
#: Shingles whose minima are taken at once.
PART = 4096
#: Odd factors, one for each minimum.
FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, ascending; a text of fewer words is one shingle, one without words none."""
    return np.unique(hashes(text, shingle))


def node_of(found: np.ndarray) -> int:
    """A signed 64-bit name of a shingle set; zero for the empty one."""
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), SEED)], np.uint64).view(np.int64)[0]) if len(found) else 0


def bands(found: np.ndarray) -> list[int]:
    """A signed long for each band: sets that agree in all minima of a band agree in its long."""
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), PART):
        least = np.minimum(least, (found[k : k + PART, None] * FACTORS[None, :]).min(axis=0))
    rows = least.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets of distinct ascending hashes; of two empty ones 1."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _named(docs: DataFrame, text_col: str, shingle: int) -> DataFrame:
    """docs with the node of every row's shingle set (_node), its fingerprint (_fp), its bands and a hash of the row (_mark).

    Only the first of a task's rows with a node carries bands, so copies don't pass on the same ones again and again.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            nodes, prints, longs = [], [], []
            for t in texts(batch.column(at)):
                all_of = hashes(t, shingle)
                found = np.unique(all_of)
                nodes.append(node_of(found))
                prints.append(majority(all_of))
                longs.append(bands(found) if len(found) and nodes[-1] not in seen else [])
                seen.add(nodes[-1])
            own = [pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(longs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "_node", "_fp", "_bands"])

    schema = StructType([*docs.schema.fields, StructField("_node", LongType()), StructField("_fp", LongType()), StructField("_bands", ArrayType(LongType()))])
    return docs.mapInArrow(run, schema).withColumn("_mark", F.xxhash64(*docs.columns))


def shared(entries: DataFrame) -> DataFrame:
    """(bucket, node, low, high, n) of the entries (bucket, node) whose bucket has n members, two or more; low and high are
    the first and last of them in an order of the bucket's own."""
    order = F.struct(F.xxhash64("bucket", "node").alias("o"), F.col("node"))
    met = entries.groupBy("bucket").agg(F.min(order)["node"].alias("low"), F.max(order)["node"].alias("high"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    n = entries.count()
    met, least = written(met, "buckets", n // 2), n / HEAVY
    heavy = F.broadcast(met.where(F.col("n") > least))  # under HEAVY rows, whatever the input
    return entries.join(heavy, "bucket").unionByName(entries.join(met.where(F.col("n") <= least), "bucket"))


def pairs(members: DataFrame) -> DataFrame:
    """(a, b): candidates among members of shared().

    Every member of a bucket meets two of them, the lowest and the highest, so a bucket of up to three is compared whole and
    a large one costs two pairs a member; crossings() has what is left of those.
    """
    ends = members.select("node", F.explode(F.array_distinct(F.array("low", "high"))).alias("other")).where("node <> other")
    return ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def close_prints(prints: DataFrame) -> DataFrame:
    """(a, b): candidates among prints (node, fp): the lowest node of every fingerprint meets the others of it and those of
    fingerprints within two bits."""
    firsts = written(prints.groupBy("fp").agg(F.min("node").alias("node")), "firsts", prints.count())
    same = prints.join(firsts.withColumnRenamed("node", "other"), "fp").select("node", "other")
    near = ball_links(firsts.select("fp")).join(firsts.select(F.col("fp").alias("a"), "node"), "a").join(firsts.select(F.col("fp").alias("b"), F.col("node").alias("other")), "b")
    ends = same.unionByName(near.select("node", "other")).where("node <> other")
    return ends.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def verified(candidates: DataFrame, sets: DataFrame, folder: str, least: float) -> DataFrame:
    """The pairs (a, b) whose sets, at the places (node, file, at, size) in the folder, have the least similarity.

    Pairs are dealt over all tasks and read their sets: a set that many pairs share is not passed on with each of them.
    """

    def check(batches):
        of = Reader(folder)
        for batch in batches:
            if batch.num_rows:
                places = zip(*(batch.column(k).to_pylist() for k in range(2, 8)), strict=True)
                good = [jaccard(of(*p[:3]), of(*p[3:])) >= least for p in places]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in PLACE)) for end in ("a", "b"))
    placed = candidates.join(right, "b").join(left, "a").select("a", "b", *(f"{end}_{c}" for end in ("a", "b") for c in PLACE))
    return placed.repartition(2 * parallelism(sets.sparkSession), "a", "b").sortWithinPartitions("a_file", "a_at").mapInArrow(check, "a long, b long")


def apart(candidates: DataFrame, roots: DataFrame, most: int | None = None) -> DataFrame:
    """(a, b): candidates whose ends are in different components yet, for each two components up to `most` of them."""
    for end in ("a", "b"):
        own = roots.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}"))
        candidates = candidates.join(own, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    rows = candidates.where("root_a <> root_b").select("a", "b", F.least("root_a", "root_b").alias("x"), F.greatest("root_a", "root_b").alias("y"))
    if most is not None:
        rows = rows.withColumn("place", F.expr("row_number() over (partition by x, y order by xxhash64(a, b), a, b)")).where(F.col("place") <= most)
    return rows.select("a", "b")


def across(found: list[np.ndarray], roots: np.ndarray, sides: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Positions of similar sets, enough to join all that have the least similarity: pairs of a cell's two sides (0 and 1),
    of all sets where it has one side only, and never of sets that have one root already."""
    sizes = np.array([len(x) for x in found])
    _, at, many = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    kept = np.flatnonzero(many[at] > 1)  # what one set has alone no two have in common
    column = np.full(len(many), -1)
    column[many > 1] = np.arange((many > 1).sum())
    row, column = np.repeat(np.arange(len(found)), sizes)[kept], column[at[kept]]
    both = np.zeros((len(found), len(found)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, WIDTH):
        i, j = np.searchsorted(column, (a, a + WIDTH))
        part = np.zeros((len(found), WIDTH), np.float32)
        part[row[i:j], column[i:j] - a] = 1
        both += part @ part.T
    good = both >= least * (sizes[:, None] + sizes[None, :] - both)
    if sides.any():
        good &= sides[:, None] != sides[None, :]
    labels, out = roots.copy(), []
    for i in range(len(found)):
        mates = np.flatnonzero(good[i] & (labels != labels[i]))
        for label in np.unique(labels[mates]).tolist():
            out.append((i, int(mates[labels[mates] == label][0])))
        labels[np.isin(labels, labels[mates])] = labels[i]
    return out


def crossings(members: DataFrame, roots: DataFrame, sets: DataFrame, folder: str, least: float) -> DataFrame:
    """(a, b): links of the least similarity between members (bucket, node) of one bucket that are in different components,
    enough to join all that have it.

    Buckets whose members are all in one component, as a large group of near copies mostly is by now, cost nothing. In the
    others every set meets all but those of its own component where that is the bucket's largest, in cells of two blocks of at
    most about BLOCK sets or BLOCK_BYTES. Cells are dealt places of sets and read the sets: what is shuffled doesn't grow with
    their length. A cell counts what its sets share and passes on only links that join something, never its pairs.
    """
    n = members.count()
    of = written(members.join(roots.withColumnRenamed("component", "root"), "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "of", n)
    mixed = of.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("roots"))
    met = written(of.join(mixed.where("roots > 1").select("bucket", "main"), "bucket").join(sets, "node").withColumn("rest", F.col("root") != F.col("main")), "met", n)
    blocks = lambda rest: F.ceil(F.greatest(F.count_if(rest) / BLOCK, F.sum(F.when(rest, F.col("size"))) / BLOCK_BYTES)).cast("int")
    dealt = met.join(met.groupBy("bucket").agg(blocks(~F.col("rest")).alias("large"), blocks(F.col("rest")).alias("small")), "bucket")
    place = F.xxhash64("bucket", "node")
    dealt = dealt.withColumn("own", F.when(F.col("rest"), F.col("large") + F.pmod(place, F.col("small"))).otherwise(F.pmod(place, F.col("large"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("rest"), 0).otherwise(F.col("large")), F.col("large") + F.col("small") - 1)))
    cells = dealt.select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root", *PLACE)
    cells = cells.repartition(4 * parallelism(sets.sparkSession), "bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")

    def compared(batches):
        set_of, cell, held = Reader(folder), None, []

        def told():
            node, root, side = (np.array(x) for x in zip(*(r[:3] for r in held), strict=True))
            if len(held) > 1 and (root != root[0]).any():
                for i, j in across([set_of(*r[3:]) for r in held], root, side, least):
                    yield min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(9)]
            for *key, side, node, root, file, at, size in zip(*columns, strict=True):
                if key != cell:
                    if held and (pairs := list(told())):
                        yield batch_of(pairs)
                    cell, held = key, []
                held.append((node, root, side, file, at, size))
        if held and (pairs := list(told())):
            yield batch_of(pairs)

    return cells.mapInArrow(compared, "a long, b long").distinct()


def links(rows: DataFrame, text_col: str, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(node, component) of the links between different shingle sets of the least similarity, for rows of _named().

    Pairs are proposed by fingerprints and bands, then verified on their whole sets: first each node with one partner; of
    the others only pairs that those links don't yet join, few between the same two components first, so a large group of
    near copies costs few comparisons of sets. In buckets of over three members that still hold several components all
    members of different ones are then compared.
    """
    some = rows.where("_node <> 0").select(F.col("_node").alias("node"), F.col("_fp").alias("fp"), F.col("_bands").alias("bands"), F.col("_mark").alias("mark"))
    entries = written(some.select("node", F.explode("bands").alias("bucket")).distinct(), "entries")
    members = written(shared(entries), "members", entries.count())
    prints = written(some.groupBy("node").agg(F.min("fp").alias("fp")), "prints", entries.count() // BANDS)  # sets of equal hashes may differ in repeats, so in the print
    dropped(entries)
    proposed = written(pairs(members).union(close_prints(prints)).distinct(), "pairs", 2 * members.count())
    n = proposed.count()
    nodes = proposed.select(F.col("a").alias("node")).union(proposed.select("b")).distinct()
    marks = some.groupBy("node").agg(F.min("mark").alias("_mark")).join(nodes, "node", "left_semi").select("_mark")
    chosen = rows.join(marks, "_mark", "left_semi").dropDuplicates(["_mark"]).select(F.col("_node").alias("node"), F.col(text_col).alias("text"))
    sets, folder = stored(chosen, lambda t: shingles(t, shingle))
    tried = proposed.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    roots = written(connected_components(written(verified(tried, sets, folder, least), "links_found")), "roots", n)
    for most in (CENTRES, None):
        chosen = written(apart(proposed.join(tried, ["a", "b"], "left_anti"), roots, most), "apart", n)
        tried = tried.unionByName(chosen)
        roots = merged(roots, written(verified(chosen, sets, folder, least), "links_found"))
    roots = merged(roots, written(crossings(members.where("n > 3").select("bucket", "node"), roots, sets, folder, least), "links_found"))
    dropped(proposed, sets, prints, members)
    deleted(rows.sparkSession, folder)
    return roots


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """roots (node, component) with more links (a, b): only components are linked anew, not all their nodes."""
    if more.isEmpty():
        return roots
    new = more.select(F.col("a").alias("node")).union(more.select("b")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("component"))
    n = roots.count() + 2 * more.count()
    nodes = written(roots.unionByName(new), "roots", n)
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("component").alias(f"root_{end}"))
    ends = more.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    top = connected_components(ends).select(F.col("node").alias("component"), F.col("component").alias("top"))
    return written(nodes.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component")), "roots", n)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """docs without near copies: of all rows linked, directly or through others, by shingle similarity of least or more, one stays.

    It is the row with the smallest id; a row with a null id stays only where the whole group has no other. Texts with the
    same shingles are copies whatever their case or white space, texts without words (null, empty) copies of each other.
    Candidates are found with probability 0.99995 at similarity 0.8, more above; none is linked unverified. Texts of any
    length are read whole. Columns of any name stay as they are. An empty table gives no rows.
    """
    given, id_col, text_col = numbered(docs, id_col, text_col)
    rows = written(_named(given, text_col, shingle), "named")
    return first_of_each(rows, links(rows, text_col, shingle, least), id_col).select(*given.columns).toDF(*docs.columns)
