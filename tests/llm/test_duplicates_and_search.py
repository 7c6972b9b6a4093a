import re

import numpy as np
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidegrid.llm import exact_topk, simhash
from tidegrid.llm.components import connected_components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


TEXTS = ["", None, "One", "one", "a b", "ONE two\x0bthree\x1cfour five", "É é", " \t\n", *[" ".join(f"w{j}" for j in range(300)) + f" end{i}" for i in range(12)], "w1 " * 50, "a b c d a b c d a b c d"]


def classes(fps):
    """Smallest position reachable for each, over links at 2 or fewer bits."""
    low = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and low[j] < low[i]:
                    low[i], changed = low[j], True
    return low


def test_simhash(spark):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(TEXTS)], "doc_id long, text string, fp int, value int")
    rows = sorted(simhash.near_duplicates(docs).collect())
    fps = [brute_fingerprint(t) for t in TEXTS]
    assert [(r.doc_id, r.fingerprint) for r in rows] == [(i, f"{f:016x}") for i, f in enumerate(fps)]
    assert [r.component_id for r in rows] == classes(fps)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes(fps)))


def test_repeated_and_nameless_rows(spark):
    docs = spark.createDataFrame([(5, "x y z"), (5, "x y z"), (None, "x y z"), (None, "quite another text"), (7, "")], "doc_id long, text string")
    rows = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id or -1), (r.component_id or -1)) for r in rows) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (7, 7)]
    assert sorted(str(r.doc_id) for r in simhash.one_of_each(docs).where("doc_id is not null").collect()) == ["5", "7"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 63), st.integers(0, 63)), max_size=40), st.integers(0, (1 << 64) - 1))
def test_ball_links(spark, flips, base):
    fps = sorted({base, *(base ^ (1 << a) ^ (1 << b) for a, b in flips), *(base ^ (7 << a % 60) for a, _ in flips)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    low = list(range(len(fps)))
    for _ in fps:
        for r in links:
            i, j = signed.index(r.a), signed.index(r.b)
            low[i] = low[j] = min(low[i], low[j])
    assert low == classes(fps)


def test_long_chain(spark):
    n = 300
    order = np.random.default_rng(1).permutation(n).tolist()
    rows = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1000), (5, 5), (None, 3)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_nearest(rows, every, k):
    out, good = set(), [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q in sorted({i for i, _ in good if i % every == 0}):
        w = min(v for i, v in good if i == q)
        ranked = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in good if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(ranked)}
    return out


@pytest.mark.parametrize(("queries", "candidates", "block", "merged"), [(exact_topk.QUERIES, exact_topk.CANDIDATES, exact_topk.BLOCK, exact_topk.MERGED), (2, 30, 7, 64), (3, 10, 7, 4)])
def test_exact_topk(spark, monkeypatch, queries, candidates, block, merged):
    for name, n in (("QUERIES", queries), ("CANDIDATES", candidates), ("BLOCK", block), ("MERGED", merged)):
        monkeypatch.setattr(exact_topk, name, n)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in range(200)]
    rows += [(300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (700, [0.0] * 6), (None, [1.0] * 6), (7, rows[7][1]), (20, rows[20][1]), (800, [0.5, 0.25])]
    table = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, w int, score int")
    found = exact_topk.nearest(table, every=20, k=5).collect()
    assert len(found) == len(set(found)) and {tuple(r) for r in found} == brute_nearest(rows, 20, 5)


def test_few_candidates(spark):
    table = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.nearest(table).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert exact_topk.nearest(table.limit(0)).count() == 0


def test_repeated_queries_as_the_sql(spark, tmp_path):
    import duckdb

    from tidegrid.llm import queries

    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 4]) for i in (*range(150), 100, 100, 7)] + [(None, [1.0] * 6), (200, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = db.sql(f"select query_id, rank, vec_id, score from ({queries.ORACLE_SQL['op4_exact_topk']})").fetchall()
    assert sorted(map(tuple, exact_topk.nearest(spark.read.parquet(f"{tmp_path}/embeddings.parquet")).collect())) == sorted(want)
