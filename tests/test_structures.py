"""Hash buckets, placement, graphs, sketches, texts and orders against brute force."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidelog.functions.hashes import mix32, murmur3_words
from tidelog.operators import graphs, hashing, ordering, reports, runs, sketches, texts
from tidelog.plans import catalogue
from tidelog.sources import textfiles


def test_bucket_search_and_display(spark):
    rng = random.Random(2)
    ops = [(s, rng.randrange(25), rng.choice(["put", "put", "get", "del"]), f"v{s}") for s in range(1500)]
    log = spark.createDataFrame(ops, "seq long, key long, op string, value string")
    chains, expected = {b: [] for b in range(10)}, {}
    for seq, key, op, _ in ops:
        chain = chains[key % 10]
        if op == "put" and key not in chain:
            chain.append(key)
        elif op == "del" and key in chain:
            chain.remove(key)
        elif op == "get":
            expected[seq] = chain.index(key) if key in chain else None
    assert {r.seq: r.chain_index for r in hashing.bucket_search(log).collect()} == expected
    shown = {(r.bucket, r.chain_index): r.key for r in hashing.bucket_display(log).collect()}
    assert shown == {(b, i): k for b, chain in chains.items() for i, k in enumerate(chain)}


def test_cuckoo_place(spark):
    keys = [(0, 0), (1, 7), (2, 5007), (3, 10007), (4, 7), (5, 8)]
    rows = hashing.cuckoo_place(spark.createDataFrame(keys, "seq long, key long")).orderBy("seq").collect()
    assert [(r.slot, r.status) for r in rows] == [(None, "invalid"), (7, "placed"), (5007, "placed"), (None, "cycle"), (None, "duplicate"), (8, "placed")]


def test_graphs_against_brute_force(spark):
    rng = random.Random(3)
    n = 9
    pairs = [(u, v, rng.randrange(1, 20)) for u in range(n) for v in range(u + 1, n) if rng.random() < 0.3]
    edges = spark.createDataFrame(pairs, "u long, v long, w long")
    vertices = spark.createDataFrame([(v,) for v in range(n)], "vertex long")
    dist = [[0 if i == j else 10**9 for j in range(n)] for i in range(n)]
    for u, v, w in pairs:
        dist[u][v] = dist[v][u] = w
    for k, i, j in itertools.product(range(n), repeat=3):
        dist[i][j] = min(dist[i][j], dist[i][k] + dist[k][j])
    arcs = graphs.both_ways(edges)
    found = graphs.shortest(arcs, vertices.withColumnRenamed("vertex", "src"))
    assert {(r.src, r.dst): r.dist for r in found.collect()} == {(i, j): dist[i][j] for i in range(n) for j in range(n) if dist[i][j] < 10**9}
    for r in graphs.paths(found, arcs).collect():
        stops = [r.src, *map(int, filter(None, r.path.split(",")))]
        steps = {(a, b): w for a, b, w in pairs} | {(b, a): w for a, b, w in pairs}
        assert stops[-1] == r.dst and sum(steps[x] for x in zip(stops, stops[1:], strict=False)) == dist[r.src][r.dst]
    parts = {r.vertex: r.component for r in graphs.components(vertices, edges).collect()}
    assert parts == {i: min(j for j in range(n) if dist[i][j] < 10**9) for i in range(n)}
    label, forest = list(range(n)), set()
    for w, u, v in sorted((w, u, v) for u, v, w in pairs):
        if label[u] != label[v]:
            forest.add((u, v, w))
            label = [label[u] if x == label[v] else x for x in label]
    assert {(r.u, r.v, r.w) for r in graphs.spanning_forest(vertices, edges).collect()} == forest
    asked = [(0, 0, [1, 2, 3]), (1, 4, [5, 6]), (2, 1, [])]
    tours = {r.query_id: r.length for r in graphs.tours(arcs, spark.createDataFrame(asked, "query_id long, source long, mids array<long>")).collect()}
    for q, s, mids in asked:
        best = min((sum(dist[a][b] for a, b in zip((s, *p), (*p, s), strict=True)) for p in itertools.permutations(mids)), default=0)
        assert tours[q] == (best if 0 < best < 10**9 else graphs.NO_TOUR)


def test_text_sources(spark, tmp_path):
    (tmp_path / "ops").write_text("Insert(3,10)\nSearch(3)\n\nDelete(3)\n")
    rows = textfiles.operations(spark, str(tmp_path / "ops")).orderBy("seq").collect()
    assert [(r.op, r.key, r.value) for r in rows] == [("Insert", 3, 10), ("Search", 3, None), ("Delete", 3, None)]
    (tmp_path / "matrix").write_text("3\n0 4 @\n4 0 2\n@ 2 0\n0\n1 2 $\n2\n1 $\n")
    edges, asked = textfiles.matrix(spark, str(tmp_path / "matrix"))
    assert {(r.src, r.dst, r.w) for r in edges.collect()} == {(0, 1, 4), (1, 0, 4), (1, 2, 2), (2, 1, 2)}
    assert {r.query_id: (r.source, r.mids) for r in asked.collect()} == {0: (0, [1, 2]), 1: (2, [1])}
    lengths = {r.query_id: r.length for r in graphs.tours(edges, asked.select("query_id", "source", "mids")).collect()}
    assert lengths == {0: 12, 1: 4}
    (tmp_path / "graph").write_text("3 2\n1 2 5\n2 3 7\n1 3 6\n")
    assert textfiles.sparse_graph(spark, str(tmp_path / "graph")).count() == 2
    assert textfiles.sparse_graph(spark, str(tmp_path / "graph"), edge_limit=False).count() == 3


def test_mix32_and_filters(spark):
    def mix(key):
        wrap = lambda x: (x + 2**31) % 2**32 - 2**31
        key = wrap(~key + (key << 15))
        key = wrap(key ^ (key >> 12))
        key = wrap(key + (key << 2))
        key = wrap(key ^ (key >> 4))
        key = wrap(key * 2057)
        return wrap(key ^ (key >> 16)) % 2**64

    keys = [0, 1, 2, 77, -5, 2**31 - 1, -(2**31), 123456789]
    rows = mix32(spark.createDataFrame([(k,) for k in keys], "key long"), "key", 500, "bit").collect()
    assert {r.key: r.bit for r in rows} == {k: mix(k) % 500 for k in keys}
    # 100 keys set 224 bits, all are found, and 8 of the 99 others pass.
    entries = spark.range(100).select(F.lit(0).alias("run"), F.col("id").alias("key"))
    bits = sketches.filters(entries, 500)
    assert bits.count() == 224
    assert sketches.hits(sketches.probe_bits(entries, 500), bits).count() == 100
    others = spark.range(100, 199).select(F.lit(0).alias("run"), F.col("id").alias("key"))
    assert sketches.hits(sketches.probe_bits(others, 500), bits).count() == 8
    kept = sketches.stored(bits, 500)
    assert len(kept.first()["filter"]) == 63
    assert sorted(sketches.restored(kept).collect()) == sorted(bits.collect())
    words = murmur3_words(np.arange(1000))
    assert words.shape == (1000, 4) and len({tuple(w) for w in words.tolist()}) == 1000 and words.min() >= 0


def test_texts(spark):
    cases = [("hello", "ll"), ("aaaaa", "bba"), ("abc", ""), ("", ""), ("ab", "abc"), ("aaaa", "aa"), ("añoñ", "ñ")]
    rows = spark.createDataFrame(cases, "text string, needle string")
    got = rows.select("text", "needle", texts.index_of(F.col("text"), F.col("needle")).alias("i"), texts.count_of(F.col("text"), F.col("needle")).alias("n")).collect()
    assert all(r.i == r.text.find(r.needle) and r.n == (r.text.count(r.needle) if r.needle else 0) for r in got)
    failure = spark.createDataFrame([("aabaaab",), ("a",), ("",)], "s string").select("s", texts.failure_table(F.col("s")).alias("f")).collect()
    assert {r.s: r.f for r in failure} == {"aabaaab": "-1,0,-1,0,1,1,2", "a": "-1", "": ""}


def test_ranks_and_differences(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 101).alias("x"), "id")
    got = {r.id: r["rank"] for r in ordering.ranked(rows, "x", "id").collect()}
    assert got == {i: k + 1 for k, i in enumerate(sorted(range(1000), key=lambda i: (i * 37 % 101, i)))}
    a = spark.createDataFrame([(1, "x\n\ny"), (2, "x\ny"), (3, "same")], "id long, text string")
    b = spark.createDataFrame([(1, "x\nz"), (2, "x\ny\nw"), (3, "same\n")], "id long, text string")
    assert {r.id: r.line for r in reports.first_difference(a, b).collect()} == {1: 1, 2: 2, 3: None}


def test_cascade(spark):
    """Compaction level by level, against the same rules over lists."""
    rng = random.Random(5)
    rows, seq = [], 0
    for ts in range(9):
        for part in range(2):
            for key in sorted(rng.sample(range(part * 30, part * 30 + 30), 8)):
                rows.append((ts * 10 + part, ts, ts % 2, key, rng.choice(["put", "put", "del"]), None, seq))
                rows[-1] = (*rows[-1][:5], "v" * rng.randrange(5, 40) if rows[-1][4] == "put" else None, seq)
                seq += 1
    schema = "run_id long, ts long, level long, key long, op string, value string, seq long"
    got = sorted(map(repr, runs.cascaded(spark.createDataFrame(rows, schema), 200).select(*(c.split()[0] for c in schema.split(", "))).collect()))
    state, level = list(rows), 0
    while any(r[2] >= level for r in state):
        facts = {}
        for r in state:
            f = facts.setdefault(r[0], [r[1], r[2], r[3], r[3]])
            f[2], f[3] = min(f[2], r[3]), max(f[3], r[3])
        mine = sorted((f[0], f[2], run) for run, f in facts.items() if f[1] == level)
        excess = max(0, len(mine) - 2 ** (level + 1))
        chosen = [run for _, _, run in (mine if level == 0 and excess else mine[:excess])]
        if chosen:
            lo, hi = min(facts[r][2] for r in chosen), max(facts[r][3] for r in chosen)
            taken = set(chosen) | {run for run, f in facts.items() if f[1] == level + 1 and f[2] <= hi and lo <= f[3]}
            newest, at = {}, 0
            for r in sorted((r for r in state if r[0] in taken), key=lambda r: (r[1], r[6])):
                newest[r[3]] = r
            ts = max(r[1] for r in state if r[0] in taken)
            state = [r for r in state if r[0] not in taken]
            for key in sorted(newest):
                r = newest[key]
                state.append((((level + 1) << 40) + at // 200, ts, level + 1, key, r[4], r[5], r[6]))
                at += 12 + len(r[5] or "")
        level += 1
    assert got == sorted(map(repr, spark.createDataFrame(state, schema).collect())) and len(got) > 10


def test_tour_stops(spark):
    edges = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1), (0, 2, 5), (1, 3, 5)]
    arcs = spark.createDataFrame(edges + [(b, a, w) for a, b, w in edges], "src long, dst long, w long")
    asked = spark.createDataFrame([(1, 0, [3, 1, 2]), (2, 0, [9]), (3, 0, [])], "query_id long, source long, mids array<long>")
    got = {r.query_id: (r.length, r.stops) for r in graphs.tours(arcs, asked).collect()}
    assert got == {1: (4, [1, 2, 3]), 2: (graphs.NO_TOUR, None), 3: (graphs.NO_TOUR, None)}


def test_search_beyond_the_broadcast(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None), (3, ""), (4, "xbcx")], "doc_id long, text string")
    needles = spark.createDataFrame([(1, "bc"), (2, "z"), (3, "x")], "item_id long, needle string")
    for limit in (0, 10):
        assert sorted((r.doc_id, r.item_id) for r in texts.search(docs, needles, limit).collect()) == [(1, 1), (4, 1), (4, 3)]


def test_gates_count_without_a_row_for_each_probe(spark):
    # Two ranges in one run, keys in no asked range, a run that is asked for nothing and a null key.
    entries = spark.createDataFrame([(1, k) for k in (3, 4, 20, 700)] + [(2, k) for k in (5, 9)] + [(3, 900)] + [(None, None)], "run long, key long")
    asked = spark.range(1, 60).withColumnRenamed("id", "key")
    ranges = {1: [*range(1, 15), *range(15, 30)], 2: range(1, 15)}
    probes = {}
    for r in sketches.probe_bits(spark.createDataFrame([(k,) for k in [*range(1, 60), 700, 900]], "key long"), 80).collect():
        probes.setdefault(r.key, set()).add(r.bit)
    held = {1: {3, 4, 20, 700}, 2: {5, 9}}
    want = []
    for run, keys in held.items():
        ones = set().union(*(probes[k] for k in keys))
        passed = [k for k in ranges[run] if probes[k] <= ones]
        want.append((run, len(passed), len([k for k in passed if k not in keys])))
    got = sketches.gate_counts(sketches.run_filters(sketches.mixed_bits(entries)), sketches.mixed_bits(asked))
    assert sorted(map(tuple, got.collect())) == want
    # The keys asked for never become rows: the join gives a row for each run and range.
    for name in ("bloom_false_positives", "bloom_run_gate"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        after = plan[: plan.index("Join")]
        assert "Generate" not in after and "hit" in after, name
