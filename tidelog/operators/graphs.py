"""Shortest paths, closed tours, spanning forests and components as iterative jobs.

Every loop joins what changed with the edges, aggregates before the shuffle, cuts the lineage
each round and ends when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.registry import query
from tidelog.sources.scratch import checkpointed, checkpointed_count
from tidelog.sources.tables import EDGES_SQL, WEIGHT_CUT, both_ways, nation_edges, table

#: The length that stands for an impossible tour.
NO_TOUR = 100_000_000


def shortest(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """src, dst, dist of all vertices that the sources (src) reach over arcs (src, dst, w)."""
    steps = arcs.select(F.col("src").alias("mid"), F.col("dst").alias("dst"), F.col("w").cast("long").alias("w"))
    best = checkpointed(sources.select("src", F.col("src").alias("dst"), F.lit(0).cast("long").alias("dist")))
    changed, n = best, 1
    while n:
        tried = changed.join(steps, changed["dst"] == steps["mid"]).groupBy("src", steps["dst"]).agg(F.min(F.col("dist") + F.col("w")).alias("new"))
        joined = best.join(tried, ["src", "dst"], "full").select("src", "dst", "dist", F.least("dist", "new").alias("least"))
        better = F.col("dist").isNull() | (F.col("least") < F.col("dist"))
        joined, n = checkpointed_count(joined, better)
        changed = joined.where(better).select("src", "dst", F.col("least").alias("dist"))
        best = joined.select("src", "dst", F.col("least").alias("dist"))
    return best


def predecessors(dist: DataFrame, arcs: DataFrame) -> DataFrame:
    """src, dst, pred: the lowest vertex before dst on a shortest path from src; null at src."""
    step = arcs.select(F.col("src").alias("pred"), F.col("dst").alias("to"), "w")
    near = dist.select("src", F.col("dst").alias("pred"), F.col("dist").alias("near"))
    tight = near.join(step, "pred").select("src", F.col("to").alias("dst"), "pred", (F.col("near") + F.col("w")).alias("dist"))
    found = tight.join(dist.where("dist > 0"), ["src", "dst", "dist"]).groupBy("src", "dst").agg(F.min("pred").alias("pred"))
    return dist.join(found, ["src", "dst"], "left").select("src", "dst", "dist", "pred")


def paths(dist: DataFrame, arcs: DataFrame) -> DataFrame:
    """src, dst, path: the vertices after src up to dst, comma-joined, by predecessors."""
    tree = checkpointed(predecessors(dist, arcs))
    open_ = checkpointed(tree.where("pred IS NOT NULL").select("src", "dst", F.col("pred").alias("at"), F.col("dst").cast("string").alias("path")))
    up = tree.select("src", F.col("dst").alias("at"), F.col("pred").alias("next"))
    done = None
    while not open_.isEmpty():
        step = checkpointed(open_.join(up, ["src", "at"]))
        ended = step.where("next IS NULL").select("src", "dst", "path")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("next IS NOT NULL").select("src", "dst", F.col("next").alias("at"), F.concat_ws(",", F.col("at").cast("string"), "path").alias("path"))
    own = tree.where("src = dst").select("src", "dst", F.lit("").alias("path"))
    return own if done is None else done.unionByName(own)


def tours(arcs: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, length, stops of the shortest closed tour from source through all mids (an array).

    Subsets of the mids grow by one vertex a round and keep their cheapest order, of equal ones the
    one that comes first: as many rows as subsets and ends, not orders. Impossible and empty tours
    have the length NO_TOUR and no stops (null).
    """
    mids = asked.select("query_id", F.posexplode("mids").alias("bit", "mid"))
    stops = asked.select(F.explode(F.array_union(F.array("source"), "mids")).alias("src")).distinct()
    dist = checkpointed(shortest(arcs, stops)).select(F.col("src").alias("a"), F.col("dst").alias("b"), "dist")
    full = F.expr("shiftleft(1L, size(mids))")
    begin = [(full - 1).alias("full"), F.col("source").alias("at"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("cost"), F.array().cast("array<bigint>").alias("stops")]
    state, open_ = checkpointed_count(asked.where(F.size("mids") > 0).select("query_id", "source", *begin), F.lit(True))
    ended = None
    while open_:
        grown = state.join(mids, "query_id").withColumn("one", F.expr("shiftleft(1L, bit)")).where("seen & one = 0")
        step = F.struct(F.expr("cost + dist").alias("cost"), F.concat("stops", F.array("mid")).alias("stops"))
        moved = grown.join(dist, (grown["at"] == dist["a"]) & (grown["mid"] == dist["b"])).groupBy("query_id", "source", "full", F.col("mid").alias("at"), F.expr("seen | one").alias("seen")).agg(F.min(step).alias("best"))
        moved, open_ = checkpointed_count(moved.select("query_id", "source", "full", "at", "seen", "best.cost", "best.stops"), F.col("seen") != F.col("full"))
        home = moved.where("seen = full").join(dist, (F.col("at") == F.col("a")) & (F.col("source") == F.col("b"))).select("query_id", F.struct(F.expr("cost + dist").alias("length"), "stops").alias("tour"))
        ended = home if ended is None else ended.unionByName(home)
        state = moved.where("seen <> full")
    none = F.lit(NO_TOUR).cast("long")
    if ended is None:
        return asked.select("query_id", none.alias("length"), F.lit(None).cast("array<bigint>").alias("stops"))
    best = ended.groupBy("query_id").agg(F.min("tour").alias("tour")).where("tour.length > 0")
    return asked.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("tour.length", none).alias("length"), "tour.stops")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex): smallest labels travel, and chains halve."""
    both = edges.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(edges.select(F.col("v").alias("a"), F.col("u").alias("b")))
    labels = checkpointed(vertices.select("vertex", F.col("vertex").alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("vertex")).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, F.col("vertex") == F.col("a"), "left").select("vertex", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        to = step.select(F.col("vertex").alias("j"), F.col("component").alias("jump"))
        step, changed = checkpointed_count(step.join(to, F.col("component") == F.col("j")).select("vertex", "old", F.col("jump").alias("component")), F.col("old") != F.col("component"))
        labels = step.select("vertex", "component")
        if not changed:
            return labels


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """u, v, w of the minimum forest under the total order (w, u, v): each round every component
    takes its least edge outwards, found by partial and final minimum, and becomes a vertex of the
    next round, so that the graphs whose components are sought halve at least."""
    chosen = None
    labels = vertices.select("vertex", F.col("vertex").alias("component"))
    while True:
        x, y = labels.select(F.col("vertex").alias("u"), F.col("component").alias("cu")), labels.select(F.col("vertex").alias("v"), F.col("component").alias("cv"))
        across = edges.join(x, "u").join(y, "v").where("cu <> cv")
        ends = across.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("w", "u", "v", "cu", "cv").alias("e"))
        least, found = checkpointed_count(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct(), F.lit(True))
        if not found:
            return chosen if chosen is not None else edges.select("u", "v", "w").where("false")
        new = least.select("u", "v", "w")
        chosen = new if chosen is None else chosen.unionByName(new)
        roots = components(labels.select(F.col("component").alias("vertex")).distinct(), least.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
        labels = checkpointed(labels.join(roots.select(F.col("vertex").alias("component"), F.col("component").alias("root")), "component").select("vertex", F.col("root").alias("component")))


def _vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("vertex"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpointed(nation_edges(spark, sf_dir).where(F.col("w") < WEIGHT_CUT))


def _squared(combine: str, rounds: int = 5) -> str:
    """CTEs d0 .. dn: the least combine over all walks of up to 2^n arcs."""
    found = ["d0 AS (SELECT src, dst, min(w) AS d FROM (SELECT src, dst, w FROM arcs UNION ALL SELECT n_nationkey::BIGINT, n_nationkey::BIGINT, 0 FROM nation) GROUP BY 1, 2)"]
    found += [f"d{k + 1} AS (SELECT a.src, b.dst, min({combine}) AS d FROM d{k} a JOIN d{k} b ON a.dst = b.src GROUP BY 1, 2)" for k in range(rounds)]
    return ", ".join(found)


_ARCS = f"{EDGES_SQL}, cut AS (SELECT * FROM edges WHERE w < {WEIGHT_CUT}), arcs AS (SELECT u AS src, v AS dst, w FROM cut UNION ALL SELECT v, u, w FROM cut)"
_DIST = f"{_ARCS}, {_squared('a.d + b.d')}, dist AS (SELECT src, dst, d::BIGINT AS dist FROM d5)"
_PRED = f"{_DIST}, pred AS (SELECT n.src, a.dst, min(a.src) AS pred FROM dist n JOIN arcs a ON n.dst = a.src JOIN dist t ON t.src = n.src AND t.dst = a.dst AND t.dist = n.dist + a.w AND t.dist > 0 GROUP BY 1, 2)"


def _every_source(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    arcs = both_ways(trades(spark, sf_dir))
    return shortest(arcs, _vertices(spark, sf_dir).select(F.col("vertex").alias("src"))), arcs


@query(f"WITH {_DIST} SELECT src, dst, dist FROM dist")
def sssp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _every_source(spark, sf_dir)[0]


@query(f"WITH {_PRED} SELECT src, dst, dist, pred FROM dist LEFT JOIN pred USING (src, dst)")
def sssp_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predecessors(*_every_source(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PRED}, walk AS (SELECT src, dst, pred AS up, dst::VARCHAR AS path FROM pred
UNION ALL SELECT w.src, w.dst, p.pred, w.up::VARCHAR || ',' || w.path FROM walk w JOIN pred p ON p.src = w.src AND p.dst = w.up)
SELECT src, dst, path FROM walk WHERE up = src UNION ALL SELECT src, dst, '' FROM dist WHERE src = dst""")
def sssp_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(*_every_source(spark, sf_dir))


@query(f"WITH {_DIST} SELECT a.n_nationkey::BIGINT AS src, count(*) - count(dist) AS unreachable FROM nation a CROSS JOIN nation b LEFT JOIN dist ON src = a.n_nationkey AND dst = b.n_nationkey GROUP BY 1")
def unreachable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dist, _ = _every_source(spark, sf_dir)
    all_ = _vertices(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return dist.groupBy("src").agg(F.count(F.lit(1)).alias("reached")).join(F.broadcast(all_)).select("src", (F.col("n") - F.col("reached")).alias("unreachable"))


TOURS_SQL = f"""{_DIST}, n AS (SELECT n_regionkey::BIGINT AS query_id, n_nationkey::BIGINT AS v, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation),
s AS (SELECT query_id, v FROM n WHERE r = 1), m AS (SELECT query_id, v FROM n WHERE r > 1),
t AS (SELECT s.query_id, nullif(d1.dist + d2.dist + d3.dist + d4.dist + d5.dist, 0) AS length, [a.v, b.v, c.v, e.v] AS stops FROM s JOIN m a USING (query_id) JOIN m b USING (query_id) JOIN m c USING (query_id) JOIN m e USING (query_id)
LEFT JOIN dist d1 ON d1.src = s.v AND d1.dst = a.v LEFT JOIN dist d2 ON d2.src = a.v AND d2.dst = b.v LEFT JOIN dist d3 ON d3.src = b.v AND d3.dst = c.v LEFT JOIN dist d4 ON d4.src = c.v AND d4.dst = e.v LEFT JOIN dist d5 ON d5.src = e.v AND d5.dst = s.v
WHERE a.v NOT IN (b.v, c.v, e.v) AND b.v NOT IN (c.v, e.v) AND c.v <> e.v)"""


def region_tours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, source, mids: a tour through all nations of each region, from its first one."""
    regions = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("query_id")).agg(F.sort_array(F.collect_set(F.col("n_nationkey").cast("long"))).alias("all"))
    return regions.select("query_id", F.get("all", F.lit(0)).alias("source"), F.slice("all", 2, F.size("all") - 1).alias("mids"))


def _solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tours(both_ways(trades(spark, sf_dir)), region_tours(spark, sf_dir))


@query(f"WITH {TOURS_SQL} SELECT query_id, coalesce(min(length), {NO_TOUR})::BIGINT AS length FROM t GROUP BY 1")
def tour_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir).select("query_id", "length")


@query(f"WITH {TOURS_SQL} SELECT query_id, array_to_string(first(stops ORDER BY length, stops) FILTER (WHERE length IS NOT NULL), ',') AS stops FROM t GROUP BY 1")
def tour_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solved(spark, sf_dir).select("query_id", F.array_join("stops", ",").alias("stops"))


@query(f"WITH {_DIST} SELECT src AS vertex, min(dst) AS component FROM dist GROUP BY 1")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(_vertices(spark, sf_dir), trades(spark, sf_dir))


_FOREST = f"""{EDGES_SQL}, ranked AS (SELECT *, row_number() OVER (ORDER BY w, u, v) AS k FROM edges), arcs AS (SELECT u AS src, v AS dst, k AS w FROM ranked UNION ALL SELECT v, u, k FROM ranked),
{_squared('greatest(a.d, b.d)')}, forest AS (SELECT u, v, w FROM ranked JOIN d5 ON src = u AND dst = v AND d = k)"""


@query(f"WITH {_FOREST} SELECT u, v, w FROM forest")
def msf_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spanning_forest(_vertices(spark, sf_dir), checkpointed(nation_edges(spark, sf_dir)))


@query(f"WITH {_FOREST} SELECT sum(w)::BIGINT AS cost, count(*) AS edges FROM forest")
def msf_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return msf_edges(spark, sf_dir).agg(F.sum("w").alias("cost"), F.count(F.lit(1)).alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    """The degree of each vertex: how many arcs its adjacency holds."""
    return both_ways(edges).groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.min("w").alias("least"))


@query(f"WITH {EDGES_SQL} SELECT src, count(*) AS degree, min(w) AS least FROM (SELECT u AS src, w FROM edges UNION ALL SELECT v, w FROM edges) GROUP BY 1")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return degrees(nation_edges(spark, sf_dir))
