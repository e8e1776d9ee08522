"""Near-dedup of embeddings by collision counts over many one-dimensional projections."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import discard, stored
from cuegrid.llm.components import components

TABLES, CUTS = 48, 9
#: Width of a cut's cells and of a query's window on each side, in units of the largest distance that links. With these, two
#: random vectors collide 0.019 times in all tables together, and 1.7 of 10,000 such pairs are verified.
CELL, WINDOW = 5.0, 2.0
#: A ball's member shares its pivot's cell and bin in at least so many tables. Balls save pairs; no link depends on this.
SHARED = 4
#: Members of a ball that one part of a join holds, about.
PART = 4096
#: Allowance for rounding, in radians and in cosines.
EDGE = 1e-7
#: Least share of linked pairs at the threshold that the collision count must let through.
RECALL = 0.9995


def collision_probability(distance: float, reach: float, cuts: int = CUTS) -> float:
    """Chance that two vectors so far apart share a table's cells and lie in each other's window there."""
    t = np.linspace(0, 12, 20001)
    density = 2 * np.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    same = np.trapezoid(density * np.clip(1 - t * distance / (CELL * reach), 0, None), t)
    return float(same**cuts * math.erf(WINDOW * reach / distance / math.sqrt(2)))


def least_count(p: float, tables: int = TABLES, recall: float = RECALL) -> int:
    """The largest count that pairs with collision probability p reach with at least the recall."""
    below, k = 0.0, 0
    while True:
        below += math.comb(tables, k) * p**k * (1 - p) ** (tables - k)
        if below > 1 - recall:
            return k
        k += 1


def _projected(vectors: DataFrame, reach: float, seed: int) -> DataFrame:
    """A row for each vector and table: cell (a hash of label, length, table and cuts), bin of the window width, place on the line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                size = np.array([len(x) for x in batch.column("unit")])
                for d in np.unique(size):
                    if d not in lines:
                        rng = np.random.default_rng((seed, int(d)))
                        lines[d] = rng.standard_normal((d, TABLES * (CUTS + 1))), rng.random(TABLES * CUTS)
                    axes, shift = lines[d]
                    at = np.flatnonzero(size == d)
                    part = batch.take(pa.array(at))
                    x = np.array(part.column("unit").to_pylist(), dtype=np.float64).reshape(len(at), d)
                    y = x @ axes
                    cells = np.floor(y[:, : TABLES * CUTS] / (CELL * reach) + shift).astype(np.int64).reshape(len(at), TABLES, CUTS)
                    place = y[:, TABLES * CUTS :]
                    n = len(at) * TABLES
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(part.column("node").to_numpy(), TABLES)), pa.array(np.repeat(part.column("label_hash").to_numpy(), TABLES)),
                         pa.array(np.tile(np.arange(TABLES, dtype=np.int32), len(at))),
                         pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * CUTS), pa.array(cells.reshape(-1))), pa.array(place.reshape(-1))],
                        ["node", "label_hash", "table", "cuts", "place"],
                    )

    rows = vectors.mapInArrow(run, "node long, label_hash long, table int, cuts array<long>, place double")
    return rows.select("node", "table", F.xxhash64("label_hash", "table", "cuts").alias("cell"), F.floor(F.col("place") / (WINDOW * reach)).alias("bin"), "place")


def _given(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once and not for each element that ``then`` goes through."""
    return F.get(F.transform(F.array(value), then), 0)


def _cosine(a: str, b: str) -> Column:
    """Null for vectors of different lengths, which then link with nothing."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _balls(nodes: DataFrame, places: DataFrame, half: float) -> DataFrame:
    """nodes with their ball and the angle to its pivot: the node of least hash among those that come first in a cell's bin with this one, SHARED times, and lie within half the linking angle; else the node itself."""
    first = places.groupBy("cell", "bin").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("p")).select("cell", "bin", F.col("p.h").alias("h"), F.col("p.node").alias("pivot"))
    met = places.join(first, ["cell", "bin"]).where("node <> pivot AND h < xxhash64(node)").groupBy("node", "pivot", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED)
    pair = met.join(nodes.select("node", "unit", "label_key"), "node").join(nodes.select(F.col("node").alias("pivot"), F.col("unit").alias("pu"), F.col("label_key").alias("pl")), "pivot")
    angle = F.acos(F.least(F.lit(1.0), _cosine("unit", "pu")))
    near = pair.where("label_key = pl").select("node", "h", "pivot", angle.alias("angle")).where(F.col("angle") <= half - EDGE)
    own = near.groupBy("node").agg(F.min(F.struct("h", "pivot", "angle")).alias("b"))
    return nodes.join(own, "node", "left").select("node", "label_key", "unit", "least", "copies", F.coalesce("b.pivot", "node").alias("ball"), F.coalesce("b.angle", F.lit(0.0)).alias("angle"))


def _with_members(rows: DataFrame, key: str, balls: DataFrame, members: DataFrame) -> DataFrame:
    """rows joined with all members of the ball in ``key``, in parts of about PART members, so that a large ball is many tasks."""
    spread = rows.join(balls.select(F.col("ball").alias(key), "parts"), key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    own = members.join(balls.select("ball", "parts"), "ball").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"))
    return spread.join(own.drop("parts").withColumnRenamed("ball", key), [key, "part"]).drop("part")


def _links(members: DataFrame, balls: DataFrame, pairs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of pairs of balls (a, b): how many rows beyond its ball each node links with, (node, others), and the pairs of balls that hold a link.

    Pairs of balls whose pivots lie too far apart for any link go first. Then each member of a ball is held against the other's pivot. The pivot's angle and the ball's radius tell whether it
    links with none or with all of that ball; only where they do not it meets the ball's members.
    """
    theta = math.acos(threshold)
    pivots = members.select("node", "unit", "label_key").join(balls.select(F.col("ball").alias("node"), "radius", "rows", "alone"), "node")
    ends = pivots.select(F.col("node").alias("b"), F.col("unit").alias("pu"), F.col("label_key").alias("pl"), F.col("radius").alias("pr"))
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _cosine("unit", "pu"))))
    met = pairs.join(pivots.withColumnRenamed("node", "a"), "a").join(ends, "b").where("label_key = pl").where(apart - F.col("radius") - F.col("pr") <= theta + EDGE)
    pairs = stored(met.select("a", "b"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    own = _with_members(both, "a", balls, members.select("ball", "node", "unit", "label_key"))
    pivot = pivots.select(F.col("node").alias("b"), F.col("unit").alias("pu"), F.col("label_key").alias("pl"), "radius", "rows", "alone")
    met = own.join(pivot, "b").where("label_key = pl").withColumn("cosine", _cosine("unit", "pu")).withColumn("angle", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine")))))
    met = met.where(F.when(F.col("alone"), F.col("cosine") >= threshold).otherwise(F.col("angle") - F.col("radius") <= theta + EDGE)).withColumn("sure", F.col("alone") | (F.col("angle") + F.col("radius") <= theta - EDGE))
    met = stored(met.select("a", "b", "node", "unit", "rows", "sure"))
    doubtful = _with_members(met.where("not sure").select("a", "b", F.col("node").alias("x"), F.col("unit").alias("xu")), "b", balls, members.select("ball", "node", "unit", "copies"))
    found = stored(doubtful.where(_cosine("xu", "unit") >= threshold).groupBy("a", "b", "x").agg(F.sum("copies").alias("rows")))
    every = met.where("sure").select("a", "b", "node", "rows").unionByName(found.withColumnRenamed("x", "node"))
    return every.groupBy("node").agg(F.sum("rows").alias("others")), every.select("a", "b").distinct()


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 7) -> DataFrame:
    """(id, n_links, component_id, kept) for each row; rows are linked where labels are equal and the cosine is at least the threshold.

    Equal vectors of a label are one node with a count. In each of 48 tables the nodes are cut into coarse cells by nine
    random projections and sorted along one more. Nodes within half the linking angle of a pivot all link with each other:
    they are one ball, which is counted and needs no pairs. A pair of balls collides in a table if both have places in a
    cell that lie in each other's window on that line (balls meet through bins of the window's width: their own and the
    next). Pairs that collide in ``least_count`` tables are verified in double precision, by their pivots where these
    decide, else member by member. That count is calibrated on the collision probability of a pair exactly at the
    threshold, for a recall of 0.9995 there and more above it. The cells keep pairs that are far apart from meeting at
    all, which one-dimensional windows alone do not.

    A null label, id or vector, a zero vector and one with null or non-finite components link with nothing: 0 links,
    their own component, kept; all finite others count, however large or small. Vectors of different lengths are not compared. Repeated ids are rows of their own.
    An empty table gives none. Only the three named columns are read.
    """
    reach = math.sqrt(2 * (1 - threshold))
    need = least_count(collision_probability(reach, reach))
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label_key"), v.alias("v")))
    largest = F.array_max(F.transform("v", F.abs))
    sound = rows.where("label_key is not null and id is not null and forall(v, x -> x is not null)").where((largest > 0) & (largest < float("inf")))
    # Squares of very large or small components leave the range of doubles: these vectors are divided by their largest component.
    scaled = _given(largest, lambda m: F.when(m.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / m)))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = _given(scaled, lambda v: _given(length(v), lambda n: F.transform(v, lambda x: x / n)))
    sound = stored(sound.select("row", "id", "label_key", unit.alias("unit")))
    nodes = stored(sound.groupBy("label_key", "unit").agg(F.min("row").alias("node"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    places = stored(_projected(nodes.select("node", F.xxhash64("label_key").alias("label_hash"), "unit"), reach, seed))
    members = stored(_balls(nodes, places, math.acos(threshold) / 2))
    alone = (F.count(F.lit(1)) == 1) & (F.min("node") == F.col("ball"))
    balls = stored(members.groupBy("ball").agg(F.max("angle").alias("radius"), F.sum("copies").alias("rows"), F.min("least").alias("least"), alone.alias("alone"), F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")))
    spots = places.join(members.select("node", "ball"), "node").groupBy("cell", "bin", "table", "ball").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    spots = stored(spots)
    near = spots.select("cell", "table", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"), F.col("ball").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"), F.col("bin").alias("ba"))
    met = near.join(spots.select("cell", "bin", F.col("ball").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb")), ["cell", "bin"])
    met = met.where((F.col("a") != F.col("b")) & (F.greatest("la", "lb") - F.least("ha", "hb") <= WINDOW * reach) & ((F.col("ba") != F.col("bin")) | (F.col("a") < F.col("b"))))
    tables = F.bit_count(F.bit_or(F.expr("shiftleft(1L, table)")))
    counted = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(tables.alias("n")).where(F.col("n") >= need).select("a", "b")
    # a pivot that lies in another ball links with the members of its own
    moved = balls.join(members.select("node", F.col("ball").alias("other")), F.col("ball") == F.col("node")).where("other <> ball").select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b"))
    pairs = stored(counted.unionByName(moved).distinct())
    others, linked = _links(members, balls, pairs, threshold)
    group = stored(balls.join(components(linked), F.col("ball") == F.col("node"), "left").select("ball", "rows", "least", F.coalesce("component", "ball").alias("component")))
    least = group.groupBy("component").agg(F.min("least").alias("component_id"))
    facts = members.join(group.join(least, "component").select("ball", "rows", "component_id"), "ball").join(others, "node", "left")
    mine = facts.select("label_key", "unit", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id").where("n_links > 0")
    found = sound.select("row", "label_key", "unit").join(mine, ["label_key", "unit"]).select("row", "n_links", "component_id")
    discard(places, spots)
    component = F.coalesce("component_id", "id")
    out = rows.select("row", "id").join(found, "row", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def op7_projections(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")
