"""Neighbours, density clusters, density grid and spatial autocorrelation.

All operators take points: different (Latitude, Longitude) pairs with a weight,
as ``summary.event_points`` makes them. Search cells are cubes in space, so the
date line and the poles need no special treatment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgraph.functions.geo import EARTH_KM, haversine_km, unit_vector
from newsgraph.operators.quantiles import exact_quantiles
from newsgraph.operators.summary import rounded
from newsgraph.operators.components import connected_components
from newsgraph.session import cut_lineage

CHUNK = 4096          # points of one cell that one join key holds
LARGEST_KM = math.pi * EARTH_KM


def chord(km: float) -> float:
    """Straight-line length that belongs to a distance along the surface."""
    return 2 * EARTH_KM * math.sin(min(km, LARGEST_KM) / (2 * EARTH_KM))


def _positions(points: DataFrame) -> DataFrame:
    x, y, z = unit_vector(F.col("Latitude"), F.col("Longitude"))
    return points.withColumns({"_x": x, "_y": y, "_z": z})


def _cell(side: float) -> Column:
    return F.struct(*[F.floor(F.col(a) / side).alias(b)
                      for a, b in (("_x", "cx"), ("_y", "cy"), ("_z", "cz"))])


def _gap2(low: Column, high: Column, at: Column) -> Column:
    """Squared distance from ``at`` to the interval [low, high]."""
    return F.pow(F.greatest(low - at, at - high, F.lit(0.0)), 2)


def _offsets(n: int) -> Column:
    """All (ox, oy, oz) from -n to n, as one constant array."""
    span = f"sequence(-{n}, {n})"
    return F.expr(f"flatten(flatten(transform({span}, x -> transform({span}, y -> "
                  f"transform({span}, z -> named_struct('ox', x, 'oy', y, 'oz', z))))))")


def _reached_cells(side: float, reach: float) -> Column:
    """Cells around the row's own that touch the ball of ``reach`` around the row's point."""
    cells = F.transform(_offsets(math.ceil(reach / side)), lambda o: F.struct(
        *[(F.col("_cell")[c] + o[k]).alias(c) for c, k in (("cx", "ox"), ("cy", "oy"), ("cz", "oz"))]))

    def touches(c):
        d2 = sum((_gap2(c[k] * side, (c[k] + 1) * side, F.col(a))
                  for a, k in (("_x", "cx"), ("_y", "cy"), ("_z", "cz"))), F.lit(0.0))
        return d2 <= reach * reach * (1 + 1e-9) + 1e-12

    return F.filter(cells, touches)


def _crowded(points: DataFrame) -> DataFrame:
    """Cells with more than ``CHUNK`` points and the number of parts they are split in.

    The table has at most one row per ``CHUNK`` points.
    """
    return (points.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK)
            .select("_cell", F.ceil(F.col("n") / CHUNK).alias("_parts")))


def _near(left: DataFrame, right: DataFrame, reach: float, side: float) -> DataFrame:
    """Pairs of ``left`` and ``right`` rows whose cells lie within ``reach`` (a chord).

    Both carry ``_x, _y, _z``. Columns of ``right`` come back with the prefix
    ``o_``. A crowded cell is split in parts and the left row visits each part,
    so one join key never holds more than about ``CHUNK`` right rows.
    """
    right = right.withColumn("_cell", _cell(side))
    crowded = _crowded(right)
    parts = F.coalesce("_parts", F.lit(1))
    mark = F.pmod(F.xxhash64("Latitude", "Longitude"), parts)
    target = right.join(crowded, "_cell", "left").withColumn("_part", mark).drop("_parts")
    target = target.select(F.col("_cell").alias("_to"), "_part",
                           *[F.col(c).alias(f"o_{c}") for c in right.columns if c != "_cell"])
    visits = (left.withColumn("_cell", _cell(side))
              .withColumn("_cell", F.explode(_reached_cells(side, reach)))
              .join(crowded, "_cell", "left")
              .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
              .withColumnRenamed("_cell", "_to").drop("_parts"))
    return visits.join(target, ["_to", "_part"]).drop("_to", "_part")


def _distance(a: str = "", b: str = "o_") -> Column:
    return haversine_km(F.col(f"{a}Latitude"), F.col(f"{a}Longitude"),
                        F.col(f"{b}Latitude"), F.col(f"{b}Longitude"))


def eps_neighbours(points: DataFrame, eps_km: float) -> DataFrame:
    """Every unordered pair of different points at most ``eps_km`` apart."""
    placed = cut_lineage(_positions(points.select("Latitude", "Longitude")))
    reach = chord(eps_km)
    pairs = _near(placed, placed, reach, reach).where(
        F.struct("Latitude", "Longitude") < F.struct("o_Latitude", "o_Longitude"))
    return (pairs.withColumn("km", _distance()).where(F.col("km") <= eps_km)
            .select("Latitude", "Longitude", F.col("o_Latitude").alias("Other_Latitude"),
                    F.col("o_Longitude").alias("Other_Longitude"), "km"))


# ---- nearest neighbours ----------------------------------------------------

def k_nearest(points: DataFrame, k: int, key: list[str], include_self: bool = False,
              start_km: float = 50.0, crowd: int = 256) -> DataFrame:
    """The ``k`` nearest other points of every point, as (key, o_key, o_*, km, rank).

    The radius starts where no cell is crowded and grows fourfold for the points
    that have found fewer than ``k`` others. A point still searching had under
    ``k`` points in the smaller radius, so few such points share a cell and the
    pairs of a round stay in proportion to the points.
    """
    placed = cut_lineage(_positions(points))
    radius = start_km
    while radius > 1e-6:
        most = (placed.groupBy(_cell(chord(radius)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
                .agg(F.max("n")).first()[0])
        if most is None or most <= max(crowd, 4 * k):
            break
        radius /= 4
    order = Window.partitionBy(*key).orderBy("km", *[f"o_{c}" for c in key])
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"o_{c}"))
    searching, found = placed, []
    while True:
        last = radius >= LARGEST_KM
        reach = chord(radius)
        pairs = _near(searching, placed, reach, reach)
        if not include_self:
            pairs = pairs.where(~same)
        near = pairs.withColumn("km", _distance()).where(F.col("km") <= radius)
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = cut_lineage(near.select(
            *key, *[f"o_{c}" for c in points.columns], "km", "rank"))
        if last:
            found.append(near)
            break
        settled = near.where(F.col("rank") == k).select(*key)
        found.append(near.join(settled, key, "left_semi"))
        searching = cut_lineage(searching.join(settled, key, "left_anti"))
        if searching.isEmpty():
            break
        radius = min(radius * 4, LARGEST_KM)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def k_distance(points: DataFrame, k: int, start_km: float = 50.0) -> DataFrame:
    """Distance within which each point has ``k`` events, its own included."""
    key = ["Latitude", "Longitude"]
    near = k_nearest(points.select(*key, "n_events"), k, key, include_self=True, start_km=start_km)
    w = (Window.partitionBy(*key).orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reached = near.withColumn("events", F.sum("o_n_events").over(w))
    return (reached.where(F.col("events") >= k).groupBy(*key).agg(F.min("km").alias("k_distance_km")))


def k_distance_curve(distances: DataFrame, steps: int = 100) -> DataFrame:
    """Quantiles of the k-distances, for choosing eps."""
    shares = [i / steps for i in range(steps + 1)]
    values = exact_quantiles(distances, ["k_distance_km"], shares)["k_distance_km"] or []
    return distances.sparkSession.createDataFrame(
        list(zip(shares, values)), "share double, k_distance_km double")


# ---- density clusters ------------------------------------------------------

def dbscan(points: DataFrame, eps_km: float, min_samples: int) -> DataFrame:
    """Cluster number per point, -1 for noise, and whether it is a core point.

    Weights count: a point is core when the events within ``eps_km``, its own
    included, reach ``min_samples``. Cells are so small that points sharing one
    are neighbours. A cell with ``min_samples`` events is therefore core as a
    whole, its points need no counting and stand in the cluster graph as one node.
    A border point takes the smallest cluster number among its core neighbours.
    Clusters are numbered by their smallest core point.
    """
    reach = chord(eps_km)
    side = reach / math.sqrt(3) * (1 - 1e-9)
    key = ["Latitude", "Longitude"]
    placed = cut_lineage(
        _positions(points.select(*key, "n_events")).withColumn("_cell", _cell(side)))
    dense = (placed.groupBy("_cell").agg(F.sum("n_events").alias("events"))
             .withColumn("dense", F.col("events") >= min_samples).drop("events"))
    placed = cut_lineage(placed.join(dense, "_cell"))

    loose = placed.where(~F.col("dense")).drop("_cell", "dense")
    counted = (_near(loose.drop("n_events"), placed.drop("_cell", "dense"), reach, side)
               .where(_distance() <= eps_km)
               .groupBy(*key).agg(F.sum("o_n_events").alias("events")))
    sparse_core = counted.where(F.col("events") >= min_samples).select(
        *key, F.lit(True).alias("_counted"))
    placed = cut_lineage(
        placed.join(sparse_core, key, "left")
        .withColumn("is_core", F.col("dense") | F.coalesce("_counted", F.lit(False)))
        .drop("_counted", "dense"))

    core = placed.where("is_core")
    labels = connected_components(
        core.select(F.col("_cell").alias("id")).distinct(),
        _touching_cells(core, eps_km, side))
    first = F.min(F.struct(*key))
    clusters = (core.groupBy("_cell").agg(first.alias("p"))
                .join(labels, F.col("_cell") == F.col("id"))
                .groupBy("label").agg(F.min("p").alias("p")))
    clusters = _numbered(clusters, [F.col("p")], "cluster").select("label", "cluster")
    core_numbers = (core.join(labels, F.col("_cell") == F.col("id"))
                    .join(clusters, "label").drop("id", "label"))
    core_numbers = cut_lineage(core_numbers)

    rest = placed.where(~F.col("is_core"))
    border = (_near(rest.select(*key, "_x", "_y", "_z"),
                    core_numbers.select(*key, "_x", "_y", "_z", "cluster"), reach, side)
              .where(_distance() <= eps_km)
              .groupBy(*key).agg(F.min("o_cluster").alias("cluster")))
    out = [*key, "n_events", "is_core", "cluster"]
    rest = rest.join(border, key, "left").withColumn(
        "cluster", F.coalesce("cluster", F.lit(-1).cast("long")))
    return core_numbers.select(*out).unionByName(rest.select(*out))


def _touching_cells(core: DataFrame, eps_km: float, side: float, last_level: int = 12) -> DataFrame:
    """Pairs (a, b) of cells that hold core points at most ``eps_km`` apart.

    Pairs of cells are settled from coarse to fine. A pair of boxes is a link as
    soon as one point of each, its representative, is near enough; it is dropped
    when the boxes are too far apart; else both are cut in 4 x 4 x 4 smaller boxes. Points are
    never compared all with all, however many a cell holds.
    """
    reach = chord(eps_km)
    points = core.select("_cell", "Latitude", "Longitude", "_x", "_y", "_z")

    def boxes(level):
        size = side / 4 ** level
        return (points.groupBy("_cell", _cell(size).alias("box"))
                .agg(F.min(F.struct("Latitude", "Longitude")).alias("rep"),
                     F.count(F.lit(1)).alias("n")))

    def judged(pairs, level):
        size = side / 4 ** level
        gap2 = sum((F.pow(F.greatest(F.abs(F.col("box_a")[k] - F.col("box_b")[k]) - 1, F.lit(0)) * size, 2)
                    for k in ("cx", "cy", "cz")), F.lit(0.0))
        km = haversine_km(F.col("rep_a.Latitude"), F.col("rep_a.Longitude"),
                          F.col("rep_b.Latitude"), F.col("rep_b.Longitude"))
        return (pairs.withColumn("linked", km <= eps_km)
                .where(F.col("linked") | ((gap2 <= reach * reach * (1 + 1e-9))
                                          & (F.col("n_a") * F.col("n_b") > 1))))

    def named(df, s):
        return df.select(*[F.col(c).alias(f"{c.lstrip('_')}_{s}") for c in df.columns])

    top = boxes(0)
    steps = F.filter(_offsets(math.ceil(reach / side)), lambda o: o > F.expr(
        "named_struct('ox', 0, 'oy', 0, 'oz', 0)"))
    a = named(top, "a").withColumn("o", F.explode(steps)).withColumn("cell_b", F.struct(
        *[(F.col("cell_a")[c] + F.col("o")[k]).alias(c)
          for c, k in (("cx", "ox"), ("cy", "oy"), ("cz", "oz"))])).drop("o")
    pairs = cut_lineage(judged(a.join(named(top, "b"), "cell_b"), 0))
    links = [pairs.where("linked").select("cell_a", "cell_b")]
    level = 0
    while True:
        linked = links[-1]
        # boxes of pairs not linked yet; a pair with a link needs no more work
        unsettled = pairs.where("NOT linked").join(
            linked.distinct(), ["cell_a", "cell_b"], "left_anti")
        unsettled = cut_lineage(unsettled.select("cell_a", "box_a", "cell_b", "box_b"))
        if unsettled.isEmpty():
            break
        level += 1
        if level > last_level:
            links.append(_compare_points(unsettled, points, eps_km, side / 4 ** (level - 1)))
            break
        finer = boxes(level).withColumn("parent", F.struct(
            *[F.floor(F.col("box")[k] / 4).alias(k) for k in ("cx", "cy", "cz")]))
        for s in ("a", "b"):
            child = named(finer, s).withColumnRenamed(f"box_{s}", f"child_{s}").withColumnRenamed(
                f"parent_{s}", f"box_{s}")
            unsettled = unsettled.join(child, [f"cell_{s}", f"box_{s}"]).drop(f"box_{s}")
            unsettled = unsettled.withColumnRenamed(f"child_{s}", f"box_{s}")
        pairs = cut_lineage(judged(unsettled, level))
        links.append(pairs.where("linked").select("cell_a", "cell_b"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out.distinct().toDF("a", "b")


def _compare_points(unsettled: DataFrame, points: DataFrame, eps_km: float, size: float) -> DataFrame:
    """The last resort, in boxes of a few millimetres: point against point."""
    inner = points.withColumn("box", _cell(size)).select("_cell", "box", "Latitude", "Longitude")
    out = unsettled
    for s in ("a", "b"):
        side = inner.toDF(f"cell_{s}", f"box_{s}", f"{s}_Latitude", f"{s}_Longitude")
        out = out.join(side, [f"cell_{s}", f"box_{s}"])
    return out.where(_distance("a_", "b_") <= eps_km).select("cell_a", "cell_b")


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows numbered from 0 in ``order``, by position within range partitions."""
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = cut_lineage(df.orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_i": low}))
    sizes = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += sizes[p]
    if not starts:
        return parts.withColumn(name, F.lit(0).cast("long")).drop("_p", "_i")
    return parts.withColumn(name, F.create_map(*starts)[F.col("_p")] + F.col("_i")).drop("_p", "_i")


# ---- density grid ----------------------------------------------------------

def kde_grid(points: DataFrame, step_deg: float = 1.0, bandwidth_km: float = 200.0,
             cutoff: float = 8.6) -> DataFrame:
    """Gaussian density per grid cell centre, from points within ``cutoff`` bandwidths.

    At the default a point further away would add less than a double can hold beside 1.

    Every point adds to the cells in its reach; sums start before the shuffle.
    """
    reach = min(cutoff * bandwidth_km, LARGEST_KM)
    arc = reach / EARTH_KM
    rows, columns = round(180 / step_deg), round(360 / step_deg)
    lat, lon = F.col("Latitude"), F.col("Longitude")
    row_from = F.greatest(F.floor((lat - math.degrees(arc) + 90) / step_deg) - 1, F.lit(0))
    row_to = F.least(F.floor((lat + math.degrees(arc) + 90) / step_deg) + 1, F.lit(rows - 1))
    spread = points.select(lat, lon, "n_events", F.explode(F.sequence(row_from, row_to)).alias("row"))
    spread = spread.withColumn("Grid_Latitude", -90 + (F.col("row") + 0.5) * step_deg)
    # widest longitude difference that a distance of ``reach`` allows between the two parallels
    p, q = F.radians("Latitude"), F.radians("Grid_Latitude")
    cosine = ((math.cos(arc) - F.sin(p) * F.sin(q)) / (F.cos(p) * F.cos(q)))
    half = F.when(cosine.isNull() | F.isnan(cosine) | (cosine <= -1), F.lit(180.0)).otherwise(
        F.degrees(F.acos(F.least(cosine, F.lit(1.0)))))
    first = F.floor((lon - half + 180) / step_deg) - 1
    last = F.floor((lon + half + 180) / step_deg) + 1
    around = last - first + 1 >= columns
    spread = spread.withColumn("col", F.explode(F.sequence(
        F.when(around, F.lit(0)).otherwise(first).cast("long"),
        F.when(around, F.lit(columns - 1)).otherwise(last).cast("long"))))
    spread = spread.withColumn("col", F.pmod("col", F.lit(columns))).withColumn(
        "Grid_Longitude", -180 + (F.col("col") + 0.5) * step_deg)
    km = haversine_km(lat, lon, F.col("Grid_Latitude"), F.col("Grid_Longitude"))
    h2 = bandwidth_km ** 2
    total = points.agg(F.sum("n_events")).scalar()
    return (spread.withColumn("km", km).where(F.col("km") <= reach)
            .groupBy("Grid_Latitude", "Grid_Longitude")
            .agg(F.sum(F.col("n_events") * F.exp(-F.pow("km", F.lit(2)) / (2 * h2))).alias("s"))
            .select("Grid_Latitude", "Grid_Longitude",
                    (F.col("s") / (2 * math.pi * h2 * total)).alias("density")))


def kde_hotspots(grid: DataFrame, top: int = 10) -> DataFrame:
    return grid.orderBy(F.desc(F.round("density", 15)), "Grid_Latitude", "Grid_Longitude").limit(top)


# ---- spatial autocorrelation -----------------------------------------------

def nearest_weights(units: DataFrame, k: int = 4, name: str = "Country") -> DataFrame:
    """Row-standardised weights over the ``k`` nearest other units; equal distances go by name."""
    near = k_nearest(units.select(name, "Latitude", "Longitude"), k, [name], start_km=500.0)
    n = Window.partitionBy(name)
    return near.select(name, F.col(f"o_{name}").alias("neighbour"),
                       (1 / F.count(F.lit(1)).over(n)).alias("weight"))


def morans_permutation(units: DataFrame, weights: DataFrame, value: str, permutations: int = 99,
                       name: str = "Country", seed: int = 42) -> DataFrame:
    """Moran's I of the values as they are (perm 0) and of hash-shuffled ones (perm 1, 2, ...).

    A shuffle ranks the units by ``md5(seed:perm:unit)``; the unit at rank r in
    name order gets the value of the unit at rank r of the shuffle.
    """
    mean = units.agg(F.avg(value)).scalar()
    base = units.select(name, (F.col(value) - mean).alias("z"),
                        F.explode(F.sequence(F.lit(-1), F.lit(permutations))).alias("perm"))
    by_name = F.col("perm") < 1
    mark = F.when(by_name, F.col(name)).otherwise(
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("perm"), F.lit(":"), F.col(name))))
    ranked = base.withColumn("rank", F.row_number().over(
        Window.partitionBy("perm").orderBy(mark, name)))
    ranked = cut_lineage(ranked)
    seats = ranked.where("perm = -1").select("rank", name)
    placed = (ranked.where("perm >= 0").select("perm", "rank", "z").join(seats, "rank")
              .select("perm", name, "z"))
    lag = (placed.join(weights, name)
           .join(placed.select("perm", F.col(name).alias("neighbour"), F.col("z").alias("z_n")),
                 ["perm", "neighbour"])
           .groupBy("perm").agg(F.sum(F.col("weight") * F.col("z") * F.col("z_n")).alias("cross"),
                                F.sum("weight").alias("s0")))
    spread = placed.groupBy("perm").agg(F.sum(F.col("z") * F.col("z")).alias("ss"),
                                        F.count(F.lit(1)).alias("n"))
    return spread.join(lag, "perm").select(
        "perm", "n", (F.col("n") / F.col("s0") * F.col("cross") / F.col("ss")).alias("I"))


def morans_i(units: DataFrame, weights: DataFrame, value: str, permutations: int = 99,
             name: str = "Country", seed: int = 42) -> DataFrame:
    """I, its expectation without clustering, and a pseudo p-value from shuffled values."""
    values = cut_lineage(morans_permutation(units, weights, value, permutations, name, seed))
    seen = values.where("perm = 0").select("I").scalar()
    shuffled = F.col("perm") > 0
    larger = F.count_if(shuffled & (F.round("I", 12) >= F.round(seen, 12)))
    return values.agg(
        F.max(F.when(~shuffled, F.col("n"))).alias("n"),
        F.max(F.when(~shuffled, F.col("I"))).alias("I"),
        larger.alias("larger"),
    ).select(
        F.lit(value).alias("measure"), "n", rounded(F.col("I")).alias("I"),
        rounded(-1 / (F.col("n") - 1)).alias("expected"),
        rounded((F.least("larger", F.lit(permutations) - F.col("larger")) + 1)
                / F.lit(permutations + 1)).alias("p_sim"))
