"""Points near other points, in regions, and their nearest neighbours, complete and without a cross join.

Space is cut into the Voronoi cells of pivots (a sample of the points by their hash, about ``MAX_PIVOTS`` at most, the
only thing that travels to every task: 4 MB). A sample is dense where the points are, so dense places have small cells. A point lives in the cell of its nearest pivot p. Whatever lies within r of a point
q has its home in a cell whose pivot is at most d(q, p) + 2r away, by the triangle inequality, so q is replicated to
exactly those cells and every pair meets. Inside a cell a vantage-point tree answers in the exact metric: metres in
the plane, or great-circle metres for longitude and latitude (``metric="sphere"``).

* ``near_pairs``: pairs of ids at most r apart. Equal locations are joined once as one, however many ids share them.
* ``near_between``: the same between two sets of points.
* ``regions_of``: the polygons that a point lies strictly inside; a polygon is replicated by its bounding circle.
* ``nearest``: a first pass in the home cell bounds the distance, a second asks only the cells that can beat it.

Defined results: points without location (null, not finite, or as the caller filters) give no row; no targets give
no row; an id at several places counts at each; ties in distance go to the smallest id; repeated rows count once;
degenerate polygons contain nothing. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut
from ruamesh.functions.geo import same_srid

MAX_PIVOTS = 1 << 18
#: As many pivots are taken exactly in hash order; more by a threshold of the hash, so their number varies a little.
EXACT_PIVOTS = 4096
#: Points times edges that are compared at once.
MAX_CROSSINGS = 4_000_000
#: Points that a cell holds on average while there are few enough for the pivots.
PER_CELL = 1500
#: Ids of one place that share a slot of the pair join.
PER_SLOT = 1000
EARTH_M = 6_371_009.0
#: Slack in metres when pruning, far above rounding and far below any distance asked.
SLACK = 1e-6


def plane(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt((a[..., 0] - b[..., 0]) ** 2 + (a[..., 1] - b[..., 1]) ** 2)


def sphere(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle metres between (longitude, latitude) in degrees."""
    la, lb = np.radians(a[..., 1]), np.radians(b[..., 1])
    h = np.sin((la - lb) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(a[..., 0] - b[..., 0]) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


METRICS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"plane": plane, "sphere": sphere}


class VPTree:
    """Vantage-point tree; whole arrays of queries walk it together."""

    def __init__(self, points: np.ndarray, metric: str = "plane", leaf: int = 32) -> None:
        self.points, self.dist = points, METRICS[metric]
        self.nodes: list[tuple] = []
        stack = [(np.arange(len(points)), None, 0)]
        while stack:
            idx, parent, side = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][3 + side] = me
            d = self.dist(points[idx], points[idx[len(idx) // 2]]) if len(idx) > leaf else None
            mu = float(np.median(d)) if d is not None else 0.0
            inner = d <= mu if d is not None else None
            if inner is None or inner.all():
                self.nodes.append((idx,))
                continue
            self.nodes.append([int(idx[len(idx) // 2]), mu, float(d[~inner].min()), -1, -1])
            stack += [(idx[inner], me, 0), (idx[~inner], me, 1)]

    def within(self, queries: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, point) index pairs with distance <= radius + 1e-9."""
        out_q, out_p, stack = [], [], [(0, np.arange(len(queries)))] if len(self.points) else []
        while stack:
            k, q = stack.pop()
            if not len(q):
                continue
            node = self.nodes[k]
            if len(node) == 1:
                d = self.dist(queries[q][:, None], self.points[node[0]][None])
                a, b = np.nonzero(d <= radius[q][:, None] + 1e-9)
                out_q.append(q[a])
                out_p.append(node[0][b])
                continue
            vantage, mu, outer, left, right = node
            d = self.dist(queries[q], self.points[vantage])
            stack += [(left, q[d - radius[q] <= mu + SLACK]), (right, q[d + radius[q] >= outer - SLACK])]
        none = np.empty(0, np.int64)
        return (np.concatenate(out_q), np.concatenate(out_p)) if out_q else (none, none)

    def nearest(self, queries: np.ndarray, rank: np.ndarray | None = None, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(point, distance) for each query; -1 where nothing is within ``bound``. Ties: least ``rank``."""
        best_d = np.full(len(queries), np.inf) if bound is None else bound + SLACK
        best = np.full(len(queries), -1)
        rank = np.arange(len(self.points)) if rank is None else rank

        def visit(k: int, q: np.ndarray) -> None:
            if not len(q):
                return
            node = self.nodes[k]
            if len(node) == 1:
                d = self.dist(queries[q][:, None], self.points[node[0]][None])
                low = d.min(axis=1)
                first = np.where(d == low[:, None], rank[node[0]][None], np.iinfo(np.int64).max).argmin(axis=1)
                p = node[0][first]
                better = (low < best_d[q]) | (low == best_d[q]) & ((best[q] < 0) | (rank[p] < rank[best[q]]))
                best_d[q[better]], best[q[better]] = low[better], p[better]
                return
            vantage, mu, outer, left, right = node
            d = self.dist(queries[q], self.points[vantage])
            inside = d <= mu
            visit(left, q[inside])
            visit(right, q[~inside])
            visit(right, q[inside & (d + best_d[q] >= outer - SLACK)])
            visit(left, q[~inside & (d - best_d[q] <= mu + SLACK)])

        if len(self.points):
            visit(0, np.arange(len(queries)))
        return best, best_d


def pick_pivots(points: DataFrame) -> np.ndarray:
    """Pivots from distinct (x, y): by their hash, so the same in every run; about ``MAX_PIVOTS`` rows at most."""
    n = points.count()
    k = int(min(MAX_PIVOTS, max(1, n // PER_CELL)))
    few, h = points.select("x", "y"), F.xxhash64("x", "y")
    few = few.orderBy(h, "x", "y").limit(k) if k <= EXACT_PIVOTS else few.filter(h < F.lit(int(-(2**63) + 2**64 * (k / n))))
    return np.array([(r["x"], r["y"]) for r in few.collect()], dtype=float).reshape(-1, 2)


def _xy(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[["x", "y"]].to_numpy(dtype=float)


def _located(df: DataFrame, *extra: str) -> DataFrame:
    """Distinct rows with a finite location; -0.0 is 0.0."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & (F.abs("x") < 1e300) & (F.abs("y") < 1e300)
    return df.select(*extra, (F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y")).filter(ok).distinct()


def _to_cells(pivots: Broadcast, metric: str, guests: bool, radius: str | None = None) -> Callable:
    """Rows gain cell and home; with guests also a copy for every further cell within reach of ``radius``."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = VPTree(pivots.value, metric)
        for pdf in batches:
            at = _xy(pdf)
            home, d = tree.nearest(at)
            if guests:
                q, cell = tree.within(at, d + 2 * pdf[radius].to_numpy(dtype=float) + SLACK)
                out = pdf.iloc[q].copy()
                out["cell"], out["home"] = cell, cell == home[q]
            else:
                out = pdf.copy()
                out["cell"], out["home"] = home, True
            yield out

    return assign


def near_pairs(points: DataFrame, radius: float, metric: str = "plane") -> DataFrame:
    """(key_a, key_b): pairs of different ids at most ``radius`` apart, the smaller first. ``points``: (id, x, y)."""
    ids = cut(_located(points, F.col("id").cast("bigint").alias("id")))
    # The ids of one place are dealt to slots, so that no task gets all pairs of a place that very many share.
    places = cut(ids.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).withColumn("slots", F.ceil(F.col("n") / PER_SLOT)))
    pivots = pick_pivots(places)
    if not len(pivots):
        return ids.select(F.col("id").alias("key_a"), F.col("id").alias("key_b")).limit(0)
    pivots = points.sparkSession.sparkContext.broadcast(pivots)
    cells = places.select("x", "y", F.lit(float(radius)).alias("r")).mapInPandas(_to_cells(pivots, metric, True, "r"), "x double, y double, r double, cell int, home boolean")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        at, home = _xy(pdf), np.flatnonzero(pdf["home"].to_numpy())
        q, p = VPTree(at, metric).within(at[home], np.full(len(home), float(radius)))
        a, b = at[home[q]], at[p]
        keep = (a[:, 0] < b[:, 0]) | (a[:, 0] == b[:, 0]) & (a[:, 1] < b[:, 1])  # each pair in the home of its first place
        return pd.DataFrame({"ax": a[keep, 0], "ay": a[keep, 1], "bx": b[keep, 0], "by": b[keep, 1]})

    pairs = cells.groupBy("cell").applyInPandas(local, "ax double, ay double, bx double, by double")
    same = places.filter("n > 1").select(F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    a = ids.select(F.col("id").alias("ka"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = ids.join(places, ["x", "y"]).select(F.col("id").alias("kb"), F.col("x").alias("bx"), F.col("y").alias("by"), F.pmod(F.xxhash64("id"), "slots").alias("slot"))
    dealt = places.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot"))
    out = pairs.unionByName(same).join(dealt, ["bx", "by"]).join(a, ["ax", "ay"]).join(b, ["bx", "by", "slot"]).filter("ka < kb OR ka > kb AND (ax <> bx OR ay <> by)")
    return out.select(F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def near_between(points: DataFrame, targets: DataFrame, radius: float, metric: str = "plane") -> DataFrame:
    """(id, target, dist): targets at most ``radius`` from a point. ``points``: (id, x, y); ``targets``: (target, x, y).

    Points stay in their home cells and targets are replicated, so a point's rows arise in one cell. Both must name
    the same reference system, if any, in the metadata of x (in all joins of two sides).
    """
    same_srid(points, "x", targets, "x")
    ids = cut(_located(points, F.col("id").cast("bigint").alias("id")))
    places = cut(ids.select("x", "y").distinct())
    goals = _located(targets, F.col("target").cast("bigint").alias("target")).filter("target IS NOT NULL").withColumn("r", F.lit(float(radius)))
    pivots = pick_pivots(places)
    if not len(pivots):
        return ids.select("id", F.lit(None).cast("bigint").alias("target"), F.lit(None).cast("double").alias("dist")).limit(0)
    pivots = points.sparkSession.sparkContext.broadcast(pivots)
    homes = places.mapInPandas(_to_cells(pivots, metric, False), "x double, y double, cell int, home boolean")
    spread = goals.mapInPandas(_to_cells(pivots, metric, True, "r"), "target bigint, x double, y double, r double, cell int, home boolean")

    def local(ps: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        at, to = _xy(ps), _xy(ts)
        q, p = VPTree(to, metric).within(at, np.full(len(at), float(radius)))
        return pd.DataFrame({"x": at[q, 0], "y": at[q, 1], "target": ts["target"].to_numpy()[p], "dist": METRICS[metric](at[q], to[p])})

    hits = homes.groupBy("cell").cogroup(spread.groupBy("cell")).applyInPandas(local, "x double, y double, target bigint, dist double")
    return hits.join(ids, ["x", "y"]).groupBy("id", "target").agg(F.min("dist").alias("dist"))


def ring_edges(rings: str) -> F.Column:
    """All edges of a polygon's rings as array<struct<x1, y1, x2, y2>>; open rings are closed."""
    return F.expr(f"flatten(transform(filter({rings}, r -> size(r) > 2), r -> transform(r, (p, i) -> named_struct('x1', p.x, 'y1', p.y, 'x2', r[(i + 1) % size(r)].x, 'y2', r[(i + 1) % size(r)].y))))")


def inside(px: np.ndarray, py: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Strictly inside by the even-odd rule over edges (x1, y1, x2, y2); on an edge is not inside.

    Points go in order of y, so many at a time that points times edges stay bounded, and meet only the edges that a ray
    to the right could cross.
    """
    out, order, at = np.zeros(len(px), bool), np.argsort(py, kind="stable"), 0
    left, low, high = np.maximum(e[:, 0], e[:, 2]), np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    size = max(1, MAX_CROSSINGS // max(1, len(e)))
    while at < len(order):
        k = order[at : at + size]
        at += size
        near = e[(high >= py[k[0]]) & (low <= py[k[-1]]) & (left >= px[k].min())]
        x, y = px[k][:, None], py[k][:, None]
        x1, y1, x2, y2 = near.T
        with np.errstate(divide="ignore", invalid="ignore"):
            crosses = ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        cross = (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)
        on = (cross == 0) & (x >= np.minimum(x1, x2)) & (x <= np.maximum(x1, x2)) & (y >= np.minimum(y1, y2)) & (y <= np.maximum(y1, y2))
        out[k] = (crosses.sum(axis=1) % 2 == 1) & ~on.any(axis=1)
    return out


def regions_of(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(id, region): the regions that each point lies strictly inside.

    ``points``: (id, x, y); ``regions``: (region, rings). The even-odd rule is that of the coordinates' plane, metres
    or degrees, so cells and replication are the plane's too; holes are rings too.
    """
    same_srid(points, "x", regions, "rings")
    ids = cut(_located(points, F.col("id").cast("bigint").alias("id")))
    places = cut(ids.select("x", "y").distinct())
    pivots = pick_pivots(places)
    if not len(pivots):
        return ids.select("id", F.lit(None).cast("bigint").alias("region")).limit(0)
    pivots = points.sparkSession.sparkContext.broadcast(pivots)
    homes = places.mapInPandas(_to_cells(pivots, "plane", False), "x double, y double, cell int, home boolean")
    flat = regions.select(F.col("region").cast("bigint").alias("region"), ring_edges("rings").alias("e")).filter("size(e) > 2")
    flat = flat.withColumns({"x": F.expr("(array_min(e.x1) + array_max(e.x1)) / 2"), "y": F.expr("(array_min(e.y1) + array_max(e.y1)) / 2")})
    reach = F.expr("sqrt(array_max(transform(e, s -> (s.x1 - x) * (s.x1 - x) + (s.y1 - y) * (s.y1 - y))))")
    flat = flat.withColumn("r", reach).select("region", "x", "y", "r", *[F.expr(f"e.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]).filter("r IS NOT NULL")
    arrays = "region bigint, x double, y double, r double, x1 array<double>, y1 array<double>, x2 array<double>, y2 array<double>"
    spread = flat.mapInPandas(_to_cells(pivots, "plane", True, "r"), arrays + ", cell int, home boolean")

    def local(pts: pd.DataFrame, regs: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(pts) and len(regs):
            at = _xy(pts)
            q, p = VPTree(at, "plane").within(_xy(regs), regs["r"].to_numpy(dtype=float) + SLACK)
            order = np.argsort(q, kind="stable")
            q, p = q[order], p[order]
            for k, mine in zip(np.unique(q), np.split(p, np.flatnonzero(np.diff(q)) + 1)):
                row = regs.iloc[k]
                e = np.column_stack([np.asarray(row[c], dtype=float) for c in ("x1", "y1", "x2", "y2")])
                hit = mine[inside(at[mine, 0], at[mine, 1], e)]
                found.append(pd.DataFrame({"x": at[hit, 0], "y": at[hit, 1], "region": row["region"]}))
        return pd.concat(found) if found else pd.DataFrame({"x": pd.Series(dtype=float), "y": pd.Series(dtype=float), "region": pd.Series(dtype="int64")})

    hits = homes.groupBy("cell").cogroup(spread.groupBy("cell")).applyInPandas(local, "x double, y double, region bigint")
    return hits.join(ids, ["x", "y"]).select("id", "region").distinct()


def nearest(points: DataFrame, targets: DataFrame, metric: str = "plane") -> DataFrame:
    """(id, target, dist): the nearest target of each point. ``points``: (id, x, y); ``targets``: (target, x, y)."""
    same_srid(points, "x", targets, "x")
    ids = cut(_located(points, F.col("id").cast("bigint").alias("id")))
    goals = cut(_located(targets, F.col("target").cast("bigint").alias("target")).filter("target IS NOT NULL").groupBy("x", "y").agg(F.min("target").alias("target")))
    pivots = pick_pivots(goals)
    if not len(pivots):
        return ids.select("id", F.lit(None).cast("bigint").alias("target"), F.lit(None).cast("double").alias("dist")).limit(0)
    reach = np.zeros(len(pivots))
    pivots = points.sparkSession.sparkContext.broadcast(pivots)
    homes = cut(goals.mapInPandas(_to_cells(pivots, metric, False), "x double, y double, target bigint, cell int, home boolean"))
    # One row a pivot: how far each cell reaches from its pivot.

    def far(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["cell"].iloc[0])
        return pd.DataFrame({"cell": [k], "reach": [float(METRICS[metric](_xy(pdf), pivots.value[k]).max())]})

    for r in homes.groupBy("cell").applyInPandas(far, "cell int, reach double").collect():
        reach[r["cell"]] = r["reach"]
    reach = points.sparkSession.sparkContext.broadcast(reach)

    def local(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        bound = qs["bound"].to_numpy(dtype=float) if "bound" in qs.columns else None
        keys = ts["target"].to_numpy()
        p, d = VPTree(_xy(ts), metric).nearest(_xy(qs), keys, bound) if len(ts) else (np.full(len(qs), -1), np.zeros(len(qs)))
        ok = p >= 0
        return pd.DataFrame({"x": qs["x"][ok], "y": qs["y"][ok], "target": keys[p[ok]], "dist": d[ok]})

    found = "x double, y double, target bigint, dist double"
    places = ids.select("x", "y").distinct().mapInPandas(_to_cells(pivots, metric, False), "x double, y double, cell int, home boolean")
    first = cut(places.groupBy("cell").cogroup(homes.groupBy("cell")).applyInPandas(local, found))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = VPTree(pivots.value, metric)
        for pdf in batches:
            at, bound = _xy(pdf), pdf["dist"].to_numpy(dtype=float)
            home, d = tree.nearest(at)
            q, cell = tree.within(at, d + 2 * bound + SLACK)
            use = (cell != home[q]) & (METRICS[metric](at[q], pivots.value[cell]) - reach.value[cell] <= bound[q] + SLACK)
            q, cell = q[use], cell[use]
            yield pd.DataFrame({"x": at[q, 0], "y": at[q, 1], "bound": bound[q], "cell": cell})

    more = first.mapInPandas(again, "x double, y double, bound double, cell int")
    second = more.groupBy("cell").cogroup(homes.groupBy("cell")).applyInPandas(local, found)
    best = first.unionByName(second).groupBy("x", "y").agg(F.min(F.struct("dist", "target")).alias("b"))
    return best.join(ids, ["x", "y"]).select("id", "b.target", "b.dist")
