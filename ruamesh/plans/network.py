"""Queries of the street-network operators on the project's tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruamesh.common import table
from ruamesh.functions import classify as C
from ruamesh.functions import geo as G
from ruamesh.operators import edges as E
from ruamesh.operators import graph as GR
from ruamesh.operators import mobility as M
from ruamesh.operators import network as N
from ruamesh.operators.spatial import near_between, nearest, regions_of
from ruamesh.plans.problems import UNITS_SQL
from ruamesh.sources.wkt import to_wkt
from ruamesh.streaming.trajectories import sessions, windowed_usage

#: A street that questions are asked of, and an area with corners on cell centres.
STREET = "tibério xandovel"
AREA = ((336000.0, 6576000.0), (375000.0, 6601575.0), (560000.0, 6610225.0), (480000.0, 6500000.0))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gdf_edges")


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gdf_nodes")


def _characterised(spark: SparkSession, sf: str, language: str = "en") -> DataFrame:
    return N.characterised(_edges(spark, sf).select("row_id", "u", "v", "highway", "name", "geometry"), _nodes(spark, sf), language)


# Oracle: the labels written down apart from the operators, and the first class of a list by plain text functions.
_FIRST = """nullif(trim(regexp_extract(translate(highway, '[]{}''"', ''), '^\\s*([^;|,/\t(:]*)', 1)), '')"""
_EN = f"CASE WHEN {_FIRST} = 'motorway' THEN 'Motorway' WHEN {_FIRST} = 'trunk' THEN 'Trunk Road' WHEN {_FIRST} = 'primary' THEN 'Arterial Road' WHEN {_FIRST} = 'secondary' THEN 'Collector Road' WHEN {_FIRST} = 'tertiary' THEN 'Local Collector' WHEN {_FIRST} = 'residential' THEN 'Residential Street' WHEN {_FIRST} = 'living_street' THEN 'Living Street' WHEN {_FIRST} = 'busway' THEN 'Bus Corridor' WHEN {_FIRST} = 'service' THEN 'Service Road' ELSE 'Other' END"
_PT = f"CASE WHEN {_FIRST} IN ('motorway', 'trunk') THEN 'Via Expressa' WHEN {_FIRST} = 'primary' THEN 'Via Arterial' WHEN {_FIRST} = 'secondary' THEN 'Via Coletora' WHEN {_FIRST} IN ('tertiary', 'residential', 'living_street') THEN 'Via Local' WHEN {_FIRST} = 'busway' THEN 'Corredor de Ônibus' WHEN {_FIRST} = 'service' THEN 'Via de Serviço' ELSE 'Other' END"
_INLINE = f"CASE WHEN {_FIRST} = 'busway' THEN 'Bus Corridor' WHEN {_FIRST} = 'motorway' THEN 'Motorway' WHEN {_FIRST} = 'trunk' THEN 'Trunk Road' WHEN {_FIRST} = 'primary' THEN 'Arterial Road' WHEN {_FIRST} = 'secondary' THEN 'Collector Road' WHEN {_FIRST} = 'secondary_link' THEN 'Collector Link' WHEN {_FIRST} = 'tertiary' THEN 'Local Collector' WHEN {_FIRST} = 'residential' THEN 'Residential Street' ELSE 'Other' END"
_LADDER = "CASE WHEN highway = 'busway' THEN 'Corredor de onibus' WHEN highway = 'primary' THEN 'Via Arterial' WHEN highway = 'secondary' THEN 'Via Coletora' WHEN highway = 'secondary_link' THEN 'Link Coletor' WHEN highway = 'tertiary' THEN 'Via Coletora Local' WHEN highway = 'residential' THEN 'Rua Residencial' ELSE 'Outro' END"
_MODE = "CASE WHEN highway = 'busway' THEN 'bus' WHEN highway IN ('primary', 'secondary', 'tertiary', 'residential') THEN 'car' WHEN highway = 'cycleway' THEN 'bike' WHEN highway = 'footway' THEN 'pedestrian' ELSE 'other' END"
_PLACES = "places AS (SELECT osmid AS node, min(x) AS x, min(y) AS y FROM gdf_nodes WHERE osmid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY osmid)"
_LINE = "list_sum(list_transform(range(2, len(g) + 1), lambda i: sqrt((g[i].x - g[i - 1].x) * (g[i].x - g[i - 1].x) + (g[i].y - g[i - 1].y) * (g[i].y - g[i - 1].y))))"
_FULL = f"""{_PLACES},
filled AS (SELECT e.* EXCLUDE (geometry), coalesce(e.geometry, CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN [{{'x': a.x, 'y': a.y}}, {{'x': b.x, 'y': b.y}}] END) AS g
  FROM gdf_edges e LEFT JOIN places a ON a.node = e.u LEFT JOIN places b ON b.node = e.v),
ch AS (SELECT row_id, u, v, highway, name, g, {_EN} AS road_type, {_MODE} AS modal,
  CAST(floor({_LINE} * 1000 + 0.5) AS BIGINT) AS length_mm FROM filled)"""


@query(f"WITH {_FULL} SELECT road_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(length_mm) AS DOUBLE) / 1e6 AS km FROM ch GROUP BY road_type")
def km_by_road_type(spark: SparkSession, sf: str) -> DataFrame:
    ch = _characterised(spark, sf)
    return ch.groupBy("road_type").agg(F.count(F.lit(1)).alias("n"), (F.sum("length_mm").cast("double") / 1e6).alias("km"))


@query(f"WITH {_FULL} SELECT {_PT} AS road_type, CAST(sum(length_mm) AS DOUBLE) / 1e6 AS km FROM ch GROUP BY 1")
def km_by_road_type_pt(spark: SparkSession, sf: str) -> DataFrame:
    return _characterised(spark, sf, "pt").groupBy("road_type").agg((F.sum("length_mm").cast("double") / 1e6).alias("km"))


@query(f"SELECT row_id, {_EN} AS en, {_PT} AS pt FROM gdf_edges")
def road_type_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("row_id", C.road_type("highway").alias("en"), C.road_type("highway", "pt").alias("pt"))


@query(f"SELECT row_id, {_LADDER} AS road_type FROM gdf_edges")
def road_type_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("row_id", C.road_type_ladder("highway").alias("road_type"))


@query(f"SELECT row_id, {_INLINE} AS road_type FROM gdf_edges")
def road_type_inline(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("row_id", C.road_type_inline("highway").alias("road_type"))


@query(f"SELECT row_id, {_FIRST} AS first_class FROM gdf_edges")
def first_class(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("row_id", F.nullif(C.first_class("highway"), F.lit("")).alias("first_class"))


@query(f"SELECT row_id, {_MODE} AS modal FROM gdf_edges")
def modal_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).select("row_id", C.modal("highway").alias("modal"))


@query(f"SELECT {_EN} AS road_type, count(*) AS n FROM gdf_edges GROUP BY 1")
def road_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    return N.counts(_edges(spark, sf).select(C.road_type("highway").alias("road_type")), "road_type")


@query(f"SELECT {_MODE} AS modal, count(*) AS n FROM gdf_edges GROUP BY 1")
def modal_counts(spark: SparkSession, sf: str) -> DataFrame:
    return N.counts(_edges(spark, sf).select(C.modal("highway").alias("modal")), "modal")


@query("SELECT highway, count(*) AS n FROM gdf_edges WHERE highway IS NOT NULL GROUP BY 1")
def highway_counts(spark: SparkSession, sf: str) -> DataFrame:
    return N.counts(_edges(spark, sf), "highway")


@query(f"SELECT name, string_agg(DISTINCT m, ';' ORDER BY m) AS items FROM (SELECT name, {_MODE} AS m FROM gdf_edges) WHERE name IS NOT NULL GROUP BY name")
def modes_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return N.distinct_lists(_edges(spark, sf).select("name", C.modal("highway").alias("m")), "name", "m")


@query(f"SELECT name, string_agg(DISTINCT m, ';' ORDER BY m) AS items FROM (SELECT name, {_EN} AS m FROM gdf_edges) WHERE name IS NOT NULL GROUP BY name")
def types_by_name(spark: SparkSession, sf: str) -> DataFrame:
    return N.distinct_lists(_edges(spark, sf).select("name", C.road_type("highway").alias("m")), "name", "m")


@query(f"SELECT row_id, CASE WHEN contains(lower(name), '{STREET}') THEN 'Avenida Marechal Tibério Xandovel' ELSE name END AS name, coalesce(contains(lower(name), '{STREET}'), false) AS changed FROM gdf_edges")
def name_contains_update(spark: SparkSession, sf: str) -> DataFrame:
    hit = C.contains("name", STREET)
    return _edges(spark, sf).select("row_id", F.when(hit, F.lit("Avenida Marechal Tibério Xandovel")).otherwise(F.col("name")).alias("name"), hit.alias("changed"))


@query(f"WITH {_FULL} SELECT row_id, length_mm FROM ch WHERE length_mm IS NOT NULL AND road_type = 'Arterial Road' ORDER BY length_mm DESC, row_id LIMIT 5")
def top5_longest(spark: SparkSession, sf: str) -> DataFrame:
    return N.top_longest(_characterised(spark, sf).filter("road_type = 'Arterial Road'")).select("row_id", "length_mm")


@query(f"WITH {_FULL} SELECT row_id, length_mm FROM ch")
def edge_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _characterised(spark, sf).select("row_id", "length_mm")


@query(f"WITH {_FULL} SELECT (SELECT count(*) FROM places) AS nodes, count(*) AS edges, CAST(sum(length_mm) AS DOUBLE) / 1e6 AS km FROM ch")
def network_totals(spark: SparkSession, sf: str) -> DataFrame:
    edges = _characterised(spark, sf).agg(F.count(F.lit(1)).alias("edges"), (F.sum("length_mm").cast("double") / 1e6).alias("km"))
    nodes = N.places(_nodes(spark, sf)).agg(F.count(F.lit(1)).alias("nodes"))
    return nodes.join(edges).select("nodes", "edges", "km")  # one row each


_RINGS = """s AS (SELECT CODIGO, ring, k, unnest(range(1, len(ring))) AS i FROM (SELECT CODIGO, unnest(geometry) AS ring, unnest(range(len(geometry))) AS k FROM bairros)),
e AS (SELECT CODIGO, k, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2, ring[1].x AS x0, ring[1].y AS y0 FROM s),
area AS (SELECT CODIGO, sum(CASE WHEN k = 0 THEN a ELSE -a END) AS m2 FROM (SELECT CODIGO, k, abs(sum((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0))) / 2 AS a FROM e GROUP BY CODIGO, k) GROUP BY CODIGO)"""


@query(f"""WITH {_PLACES}, {_RINGS}, box AS (SELECT CODIGO, min(least(x1, x2)) AS xa, max(greatest(x1, x2)) AS xb, min(least(y1, y2)) AS ya, max(greatest(y1, y2)) AS yb FROM e GROUP BY CODIGO),
c AS (SELECT p.*, CODIGO FROM places p JOIN box ON p.x BETWEEN xa AND xb AND p.y BETWEEN ya AND yb),
hit AS (SELECT c.node, c.CODIGO FROM c JOIN e USING (CODIGO) GROUP BY c.node, c.CODIGO HAVING sum(CASE WHEN (y1 > c.y) <> (y2 > c.y) AND c.x < (x2 - x1) * (c.y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1),
n AS (SELECT CODIGO, count(*) AS n FROM hit GROUP BY CODIGO)
SELECT CAST(CODIGO AS BIGINT) AS codigo, coalesce(n, 0) AS nodes, round(coalesce(n, 0) / (m2 / 1e6), 6) AS nodes_km2 FROM area LEFT JOIN n USING (CODIGO) WHERE m2 > 0""")
def node_density(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of each district over the district's own area."""
    b = table(spark, sf, "bairros").select(F.col("CODIGO").cast("bigint").alias("region"), F.col("geometry").alias("rings"))
    inside = regions_of(N.places(_nodes(spark, sf)).withColumnRenamed("node", "id"), b).groupBy("region").agg(F.count(F.lit(1)).alias("nodes"))
    d = b.select("region", (G.polygon_area("rings") / 1e6).alias("km2")).join(inside, "region", "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
    return d.filter("km2 > 0").select(F.col("region").alias("codigo"), "nodes", F.round(F.col("nodes") / F.col("km2"), 6).alias("nodes_km2"))


@query("SELECT fid, load_id, POP FROM grid WHERE POP > 0")
def origins_populated(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "grid").filter("POP > 0").select("fid", "load_id", "POP")


_RING = "list_sum(list_transform(range(1, len({r}) + 1), lambda i: {t}))"


def _ring_sql(r: str, t: str) -> str:
    p, q, o = f"{r}[i]", f"{r}[i % len({r}) + 1]", f"{r}[1]"
    cross = f"(({p}.x - {o}.x) * ({q}.y - {o}.y) - ({q}.x - {o}.x) * ({p}.y - {o}.y))"
    return _RING.format(r=r, t={"a": cross, "x": f"({p}.x + {q}.x - 2 * {o}.x) * {cross}", "y": f"({p}.y + {q}.y - 2 * {o}.y) * {cross}"}[t])


@query(f"SELECT fid AS origin_id, POP, round(geometry[1].x + {_ring_sql('geometry', 'x')} / (3 * {_ring_sql('geometry', 'a')}), 3) AS x, round(geometry[1].y + {_ring_sql('geometry', 'y')} / (3 * {_ring_sql('geometry', 'a')}), 3) AS y FROM grid WHERE POP > 0")
def origin_centroids(spark: SparkSession, sf: str) -> DataFrame:
    return N.populated_origins(table(spark, sf, "grid")).select("origin_id", "POP", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"SELECT CAST(CODIGO AS BIGINT) AS codigo, CAST(floor(list_sum(list_transform(range(1, len(geometry) + 1), lambda k: (CASE WHEN k = 1 THEN 1 ELSE -1 END) * abs(list_sum(list_transform(range(1, len(geometry[k]) + 1), lambda i: (geometry[k][i].x - geometry[k][1].x) * (geometry[k][i % len(geometry[k]) + 1].y - geometry[k][1].y) - (geometry[k][i % len(geometry[k]) + 1].x - geometry[k][1].x) * (geometry[k][i].y - geometry[k][1].y)))) / 2)) + 0.5) AS BIGINT) AS m2 FROM bairros")
def district_area(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bairros").select(F.col("CODIGO").cast("bigint").alias("codigo"), F.floor(G.polygon_area("geometry") + 0.5).alias("m2"))


@query("SELECT min(p.x) AS minx, min(p.y) AS miny, max(p.x) AS maxx, max(p.y) AS maxy FROM (SELECT unnest(geometry) AS p FROM grid)")
def total_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return G.total_bounds(table(spark, sf, "grid"), "geometry")


_ORIGINS = "o AS (SELECT DISTINCT origin_id, geometry.x AS x, geometry.y AS y FROM origins WHERE geometry IS NOT NULL AND NOT (geometry.x = 0 AND geometry.y = 0))"
_SEGMENTS = "(VALUES " + ", ".join(f"({a[0]}, {a[1]}, {b[0]}, {b[1]})" for a, b in zip(AREA, AREA[1:] + AREA[:1])) + ") AS s(x1, y1, x2, y2)"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "origins").select("origin_id", F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"))
    return o.filter("x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0)").distinct()


@query(f"""WITH {_ORIGINS} SELECT o.origin_id FROM o, {_SEGMENTS} GROUP BY o.origin_id, o.x, o.y
HAVING sum(CASE WHEN (y1 > o.y) <> (y2 > o.y) AND o.x < (x2 - x1) * (o.y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1
AND sum(CASE WHEN (x2 - x1) * (o.y - y1) - (y2 - y1) * (o.x - x1) = 0 AND o.x BETWEEN least(x1, x2) AND greatest(x1, x2) AND o.y BETWEEN least(y1, y2) AND greatest(y1, y2) THEN 1 ELSE 0 END) = 0""")
def points_in_area(spark: SparkSession, sf: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in AREA])
    return _points(spark, sf).withColumn("rings", F.array(ring)).filter(G.within("x", "y", "rings")).select("origin_id")


@query("""WITH o AS (SELECT DISTINCT origin_id, geometry.x AS x, geometry.y AS y FROM origins WHERE geometry IS NOT NULL AND NOT (geometry.x = 0 AND geometry.y = 0)),
r AS (SELECT CODIGO, unnest(geometry) AS ring FROM bairros),
s AS (SELECT CODIGO, ring, unnest(range(1, len(ring))) AS i FROM r),
e AS (SELECT CODIGO, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM s),
b AS (SELECT CODIGO, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS xx, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS yy FROM e GROUP BY CODIGO),
c AS (SELECT o.*, b.CODIGO FROM o JOIN b ON o.x BETWEEN b.x0 AND b.xx AND o.y BETWEEN b.y0 AND b.yy)
SELECT c.origin_id, CAST(c.CODIGO AS BIGINT) AS codigo FROM c JOIN e ON e.CODIGO = c.CODIGO GROUP BY c.origin_id, c.CODIGO, c.x, c.y
HAVING sum(CASE WHEN (y1 > c.y) <> (y2 > c.y) AND c.x < (x2 - x1) * (c.y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1""")
def points_in_district(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "bairros").select(F.col("CODIGO").alias("region"), F.col("geometry").alias("rings"))
    return regions_of(_points(spark, sf).withColumnRenamed("origin_id", "id"), b).select(F.col("id").alias("origin_id"), F.col("region").alias("codigo"))


@query(f"WITH {_ORIGINS}, {_PLACES} SELECT o.origin_id, arg_min(p.node, ((o.x - p.x) * (o.x - p.x) + (o.y - p.y) * (o.y - p.y), p.node)) AS node FROM o, places p GROUP BY o.origin_id, o.x, o.y")
def nearest_node(spark: SparkSession, sf: str) -> DataFrame:
    nodes = N.places(_nodes(spark, sf)).withColumnRenamed("node", "target")
    return nearest(_points(spark, sf).withColumnRenamed("origin_id", "id"), nodes).select(F.col("id").alias("origin_id"), F.col("target").alias("node"))


@query(f"WITH {_PLACES}, e AS (SELECT u AS node FROM gdf_edges UNION ALL SELECT v FROM gdf_edges), d AS (SELECT node, count(*) AS degree FROM e GROUP BY node) SELECT p.node, coalesce(d.degree, 0) AS degree FROM places p LEFT JOIN d USING (node)")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return GR.degree(N.places(_nodes(spark, sf)), _edges(spark, sf))


@query(f"WITH {_PLACES}, e AS (SELECT u AS node FROM gdf_edges UNION ALL SELECT v FROM gdf_edges), d AS (SELECT node, count(*) AS degree FROM e GROUP BY node) SELECT round(avg(coalesce(d.degree, 0)), 6) AS mean_degree FROM places p LEFT JOIN d USING (node)")
def mean_degree(spark: SparkSession, sf: str) -> DataFrame:
    return degree(spark, sf).agg(F.round(F.avg("degree"), 6).alias("mean_degree"))


_WCC = f"""{_PLACES}, both_ways AS (SELECT u AS a, v AS b FROM gdf_edges UNION SELECT v, u FROM gdf_edges),
reach AS (SELECT node, node AS label FROM places UNION SELECT e.b, r.label FROM reach r JOIN both_ways e ON e.a = r.node),
labels AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
sizes AS (SELECT label, count(*) AS n FROM labels GROUP BY label),
ranked AS (SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) - 1 AS BIGINT) AS componente FROM sizes)"""


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return GR.components(N.places(_nodes(spark, sf)), _edges(spark, sf))


@query(f"WITH RECURSIVE {_WCC} SELECT node, componente FROM labels JOIN ranked USING (label)")
def weak_components(spark: SparkSession, sf: str) -> DataFrame:
    return GR.component_index(_labels(spark, sf))


@query(f"WITH RECURSIVE {_WCC} SELECT componente, n FROM ranked")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return weak_components(spark, sf).groupBy("componente").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH RECURSIVE {_WCC}, oo AS (SELECT DISTINCT origin_id, node FROM origins) SELECT oo.origin_id, oo.node, r.componente FROM oo LEFT JOIN labels l ON l.node = oo.node LEFT JOIN ranked r ON r.label = l.label")
def origin_component(spark: SparkSession, sf: str) -> DataFrame:
    origins = table(spark, sf, "origins").select("origin_id", "node").distinct()
    return origins.join(weak_components(spark, sf), "node", "left").select("origin_id", "node", "componente")


@query("SELECT flag, count(*) AS n FROM (SELECT node IS NOT NULL AND node IN (SELECT osmid FROM gdf_nodes WHERE osmid IS NOT NULL) AS flag FROM origins) GROUP BY flag")
def node_membership(spark: SparkSession, sf: str) -> DataFrame:
    known = _nodes(spark, sf).select(F.col("osmid").alias("node"), F.lit(True).alias("flag")).filter("node IS NOT NULL").distinct()
    return table(spark, sf, "origins").select("node").join(known, "node", "left").groupBy(F.coalesce("flag", F.lit(False)).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT CAST(componente AS BIGINT) AS componente FROM origins")
def distinct_components(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "origins").select(F.col("componente").cast("bigint").alias("componente")).distinct()


def _arcs_sql(weight: str) -> str:
    """Oracle: arcs between nodes with their least weight."""
    return f"""{_FULL}, street AS (SELECT c.u, c.v, {weight} AS w, coalesce(e.oneway, false) AS oneway FROM ch c JOIN gdf_edges e USING (row_id) WHERE c.u <> c.v AND c.length_mm IS NOT NULL),
arc AS (SELECT u, v, greatest(min(w), 1) AS w FROM (SELECT u, v, w FROM street UNION ALL SELECT v, u, w FROM street WHERE NOT oneway) GROUP BY u, v)"""


# Oracle: distances from the nodes of sources, relaxed until none shrinks.
_DIST = """dist(s, n, d) USING KEY (s, n) AS (
  SELECT node, node, CAST(0 AS BIGINT) FROM sources
  UNION
  SELECT x.s, arc.v, CAST(min(x.d + arc.w) AS BIGINT) FROM dist x JOIN arc ON arc.u = x.n LEFT JOIN recurring.dist o ON o.s = x.s AND o.n = arc.v WHERE o.d IS NULL OR x.d + arc.w < o.d GROUP BY x.s, arc.v)"""
# Oracle: numbers of shortest paths, hop by hop.
_SIGMA = f"""sources AS (SELECT u AS node FROM arc UNION SELECT v FROM arc), {_DIST},
short AS (SELECT a.s, arc.u, arc.v FROM dist a JOIN arc ON arc.u = a.n JOIN dist b ON b.s = a.s AND b.n = arc.v WHERE a.d + arc.w = b.d),
hop AS (SELECT node AS s, node AS n, CAST(1 AS DOUBLE) AS c FROM sources UNION ALL SELECT hop.s, short.v, sum(hop.c) FROM hop JOIN short ON short.s = hop.s AND short.u = hop.n GROUP BY hop.s, short.v),
sigma AS (SELECT s, n, d, sum(c) AS c FROM hop JOIN dist USING (s, n) GROUP BY s, n, d),
size AS (SELECT count(*) AS n FROM places)"""
_OD = """begin_at AS (SELECT origin_id, max(node) AS source FROM origins WHERE origin_id IS NOT NULL AND node IS NOT NULL GROUP BY origin_id),
od AS (SELECT DISTINCT pair_id, source, dest_node AS target FROM od_pairs JOIN begin_at USING (origin_id)), sources AS (SELECT DISTINCT source AS node FROM od)"""
_MM, _BUS_DEAR = "c.length_mm", "CASE WHEN c.modal = 'bus' THEN CAST(floor(c.length_mm * 1.5) AS BIGINT) ELSE c.length_mm END"
_ROUTES = "SELECT pair_id, source, target, d AS dist FROM od JOIN dist ON s = source AND n = target"


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    """(u, v, w) in millimetres; a street that is not known to be one-way goes both ways."""
    e = N.characterised(_edges(spark, sf).select("u", "v", "highway", "geometry", "oneway"), _nodes(spark, sf)).select("u", "v", F.col("length_mm").alias("w"), "oneway")
    return e.select("u", "v", "w").unionByName(e.filter("NOT coalesce(oneway, false)").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))


@query(f"""WITH RECURSIVE {_arcs_sql(_MM)}, {_SIGMA}, part AS (SELECT x.n AS node, sum(x.c * y.c / z.c) AS flow FROM sigma x JOIN sigma y ON y.s = x.n JOIN sigma z ON z.s = x.s AND z.n = y.n WHERE x.d + y.d = z.d AND x.s <> x.n AND y.n <> x.n GROUP BY x.n)
SELECT p.node, round(coalesce(flow, 0) / greatest(1, (n - 1) * (n - 2)), 12) AS betweenness FROM places p CROSS JOIN size LEFT JOIN part USING (node)""")
def betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return GR.centralities(N.places(_nodes(spark, sf)), _weighted(spark, sf)).select("node", F.round("betweenness", 12).alias("betweenness"))


@query(f"""WITH RECURSIVE {_arcs_sql(_MM)}, sources AS (SELECT u AS node FROM arc UNION SELECT v FROM arc), {_DIST}, t AS (SELECT n AS node, sum(d) AS far, count(*) AS reached FROM dist WHERE s <> n GROUP BY n)
SELECT p.node, round(coalesce(reached / CAST(far AS DOUBLE) * reached / greatest(1, (SELECT count(*) FROM places) - 1), 0.0), 15) AS closeness FROM places p LEFT JOIN t USING (node)""")
def closeness(spark: SparkSession, sf: str) -> DataFrame:
    return GR.closeness(N.places(_nodes(spark, sf)), _weighted(spark, sf)).select("node", F.round("closeness", 15).alias("closeness"))


@query(f"""WITH RECURSIVE {_arcs_sql(_MM)}, {_SIGMA}, part AS (SELECT arc.u, arc.v, sum(x.c * y.c / z.c) AS flow FROM sigma x JOIN arc ON arc.u = x.n JOIN sigma y ON y.s = arc.v JOIN sigma z ON z.s = x.s AND z.n = y.n WHERE x.d + arc.w + y.d = z.d GROUP BY arc.u, arc.v)
SELECT arc.u, arc.v, round(coalesce(flow, 0) / greatest(1, n * (n - 1)), 12) AS betweenness FROM arc CROSS JOIN size LEFT JOIN part USING (u, v)""")
def edge_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    return GR.edge_betweenness(N.places(_nodes(spark, sf)), _weighted(spark, sf)).select("u", "v", F.round("betweenness", 12).alias("betweenness"))


def _od(spark: SparkSession, sf: str) -> DataFrame:
    at = table(spark, sf, "origins").filter("origin_id IS NOT NULL AND node IS NOT NULL").groupBy("origin_id").agg(F.max("node").alias("source"))
    od = table(spark, sf, "od_pairs").select("pair_id", "origin_id", F.col("dest_node").alias("target")).distinct()
    return od.join(at, "origin_id").select("pair_id", "source", "target")


@query(f"WITH RECURSIVE {_arcs_sql(_MM)}, {_OD}, {_DIST} {_ROUTES}")
def od_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Network distance of every od pair that is connected, in millimetres."""
    od = _od(spark, sf)
    return od.join(GR.shortest_paths(_weighted(spark, sf), od), ["source", "target"]).select("pair_id", "source", "target", "dist")


@query(f"WITH RECURSIVE {_arcs_sql(_BUS_DEAR)}, {_OD}, {_DIST} {_ROUTES}")
def od_second_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Distance of every od pair where bus corridors cost half as much again: a second choice of route."""
    e = N.characterised(_edges(spark, sf).select("u", "v", "highway", "geometry", "oneway"), _nodes(spark, sf))
    w = F.when(F.col("modal") == "bus", F.floor(F.col("length_mm") * 1.5)).otherwise(F.col("length_mm"))
    e = e.select("u", "v", w.alias("w"), "oneway")
    e = e.select("u", "v", "w").unionByName(e.filter("NOT coalesce(oneway, false)").select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    od = _od(spark, sf)
    return od.join(GR.shortest_paths(e, od), ["source", "target"]).select("pair_id", "source", "target", "dist")


@query(f"""WITH RECURSIVE {_arcs_sql(_MM)}, {_OD}, {_DIST}, got AS ({_ROUTES})
SELECT pair_id, round(dist / 1000 / nullif(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 0), 6) AS detour FROM got JOIN places a ON a.node = source JOIN places b ON b.node = target""")
def od_detours(spark: SparkSession, sf: str) -> DataFrame:
    """Network distance over the straight line, for connected od pairs."""
    at = N.places(_nodes(spark, sf))
    a, b = at.toDF("source", "x1", "y1"), at.toDF("target", "x2", "y2")
    got = od_routes(spark, sf).join(a, "source").join(b, "target")
    straight = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return got.select("pair_id", F.round(M.detour(F.col("dist") / 1000, straight), 6).alias("detour"))


@query("SELECT DISTINCT pair_id, origin_id, dest_node, dist_m FROM od_pairs WHERE dist_m <= 30000")
def od_within_cap(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "od_pairs").filter("dist_m <= 30000").select("pair_id", "origin_id", "dest_node", "dist_m").distinct()


@query(f"""WITH {_ORIGINS}, t AS (SELECT osmid AS node, min(x) AS x, min(y) AS y FROM gdf_nodes WHERE highway = 'traffic_signals' AND osmid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY osmid)
SELECT o.origin_id, t.node, round(min(sqrt((o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y))), 3) AS dist_m FROM o JOIN t ON t.x BETWEEN o.x - 500.001 AND o.x + 500.001 AND t.y BETWEEN o.y - 500.001 AND o.y + 500.001
WHERE sqrt((o.x - t.x) * (o.x - t.x) + (o.y - t.y) * (o.y - t.y)) <= 500 + 1e-9 GROUP BY ALL""")
def od_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Destinations of one category (signals) within the buffer of 500 m of each origin."""
    signals = N.places(_nodes(spark, sf).filter("highway = 'traffic_signals'")).withColumnRenamed("node", "target")
    got = near_between(_points(spark, sf).withColumnRenamed("origin_id", "id"), signals, 500.0)
    return got.select(F.col("id").alias("origin_id"), F.col("target").alias("node"), F.round("dist", 3).alias("dist_m"))


def _entropy_sql(group: str, item: str, rows: str) -> str:
    return f"WITH c AS (SELECT {group}, {item}, count(*) AS n FROM {rows} WHERE {group} IS NOT NULL AND {item} IS NOT NULL GROUP BY 1, 2) SELECT {group}, round(greatest(log2(sum(n)) - sum(n * log2(n)) / sum(n), 0), 6) + 0.0 AS entropy, CAST(sum(n) AS BIGINT) AS visits FROM c GROUP BY {group}"


@query(_entropy_sql("user_id", "event_type", "events"))
def trajectory_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return M.entropy(table(spark, sf, "events"), "user_id", "event_type").withColumn("entropy", F.round("entropy", 6))


@query(_entropy_sql("origin_id", "dest_node", "(SELECT DISTINCT * FROM od_pairs)"))
def destination_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return M.entropy(table(spark, sf, "od_pairs").distinct(), "origin_id", "dest_node").withColumn("entropy", F.round("entropy", 6))


@query(_entropy_sql("name", "modal", f"(SELECT name, {_MODE} AS modal FROM gdf_edges)"))
def modal_diversity(spark: SparkSession, sf: str) -> DataFrame:
    return M.entropy(_edges(spark, sf).select("name", C.modal("highway").alias("modal")), "name", "modal").withColumn("entropy", F.round("entropy", 6))


@query("SELECT dest_node, count(DISTINCT origin_id) AS trajectories, count(*) AS visits FROM od_pairs WHERE dest_node IS NOT NULL AND origin_id IS NOT NULL GROUP BY 1")
def segment_usage(spark: SparkSession, sf: str) -> DataFrame:
    return M.segment_usage(table(spark, sf, "od_pairs"), "origin_id", "dest_node")


@query("WITH d AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) SELECT user_id, CAST(sum(CASE WHEN b IS NULL OR b <> event_type THEN 1 ELSE 0 END) AS BIGINT) AS fragments, count(*) AS steps FROM d GROUP BY user_id")
def trajectory_fragments(spark: SparkSession, sf: str) -> DataFrame:
    return M.fragments(table(spark, sf, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("SELECT event_type, date_trunc('hour', ts) AS period, count(DISTINCT user_id) AS present, CAST(count(DISTINCT user_id) * (count(DISTINCT user_id) - 1) / 2 AS BIGINT) AS pairs FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY 1, 2")
def co_presence(spark: SparkSession, sf: str) -> DataFrame:
    return M.co_presence(table(spark, sf, "events"), "event_type", "user_id", "ts")


@query("SELECT date_trunc('month', created_at) AS period, count(*) AS n, count(DISTINCT origin_id) AS origins FROM od_pairs WHERE created_at IS NOT NULL GROUP BY 1")
def od_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return M.per_period(table(spark, sf, "od_pairs"), "created_at", "month", F.count(F.lit(1)).alias("n"), F.count_distinct("origin_id").alias("origins"))


@query(f"WITH {_FULL}, {UNITS_SQL}, head AS (SELECT row_id, arg_min(si, pos) AS kmh FROM speed WHERE si > 0 GROUP BY row_id) SELECT ch.row_id, round(length_mm / 1000 / (kmh / 3.6), 6) AS seconds FROM ch JOIN head USING (row_id)")
def travel_times(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds along each edge at the first of its speeds, taken in km/h from ``edges.measured``; no row without a positive speed."""
    edges = _edges(spark, sf).select("row_id", "highway", "maxspeed", "note", "source", "loaded_at", "geometry")
    speed = E.speeds(E.measured(edges, table(spark, sf, "fontes")))
    first = speed.filter("si > 0").groupBy("row_id").agg(F.min_by("si", "pos").alias("kmh"))
    e = _characterised(spark, sf).join(first, "row_id")
    return e.select("row_id", F.round(M.travel_seconds(F.col("length_mm") / 1000, F.col("kmh")), 6).alias("seconds"))


@query("SELECT DISTINCT CODIGO AS codigo, NOME || ', Porto Alegre' AS place FROM bairros")
def district_places(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bairros").select(F.col("CODIGO").alias("codigo"), F.concat("NOME", F.lit(", Porto Alegre")).alias("place")).distinct()


@query(f"WITH {_PLACES}, both_ways AS (SELECT DISTINCT least(u, v) AS a, greatest(u, v) AS b FROM gdf_edges WHERE u <> v), near AS (SELECT a, b FROM both_ways UNION ALL SELECT b, a FROM both_ways) SELECT a AS node, count(*) AS neighbours, min(b) AS low, max(b) AS high FROM near GROUP BY a HAVING count(*) = 2")
def pass_through_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return N.contracted(_edges(spark, sf), _nodes(spark, sf))


def _lonlat_sql(x: str, y: str, of: str, keep: str, g: G.TransverseMercator = G.UTM_22S) -> str:
    """Oracle: degrees of grid metres by the inverse series, step by step."""
    r = g.k0 * G._RECT
    a = " ".join(f"- {b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(G._BETA, 1))
    b_ = " ".join(f"- {b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(G._BETA, 1))
    lat = " ".join(f"+ {d!r} * sin({2 * j} * chi)" for j, d in enumerate(G._DELTA, 1))
    return f"""(SELECT {keep}, {g.lon0!r} + degrees(atan2(sinh(b), cos(a))) AS lon, degrees(chi {lat}) AS lat FROM (SELECT *, asin(sin(a) / cosh(b)) AS chi FROM (SELECT *, xi {a} AS a, eta {b_} AS b
  FROM (SELECT *, ({y} - {g.northing!r}) / {r!r} AS xi, ({x} - {g.easting!r}) / {r!r} AS eta FROM {of}))))"""


@query(f"WITH {_PLACES} SELECT node, round(lon, 9) AS lon, round(lat, 9) AS lat, round(x, 3) AS x, round(y, 3) AS y FROM {_lonlat_sql('x', 'y', 'places', 'node, x, y')}")
def node_lonlat(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes in degrees and projected back."""
    at = N.places(_nodes(spark, sf))
    lon, lat = G.unproject("x", "y")
    both = at.withColumns({"lon": lon, "lat": lat})
    x, y = G.project("lon", "lat")
    return both.select("node", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query(f"""WITH {_FULL}, p AS (SELECT row_id, unnest(range(1, len(g) + 1)) AS pos, unnest(g) AS p FROM filled)
SELECT row_id, CAST(pos AS BIGINT) AS pos, round(lon, 8) AS lon, round(lat, 8) AS lat FROM {_lonlat_sql("p.x", "p.y", "p", "row_id, pos")}""")
def edge_lonlat(spark: SparkSession, sf: str) -> DataFrame:
    """The points of every edge's geometry in degrees: the whole table reprojected."""
    e = N.filled_edges(_edges(spark, sf).select("row_id", "u", "v", "geometry"), _nodes(spark, sf))
    points = G.to_crs(e, "geometry", 31982, 4674).select("row_id", F.posexplode("geometry").alias("pos", "p"))
    return points.select("row_id", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("p.x", 8).alias("lon"), F.round("p.y", 8).alias("lat"))


@query(f"WITH {_PLACES}, b AS (SELECT unnest(geometry) AS r FROM bairros) SELECT count(*) AS rings, CAST(sum(len(r)) AS BIGINT) AS points FROM b")
def ring_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "bairros").select(F.explode("geometry").alias("r")).agg(F.count(F.lit(1)).alias("rings"), F.sum(F.size("r")).alias("points"))


@query(f"WITH {_FULL} SELECT row_id, 'LINESTRING (' || array_to_string(list_transform(g, lambda p: CAST(p.x AS VARCHAR) || ' ' || CAST(p.y AS VARCHAR)), ', ') || ')' AS wkt FROM filled")
def edge_wkt(spark: SparkSession, sf: str) -> DataFrame:
    return N.filled_edges(_edges(spark, sf).select("row_id", "u", "v", "geometry"), _nodes(spark, sf)).select("row_id", to_wkt("geometry").alias("wkt"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS visits, count(DISTINCT user_id) AS users FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2")
def usage_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming operator over the table as a batch."""
    return windowed_usage(table(spark, sf, "events"), "ts", "event_type", "user_id")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS steps FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(table(spark, sf, "events"), "ts", "user_id")


@query(ORACLES["betweenness"].replace("SELECT p.node, round(", "SELECT p.node, p.x, p.y, round("))
def nodes_betweenness(spark: SparkSession, sf: str) -> DataFrame:
    """The node layer with its betweenness, ready to be written."""
    return N.places(_nodes(spark, sf)).join(betweenness(spark, sf), "node")


@query(f"WITH RECURSIVE {_arcs_sql(_MM)}, {_OD}, {_DIST} SELECT source, count(DISTINCT target) AS reached FROM od JOIN dist ON s = source AND n = target WHERE d <= 5000000 GROUP BY source")
def cumulative_access(spark: SparkSession, sf: str) -> DataFrame:
    """Different destinations of each origin's node within 5 km of network."""
    return M.cumulative(od_routes(spark, sf), "source", "target", F.col("dist") <= 5_000_000)


@query("SELECT DISTINCT name FROM gdf_edges WHERE regexp_matches(name, '(?i)^(av|avenida)[. ].*[aeo]ra$')")
def names_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Street names that match a pattern."""
    return _edges(spark, sf).filter(C.matches("name", r"^(av|avenida)[. ].*[aeo]ra$")).select("name").distinct()


@query(f"""WITH RECURSIVE {_FULL}, street AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(length_mm) AS w FROM ch WHERE u <> v GROUP BY ALL),
ends AS (SELECT a AS node, b AS other, a, b, w FROM street UNION ALL SELECT b, a, a, b, w FROM street), inner_ AS (SELECT node FROM ends GROUP BY node HAVING count(*) = 2),
label(node, l) USING KEY (node) AS (SELECT node, node FROM inner_ UNION
  SELECT e.other, min(x.l) FROM label x JOIN ends e ON e.node = x.node JOIN recurring.label o ON o.node = e.other WHERE x.l < o.l GROUP BY e.other),
per AS (SELECT l.l, e.a, e.b, any_value(e.w) AS w, max(CASE WHEN e.other NOT IN (SELECT node FROM inner_) THEN e.other END) AS out FROM label l JOIN ends e USING (node) GROUP BY l.l, e.a, e.b)
SELECT l AS chain, min(out) AS end_a, max(out) AS end_b, count(*) AS edges, CAST(sum(w) AS BIGINT) AS length_mm FROM per GROUP BY l""")
def street_chains(spark: SparkSession, sf: str) -> DataFrame:
    """Streets through nodes of degree 2, each contracted to one with the sum of its lengths."""
    return N.chains(_characterised(spark, sf).select("u", "v", "length_mm"), _nodes(spark, sf))
