"""Queries of the data-preparation problems in the core: points, units, packed values, profile, orphans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruamesh.common import cut, lookup, table
from ruamesh.functions.units import number
from ruamesh.operators import edges as E
from ruamesh.operators import profile as P
from ruamesh.operators.multivalue import learn_splits, split_values
from ruamesh.operators.orphans import orphans
from ruamesh.operators.spatial import near_pairs, nearest, regions_of
from ruamesh.operators.units import switches

NEAR_M = 40.0


def _origin_points(spark: SparkSession, sf: str) -> DataFrame:
    """(id, x, y, node) of the origins with a location; 0,0 means none."""
    o = table(spark, sf, "origins").select(F.col("origin_id").alias("id"), F.col("geometry.x").alias("x"), F.col("geometry.y").alias("y"), "node")
    return o.filter("x IS NOT NULL AND y IS NOT NULL AND NOT (x = 0 AND y = 0)").distinct()


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    points = cut(_origin_points(spark, sf))
    near = near_pairs(points, NEAR_M).select(F.lit("near").alias("relation"), "key_a", "key_b")
    bairros = table(spark, sf, "bairros").select(F.col("CODIGO").alias("region"), F.col("geometry").alias("rings"))
    within = regions_of(points, bairros).select(F.lit("in").alias("relation"), F.col("id").alias("key_a"), F.col("region").alias("key_b"))
    nodes = table(spark, sf, "gdf_nodes").select(F.col("osmid").alias("target"), "x", "y")
    true = nearest(points, nodes).join(points.select("id", "node").distinct(), "id")
    wrong = true.filter(~F.col("node").eqNullSafe(F.col("target"))).select(F.lit("node").alias("relation"), F.col("id").alias("key_a"), F.col("target").alias("key_b")).distinct()
    return near.unionByName(within).unionByName(wrong)


def p1_bairros(spark: SparkSession, sf: str) -> DataFrame:
    """Each located origin with the bairro (code and name) that contains it, or nulls."""
    points = cut(_origin_points(spark, sf).select("id", "x", "y").distinct())
    b = table(spark, sf, "bairros").select(F.col("CODIGO").cast("bigint").alias("region"), F.col("NOME").alias("nome"), F.col("geometry").alias("rings"))
    found = regions_of(points, b).join(b.select("region", "nome"), "region")
    return points.select("id").distinct().join(found, "id", "left").select(F.col("id").alias("origin_id"), F.col("region").alias("codigo"), "nome")


PACKED = ["highway", "lanes", "maxspeed"]


MEASURED = ["row_id", "load_id", "highway", "length", "maxspeed", "note", "source", "loaded_at", "geometry"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = E.measured(table(spark, sf, "gdf_edges").select(MEASURED), table(spark, sf, "fontes"))
    length = F.when(F.col("length.num").isNotNull() & (F.col("length.unit") != "m"), F.lit("length"))
    speed = F.when(F.exists("speeds", lambda s: s["num"].isNotNull() & (s["unit"] != "km/h")), F.lit("maxspeed"))
    return rows.select("row_id", F.explode(F.array_compact(F.array(length, speed))).alias("field")).distinct()


def p2_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every length and speed in metres and km/h."""
    rows = E.measured(table(spark, sf, "gdf_edges").select(MEASURED), table(spark, sf, "fontes"))
    length = F.struct(F.lit("length").alias("field"), F.lit(1).cast("bigint").alias("pos"), F.col("length.val").alias("val"), F.col("length.num").alias("num"), F.col("length.unit").alias("unit"), F.col("length.si").alias("si"))
    speeds = F.transform("speeds", lambda s: F.struct(F.lit("maxspeed").alias("field"), s["pos"].alias("pos"), s["val"].alias("val"), s["num"].alias("num"), s["unit"].alias("unit"), s["si"].alias("si")))
    values = rows.select("row_id", F.explode(F.array_append(F.coalesce(speeds, F.expr("filter(array(named_struct('field', '', 'pos', 0L, 'val', '', 'num', 0D, 'unit', '', 'si', 0D)), x -> false)")), length)).alias("v"))
    return values.select("row_id", "v.*").filter("num IS NOT NULL").select("row_id", "field", "pos", "val", "unit", F.round("si", 4).alias("si"))


def p2_switches(spark: SparkSession, sf: str) -> DataFrame:
    """The days on which each source recorded in which unit, from its values alone, without any statement."""
    edges, fontes = table(spark, sf, "gdf_edges").select(MEASURED), table(spark, sf, "fontes")
    counts = E.text_counts(edges, ["maxspeed"])
    splits = learn_splits(edges, ["maxspeed"], E.DECIMALS, texts=E.texts_of(counts))
    states = E.day_states(edges, fontes, counts, splits, statement_weight=0.0)
    parts = [switches(states[kind]).select("source", F.lit(field).alias("field"), "unit", "first", "last") for field, kind in E.KINDS.items()]
    return parts[0].unionByName(parts[1])


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "gdf_edges").select("row_id", *PACKED)
    return split_values(edges, "row_id", PACKED, E.DECIMALS, multi_only=True).distinct()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    edges, fields = table(spark, sf, "gdf_edges").select([*MEASURED, "lanes"]), ["lanes", "maxspeed"]
    counts = E.text_counts(edges, fields)
    splits = learn_splits(edges, fields, E.DECIMALS, texts=E.texts_of(counts))
    texts = E.texts_of(counts).join(splits, ["field", "text"], "left").withColumn("split", F.col("vals").isNotNull()).withColumn("vals", F.coalesce("vals", F.array(F.trim("text"))))
    judged = cut(P.violations(cut(texts), {"lanes": None, "maxspeed": "speed"}).filter("split OR bad"))  # the other texts are their own value
    rows = E.measured(edges, table(spark, sf, "fontes"), keep=("row_id", "load_id", "lanes"), counts=counts, splits=splits)
    for f in fields:
        rows = lookup(rows, judged.filter(F.col("field") == f).select(F.col("text").alias(f), F.col("vals").alias(f"{f}_vals"), F.col("bad").alias(f"{f}_bad")), [f], "left")
    lanes = F.transform(F.filter(F.coalesce("lanes_vals", F.array(F.trim("lanes"))), lambda v: v != ""), lambda v: number(v))
    speeds = F.transform("speeds", lambda s: s["si"])
    marks = [P.mark(F.col("lanes"), F.col("lanes_bad"), lanes, 1, 10, whole=True).alias("lanes"), P.mark(F.col("maxspeed"), F.col("maxspeed_bad"), speeds, 5, 130).alias("maxspeed")]
    marked = cut(rows.select("row_id", "load_id", *marks))  # read for the loads and for the findings of both columns
    grid = table(spark, sf, "grid").select(F.col("fid").alias("row_id"), "load_id", F.col("POP").cast("double").alias("num"))
    out = P.plain_findings(grid, 0, 5000).withColumns({"tab": F.lit("grid"), "col": F.lit("POP")})
    for f in fields:
        out = out.unionByName(P.number_findings(marked.select("row_id", "load_id", F.col(f).alias("mark"))).withColumns({"tab": F.lit("gdf_edges"), "col": F.lit(f)}))
    return out.select("tab", "col", F.col("load_id").cast("bigint").alias("load_id"), F.col("row_id").cast("bigint").alias("row_id"), "finding").distinct()


def p4_profile(spark: SparkSession, sf: str) -> DataFrame:
    edges, grid = table(spark, sf, "gdf_edges"), table(spark, sf, "grid")
    parts = [P.column_profile(df.select("load_id", c), c).withColumns({"tab": F.lit(t), "col": F.lit(c)}) for t, df, c in (("gdf_edges", edges, "maxspeed"), ("gdf_edges", edges, "lanes"), ("grid", grid, "POP"))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("tab", "col", F.col("load").cast("bigint").alias("load_id"), "n", F.round("null_share", 6).alias("null_share"), "n_distinct", "low", "high", "rare_n", F.round("js", 6).alias("js"))


#: (tab, field, row key, time, parent, parent key, deleted) of every reference.
REFERENCES = (("origins", "node", "origin_id", "loaded_at", "gdf_nodes", "osmid", "deleted_at"), ("origins", "origin_id", "origin_id", "loaded_at", "grid", "fid", None), ("od_pairs", "origin_id", "pair_id", "created_at", "origins", "origin_id", None))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for tab, field, key, at, parent, parent_key, deleted in REFERENCES:
        one = orphans(table(spark, sf, tab), field, key, at, table(spark, sf, parent), parent_key, "loaded_at", deleted)
        one = one.select(F.lit(tab).alias("tab"), F.lit(field).alias("field"), "row_key", F.date_format("at", "yyyy-MM").alias("period")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def p6_periods(spark: SparkSession, sf: str) -> DataFrame:
    """Orphans counted by table, field and period."""
    return p6_found(spark, sf).groupBy("tab", "field", "period").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"p1_found": p1_found, "p1_bairros": p1_bairros, "p2_found": p2_found, "p2_values": p2_values, "p2_switches": p2_switches, "p3_found": p3_found, "p4_found": p4_found, "p4_profile": p4_profile, "p6_found": p6_found, "p6_periods": p6_periods}

_P6 = """
WITH refs AS (
  SELECT 'origins' AS tab, 'node' AS field, origin_id AS row_key, node AS ref, loaded_at AS t FROM origins
  UNION ALL SELECT 'origins', 'origin_id', origin_id, origin_id, loaded_at FROM origins
  UNION ALL SELECT 'od_pairs', 'origin_id', pair_id, origin_id, created_at FROM od_pairs),
parents AS (
  SELECT DISTINCT 'origins' AS tab, 'node' AS field, osmid AS ref, loaded_at AS a, coalesce(deleted_at, TIMESTAMP '9999-12-31') AS b FROM gdf_nodes
  UNION SELECT 'origins', 'origin_id', fid, loaded_at, TIMESTAMP '9999-12-31' FROM grid
  UNION SELECT 'od_pairs', 'origin_id', origin_id, loaded_at, TIMESTAMP '9999-12-31' FROM origins),
found AS (
  SELECT DISTINCT r.tab, r.field, r.row_key, strftime(r.t, '%Y-%m') AS period FROM refs r
  WHERE r.ref IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.tab = r.tab AND p.field = r.field AND p.ref = r.ref AND p.a <= r.t AND p.b > r.t))
"""
ORACLES = {
    "p6_found": _P6 + "SELECT tab, field, row_key, period FROM found",
    "p6_periods": _P6 + "SELECT tab, field, period, count(*) AS n FROM found GROUP BY tab, field, period",
}

ORACLES["p1_found"] = """
WITH o AS (SELECT DISTINCT origin_id, geometry.x AS x, geometry.y AS y, node FROM origins WHERE geometry IS NOT NULL AND NOT (geometry.x = 0 AND geometry.y = 0)),
p AS (SELECT DISTINCT origin_id, x, y FROM o),
near AS (SELECT a.origin_id AS key_a, b.origin_id AS key_b FROM p a JOIN p b ON a.origin_id < b.origin_id AND b.x BETWEEN a.x - 40.001 AND a.x + 40.001 AND b.y BETWEEN a.y - 40.001 AND a.y + 40.001
  WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 40 + 1e-9),
s AS (SELECT CODIGO, ring, unnest(range(1, len(ring))) AS i FROM (SELECT CODIGO, unnest(geometry) AS ring FROM bairros)),
e AS (SELECT CODIGO, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM s),
b AS (SELECT CODIGO, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS xx, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS yy FROM e GROUP BY CODIGO),
c AS (SELECT p.*, b.CODIGO FROM p JOIN b ON p.x BETWEEN b.x0 AND b.xx AND p.y BETWEEN b.y0 AND b.yy),
inside AS (SELECT c.origin_id AS key_a, CAST(c.CODIGO AS BIGINT) AS key_b FROM c JOIN e ON e.CODIGO = c.CODIGO GROUP BY c.origin_id, c.CODIGO, c.x, c.y
  HAVING sum(CASE WHEN (y1 > c.y) <> (y2 > c.y) AND c.x < (x2 - x1) * (c.y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1),
places AS (SELECT x, y, min(osmid) AS node FROM gdf_nodes WHERE osmid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY x, y),
nn AS (SELECT p.origin_id, p.x, p.y, arg_min(q.node, (sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)), q.node)) AS node FROM p, places q GROUP BY p.origin_id, p.x, p.y)
SELECT DISTINCT * FROM (
  SELECT 'near' AS relation, key_a, key_b FROM near
  UNION ALL SELECT 'in', key_a, key_b FROM inside
  UNION ALL SELECT 'node', o.origin_id, nn.node FROM o JOIN nn ON nn.origin_id = o.origin_id AND nn.x = o.x AND nn.y = o.y WHERE o.node IS DISTINCT FROM nn.node)
"""
ORACLES["p1_bairros"] = """
WITH p AS (SELECT DISTINCT origin_id, geometry.x AS x, geometry.y AS y FROM origins WHERE geometry IS NOT NULL AND NOT (geometry.x = 0 AND geometry.y = 0)),
s AS (SELECT CODIGO, ring, unnest(range(1, len(ring))) AS i FROM (SELECT CODIGO, unnest(geometry) AS ring FROM bairros)),
e AS (SELECT CODIGO, ring[i].x AS x1, ring[i].y AS y1, ring[i + 1].x AS x2, ring[i + 1].y AS y2 FROM s),
b AS (SELECT CODIGO, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS xx, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS yy FROM e GROUP BY CODIGO),
c AS (SELECT p.*, b.CODIGO FROM p JOIN b ON p.x BETWEEN b.x0 AND b.xx AND p.y BETWEEN b.y0 AND b.yy),
inside AS (SELECT DISTINCT c.origin_id, c.CODIGO FROM c JOIN e ON e.CODIGO = c.CODIGO GROUP BY c.origin_id, c.CODIGO, c.x, c.y
  HAVING sum(CASE WHEN (y1 > c.y) <> (y2 > c.y) AND c.x < (x2 - x1) * (c.y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1),
n AS (SELECT i.origin_id, i.CODIGO, r.NOME FROM inside i JOIN bairros r USING (CODIGO))
SELECT o.origin_id, CAST(n.CODIGO AS BIGINT) AS codigo, n.NOME AS nome FROM (SELECT DISTINCT origin_id FROM p) o LEFT JOIN n USING (origin_id)
"""
ORACLES["p4_profile"] = r"""
WITH v AS (SELECT 'gdf_edges' AS tab, 'maxspeed' AS col, load_id, maxspeed AS v FROM gdf_edges UNION ALL SELECT 'gdf_edges', 'lanes', load_id, lanes FROM gdf_edges
  UNION ALL SELECT 'grid', 'POP', load_id, CAST(POP AS VARCHAR) FROM grid),
base AS (SELECT tab, col, load_id, count(*) AS n, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS null_share, count(DISTINCT v) AS n_distinct, min(v) AS low, max(v) AS high FROM v GROUP BY ALL),
m AS (SELECT tab, col, load_id, regexp_replace(regexp_replace(regexp_replace(v, '\d+', '9', 'g'), '\p{L}+', 'a', 'g'), '\s+', ' ', 'g') AS mask, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY ALL),
a AS (SELECT *, sum(n) OVER (PARTITION BY tab, col, mask) / sum(n) OVER (PARTITION BY tab, col) AS q, n / sum(n) OVER (PARTITION BY tab, col, load_id) AS p FROM m),
j AS (SELECT tab, col, load_id, CAST(sum(CASE WHEN q < 0.01 THEN n ELSE 0 END) AS BIGINT) AS rare_n, round(sum(p / 2 * log2(p / ((p + q) / 2)) + q / 2 * log2(q / ((p + q) / 2))) + (1 - sum(q)) / 2, 6) AS js FROM a GROUP BY ALL)
SELECT b.tab, b.col, CAST(b.load_id AS BIGINT) AS load_id, b.n, b.null_share, b.n_distinct, b.low, b.high, coalesce(j.rare_n, 0) AS rare_n, j.js FROM base b LEFT JOIN j ON j.tab = b.tab AND j.col = b.col AND j.load_id IS NOT DISTINCT FROM b.load_id
"""

# The tables' packed texts split by plain rules, apart from the operator: delimiters outside quotes and parentheses part
# values, a slash between letters and a comma before a single digit of a speed do not.
_SPLIT = r"""
texts AS (SELECT DISTINCT field, text FROM (SELECT 'maxspeed' AS field, maxspeed AS text FROM gdf_edges UNION ALL SELECT 'lanes', lanes FROM gdf_edges UNION ALL SELECT 'highway', highway FROM gdf_edges) WHERE text IS NOT NULL),
hidden AS (SELECT field, text, regexp_replace(regexp_replace(CASE WHEN field = 'maxspeed' THEN regexp_replace(b, '(\d),(\d)([^\d]|$)', '\1' || chr(2) || '\2\3', 'g') ELSE b END, '([A-Za-z])/([A-Za-z])', '\1' || chr(1) || '\2', 'g'), '\b[sS]/ ', 's' || chr(1) || ' ', 'g') AS t
  FROM (SELECT field, text, regexp_replace(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(160)), '^[\[{](.*)[\]}]$', '\1') AS b FROM texts)),
items AS (SELECT field, text, CASE WHEN len(i) > 1 AND i[-1] = '' AND NOT regexp_matches(t, '[;|\t,/]$') THEN i[:-2] ELSE i END AS items
  FROM (SELECT field, text, t, regexp_extract_all(t, '((?:"[^"]*"|''[^'']*''|\([^)]*\)|[^;|\t,/("''])*)(?:[;|\t,/]|$)', 1) AS i FROM hidden)),
vals AS (SELECT field, text, pos, trim(regexp_replace(trim(v), '^(["''])(.*)["'']$', '\2')) AS val
  FROM (SELECT field, text, unnest(range(1, len(items) + 1)) AS pos, translate(unnest(items), chr(1) || chr(2), '/,') AS v FROM items)),
good AS (SELECT field, text, CAST(pos AS BIGINT) AS pos, val FROM vals WHERE val <> '')"""
ORACLES["p3_found"] = f"""WITH {_SPLIT}, many AS (SELECT field, text FROM good GROUP BY ALL HAVING count(*) >= 2),
e AS (SELECT row_id, 'maxspeed' AS field, maxspeed AS text FROM gdf_edges UNION ALL SELECT row_id, 'lanes', lanes FROM gdf_edges UNION ALL SELECT row_id, 'highway', highway FROM gdf_edges)
SELECT DISTINCT row_id, field, pos, val FROM e JOIN many USING (field, text) JOIN good USING (field, text)"""

# Units by the words that occur in these tables' values, notes and sources.
UNITS_SQL = (
    _SPLIT
    + r""",
said AS (SELECT source, CASE WHEN descricao LIKE '%quilômetros até%' THEN 'km' WHEN descricao LIKE '%pés%' THEN 'ft' WHEN descricao LIKE '%yards%' THEN 'yd' WHEN descricao LIKE '%centímetro%' THEN 'cm' ELSE 'm' END AS lu,
  CASE WHEN descricao LIKE '%metros por segundo%' THEN 'm/s' WHEN descricao LIKE '%miles per hour%' THEN 'mph' ELSE 'km/h' END AS su,
  coalesce(try_strptime(regexp_extract(descricao, 'quilômetros até (\d{2}/\d{2}/\d{4})', 1), '%d/%m/%Y'), TIMESTAMP '9999-12-31') + INTERVAL 1 DAY AS until FROM fontes),
edge AS (SELECT e.row_id, e.load_id, e.length, e.maxspeed, e.lanes, CASE WHEN coalesce(e.loaded_at, TIMESTAMP '9999-12-31') < s.until THEN coalesce(s.lu, 'm') ELSE 'm' END AS lu, coalesce(s.su, 'km/h') AS su,
  CASE WHEN regexp_matches(note, 'comprimento|extens|ext\.|length|medida') THEN CASE WHEN regexp_matches(note, 'cent[ií]metros') THEN 'cm' WHEN regexp_matches(note, 'quil[ôo]metros|km') THEN 'km' WHEN regexp_matches(note, 'p[ée]s|feet') THEN 'ft' WHEN regexp_matches(note, 'jardas|yards') THEN 'yd' END END AS ln,
  CASE WHEN regexp_matches(note, 'vel|limite') THEN CASE WHEN regexp_matches(note, 'metros por segundo|m/s') THEN 'm/s' WHEN regexp_matches(note, 'mph|milhas por hora') THEN 'mph' END END AS sn
  FROM gdf_edges e LEFT JOIN said s USING (source)),
lparts AS (SELECT *, regexp_extract(lower(length), '^\s*([+-]?\d+(?:[.,]\d+)?)\s*([a-zéôó]*)\s*$', ['n', 'u']) AS p FROM edge WHERE length IS NOT NULL),
lens AS (SELECT row_id, length AS val, try_cast(replace(p.n, ',', '.') AS DOUBLE) AS num, CASE WHEN p.u IN ('km', 'quilômetros') THEN 'km' WHEN p.u IN ('m', 'mts', 'metros') THEN 'm' WHEN p.u = 'cm' THEN 'cm' WHEN p.u IN ('ft', 'pés', 'feet') THEN 'ft' WHEN p.u IN ('yd', 'jardas') THEN 'yd' ELSE coalesce(ln, lu) END AS unit FROM lparts WHERE p.n <> ''),
sparts AS (SELECT e.*, g.pos, g.val, regexp_extract(regexp_replace(lower(g.val), '\s*(\(.*\)|@.*)\s*$', ''), '^\s*([+-]?\d+(?:[.,]\d+)?)\s*(km/h|kmh|kph|quilômetros por hora|mph|milhas/h|m/s|kn|knots|nós|)\s*$', ['n', 'u']) AS p FROM edge e JOIN good g ON g.field = 'maxspeed' AND g.text = e.maxspeed),
spds AS (SELECT row_id, load_id, pos, val, try_cast(replace(p.n, ',', '.') AS DOUBLE) AS num, CASE WHEN p.u = '' THEN coalesce(sn, su) WHEN p.u IN ('mph', 'milhas/h') THEN 'mph' WHEN p.u = 'm/s' THEN 'm/s' WHEN p.u IN ('kn', 'knots', 'nós') THEN 'kn' ELSE 'km/h' END AS unit FROM sparts),
speed AS (SELECT *, num * CASE unit WHEN 'm/s' THEN 3.6 WHEN 'mph' THEN 1.609344 WHEN 'kn' THEN 1.852 ELSE 1.0 END AS si FROM spds)"""
)
ORACLES["p2_values"] = f"""WITH {UNITS_SQL}
SELECT row_id, 'length' AS field, CAST(1 AS BIGINT) AS pos, val, unit, round(num * CASE unit WHEN 'km' THEN 1000 WHEN 'cm' THEN 0.01 WHEN 'ft' THEN 0.3048 WHEN 'yd' THEN 0.9144 ELSE 1.0 END, 4) AS si FROM lens
UNION ALL SELECT row_id, 'maxspeed', pos, val, unit, round(si, 4) FROM speed WHERE num IS NOT NULL"""
ORACLES["p2_found"] = f"""WITH {UNITS_SQL}
SELECT DISTINCT row_id, 'length' AS field FROM lens WHERE unit <> 'm' UNION ALL SELECT DISTINCT row_id, 'maxspeed' FROM speed WHERE num IS NOT NULL AND unit <> 'km/h'"""
ORACLES["p4_found"] = f"""WITH {UNITS_SQL},
lane AS (SELECT e.row_id, g.pos, try_cast(replace(nullif(regexp_extract(regexp_replace(g.val, '\\s*(\\(.*\\)|@.*)\\s*$', ''), '^\\s*([+-]?\\d+(?:[.,]\\d+)?)\\s*$', 1), ''), ',', '.') AS DOUBLE) AS num FROM edge e JOIN good g ON g.field = 'lanes' AND g.text = e.lanes),
value AS (SELECT 'lanes' AS col, row_id, pos, num, num < 1 OR num > 10 OR num <> floor(num) AS off FROM lane UNION ALL SELECT 'maxspeed', row_id, pos, si, si < 5 OR si > 130 FROM speed),
per AS (SELECT col, row_id, count(num) AS numbers, coalesce(bool_or(off), false) AS off, arg_min(coalesce(num, 'nan'::DOUBLE), pos) AS head FROM value GROUP BY ALL),
cells AS (SELECT row_id, load_id, 'lanes' AS col, lanes AS text FROM gdf_edges UNION ALL SELECT row_id, load_id, 'maxspeed', maxspeed FROM gdf_edges),
rows_ AS (SELECT 'gdf_edges' AS tab, c.col, c.load_id, c.row_id, c.text IS NULL AS gone, CASE WHEN c.text IS NOT NULL AND coalesce(p.numbers, 0) = 0 THEN 'pattern' WHEN p.off THEN 'range' END AS finding, CASE WHEN isnan(p.head) THEN NULL ELSE p.head END AS head FROM cells c LEFT JOIN per p USING (col, row_id)
  UNION ALL SELECT 'grid', 'POP', load_id, fid, POP IS NULL, CASE WHEN POP < 0 OR POP > 5000 THEN 'range' END, CAST(POP AS DOUBLE) FROM grid),
loads AS (SELECT tab, col, load_id, avg(CASE WHEN gone THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN finding IS NULL AND NOT gone THEN head END) AS mean FROM rows_ GROUP BY ALL),
med AS (SELECT tab, col, median(share) AS ms, median(mean) AS mm FROM loads GROUP BY ALL)
SELECT DISTINCT tab, col, CAST(load_id AS BIGINT) AS load_id, CAST(row_id AS BIGINT) AS row_id, finding FROM (
  SELECT tab, col, load_id, row_id, finding FROM rows_ WHERE finding IS NOT NULL
  UNION ALL SELECT tab, col, load_id, 0, 'nulls' FROM loads JOIN med USING (tab, col) WHERE share > 2 * ms
  UNION ALL SELECT tab, col, load_id, 0, 'shift' FROM loads JOIN med USING (tab, col) WHERE abs(mean - mm) > 0.25 * abs(mm))"""
