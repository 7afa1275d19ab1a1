import json

from pyspark.sql import functions as F

from ruamesh.sources.config import raster_cells, read_config, read_geocoder, read_labels
from ruamesh.sources.graphml import as_list, read_graphml, to_graphml_lines, write_graphml
from ruamesh.sources.layers import convert, read_layer, write_layer
from ruamesh.sources.wkt import polygon_to_wkt

GRAPHML = """<?xml version='1.0' encoding='utf-8'?>
<graphml xmlns="http://graphml.graphdrawing.org/xmlns">
<key id="d0" for="node" attr.name="x" attr.type="string"/>
<key id="d1" for="node" attr.name="y" attr.type="string"/>
<key id="d2" for="edge" attr.name="highway" attr.type="string"/>
<key id="d3" for="edge" attr.name="oneway" attr.type="string"/>
<key id="d4" for="edge" attr.name="length" attr.type="string"/>
<key id="d5" for="edge" attr.name="geometry" attr.type="string"/>
<graph edgedefault="directed">
<node id="10"><data key="d0">1.5</data><data key="d1">2.5</data></node>
<node id="11"><data key="d0">4.5</data><data key="d1">6.5</data></node>
<edge source="10" target="11" id="0"><data key="d2">['primary', 'tertiary']</data><data key="d3">True</data><data key="d4">5.25</data><data key="d5">LINESTRING (1.5 2.5, 4.5 6.5)</data></edge>
<edge source="11" target="10" id="0"><data key="d2">primary</data><data key="d3">False</data></edge>
</graph>
</graphml>
"""


def test_graphml(spark, tmp_path):
    path = tmp_path / "g.graphml"
    path.write_text(GRAPHML)
    nodes, edges = read_graphml(spark, str(path))
    assert {(r["osmid"], r["x"], r["y"]) for r in nodes.collect()} == {(10, 1.5, 2.5), (11, 4.5, 6.5)}
    got = {r["u"]: r for r in edges.collect()}
    assert got[10]["highway"] == ["primary", "tertiary"] and got[10]["oneway"] is True and got[10]["length"] == 5.25
    assert [tuple(p) for p in got[10]["geometry"]] == [(1.5, 2.5), (4.5, 6.5)]
    assert got[11]["highway"] == ["primary"] and got[11]["oneway"] is False and got[11]["geometry"] is None
    assert edges.schema["geometry"].metadata["srid"] == 31982
    lines = [r["line"] for r in to_graphml_lines(nodes, edges).orderBy("part", "line").collect()]
    assert len(lines) == 6 and lines[1].startswith('<node id="10">') and "LINESTRING (1.5 2.5, 4.5 6.5)" in lines[3]


def test_graphml_round_trip(spark, tmp_path):
    (tmp_path / "g.graphml").write_text(GRAPHML)
    nodes, edges = read_graphml(spark, str(tmp_path / "g.graphml"))
    edges = edges.withColumn("name", F.when(F.col("u") == 10, F.lit('Rua "A" & <B>'))).withColumn("lanes", F.array(F.lit("2, fundos"), F.lit("d'água")))
    write_graphml(nodes, edges, str(tmp_path / "out"))
    again_nodes, again = read_graphml(spark, str(tmp_path / "out"))
    assert sorted(map(str, again_nodes.collect())) == sorted(map(str, nodes.collect()))
    assert sorted(map(str, again.collect())) == sorted(map(str, edges.collect()))


def test_lists_keep_commas_inside_quotes(spark):
    df = spark.createDataFrame([("['Rua A, fundos', 'B']",), ("[1, 2]",), ("solo",), (None,), ("[]",)], "t string")
    assert [r[0] for r in df.select(as_list(F.col("t"))).collect()] == [["Rua A, fundos", "B"], ["1", "2"], ["solo"], None, []]


def test_layers_and_conversion(spark, tmp_path):
    df = spark.range(5)
    write_layer(df, str(tmp_path / "set"), "nodes")
    write_layer(df.limit(2), str(tmp_path / "set"), "nodes")
    assert read_layer(spark, str(tmp_path / "set"), "nodes").count() == 2
    df.write.csv(str(tmp_path / "c"), header=True)
    assert convert(spark, str(tmp_path / "c"), "csv", str(tmp_path / "set"), "copy", header="true", inferSchema="true").count() == 5


def test_configuration(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"study_area": {"network_type": "drive", "crs": "EPSG:31982", "place": "P", "districts": ["A", "B"]}, "paths": {"data": "d"}, "analysis": {"entropy_base": 2, "buffer": 500, "max_trip_distance": 30000}}, indent=1))
    c = read_config(spark, str(tmp_path / "c.json"))
    assert (c.srid, c.district_place(1), c.paths, c.buffer) == (31982, "B, P", {"data": "d"}, 500.0)
    (tmp_path / "l.json").write_text('{"pt": {"primary": "Via"}, "en": {"primary": "Road"}}')
    assert read_labels(spark, str(tmp_path / "l.json")) == {"pt": {"primary": "Via"}, "en": {"primary": "Road"}}
    (tmp_path / "g.json").write_text('[{"place_id": 1, "osm_id": 2, "name": "n", "geojson": {"type": "Polygon", "coordinates": [[[0, 1], [2, 3], [0, 1]]]}}]')
    g = read_geocoder(spark, str(tmp_path / "g.json"))
    assert g.select(polygon_to_wkt("rings")).first()[0] == "POLYGON ((0.0 1.0, 2.0 3.0, 0.0 1.0))"
    cells = raster_cells(spark.createDataFrame([(0, 1, 7.0)], "row int, col int, pop double"), 100.0, 200.0, 10.0).first()
    assert [tuple(p) for p in cells["geometry"]][:3] == [(110.0, 190.0), (120.0, 190.0), (120.0, 200.0)]
