import sqlite3
import struct

from ruamesh.sources.vector import read_geopackage, read_shapefile, wkb

RING = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)]


def flat(points):
    return struct.pack(f"<{2 * len(points)}d", *[v for p in points for v in p])


def shp(*bodies):
    out = b"\0" * 100
    for k, b in enumerate(bodies, 1):
        out += struct.pack(">2i", k, len(b) // 2) + b
    return out


def dbf(rows):
    header = b"\3\0\0\0" + struct.pack("<IHH", len(rows), 32 + 2 * 32 + 1, 1 + 6 + 4) + b"\0" * 20
    for name, size in (("NOME", 6), ("POP", 4)):
        header += name.encode().ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([size]) + b"\0" * 15
    return header + b"\r" + b"".join(b" " + n.encode("latin-1").ljust(6) + p.encode().ljust(4) for n, p in rows)


def parts(row):
    return row["geometry"] and [[tuple(p) for p in part] for part in row["geometry"]]


def test_shapefile(spark, tmp_path):
    polygon = struct.pack("<i4d2i2i", 5, 0, 0, 10, 10, 2, 8, 0, 4) + flat(RING + RING)
    point, null = struct.pack("<i2d", 1, 3.0, 4.0), struct.pack("<i", 0)
    (tmp_path / "b.shp").write_bytes(shp(polygon, point, null))
    (tmp_path / "b.dbf").write_bytes(dbf([("São", "12"), ("x", ""), ("y", "3")]))
    rows = read_shapefile(spark, str(tmp_path / "*.shp"), 31982, "latin-1").collect()
    assert [parts(r) for r in rows] == [[RING, RING], [[(3.0, 4.0)]], None]
    assert [r["attrs"] for r in rows] == [{"NOME": "São", "POP": "12"}, {"NOME": "x", "POP": None}, {"NOME": "y", "POP": "3"}]
    assert {(r["layer"], r["srid"]) for r in rows} == {("b", 31982)}


def test_geopackage(spark, tmp_path):
    line = struct.pack("<BII", 1, 2, 2) + flat(RING[:2])
    many = struct.pack("<BII", 1, 6, 1) + struct.pack("<BIII", 1, 3, 1, 4) + flat(RING)
    db = sqlite3.connect(tmp_path / "n.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('edges', 'geom', 31982), ('nodes', 'geom', 31982)")
    db.execute("CREATE TABLE edges (fid INTEGER, geom BLOB, name TEXT)")
    db.execute("CREATE TABLE nodes (fid INTEGER, geom BLOB)")
    plain, boxed = b"GP\0\1" + struct.pack("<i", 31982), b"GP\0\3" + struct.pack("<i4d", 31982, 0, 10, 0, 10)
    db.executemany("INSERT INTO edges VALUES (?, ?, ?)", [(1, plain + line, "a"), (2, boxed + many, None), (3, None, "c")])
    db.execute("INSERT INTO nodes VALUES (7, ?)", (plain + struct.pack("<BI2d", 1, 1, 5.0, 6.0),))
    db.commit()
    db.close()
    rows = read_geopackage(spark, str(tmp_path / "n.gpkg"), "edges").collect()
    assert [parts(r) for r in rows] == [[RING[:2]], [RING], None]
    assert [r["attrs"] for r in rows] == [{"fid": "1", "name": "a"}, {"fid": "2", "name": None}, {"fid": "3", "name": "c"}]
    assert read_geopackage(spark, str(tmp_path / "n.gpkg")).count() == 4


def test_binary_with_height():
    assert wkb(struct.pack("<BI3d", 1, 1001, 1.0, 2.0, 3.0))[0] == [[{"x": 1.0, "y": 2.0}]]


def test_geopackage_in_ranges_of_rows(spark, tmp_path, monkeypatch):
    from ruamesh.sources import vector

    monkeypatch.setattr(vector, "GPKG_ROWS", 7)
    db = sqlite3.connect(tmp_path / "a b.gpkg")
    db.execute("CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id)")
    db.execute("INSERT INTO gpkg_geometry_columns VALUES ('rows', 'geom', 31982), ('none', 'geom', 31982)")
    db.execute("CREATE TABLE rows (fid INTEGER PRIMARY KEY, geom BLOB, name TEXT)")
    db.execute("CREATE TABLE none (fid INTEGER PRIMARY KEY, geom BLOB)")
    db.executemany("INSERT INTO rows VALUES (?, NULL, ?)", [(k * 3 - 20, f"n{k}") for k in range(50)])
    db.commit()
    db.close()
    got = read_geopackage(spark, str(tmp_path / "a b.gpkg")).collect()
    assert sorted(r["attrs"]["name"] for r in got) == sorted(f"n{k}" for k in range(50))
