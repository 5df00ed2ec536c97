import hashlib
import json

from pyspark.sql import functions as F

from urban_spark.functions.geometry_text import decode
from urban_spark.sources import io

KML = """<kml><Document>
<Placemark><name>A &amp; co</name><Point><coordinates>77.5,12.9,10</coordinates></Point></Placemark>
<Placemark id="x"><name><![CDATA[<b>B</b>]]></name><description>Diameter mm: 300</description><LineString><coordinates> 1,2 3,4,0
5,6 bad</coordinates></LineString></Placemark>
<Placemark><name>no place</name></Placemark>
<placemark><name>M</name><MultiGeometry><LineString><coordinates>0,0 1,1</coordinates></LineString><LineString><coordinates>2,2 3,3 4,4</coordinates></LineString></MultiGeometry></placemark>
<Placemark><name>P</name><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 4,0 4,4 0,4 0,0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>1,1 2,1 2,2 1,1</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark>
<Placemark><name>broken</name><Point><coordinates>here</coordinates></Point></Placemark>
</Document></kml>"""


def test_kml(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    rows = io.read_table(spark, f"{tmp_path}/a.kml")
    assert [(r.name, r.type, [len(x) for x in r.rings]) for r in rows.collect()] == [("A &amp; co", "Point", [1]), ("B", "LineString", [3]), ("M", "LineString", [2, 3]), ("P", "Polygon", [5, 4])]
    assert [tuple(r) for r in io.kml_points(rows).collect()] == [("A &amp; co", 77.5, 12.9)]
    assert [(r.name, [tuple(v) for v in r.line]) for r in io.kml_lines(rows).collect()][0] == ("B", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])


def test_geojson(spark, tmp_path):
    shapes = [("Point", [1, 2, 9]), ("LineString", [[0, 0], [1, 1]]), ("Polygon", [[[0, 0], [1, 0], [1, 1], [0, 0]]]), ("MultiPolygon", [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]])]
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c}, "properties": {"n": i, "name": "é"}} for i, (k, c) in enumerate(shapes)] + [{"type": "Feature", "geometry": None, "properties": {"n": 9}}]
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = io.read_table(spark, f"{tmp_path}/a.geojson").collect()
    assert [(r.type, [len(x) for x in r.rings or []]) for r in rows] == [("Point", [1]), ("LineString", [2]), ("Polygon", [4]), ("MultiPolygon", [4, 4]), (None, [])]
    assert tuple(rows[0].rings[0][0]) == (1.0, 2.0) and rows[0].properties == {"n": "0", "name": "é"}


def test_feature_lines_have_null_for_nan(spark):
    df = spark.createDataFrame([(1, float("nan"))], "id int, v double").withColumn("g", F.array(F.array(F.struct(F.lit(1.5).alias("x"), F.lit(2.0).alias("y")))))
    assert json.loads(io.feature_json(df, "g", "Point").collect()[0][0]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.0]}, "properties": {"id": 1, "v": None}}


def test_csv_is_text_and_may_be_absent(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Ward No,"Population"\n1,"12,345"\n2,\n')
    assert [tuple(r) for r in io.read_table(spark, f"{tmp_path}/a.csv").collect()] == [("1", "12,345"), ("2", None)]
    assert io.read_csv(spark, f"{tmp_path}/none.csv", ["a", "b"]).columns == ["a", "b"]
    (tmp_path / "t1.csv").write_text("x\n1\n")
    assert {(r.x, r.target) for r in io.read_keyed_csvs(spark, f"{tmp_path}/t*.csv").collect()} == {("1", "t1")}


def test_metrics_take_target_from_the_file(spark, tmp_path):
    (tmp_path / "ward_1_pm25_backtest_metrics.json").write_text(json.dumps({"ward_id": "1", "backtest": {"metrics": {"mae": 0.5}}}))
    (tmp_path / "ward_2_x_backtest_metrics.json").write_text(json.dumps({"ward_id": "2", "target": "water", "backtest": {"metrics": {}}}))
    rows = {r.ward_id: (r.target, r.mae) for r in io.read_metrics(spark, str(tmp_path)).collect()}
    assert rows["2"] == ("water", None) and rows["1"][1] == 0.5 and "pm25" in rows["1"][0]


def test_fingerprint_ignores_the_order(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2")):
        (tmp_path / name).write_text(text)
    one = io.fingerprints(spark, str(tmp_path))
    assert {r.bytes for r in one.collect()} == {1}
    two = one.orderBy(F.desc("name"))
    assert io.combined_fingerprint(one).collect() == io.combined_fingerprint(two).collect()


def test_decodes_geometry_text(spark):
    texts = ["POINT (1 2)", "POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))", "SRID=4326;LINESTRING(0 0 5, 1 1 5)", '{"type": "Point", "coordinates": [3.5, -4e1]}', "[[0, 0], [1, 1], [2, 2]]", "nothing", "", None,
             '{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", decode(F.col("t")).alias("g")).orderBy("i").collect()
    assert [(r.g.type, [len(x) for x in r.g.rings]) if r.g else None for r in rows] == [("Point", [1]), ("Polygon", [4, 4]), ("LineString", [2]), ("Point", [1]), ("LineString", [3]), None, None, None, ("MultiPolygon", [4, 4])]
    assert tuple(rows[3].g.rings[0][0]) == (3.5, -40.0) and tuple(rows[2].g.rings[0][1]) == (1.0, 1.0)


def test_fingerprints_by_blocks(spark, tmp_path):
    content = {f"{i}.bin": bytes(j * j * i % 251 for j in range(n)) for i, n in enumerate((1, 64, 999, 1000, 1001, 5000))}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    want = {(name, len(data), hashlib.sha256(data).hexdigest()) for name, data in content.items()}
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # no file is read whole
    try:
        for block in (1000, 1 << 20):
            assert {tuple(r) for r in io.fingerprints(spark, str(tmp_path), block=block).collect()} == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
