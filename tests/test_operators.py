"""Small hand-made cases for operators that SQL cannot state well."""
import itertools
import math

from pyspark.sql import functions as F

from routekit.functions import is_truncated, nineties_candidates, parse_coordinate, parse_metres, utm_forward, utm_inverse
from routekit.operators import association as asn
from routekit.operators import fits, graph, linework, output, placement, quality, sequence
from routekit.sources import cad, files


def test_utm_round_trip_within_the_series(spark):  # the inverse series stops at the cubic term, a few centimetres here
    df = spark.createDataFrame([(-27.6, -48.6), (-10.1, -60.2), (-33.0, -53.5)], "lat double, lon double")
    r = df.withColumn("u", utm_forward("lat", "lon")).withColumn("g", utm_inverse("u.easting", "u.northing", F.col("u.zone")))
    for row in r.collect():
        assert abs(row.g.lat - row.lat) < 1e-6 and abs(row.g.lon - row.lon) < 1e-6


def test_scalars(spark):
    row = spark.range(1).select(parse_metres(F.lit(" 40,2 ")).alias("a"), parse_metres(F.lit("4x")).alias("b"), parse_coordinate(F.lit("-27.6, -48.6")).alias("c"),
                                parse_coordinate(F.lit("95, 1")).alias("d"), is_truncated(F.lit(8), F.lit(58)).alias("e"), nineties_candidates(F.lit(99), F.lit(60)).alias("f")).first()
    assert (row.a, row.b, row.c.lat, row.d, row.e, row.f) == (40.2, None, -27.6, None, True, [59])


def test_similarity_recovers_parameters(spark):
    scale, theta, tx, ty = 1.02, 0.3, 5.0, -7.0
    pts = [(0.0, 0.0), (10.0, 1.0), (3.0, 8.0), (-4.0, 2.0)]
    rows = [(1, x, y, scale * (math.cos(theta) * x + math.sin(theta) * y) + tx, scale * (math.cos(theta) * y - math.sin(theta) * x) + ty) for x, y in pts]
    r = fits.similarity_fit(spark.createDataFrame(rows, "k int, px double, py double, qx double, qy double"), "k").first()
    assert max(abs(r.scale - scale), abs(r.theta - theta), abs(r.tx - tx), abs(r.ty - ty)) < 1e-9


def test_gate_bands(spark):
    shape = spark.createDataFrame([(1, 0.01), (2, 0.2), (3, 0.01), (4, 0.1), (5, 0.01)], "route_id long, median_rel double")
    gap = spark.createDataFrame([(1, 3.0), (2, 3.0), (3, 25.0), (4, 3.0)], "route_id long, p95_gap double")
    got = {r.route_id: r.decision for r in quality.route_decision(shape, gap).collect()}
    assert got == {1: "trust", 2: "fail", 3: "fail", 4: "fallback", 5: "fallback"}


def test_repair_sequence(spark):
    numbers = [1, None, 3, 4, 5, 6, 7, 8, 9, 10] + list(range(11, 57)) + [57, 8, 59, 99]
    rows = [(1, i + 1, 1, n) for i, n in enumerate(numbers)]
    got = {r.pos: (r.assigned, r.action) for r in sequence.repair_sequence(spark.createDataFrame(rows, "route_id long, pos int, page int, number int")).collect()}
    assert got[2] == (2, "renumbered") and got[58] == (58, "renumbered") and got[60][1] == "renumbered" and got[5] == (5, "kept")


def test_decode_path_equals_exhaustive_search(spark):
    cands = {1: [(10, 0.0, 2.0), (11, 30.0, 1.0)], 2: [(20, 55.0, 5.0), (21, 70.0, 1.0)], 3: [(30, 60.0, 0.0), (31, 120.0, 9.0)]}
    labels = {2: 28.0, 3: 30.0}
    rows = [(1, 1, n, s, t, d) for n, opts in cands.items() for s, t, d in opts]
    spans = spark.createDataFrame([(1, n - 1, n, m, "legacy-midpoint") for n, m in labels.items()], "route_id long, lo int, hi int, meters double, source string")
    one = lambda c, v: spark.createDataFrame([(1, 1, v)], f"route_id long, page int, {c} double")
    out = placement.decode_path(spark.createDataFrame(rows, "route_id long, page int, number int, sym_id long, t double, d double"), spans, one("scale", 0.5), one("direction", 1.0))
    best = None
    for path in itertools.product(*cands.values()):
        if any(b[1] - a[1] < 4 for a, b in zip(path, path[1:])):
            continue
        score = -sum(p[2] ** 2 / 800 for p in path) - sum(abs((b[1] - a[1]) * 0.5 - labels[n]) / 3 for n, (a, b) in zip((2, 3), zip(path, path[1:])))
        best = max(best or (-1e9, None), (score, [p[0] for p in path]))
    assert [r.sym_id for r in out.orderBy("number").collect()] == best[1]


def test_fit_page_origins_lowers_rmse(spark):
    poles = [(1, n, 1 if n <= 4 else 2, 60.0 * ((n - 1) % 4), 300.0) for n in range(1, 9)]
    xf = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.5, 0.5, 0.0), (1, 2, 150.0, 20.0, 0.5, 0.5, 0.0)], "route_id long, page int, origin_e double, origin_n double, sx double, sy double, theta double")
    pdf = spark.createDataFrame(poles, "route_id long, number int, page int, x double, y double")
    spans = spark.createDataFrame([(1, n, n + 1, 30.0, None) for n in range(1, 8)], "route_id long, lo int, hi int, meters double, source string")
    got = placement.fit_page_origins(xf, pdf, spans, spark.createDataFrame([(1, 1)], "route_id long, page int"), rounds=8).where("page = 2").first()
    assert got.rmse < got.rmse0


def test_contract_and_bridges(spark):
    # cable 1-2-3-4-5 with poles on 1, 3 and 5, and a separate pole
    links = spark.createDataFrame([(1, a, a + 1) for a in range(1, 5)], "region_id long, u long, v long")
    owner = spark.createDataFrame([(1, 1, 100), (1, 3, 300), (1, 5, 500)], "region_id long, node long, owner long")
    adj = graph.contract(links, owner)
    assert {(r.u, r.v) for r in adj.collect()} == {(100, 300), (300, 100), (300, 500), (500, 300)}
    poles = spark.createDataFrame([(1, 100, 0.0, 0.0), (1, 300, 10.0, 0.0), (1, 500, 20.0, 0.0), (1, 900, 26.0, 0.0)], "region_id long, number long, x double, y double")
    assert [(r.u, r.v) for r in graph.bridge_components(adj, poles, ["region_id"]).collect()] == [(500, 900)]
    ring = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 3, 4)], "route_id long, u long, v long")
    assert {(r.u, r.v) for r in graph.bridges(ring).collect()} == {(3, 4)}


def test_vertices_and_kinks(spark):
    stroke = [(1, 1, i, float(x), 0.0) for i, x in enumerate([0, 5, 5, 0, 5, 10, 10, 5, 10, 15])]
    kept = linework.dedupe_vertices(spark.createDataFrame(stroke, "route_id long, path_id int, seq int, x double, y double"))
    assert [r.x for r in kept.orderBy("seq").collect()] == [0.0, 5.0, 10.0, 15.0]


def test_swap_and_split(spark):
    poles = spark.createDataFrame([(1, 1, 1, 0.0, 0.0), (1, 2, 1, 60.0, 0.0), (1, 3, 1, 60.0, 90.0)], "route_id long, number int, page int, x double, y double")
    labels = spark.createDataFrame([(1, 1, 1, "45,0", 60.0, 45.0, None), (1, 2, 1, "30,0", 30.0, 0.0, None)], "route_id long, item_id long, page int, str string, x double, y double, width double")
    spans = spark.createDataFrame([(1, 1, 2, 45.0, "a"), (1, 2, 3, 30.0, "a")], "route_id long, lo int, hi int, meters double, source string")
    degree = spark.createDataFrame([(1, 1, 3)], "route_id long, number int, degree int")
    got = {r.lo: (r.meters, r.source) for r in asn.swap_at_junction(spans, labels, poles, degree).collect()}
    assert got == {1: (30.0, "dense-junction-swap"), 2: (45.0, "dense-junction-swap")}
    scales = spark.createDataFrame([(1, 1, 0.5)], "route_id long, page int, scale double")
    short = spark.createDataFrame([(1, 1, 2, 18.0, "a"), (1, 2, 3, 45.0, "a")], "route_id long, lo int, hi int, meters double, source string")
    part = spark.createDataFrame([(1, 7, 1, "12,0", 30.0, 4.0, None)], "route_id long, item_id long, page int, str string, x double, y double, width double")
    assert {r.lo: r.meters for r in asn.merge_split_labels(short, part, poles, scales).collect()} == {1: 30.0, 2: 45.0}


def test_cad_and_truth_text(spark, tmp_path):
    body = ["0", "SECTION", "2", "HEADER", "9", "$EXTMIN", "10", "1.0", "20", "2.0", "9", "$EXTMAX", "10", "9.0", "20", "8.0", "0", "ENDSEC", "0", "SECTION", "2", "BLOCKS", "0", "INSERT", "8", "Poste",
            "10", "5", "20", "5", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES", "0", "INSERT", "8", "Poste", "2", "P1", "10", "3.5", "20", "4.5", "0", "INSERT", "8", "Outro", "10", "1", "20", "1",
            "0", "LWPOLYLINE", "8", "TrechoSecundarioAereo", "10", "0", "20", "0", "10", "1", "20", "1", "10", "2", "20", "0", "0", "ENDSEC", "0", "EOF"]
    path = tmp_path / "a.dxf"
    path.write_text("\n".join(body) + "\n")
    entities = cad.read_cad_text(spark, str(path))
    assert [(r.block, r.x, r.y) for r in cad.pole_inserts(entities).collect()] == [("P1", 3.5, 4.5)]
    assert {(r.kind, r.ax, r.bx) for r in cad.polyline_edges(entities).collect()} == {("secondary", 0.0, 1.0), ("secondary", 1.0, 2.0)}
    r = cad.read_extents(spark, str(path)).first()
    assert (r.min_x, r.min_y, r.max_x, r.max_y) == (1.0, 2.0, 9.0, 8.0)
    text = tmp_path / "t.txt"
    text.write_text("Poste 01; -27.5, -48.5;\nPOSTE 2; 1.0, 2.0\nposte 3; x\nnote\n")
    assert [x.number for x in files.read_truth_text(spark, str(text)).orderBy("number").collect()] == [1, 2]
    assert files.dropped_lines(files.read_text_lines(spark, str(text))).first().dropped == 1


def test_map_text(spark):
    poles = spark.createDataFrame([(1, 5, -27.5, -48.5, None), (1, 12, -27.6, -48.6, "dwg")], "route_id long, number int, lat double, lon double, source string")
    tiers = spark.createDataFrame([(1, 12, "MED", 1.25, None)], "route_id long, number int, tier string, shape_residual_m double, anchor_gap_m double")
    text = {r.number: r.text for r in output.pole_placemarks(poles, tiers).collect()}
    assert "<name>Poste 05</name>" in text[5] and "-48.5000000,-27.5000000,0" in text[5] and "ExtendedData" not in text[5]
    assert "Confiança: MÉDIA" in text[12] and 'name="source"><value>dwg' in text[12]
    conns = spark.createDataFrame([(1, 5, 12, False, None)], "route_id long, src int, dst int, gap boolean, source string")
    line = output.line_placemarks(graph.route_polylines(conns), poles).first()
    assert line.n_points == 2 and "Poste 05 → Poste 12" in line.text


def test_an_override_of_zero_metres_wins(spark):
    seq = spark.createDataFrame([(1, 1, 2, 27.0, "legacy-midpoint"), (1, 2, 3, 28.0, "legacy-midpoint")], "route_id long, lo int, hi int, meters double, source string")
    by_hand = spark.createDataFrame([(1, 1, 2, 0.0), (1, 2, 3, None)], "route_id long, lo int, hi int, meters double")
    got = {(r.lo, r.meters, r.source) for r in asn.merge_spans(seq, seq.where("false"), by_hand).collect()}
    assert got == {(1, 0.0, "override"), (2, 28.0, "legacy-midpoint")}
