"""CAD text over many splits against a plain reader, line by line."""
import random
import re

from pyspark.sql import functions as F

from routekit.sources import cad


def plain(text):
    """(inserts, vertices per polyline, extents) as one task would read them."""
    lines = [line.strip() for line in re.split("\r\n|\n|\r", text)]
    pairs, k = [], 0
    while k < len(lines) and lines[k] != "":
        m = re.match(r"[+-]?\d+", lines[k])
        if m:
            pairs.append((int(m[0]), lines[k + 1] if k + 1 < len(lines) else ""))
        k += 2 if m else 1
    number = lambda v: (lambda m: float(m[0]) if m else None)(re.match(cad.REAL, v))
    section, ent, inserts, lines_, extents, var = None, None, [], [], {}, None

    def flush():
        if section == "ENTITIES" and ent:
            if ent["type"] == "INSERT" and ent["layer"] == cad.POLE_LAYER and ent.get("x") is not None and ent.get("y") is not None:
                inserts.append((ent.get("block", "unknown"), ent["x"], ent["y"]))
            if ent["type"] == "LWPOLYLINE" and ent["poly"]:
                lines_.append((ent["poly"], tuple(map(tuple, ent["vs"]))))

    k = 0
    while k < len(pairs):
        code, value = pairs[k]
        k += 1
        if code == 0:
            flush()
            ent = {"type": value, "layer": None, "poly": None, "vs": []}
            if value == "SECTION":
                section, var = "", None
                if k < len(pairs) and pairs[k][0] == 2:
                    section = pairs[k][1]
            elif value == "ENDSEC":
                section = ""
        elif section == "HEADER":
            var = value if code == 9 else var
            if code in (10, 20):
                extents[(var, code)] = number(value)
        elif section == "ENTITIES" and ent:
            if code == 8:
                ent["layer"] = value
                if ent["type"] == "LWPOLYLINE" and value in cad.CABLE_LAYERS:
                    ent["poly"] = value
            elif ent["type"] == "INSERT" and ent["layer"] == cad.POLE_LAYER:
                if code == 2:
                    ent["block"] = value
                elif code in (10, 20):
                    ent["x" if code == 10 else "y"] = number(value)
            elif ent["type"] == "LWPOLYLINE" and ent["poly"]:
                if code == 10:
                    ent["vs"].append([number(value), None])
                elif code == 20 and ent["vs"]:
                    ent["vs"][-1][1] = number(value)
    flush()
    get = lambda *key: extents.get(key) or 0.0
    return sorted(inserts), sorted(v for v in lines_ if v[1]), (get("$EXTMIN", 10), get("$EXTMIN", 20), get("$EXTMAX", 10), get("$EXTMAX", 20))


def drawing(deal, n, stray):
    out = ["0", "SECTION", "2", "HEADER", "9", "$EXTMIN", "10", "1.5", "20", "2.5", "9", "$EXTMAX", "10", "7", "20", "8e1", "0", "ENDSEC", "0", "SECTION", "2", "BLOCKS", "0", "INSERT", "8", "Poste", "10", "1", "20", "1", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]
    for k in range(n):
        kind = deal.random()
        if kind < 0.4:
            out += ["0", "INSERT", "8", deal.choice(["Poste", "Outro"]), "2", f"B{k}", "10", f"{k}.25", "20", str(-k), "62", str(k)]
        elif kind < 0.8:
            out += ["0", "LWPOLYLINE", "8", deal.choice(["TrechoSecundarioAereo", "TrechoPrimarioAereo", "x"])] + [v for j in range(deal.choice([1, 2, 5, 60])) for v in ("10", str(k + j), "20", f"{j}.5")]
        elif kind < 0.9:
            out += ["0", "ENDSEC", "0", "SECTION", "2", deal.choice(["ENTITIES", "OBJECTS", "ENTITIES"])]
        else:
            out += ["0", "LINE"] + ["70", "0"] * deal.choice([0, 3, 200]) + ["1", ""]
        if stray and deal.random() < 0.1:
            out.insert(len(out) - deal.randint(0, 3), deal.choice(["stray line", "12", "-", "99999999999999999999", "20x"]))
    return out + ["0", "ENDSEC", "0", "EOF"]


def found(spark, path):
    entities = cad.read_cad_text(spark, path)
    rows = entities.collect()
    polys = {}
    for r in sorted(rows, key=lambda r: r.seq):
        if r.type == "LWPOLYLINE":
            polys.setdefault((r.entity, r.layer), []).append((r.x, r.y))
    return sorted((r.block, r.x, r.y) for r in rows if r.type == "INSERT"), sorted((layer, tuple(v)) for (_, layer), v in polys.items()), tuple(cad.read_extents(spark, path).first() or (0.0,) * 4)[-4:]


def key(parts):
    return [sorted(map(repr, p)) if isinstance(p, list) else p for p in parts]


def test_splits_and_stray_lines(spark, tmp_path):
    deal = random.Random(11)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for k, (stray, end, size) in enumerate([(True, "\n", 457), (True, "\r\n", 3001)]):
            lines = drawing(deal, 30, stray)
            if k == 0:
                lines[300:300] = ["5"] * 301  # splits of numbers only
            if k == 1:
                lines.insert(lines.index("ENTITIES") + 300, "")  # may end the file
            text = end.join(lines) + end
            path = tmp_path / f"{k}.dxf"
            path.write_text(text, newline="")
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 1)
            assert key(found(spark, str(path))) == key(plain(text)), k
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_long_entities_and_stops(spark, tmp_path, monkeypatch):
    text = "\n".join(drawing(random.Random(3), 40, True)) + "\n"
    reader = cad.Split("f", 0)
    import pyarrow as pa
    monkeypatch.setattr(cad, "CARRY", 20)
    for low in range(0, len(text.split("\n")), 7):
        reader.feed(pa.array(text.split("\n")[low:low + 7]))
    kinds = {}
    for batch in reader.close():
        for row in batch.to_pylist():
            kinds.setdefault(row["kind"], []).append(row)
    assert len(kinds["end"]) == 1 and kinds["pair"] and all(row["at"] < kinds["end"][0]["at"] for row in kinds["pair"])
    for name, body in (("empty.dxf", ""), ("blank.dxf", "\n0\nSECTION\n2\nENTITIES\n0\nINSERT\n8\nPoste\n10\n1\n20\n2\n")):
        (tmp_path / name).write_text(body)
        assert cad.read_cad_text(spark, str(tmp_path / name)).count() == 0 and cad.read_extents(spark, str(tmp_path / name)).count() == 0


def test_files_are_kept_apart(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.dxf").write_text("\n".join(drawing(random.Random(k), 30, False)) + "\n")
    rows = cad.read_cad_text(spark, str(tmp_path)).where("type = 'INSERT'").groupBy(F.substring_index("file", "/", -1).alias("name")).count().collect()
    assert {r["name"]: r["count"] for r in rows} == {f"{k}.dxf": len(plain((tmp_path / f"{k}.dxf").read_text())[0]) for k in range(3)}
