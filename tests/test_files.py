import pytest

from conftest import SF

import __spark_entry__ as entry
from gridloom.operators.gauges import union_sources
from gridloom.sources import rasters, stations

QUERIES = entry.queries()


def test_line_numbers_are_exact_across_blocks(spark, tmp_path):
    for name, n in (("a", 3000), ("b", 7)):
        (tmp_path / f"{name}.img").write_text("".join(f"{name}{i} {'x' * (i % 50)}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = rasters.read_lines(spark, str(tmp_path))
        got = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 3007
    assert all(r.value.split()[0] == f"{r.raster[-5]}{r.line}" for r in got)


def test_short_raster_is_an_error(spark, tmp_path):
    (tmp_path / "a.img").write_text("1 2 3\n4 5 6\n")
    assert rasters.read_ascii_raster(spark, str(tmp_path), shape=(2, 3)).count() == 6
    with pytest.raises(Exception, match="does not fit"):
        rasters.read_ascii_raster(spark, str(tmp_path), shape=(3, 3)).collect()


def test_sparse_csv_with_comment_and_outside_rows(spark, tmp_path):
    (tmp_path / "step_00000.csv").write_text("# rows=4 cols=5 cell_size_m=10.0\nrow,col,flood_risk\n0,0,1\n1,2,3\n9,9,2\n")
    (tmp_path / "step_00001.csv").write_text("# rows=4 cols=5 cell_size_m=10.0\nrow,col,flood_risk\n3,4,5\n")
    got = sorted(map(tuple, rasters.read_sparse_frames(spark, str(tmp_path), 4, 5).collect()))
    assert got == [(0, 0, 0, 1), (0, 1, 2, 3), (1, 3, 4, 5)]


def test_header_values_may_hold_colons(spark, tmp_path):
    (tmp_path / "a.doc").write_text("columns     : 3\nrows        : 2\nref. system : EPSG:25830\nmin. X      : 1.5\nbad line\n")
    r = rasters.read_raster_headers(spark, str(tmp_path)).first()
    assert (r.cols, r.rows, r.crs, r.min_x) == (3, 2, "EPSG:25830", 1.5)


def test_alias_json(spark, tmp_path):
    (tmp_path / "m.json").write_text('{\n "S1": ["A", "B"],\n "S2": []\n}')
    assert sorted(map(tuple, stations.read_aliases(spark, str(tmp_path)).collect())) == [("S1", "A"), ("S1", "B")]


def test_union_needs_one_source(spark):
    with pytest.raises(ValueError):
        union_sources(lambda: spark.read.parquet("/nonexistent/x"))


PLANNED = [n for n in QUERIES if n[0] in "BCDEFG" and n not in ("D4_grow_region", "G11_grid_at", "G15_frames_stream", "G16_grid_sink", "G22_initial_grid")]


@pytest.mark.parametrize("name", PLANNED)
def test_plan_pairs_rows_only_through_keys(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_features_of_all_polygon_forms(spark, tmp_path):
    from gridloom.sources.stations import features_without_rings, read_features

    ring = lambda n: f"<g:LinearRing><g:posList>{n} 0 {n} 1 {n + 1} 1</g:posList></g:LinearRing>"
    part = lambda tag, n: f"<g:{tag}><g:exterior>{ring(n)}</g:exterior></g:{tag}>"
    hole = f"<g:Polygon><g:exterior>{ring(1)}</g:exterior><g:interior>{ring(2)}</g:interior></g:Polygon>"
    forms = {
        "a": hole,
        "b": f"<g:MultiSurface><g:surfaceMember>{part('Polygon', 3)}</g:surfaceMember><g:surfaceMember>{part('Polygon', 4)}</g:surfaceMember></g:MultiSurface>",
        "c": f"<g:Surface><g:patches>{part('PolygonPatch', 5)}{part('PolygonPatch', 6)}</g:patches></g:Surface>",
        "d": "<g:Point><g:pos>1 2</g:pos></g:Point>",
    }
    body = "".join(f'<u:LandCoverUnit id="{k}"><u:class href="x/111"/><u:geometry>{v}</u:geometry></u:LandCoverUnit>' for k, v in forms.items())
    (tmp_path / "f.xml").write_text(f'<r xmlns:u="urn:u" xmlns:g="urn:g">{body}</r>')
    good, bad = features_without_rings(read_features(spark, str(tmp_path)))
    got = {r["feature_id"]: [ring[0]["x"] for ring in r["rings"]] for r in good.collect()}
    assert got == {"a": [1.0, 2.0], "b": [3.0, 4.0], "c": [5.0, 6.0]}
    assert [r["feature_id"] for r in bad.collect()] == ["d"]
