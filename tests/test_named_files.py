"""Files under exact names, and raster folders in the layout of single files."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom import GridSpec
from gridloom.sinks import rasters as out
from gridloom.sinks.named_files import NamedTextWriter, write_named_text
from gridloom.sources import rasters

SPEC = GridSpec(2, 3, 25.0, 10.0, 100.0)
HEADER = "data type   : real\ncolumns     : 3\nrows        : 2\nref. system : EPSG:25830\n"


def batch(*rows):
    return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["name", "line"])


def found(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f)).read() for d, _, names in os.walk(path) for f in names}


def test_a_task_that_runs_twice_leaves_one_file(tmp_path):
    writer = NamedTextWriter(str(tmp_path))
    lost = writer.write(iter([batch(("a.txt", "1"), ("a.txt", "half"))]))
    kept = writer.write(iter([batch(("a.txt", "1")), batch(("a.txt", "2"), ("b/c.txt", "3"))]))
    assert lost.folder != kept.folder and not (tmp_path / "a.txt").exists()
    writer.commit([kept, None])
    assert found(tmp_path) == {"a.txt": "1\n2\n", "b/c.txt": "3\n"}


def test_a_job_that_fails_leaves_nothing(tmp_path):
    writer = NamedTextWriter(f"file://{tmp_path}")
    done = writer.write(iter([batch(("a.txt", "1"))]))
    writer.abort([done])
    assert found(tmp_path) == {}
    with pytest.raises(ValueError, match="next to one another"):
        writer.write(iter([batch(("a.txt", "1"), ("b.txt", "1"), ("a.txt", "2"))]))
    writer.abort([])
    again = NamedTextWriter(str(tmp_path))
    two = [again.write(iter([batch(("a.txt", "1"))])) for _ in range(2)]
    with pytest.raises(ValueError, match="several tasks"):
        again.commit(two)
    assert found(tmp_path) == {}


def test_lines_are_in_order_and_files_are_replaced(spark, tmp_path):
    rows = spark.range(5000).select(F.format_string("f%02d.txt", F.col("id") % 7).alias("name"), (-F.col("id")).alias("k"), F.col("id").alias("line")).repartition(9)
    for _ in range(2):
        write_named_text(rows, str(tmp_path), "k")
    assert found(tmp_path) == {f"f{k:02d}.txt": "".join(f"{i}\n" for i in range(4999, -1, -1) if i % 7 == k) for k in range(7)}


def test_a_failing_job_keeps_earlier_files(spark, tmp_path):
    ok = spark.range(3).select(F.lit("a.txt").alias("name"), F.col("id").alias("line"))
    write_named_text(ok, str(tmp_path), "line")
    bad = ok.withColumn("line", F.when(F.col("line") == 2, F.raise_error(F.lit("no")).cast("long")).otherwise(9))
    with pytest.raises(Exception, match="no"):
        write_named_text(bad, str(tmp_path), "line")
    assert found(tmp_path) == {"a.txt": "0\n1\n2\n"}


def series_folder(path, frames, stamps=("2024-01-01T00:00:00", "2024-01-01T01:00:00", "2024-01-01T02:00:00.500000")):
    """A folder as array writers leave it."""
    for name, data in frames.items():
        np.savetxt(path / f"{name}.img", data, fmt="%f")
    (path / "rain.hif").write_text("file format : Hierarchical IDRISI\n" + HEADER)
    (path / "rain_metadata.json").write_text(json.dumps({"steps": 2, "downgrade_factor": 4, "timestamps": list(stamps), "filenames": ["000000", "000001"]}, indent=4))


def test_series_of_single_files(spark, tmp_path):
    data = {"000000": np.arange(6.0).reshape(2, 3), "000001": np.array([[np.nan, -9999, 1.5], [0, 0, 0]]), "000009": np.zeros((1, 1))}
    series_folder(tmp_path, data)
    rows = rasters.read_raster_series(spark, str(tmp_path), "rain").collect()
    assert {r.factor for r in rows} == {4} and len(rows) == 12
    for r in rows:
        want = data[f"{r.step:06d}"][r.row, r.col]
        assert r.value == want or (np.isnan(r.value) and np.isnan(want))
    assert {str(r.ts_end) for r in rows} == {"2024-01-01 01:00:00", "2024-01-01 02:00:00.500000"}


@pytest.mark.parametrize("broken,says", [(np.zeros((1, 3)), "does not fit"), (np.zeros((2, 4)), "does not fit"), (None, "not found")])
def test_series_with_a_bad_frame(spark, tmp_path, broken, says):
    frames = {"000000": np.zeros((2, 3))} | ({} if broken is None else {"000001": broken})
    series_folder(tmp_path, frames)
    with pytest.raises(Exception, match=says):
        rasters.read_raster_series(spark, str(tmp_path), "rain").collect()


def test_series_is_written_in_the_layout_that_is_read(spark, tmp_path):
    cells = [(s, r, c, None if (s, r, c) == (7, 0, 0) else s + r * 3 + c / 8) for s in (3, 7) for r in range(2) for c in range(3)]
    series = spark.createDataFrame(cells, "step int, row int, col int, value double")
    index = spark.sql("select 3 as step, timestamp_ntz'2024-01-01 00:00:00' as ts_start, timestamp_ntz'2024-01-01 00:30:00.25' as ts_end union all select 7, timestamp_ntz'2024-01-01 00:30:00.25', timestamp_ntz'2024-01-01 01:00:00'")
    out.write_raster_series(series, index, SPEC, str(tmp_path), "rain", 2)
    assert sorted(found(tmp_path)) == ["000000.img", "000001.img", "rain.hif", "rain_metadata.json"]
    assert json.loads((tmp_path / "rain_metadata.json").read_text()) == {
        "steps": 2, "downgrade_factor": 2, "timestamps": ["2024-01-01T00:00:00", "2024-01-01T00:30:00.250000", "2024-01-01T01:00:00"], "filenames": ["000000", "000001"]
    }
    lines = (tmp_path / "rain.hif").read_text().splitlines()
    assert len(lines) == 20 and lines[0] == "file format : Hierarchical IDRISI" and "rows        : 2" in lines
    assert np.loadtxt(tmp_path / "000001.img").tolist() == [[-9999, 7.125, 7.25], [10, 10.125, 10.25]]
    back = rasters.read_raster_series(spark, str(tmp_path), "rain")
    assert {(r.step, r.row, r.col): r.value for r in back.collect()} == {(0 if s == 3 else 1, r, c): -9999 if v is None else v for s, r, c, v in cells}


def test_rasters_with_headers(spark, tmp_path):
    cells = spark.createDataFrame([(r, c, r * 3 + c) for r in range(2) for c in range(3)], "row int, col int, value int")
    out.write_raster(cells, SPEC, str(tmp_path), "a", data_type="integer")
    out.write_raster(cells.withColumn("value", F.col("value") / 2), SPEC, str(tmp_path), "b")
    assert (tmp_path / "a.img").read_text() == "0 1 2\n3 4 5\n"
    assert len((tmp_path / "a.doc").read_text().splitlines()) == 21
    got = rasters.read_rasters(spark, str(tmp_path)).groupBy("raster").agg(F.sum("value").alias("v")).collect()
    assert {r.raster: r.v for r in got} == {"a": 15.0, "b": 7.5}
    (tmp_path / "b.img").write_text("0 1 2\n")
    with pytest.raises(Exception, match="does not fit"):
        rasters.read_rasters(spark, str(tmp_path)).collect()
    (tmp_path / "c.doc").write_text(HEADER)
    (tmp_path / "b.doc").unlink()
    with pytest.raises(Exception, match="not found: c"):
        rasters.read_rasters(spark, str(tmp_path)).collect()


def test_sparse_frames_of_single_files(spark, tmp_path):
    frames = spark.createDataFrame([(0, 1, 2, 3), (0, 0, 1, 1), (0, 0, 0, 0), (1, 0, 0, 0)], "step int, row int, col int, risk int")
    out.write_sparse_frames(frames, SPEC, str(tmp_path))
    head = "# rows=2 cols=3 cell_size_m=25.0\nrow,col,flood_risk\n"
    files = found(tmp_path)
    assert json.loads(files.pop("meta.json")) == {"rows": 2, "cols": 3, "cell_size_m": 25.0}
    assert files == {"step_00000.csv": head + "0,1,1\n1,2,3\n", "step_00001.csv": head}
    assert sorted(map(tuple, rasters.read_sparse_frames(spark, str(tmp_path), 2, 3).collect())) == [(0, 0, 1, 1), (0, 1, 2, 3)]
