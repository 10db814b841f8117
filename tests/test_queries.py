"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from tessera.operators import assign, dither, regions
from tessera.plans import catalog
from tessera.plans.catalog import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=str)
    assert rows == sorted((tuple(dict(zip(want.columns, x))[c] for c in order) for x in want.fetchall()), key=str)


def test_scenes_reach_every_branch(spark):
    px = catalog.scenes(spark, "/root/testdata/sf0.01")
    classes = {r["class"] for r in regions.classify(px, catalog.pal(px)).select("class").distinct().collect()}
    assert classes == set(regions.NAMES)
    modes = catalog.H.histogram(px, catalog.LIMIT).select("exact").distinct().collect()
    assert {r.exact for r in modes} == {True, False}
    sizes = QUERIES["scene_fewest_colors"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.k for r in sizes}) > 2 and {r.fallback for r in sizes} == {True, False}


@pytest.mark.parametrize("name", ["trial_deflate", "greedy_orders", "fs_dither", "palette_fit", "seam_search", "quantize_files_dithered", "oklab_remap"])
def test_query_without_sql(spark, name):
    first, again = (sorted(map(str, QUERIES[name](spark, SMALL).collect())) for _ in (0, 1))
    assert first and first == again


def test_partitioning_does_not_matter(spark):
    from tessera.operators import histogram

    px = catalog.scenes(spark, SMALL)
    found = [sorted(map(tuple, histogram.finalise(histogram.histogram(px.repartition(n), 1000)).collect())) for n in (1, 3, 7)]
    assert found[0] == found[1] == found[2]


def test_images_that_a_palette_cannot_serve(spark):
    """Null results for the image, the others go on."""
    rows = [(i, y * 2 + x, y, x, 10 * x, 0, 0, 255 if i else 99) for i in (0, 1) for y in (0, 1) for x in (0, 1)]
    px = spark.createDataFrame(rows, "image_id bigint, pos bigint, y bigint, x bigint, r bigint, g bigint, b bigint, a bigint")
    entries = spark.createDataFrame([(i, 0, 5, 0, 0, 255) for i in (0, 1)], "image_id bigint, idx bigint, r bigint, g bigint, b bigint, a bigint")
    for found, column in ((regions.classify(px, entries), "class"), (dither.floyd_steinberg(px, entries), "idx"), (assign.nearest(assign.featured(px), entries, ["pos"]), "idx")):
        assert {(r.image_id, r[column] is None) for r in found.collect()} == {(0, True), (1, False)}
    lost = assign.unmatched(assign.nearest(assign.featured(px), entries, ["pos"])).collect()
    assert [tuple(r) for r in lost] == [(0, 4)]
    assert {r.idx for r in assign.remap(px, entries).collect()} == {0}


def test_nearest_entries_come_without_more_rows(spark):
    """Neither colours nor entries are multiplied, and pixels aren't shuffled but by image."""
    px = catalog.pixels(spark, SMALL)
    plan = assign.remap(px, catalog.pal(px))._jdf.queryExecution().executedPlan().toString()
    assert "Explode" not in plan.split("Join")[0] and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_decoded_files_as_rows(spark, tmp_path):
    from tessera.operators import pack
    from tessera.sources import png

    (tmp_path / "a.png").write_bytes(pack.write_indexed(np.array([[0, 1]]), np.array([[1, 2, 3, 255], [4, 5, 6, 0]])))
    (tmp_path / "b.png").write_bytes(b"broken")
    got = png.decode_images(png.read_files(spark, str(tmp_path))).cache()
    assert got.where("error_kind = 'data'").count() == 1
    good = got.where("error_kind is null").first()
    assert bytes(good.plte) == b"\1\2\3\4\5\6" and bytes(good.trns) == b"\xff\0" and good.conversions == ["palette:plte-lookup", "trns:palette-entry-alpha(default-255)"]
    assert sorted(tuple(r)[2:] for r in png.pixels(got).collect()) == [(0, 0, 1, 2, 3, 255), (0, 1, 4, 5, 6, 0)]


def test_large_files_are_never_read(spark, tmp_path, monkeypatch):
    from tessera.sources import png

    (tmp_path / "a.png").write_bytes(bytes(100))
    monkeypatch.setattr(png, "MOST_FILE", 50)
    files = png.read_files(spark, str(tmp_path))
    assert [r.content for r in files.collect()] == [None]
    assert "LessThanOrEqual(length,50)" in files._jdf.queryExecution().executedPlan().toString()
