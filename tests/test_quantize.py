"""Files in, smaller files out; options; a command line; and the same for a growing folder."""

import json
import os
import stat

import numpy as np
import pytest

from tessera import cli, files
from tessera.errors import DataError, IoError, UsageError, exit_code
from tessera.operators import pack
from tessera.plans import quantize as Q
from tessera.plans.quantize import Options, quantise, quantize
from tessera.sources import png
from tessera.streaming.images import pack_folder


def image(seed):
    rng = np.random.default_rng(seed)
    colours = rng.integers(0, 256, (12, 4))
    colours[:5, 3], colours[5, 3] = 255, 0
    return pack.write_indexed(rng.integers(0, 12, (10, 14)), colours)


@pytest.fixture(scope="module")
def images(spark):
    rows = [(1, bytearray(image(1))), (2, bytearray(image(2))), (3, bytearray(b"broken")), (4, None)]
    return spark.createDataFrame(rows, "image_id bigint, content binary").cache()


PLAIN = {"adaptive": "off"}


@pytest.mark.parametrize("options", [Options(), Options(space="oklab", memory=True), Options(pack="fast", evidence=True), Options(pack="fast", search="v2", **PLAIN), Options(sort=False, **PLAIN)])
def test_enough_colours_lose_nothing(images, options):
    got = {r.image_id: r for r in quantize(images, options).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(got[i].error_kind == "data" and got[i].content is None for i in (3, 4))
    for i in (1, 2):
        want, have = png.decode(image(i)).rgba, png.decode(bytes(got[i].content)).rgba
        assert got[i].bytes_out <= got[i].bytes_in and np.array_equal(want[..., 3], have[..., 3])
        assert np.array_equal(want[want[..., 3] > 0], have[want[..., 3] > 0])
        assert list(json.loads(got[i].report)) == list(Q.REPORT) and got[i].notes.sampled_pixels == 140


def test_nothing_is_shuffled(images):
    plan = quantize(images)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1


@pytest.mark.parametrize("policy", Q.POLICIES)
def test_few_colours_and_dithering(images, policy):
    o = Options(colours=5, dither=True, policy=policy, evidence=True, **PLAIN)
    got = quantize(images, o).where("image_id < 3").collect()
    assert len(got) == 2 and all(png.decode(bytes(r.content)).rgba.shape == (10, 14, 4) and r.dither_algorithm != "none" for r in got)


def test_an_image_without_an_entry_is_an_error_row(spark):
    mixed = pack.write_indexed(np.array([[0, 1], [2, 1]]), np.array([[9, 9, 9, 0], [200, 0, 0, 255], [0, 99, 0, 120]]))
    rows = spark.createDataFrame([(1, bytearray(mixed)), (2, bytearray(image(2)))], "image_id bigint, content binary")
    got = {r.image_id: r for r in quantize(rows, Options(colours=1)).collect()}
    assert got[1].error_kind == "data" and "cannot dither" in got[1].error_message
    assert quantize(rows, Options(colours=1, **PLAIN)).where("error_kind is null").count() == 2


def test_guard_and_explicit_strength():
    soft = pack.write_indexed(np.arange(64).reshape(8, 8), np.concatenate([np.arange(192).reshape(64, 3), np.full((64, 1), 90)], 1))
    got = quantise(soft, Options(colours=9))
    assert got.guard_fired and got.algorithm == "none" and quantise(soft, Options(colours=9, adaptive=True)).algorithm != "none"
    named = quantise(image(1), Options(colours=5, dither=True, policy="adaptive-unit", strength=(1, 3), **PLAIN))
    assert named.strength == (1, 3)


@pytest.mark.parametrize("bad", [
    {"colours": 0}, {"space": "lab"}, {"adaptive": "much"}, {"strength": (1, 0), **PLAIN}, {"pack": "best"}, {"search": "v3"}, {"hidden": "white"}, {"policy": "odd", **PLAIN},
    {"dither": True}, {"strength": (1, 1)}, {"policy": "region", **PLAIN}, {"policy": "region", "dither": True, "strength": (1, 2), **PLAIN}, {"pack": "fast", "sort": True},
    {"fewest": (5, 4, 50.0)}, {"fewest": (1, 4, 101.0)}, {"fewest": (1, 4, 50.0), "colours": 8},
])
def test_bad_options(bad):
    with pytest.raises(DataError):
        Options(**bad)


def test_options_are_refused_in_order():
    every = {"adaptive": "on", "dither": True, "colours": 0, "hidden": "x", "space": "x", "policy": "x", "pack": "x", "search": "x"}
    for key, word in (("dither", "combined"), ("colours", "colours"), ("hidden", "hidden"), ("space", "space"), ("policy", "policy"), ("pack", "pack mode"), ("search", "search")):
        with pytest.raises(DataError, match=word):
            Options(**every)
        del every[key]
        every["adaptive"] = "off"
    assert Options(sort=True).seams == (True, False, False) and Options().seams == (True, False, True) and Options(pack="max").seams == (False,) * 3


def test_fewest_colours():
    assert Q.sizes("2..12@55.5") == (2, 12, 55.5)
    for bad in ("2..12", "a..3@5", "1..300@5", "5..2@1", "1..2@x", "1..2@nan", "1..2@5@6", "1..2..3@4"):
        with pytest.raises(DataError):
            Q.sizes(bad)
    curve = [Q.ceiling(q) for q in range(101)]
    assert all(a > b for a, b in zip(curve, curve[1:]))
    got = quantise(image(1), Options(fewest=(2, 12, 20.0)))
    assert sorted(got.trace["errors"]) == list(range(2, 13)) and got.colours == min(got.trace["passing"] or [12])
    assert got.trace["errors"][got.colours] <= Q.ceiling(20.0) or got.trace["fallback"]


@pytest.mark.parametrize("argv,code", [
    ([], 0), (["--colors", "7", "--report", "json"], 0), (["--adaptive-default", "off", "--dither", "on", "--dither-strength", "1e-1"], 0), (["--colors-search", "2..9@30"], 0),
    (["--threads", "8", "--parallel-merge-order", "shuffle:5", "--max-pixels", "1_000"], 0), (["--version"], 0), (["--help", "--bogus"], 0),
    (["--bogus"], 2), (["--colors"], 2), (["--colors", "x"], 2), (["--dither", "on"], 2), (["--pack-search", "v1"], 2), (["--pack", "fast", "--pack-seam-memlevel", "on"], 2),
    (["--threads", "0"], 2), (["--parallel-merge-order", "shuffle:x"], 2), (["--max-pixels", "0"], 2), (["--report", "xml"], 2), (["--colors", "5", "--colors-search", "2..9@30"], 2),
    (["--adaptive-default", "off", "--dither-policy", "region"], 2), (["third.png"], 2), (["--colors", "0"], 3), (["--hidden-rgb-policy", "x"], 3), (["--max-pixels", "9"], 3),
])
def test_command_line(tmp_path, capsys, argv, code):
    source = tmp_path / "a.png"
    source.write_bytes(image(1))
    assert cli.main([str(source), str(tmp_path / "b.png"), *argv]) == code
    out = capsys.readouterr()
    if "json" in argv:
        assert json.loads(out.out)["schema_version"] == Q.SCHEMA
    assert bool(out.err) == (code > 0) and sorted(os.listdir(tmp_path)) == (["a.png", "b.png"] if code == 0 and not {"--version", "--help"} & set(argv) else ["a.png"])


def test_exit_codes_and_merge_orders():
    assert [exit_code(e("x")) for e in (UsageError, DataError, IoError)] == [2, 3, 5] and cli.main(["/none.png", "/none/b.png"]) == 5
    assert [cli.merge_order(t) for t in ("balanced", "shuffle:18446744073709551615")] == [("balanced", None), ("shuffle", (1 << 64) - 1)]


def test_publication_replaces_at_once(tmp_path):
    a, b = tmp_path / "a.png", tmp_path / "b.png"
    a.write_bytes(image(1))
    a.chmod(0o640)
    b.symlink_to(a)
    files.publish(b, b"new")
    assert b.read_bytes() == b"new" and not b.is_symlink() and stat.S_IMODE(b.stat().st_mode) == 0o640 and a.read_bytes() == image(1)
    files.quantize_file(str(a), str(a), Options(colours=4, **PLAIN))
    assert png.decode(a.read_bytes()).rgba.shape == (10, 14, 4) and sorted(os.listdir(tmp_path)) == ["a.png", "b.png"]
    (tmp_path / "folder").mkdir()
    for target in (tmp_path / "folder", tmp_path / "none" / "x.png"):
        with pytest.raises(IoError):
            files.publish(target, b"x")
    assert sorted(os.listdir(tmp_path)) == ["a.png", "b.png", "folder"]


def test_never_worse(tmp_path):
    tiny = pack.encode(np.zeros((1, 1), int), np.array([[1, 2, 3, 255]]), "none")
    got = quantise(tiny, Options(**PLAIN, sort=False))
    assert got.fallback and got.content == tiny and json.loads(got.summary()["report"])["candidate"] == "input-verbatim"


def test_folder_as_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    for round_, count in ((1, 1), (2, 3)):
        (source / f"{round_}.png").write_bytes(image(round_))
        (source / f"{round_}b.png").write_bytes(image(round_ + 5)) if round_ == 2 else None
        pack_folder(spark, str(source), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).where("error_kind is null").count() == count
