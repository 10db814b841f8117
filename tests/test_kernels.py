"""Kernels on small inputs: decoding, encoding, palettes, diffusion, regions."""

import struct
import zlib

import numpy as np
import pytest

from tessera.errors import DataError, InternalError, UsageError
from tessera.functions import numbers
from tessera.operators import dither, oklab, pack, palette, raster, regions, search
from tessera.sources import png


def file(w, h, depth, colour, raw, interlace=0, extra=b""):
    head = struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlace)
    return png.SIGNATURE + png.chunk(b"IHDR", head) + extra + png.chunk(b"IDAT", zlib.compress(raw)) + png.chunk(b"IEND", b"")


def test_round_trip_of_every_filter():
    rng = np.random.default_rng(1)
    idx, colours = rng.integers(0, 5, (9, 13)), rng.integers(0, 256, (5, 4))
    for f in (*pack.FILTERS, "trial-zlib"):
        assert np.array_equal(png.decode(pack.encode(idx, colours, f)).rgba, colours[idx])


def test_interlaced_equals_plain():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 256, (8, 8), dtype=np.uint8)
    rows = lambda x: b"".join(b"\0" + r.tobytes() for r in x)
    laced = b"".join(rows(v[y::dy, x::dx]) for x, y, dx, dy in png.PASSES)
    assert np.array_equal(png.decode(file(8, 8, 8, 0, laced, 1)).rgba, png.decode(file(8, 8, 8, 0, rows(v))).rgba)


def test_sixteen_bits_round_and_keys_match_before():
    raw = b"\0" + struct.pack(">HHHHHH", 1, 2, 3, 65535, 32768, 0)
    got = png.decode(file(2, 1, 16, 2, raw, extra=png.chunk(b"tRNS", struct.pack(">HHH", 1, 2, 3)))).rgba
    assert got[0].tolist() == [[0, 0, 0, 0], [255, 128, 0, 255]]


@pytest.mark.parametrize("damage", [lambda d: b"", lambda d: d[:20], lambda d: d[:-1], lambda d: d[:30] + b"x" + d[31:], lambda d: b"nonsense" + d])
def test_damage_is_a_data_error(damage):
    good = pack.write_indexed(np.zeros((2, 2), int), np.array([[1, 2, 3, 255]]))
    with pytest.raises(DataError):
        png.decode(damage(good))


def test_limits_come_before_inflation():
    with pytest.raises(DataError, match="dimension"):
        png.decode(file(40000, 1, 8, 0, b"\0"))
    with pytest.raises(DataError, match="pixel"):
        png.decode(file(30000, 30000, 8, 0, b"\0"))
    with pytest.raises(DataError, match="too long"):
        png.decode(file(8, 8, 8, 2, bytes(1 << 20)))


def bins_of(pixels):
    colours, n = np.unique(np.array(pixels), axis=0, return_counts=True)
    r, g, b, a = colours.T
    return {"n": n, "sr": r * n, "sg": g * n, "sb": b * n, "sa": a * n, "sar": a * r * n, "sag": a * g * n, "sab": a * b * n}


#: The pixels of the next tests are those of the published fixtures.
def test_few_colours_stay_exact():
    px = [(236, 32, 55, 255)] * 10 + [(238, 238, 247, 255)] * 5 + [(52, 57, 203, 255)] * 7 + [(0, 0, 0, 255), (255, 255, 255, 255), (9, 9, 9, 255)]
    assert {tuple(c) for c in palette.fit(bins_of(px), 6, True).palette.tolist()} == set(px)


def test_forced_merge_keeps_member_means():
    px = [(10, 10, 10, 255)] * 1000 + [(30, 30, 30, 255)] * 1000 + [(20, 20, 20, 255)]
    assert sorted(palette.fit(bins_of(px), 2, True).palette[:, 0].tolist()) == [10, 30]


def test_transparent_stays_transparent_under_a_tiny_cap():
    px = [(1, 2, 3, 0), (4, 5, 6, 255), (7, 8, 9, 128), (10, 11, 12, 13)]
    for cap in (1, 2, 3):
        assert [0, 0, 0, 0] in palette.fit(bins_of(px), cap, True).palette.tolist()


def test_diffusion_equals_uniform_strength():
    image = np.zeros((6, 6, 4), int)
    image[..., 0], image[..., 3] = np.arange(36).reshape(6, 6) * 7, 255
    entries = np.array([[0, 0, 0, 255], [128, 0, 0, 255], [255, 0, 0, 255]])
    full = dither.Directives.uniform((6, 6), 1, 1)
    assert np.array_equal(dither.diffuse(image, entries), dither.diffuse(image, entries, full))
    still = dither.diffuse(image, entries, dither.Directives.uniform((6, 6), 0, 1))
    assert np.array_equal(still, abs(image[..., :1] - entries[:, 0]).argmin(-1))
    with pytest.raises(DataError):
        dither.diffuse(np.zeros((1, 1, 4), int), entries)
    with pytest.raises(DataError):
        dither.diffuse(image, entries, dither.Directives.uniform((6, 6), 1, 0))


def plain_diffusion(image, entries, d, serpentine):
    """Error diffusion as its definition reads, pixel by pixel."""
    f, e = palette.feature(image), palette.feature(entries)
    zones, kinds = palette.zone(image[..., 3]), palette.zone(entries[:, 3])
    h, w = zones.shape
    left, out, passed, dropped = np.zeros((h, w, 4), object), np.zeros((h, w), int), 0, 0
    for y in range(h):
        back = serpentine and y % 2
        for x in range(w)[:: -1 if back else 1]:
            v = [min(65025, max(0, int(f[y, x, c]) + left[y, x, c])) for c in range(4)]
            own = [i for i in range(len(e)) if kinds[i] == zones[y, x]]
            out[y, x] = best = min(own, key=lambda i: (sum((v[c] - int(e[i, c])) ** 2 for c in range(4)), i))
            for dx, dy, weight in dither.KERNEL:
                nx, ny = x - dx if back else x + dx, y + dy
                if not (0 <= nx < w and ny < h):
                    continue
                if zones[ny, nx] != zones[y, x] or d.region[ny, nx] != d.region[y, x] or d.barrier[ny, nx] or d.barrier[y, x]:
                    dropped += 1
                    continue
                passed += 1
                for c in range(4):
                    left[ny, nx, c] += dither.round_away((v[c] - int(e[best, c])) * weight * int(d.num[y, x]), 16 * int(d.den[y, x]))
    return out, passed, dropped


@pytest.mark.parametrize("serpentine", [True, False])
def test_diffusion_equals_its_definition(serpentine):
    rng = np.random.default_rng(7)
    image = rng.integers(0, 256, (9, 11, 4))
    image[..., 3] = rng.choice([0, 90, 200, 255, 255], (9, 11))
    entries = np.concatenate([rng.integers(0, 256, (7, 4)), [[0, 0, 0, 0], [9, 9, 9, 255], [80, 99, 3, 120]]])
    d = dither.Directives(rng.integers(0, 2, (9, 11)), rng.random((9, 11)) < 0.1, rng.integers(0, 4, (9, 11)), rng.integers(4, 9, (9, 11)))
    got, seen = dither.diffuse_with_evidence(image, entries, d, serpentine=serpentine)
    want, passed, dropped = plain_diffusion(image, entries, d, serpentine)
    assert np.array_equal(got, want) and (seen.transported_edges, seen.discarded_edges) == (passed, dropped) and seen.changed > 0
    hook = lambda x, y, pixel: (d.region[y, x], d.barrier[y, x], d.num[y, x], d.den[y, x])
    assert np.array_equal(dither.diffuse(image, entries, dither.Directives.from_hook(image, hook), serpentine=serpentine), want)


def test_masks_hold_every_rank_and_published_ones_are_tested(tmp_path):
    for mask in dither.own_masks():
        assert sorted(mask.ravel().tolist()) == list(range(4096))
    (tmp_path / "m.json").write_text('{"seed":20260719,"ranks_row_major":[1]}')
    with pytest.raises(InternalError):
        dither.read_masks([str(tmp_path / "m.json")] * 3)


def test_ordered_dithering_of_a_ramp():
    image = np.zeros((4, 16, 4), int)
    image[..., :3], image[..., 3] = (40 + 10 * np.arange(16))[None, :, None], 255
    entries = np.array([[0, 0, 0, 255], [85, 85, 85, 255], [170, 170, 170, 255], [255, 255, 255, 255]])
    masks = dither.own_masks()
    nearest = abs(image[..., :1] - entries[:, 0]).argmin(-1)
    assert np.array_equal(dither.ordered(image, entries, masks, 4, 0, 1), nearest)
    noisy = dither.ordered(image, entries, masks, 4)
    assert not np.array_equal(noisy, nearest) and abs(noisy - nearest).max() <= 1
    with pytest.raises(DataError):
        dither.ordered(image, entries, masks, 0)


def plain_classes(image, entries):
    """The classifier as its definition reads, pixel by pixel."""
    f, e = palette.feature(image), palette.feature(entries)
    zones, kinds = palette.zone(image[..., 3]), palette.zone(entries[:, 3])
    h, w = zones.shape
    beside = lambda y, x: [(y + b, x + a) for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1)) if 0 <= y + b < h and 0 <= x + a < w]
    step = lambda p, q: int(abs(f[p] - f[q]).max())
    out = {}
    for p in np.ndindex(h, w):
        if zones[p] == 0:
            out[p] = "transparent"
        elif any(kinds[i] == zones[p] and (e[i] == f[p]).all() for i in range(len(e))):
            out[p] = "protected-exact"
    todo = [p for p in np.ndindex(h, w) if p not in out and all((image[q] == image[p]).all() for q in beside(*p))]
    out |= dict.fromkeys(todo, "flat")
    while todo:
        p = todo.pop()
        for q in beside(*p):
            if q not in out and (image[q] == image[p]).all():
                out[q] = "flat"
                todo.append(q)
    for p in np.ndindex(h, w):
        if p in out:
            continue
        near = beside(*p)
        if any(zones[q] != zones[p] for q in near):
            out[p] = "hard-edge"
            continue
        q = max(near, key=lambda n: step(p, n)) if near else None
        if q and step(p, q) >= 1020 and 4 * max([step(p, n) for n in near if n != q] + [step(q, n) for n in beside(*q) if n != p] + [0]) <= step(p, q):
            out[p] = "hard-edge"
            continue
        s = f[..., :3].sum(-1)
        y, x = min(p[0], h - 2), min(p[1], w - 2)
        rough = min(h, w) > 1 and ((s[y, x + 1] - s[y, x]) * (s[y + 1, x + 1] - s[y + 1, x]) < 0 or (s[y + 1, x] - s[y, x]) * (s[y + 1, x + 1] - s[y, x + 1]) < 0)
        out[p] = "texture" if rough else "gradient-opaque" if zones[p] == 2 else "soft-shadow" if image[p][3] < 64 else "gradient-alpha"
    return np.array([regions.NAMES.index(out[p]) for p in np.ndindex(h, w)]).reshape(h, w)


@pytest.mark.parametrize("seed", range(12))
def test_classes_equal_their_definition(seed):
    rng = np.random.default_rng(seed)
    h, w = rng.integers(1, 14, 2)
    image = np.repeat(np.repeat(rng.integers(0, 256, (h, w, 4)), 3, 0), 2, 1)
    image[..., 3] = np.repeat(np.repeat(rng.choice([0, 30, 150, 255, 255, 255], (h, w)), 3, 0), 2, 1)
    y, x = np.mgrid[: len(image), : image.shape[1]]
    smooth = (x // 7 + seed) % 2 == 0
    image[smooth, :3] = np.stack([x * 3 + y, x + y * 2, x * 2], -1)[smooth] % 256
    entries = np.concatenate([image.reshape(-1, 4)[:2], [[1, 2, 3, 255], [1, 2, 3, 77]]])
    assert np.array_equal(regions.classes_of(image, entries), plain_classes(image, entries))
    with pytest.raises(DataError):
        regions.classes_of(np.full((2, 2, 4), 9), np.array([[1, 1, 1, 255]]))


def test_strength_is_in_lowest_terms():
    one_of_each = np.arange(8).reshape(2, 4)
    assert regions.strength_of(one_of_each) == (3, 5) and regions.strength_of(one_of_each[:1, :2]) == (0, 1)
    assert regions.strength_of(np.array([[5, 5, 4, 4]])) == (1, 2)


def test_orders_are_permutations_and_packing_is_verified():
    rng = np.random.default_rng(3)
    idx, colours = rng.integers(0, 6, (12, 10)), np.unique(rng.integers(0, 256, (7, 4)), axis=0)
    made = pack.variants(idx, colours, pack.ORDERS + pack.MORE_ORDERS, ("none", "residual"))
    assert len(made) == 18
    for o in pack.ORDERS + pack.MORE_ORDERS:
        assert sorted(pack.order(o, colours, idx)) == list(range(len(colours)))


def script(folder, text):
    tool = folder / "zopflipng"
    tool.write_text("#!/bin/sh\n" + text)
    tool.chmod(0o755)
    return tool


def test_optimiser_is_found_and_bounded(tmp_path, monkeypatch):
    data = pack.write_indexed(np.zeros((2, 3), int), np.array([[1, 2, 3, 255]]))
    assert pack.optimiser({"PATH": ""}) is None and pack.optimiser({"PATH": f":{tmp_path}"}) is None
    tool = script(tmp_path, 'for last; do :; done; cp "$(eval echo \\${$(($# - 1))})" "$last"\n')
    assert pack.optimiser({"PATH": f":{tmp_path}"}) == tool and str(pack.optimiser({"TESSERA_OPTIMISER": "/none", "PATH": str(tmp_path)})) == "/none"
    assert pack.optimise(data, tool, ("-m",)) == data
    monkeypatch.setenv("PATH", f"{tmp_path}:/usr/bin:/bin")
    packed = pack.pack(np.arange(12).reshape(3, 4) % 5, np.arange(20).reshape(5, 4) * 10, "max", "v2")
    assert packed.search["finalists"] == len(packed.optimised) >= 1 and len(packed.data) == min(o["png_bytes"] for o in packed.optimised)
    for text in ("exit 3\n", "exit 0\n", "yes & yes | head -c 10000000 & sleep 60\n", 'for last; do :; done; echo x > "$last"\n'):
        with pytest.raises(DataError):
            pack.optimise(data, script(tmp_path, text), (), 1)
    with pytest.raises(DataError):
        pack.optimise(data, tmp_path / "nothing")
    assert pack.seconds_allowed({}) == 120 and pack.seconds_allowed({"TESSERA_OPTIMISER_SECONDS": " 7 "}) == 7 and pack.seconds_allowed({"TESSERA_OPTIMISER_SECONDS": "-1"}) == 120


def test_facts_and_shorter_transparency():
    idx, colours = np.arange(12).reshape(3, 4) % 4, np.array([[1, 2, 3, 0], [4, 5, 6, 255], [7, 8, 9, 255], [9, 9, 9, 255]])
    data = pack.encode(idx, colours, [0, 1, 4])
    got = pack.facts(data)
    assert got["filter_histogram"] == [1, 1, 0, 0, 1] and (got["palette_entries"], got["trns_bytes"], got["plte_bytes"], got["bit_depth"]) == (4, 1, 12, 2)
    padded = png.SIGNATURE + b"".join(png.chunk(k, b"\0\xff\xff" if k == b"tRNS" else body) for k, body, _ in png.walk(data))
    assert pack.retruncated(padded) == data and pack.retruncated(data) is None


#: The published trial rows and what they give.
TRIAL = [
    [0] * 16, [10, 20, 30, 40] + [0] * 12, list(range(16)), [5] * 9 + [0] * 7, [i * i for i in range(16)],
    [77, 202, 24, 37, 48, 187, 29, 109, 19, 44, 222, 214, 35, 123, 46, 217], [114, 31, 203] + [0] * 13, [113, 23, 68] + [0] * 13,
    [214, 73, 60, 157, 92, 52, 96, 190, 49, 32, 30, 105, 254, 218, 160, 238], [153, 127, 92, 124, 41, 153, 253, 175, 229, 147, 37, 60, 214, 84, 175, 77],
    [20, 39, 160, 174, 179, 254, 233, 35, 47, 138, 242, 33, 31, 158, 228, 145],
]


def test_trial_compression_of_the_published_rows():
    data, kinds = pack.choose(np.array(TRIAL), "trial-zlib")
    assert kinds == [0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 1] and len(data) == 187


def test_colour_keys_are_compared_as_they_are():
    """A key beyond the depth's range matches nothing; one that is in range matches its sample."""
    raw = b"\0" + bytes([7, 8])
    for key, alpha in ((0x0107, [255, 255]), (0x0007, [0, 255])):
        got = png.decode(file(2, 1, 8, 0, raw, extra=png.chunk(b"tRNS", struct.pack(">H", key))))
        assert got.rgba[0, :, 3].tolist() == alpha
    assert got.conversions == ["gray:replicate-sample-to-rgb", "trns:colorkey-binary-alpha(native-source-sample-match)"]
    assert png.conversions(16, 6, True, False) == ["rgba:passthrough", "16-to-8-rounding:(v*255+32767)//65535", "adam7:seven-pass-reassembly"]


@pytest.mark.parametrize("chunks,word", [
    ([(b"gAMA", b"abc")], "gAMA"), ([(b"iCCP", b"name")], "iCCP"), ([(b"iCCP", b"n\0\1x")], "iCCP"), ([(b"ABCD", b"")], "critical"), ([(b"PLTE", b"abc")] * 2, "duplicate"),
    ([(b"tRNS", b"ab")] * 2, "duplicate"), ([(b"tRNS", b"abc")], "tRNS"), ([(b"PLTE", b"ab")], "PLTE"),
])
def test_chunks_that_are_refused(chunks, word):
    with pytest.raises(DataError, match=word):
        png.decode(file(1, 1, 8, 0, b"\0\1", extra=b"".join(png.chunk(*c) for c in chunks)))


def test_chunks_that_are_passed_over_or_repeated():
    extra = b"".join(png.chunk(*c) for c in ((b"abCd", b"x"), (b"gAMA", b"\0\0\0\1"), (b"gAMA", b"\0\0\0\2"), (b"iCCP", b"one\0\0zz")))
    got = png.decode(file(1, 1, 8, 0, b"\0\1", extra=extra))
    assert got.gamma == 2 and got.profile == ("one", 2)


@pytest.mark.parametrize("shape,bpp", [((40, 60), 1), ((30, 200), 4), ((3, 12), 3), ((64, 96), 2)])
def test_anti_diagonals_equal_samples(shape, bpp):
    rng = np.random.default_rng(bpp)
    raw, above = rng.integers(0, 256, shape, dtype=np.uint8), rng.integers(0, 256, shape[1], dtype=np.uint8)
    kinds = rng.integers(3, 5, shape[0])
    assert np.array_equal(png._diagonals(raw, above, kinds, bpp), png._by_sample(raw, above, kinds, bpp))


def test_hidden_colours_and_notes():
    px = np.array([(100 + i, 0, 200 - i, 0) for i in range(40) for _ in range(10)] + [(i, i, i, 255) for i in range(10) for _ in range(5)], np.uint8).reshape(10, 45, 4)
    for hidden, want in (("canonicalize-black", [0, 0, 0, 0]), ("preserve-mean", [120, 0, 181, 0])):
        entries, idx, notes = raster.candidate(px, 8, hidden=hidden)
        assert [e for e in entries.tolist() if e[3] == 0] == [want] and not notes.exact_path and notes.hidden_rgb_policy == hidden and notes.sampled_pixels == 450
        assert ((entries[idx][..., 3] == 0) == (px[..., 3] == 0)).all()
    ramp = np.array([(200, 30, 40, a) for a in range(256)] + [(123, 45, 67, 0)] * 3000 + [(10, 200, 30, 255)] * 2000, np.uint8).reshape(4, 1314, 4)
    entries, idx, _ = raster.candidate(ramp, 16)
    for end in (0, 255):
        assert (entries[idx][..., 3][ramp[..., 3] == end] == end).all()
    grid = np.array([(i & 255, (i >> 8) & 255, (i * 31) & 255, 128 + (i & 127)) for i in range(8192)], np.uint8).reshape(128, 64, 4)
    assert raster.candidate(grid, 32)[2].refinement_iterations <= 8
    extremes = np.array([(0, 0, 0, 255)] * 1000 + [(255, 255, 255, 255)] * 1000 + [(17, 19, 21, 255)] * 3, np.uint8)[None]
    assert {(0, 0, 0, 255), (255, 255, 255, 255)} <= set(map(tuple, raster.candidate(extremes, 3)[0].tolist()))


def test_image_bins_equal_counted_colours():
    rng = np.random.default_rng(8)
    px = rng.integers(0, 4, (20, 30, 4), dtype=np.uint8) * 80
    for limit in (10_000, 5):
        got = raster.bins(px, limit)
        keys = px.reshape(-1, 4).astype(int) if limit > 5 else raster.coarse_keys(px.reshape(-1, 4).astype(int))
        want, n = np.unique(keys, axis=0, return_counts=True)
        assert np.array_equal(got.keys, want) and np.array_equal(got.sums["n"], n) and np.array_equal(got.keys[got.own], keys)


def test_exact_numbers():
    assert [numbers.integer(t) for t in (" +1_0 ", "-7", "\u0661\u0662", "9" * 400, "1__0", "_1", "1_", "", "0x1", "1.0")] == [10, -7, 12, numbers.MOST, None, None, None, None, None, None]
    assert [numbers.strength(t) for t in ("0.75", "1e-1", " +.5", "1.", "0", "-0", "100e-2")] == [(3, 4), (1, 10), (1, 2), (1, 1), (0, 1), (0, 1), (1, 1)]
    for text in ("nan", "inf", "1.1", "-0.5", "", ".", "1e", "0x1", "1e99999999999999999999"):
        with pytest.raises(UsageError):
            numbers.strength(text)


def test_local_moves_are_distinct_rearrangements():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 9, 200):
        colours = rng.integers(0, 256, (n, 4))
        colours[: n // 3, 3] = 255
        found = search.moves(colours)
        assert len(found) == len(set(found)) <= search.MOVES and all(sorted(m) == list(range(n)) and m != tuple(range(n)) for m in found)
    assert search.spread(5, 1) == [0] and search.spread(10, 4) == [0, 3, 6, 9] and search.spread(0, 3) == []


def test_wide_search_keeps_pixels_and_budget():
    rng = np.random.default_rng(4)
    idx, colours = rng.integers(0, 12, (20, 16)), rng.integers(0, 256, (14, 4))
    found, moves, changes = search.widest(idx, colours)
    assert 63 < len(found) <= search.BUDGET and [v.gen for v in found] == list(range(len(found))) and 0 < moves <= search.MOVES and changes <= search.ROW_CHANGES
    assert all(np.array_equal(png.decode(v.data).rgba, colours[idx]) for v in found[::7])
    first = pack.variants(idx, colours)
    assert min(len(v.data) for v in found) <= min(len(v.data) for v in first)
    got = pack.pack(idx, colours, "fast", "v2")
    assert len(got.data) == min(len(v.data) for v in found) and got.search["variants"] == len(found) and len(got.evidence()["portfolio"]) == len(found)
    ends = pack.finalists(found, 3)
    assert len({v.palette.tobytes() for v in ends}) == len(ends) and ends[0].data == got.data
    for bad in ({"mode": "best"}, {"search": "v3"}, {"orders": ()}, {"search": "v2", "orders": ("identity",)}):
        with pytest.raises(DataError):
            pack.pack(idx, colours, **bad)
    for idx, colours in ((idx[:0], colours), (idx, colours[:0]), (idx, colours[:3])):
        with pytest.raises(DataError):
            pack.pack(idx, colours)


def test_seams_never_grow_and_prefer_in_order():
    idx, colours = np.arange(12).reshape(3, 4) % 3, np.array([[9, 8, 7, 255], [1, 2, 3, 0], [4, 5, 6, 255]])
    rows = search.seam_rows(idx, colours, memory=True)
    assert len(rows) == 5 * 2 * 2 and len({r[0] for r in rows}) == 20
    best = min(rows, key=lambda r: (len(r[3]), r[0]))
    assert len(best[3]) <= len(pack.write_indexed(idx, colours)) and np.array_equal(png.decode(best[3]).rgba, colours[idx])
    assert [r[1:3] for r in search.seam_rows(idx, colours, False, False, False)] == [("identity", "8/8")]


def test_oklab_goes_back_and_forth():
    rng = np.random.default_rng(6)
    colours = rng.integers(0, 256, (500, 4))
    colours[:, 3] = np.maximum(colours[:, 3], 1)
    f = oklab.feature(colours)
    assert np.array_equal([oklab.centre(1, a, *x[:3]) for a, x in zip(colours[:, 3].tolist(), f.tolist())], colours)
    black, white = oklab.to_lab(0, 0, 0), oklab.to_lab(255, 255, 255)
    assert black == (0, 0, 0) and abs(white[0] - 1) < 1e-6


def test_near_ties_of_real_features_go_by_the_power_function():
    rng = np.random.default_rng(9)
    points, entries = rng.random((300, 4)), rng.random((20, 4))
    entries[10:] = entries[:10]
    entries[15] += 1e-16
    at, far = palette.nearest_real(points, entries)
    for p, i, d in zip(points.tolist(), at.tolist(), far.tolist()):
        every = [palette.powered(p, e) for e in entries.tolist()]
        assert every.index(min(every)) == i and d == min(every)


def test_oklab_sums_go_pixel_by_pixel():
    rng = np.random.default_rng(10)
    px = rng.integers(0, 256, (12, 15, 4), dtype=np.uint8) // 64 * 64
    got = raster.bins(px, 10_000, lab=True)
    for k in range(0, len(got.keys), 9):
        total = [0.0] * 4
        for f in oklab.feature(px.reshape(-1, 4)[got.own == k].astype(int)).tolist():
            total = [t + x for t, x in zip(total, f)]
        assert total == [got.sums[f][k] for f in oklab.FEATURES]


def test_bins_of_a_zone_without_entries_take_a_visible_one():
    own, _ = palette.serve(np.array([[0, 0, 0, 9], [5, 5, 5, 5]]), np.array([2, 1]), np.array([[0, 0, 0, 0], [5, 5, 5, 5]]), np.array([0, 1]))
    assert own.tolist() == [1, 1]
    with pytest.raises(InternalError):
        palette.serve(np.zeros((1, 4), int), np.array([0]), np.array([[5, 5, 5, 5]]), np.array([1]))


