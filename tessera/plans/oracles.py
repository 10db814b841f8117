"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from tessera.operators import histogram as H
from tessera.operators import regions
from tessera.plans.quantize import ceiling

PER_ZONE, LIMIT, WIDTH, QUALITY = 8, 1000, 32, 60.0
PASS_TABLE = "(0,0,0,8,8),(1,4,0,8,8),(2,0,4,4,8),(3,2,0,4,4),(4,0,2,2,4),(5,1,0,2,2),(6,0,1,1,2)"
#: The queries that run on scenes as well.
SCENES = (
    "exact_histogram", "mode_switch", "alpha_quantile_seeds", "stride_sample", "guard_predicate", "nearest_entry_zone", "nearest_with_fallback", "remap_join", "remap_bins",
    "palette_cleanup", "refine_one_step", "worst_served", "slot_cooccurrence", "rank_slots", "local_gradient", "adaptive_strength", "flat_seeds", "hard_edge", "region_classes",
    "region_directives", "class_counts", "unit_strength", "order_alpha_frequency", "order_transparent_front", "spatial_adjacency", "fewest_colors", "identity_check", "png_roundtrip",
)
#: Drawn images by number modulo 8, as SQL for either engine: r, g, b, a over x (0 to 15), y (0 to 47) and m, the number.
DRAWN = (
    ("(x // 4 * 60 + y // 6 * 25) % 256", "(x // 4 * 90 + y // 6 * 40) % 256", "y // 6 * 30", "255"),
    ("x * 12 + y", "y * 4", "128 + x", "255"),
    ("200", "40 + x", "90", "10 + x * 4 + y * 3"),
    ("(x * x * 7 + y * y * 13 + x * y * 29 + m * 17) % 256", "(x * 31 + y * 57 + x * y) % 256", "(x * y * 11 + m) % 256", "255"),
    ("CASE (x // 4 + y // 4) % 3 WHEN 0 THEN 0 WHEN 1 THEN 250 ELSE 10 END", "CASE (x // 4 + y // 4) % 3 WHEN 0 THEN 0 WHEN 1 THEN 10 ELSE 250 END", "CASE (x // 4 + y // 4) % 3 WHEN 0 THEN 0 ELSE 10 END", "CASE (x // 4 + y // 4) % 3 WHEN 0 THEN 0 ELSE 255 END"),
    ("10", "10", "10 + m % 7", "5 + abs(x - 8) + y"),
    ("CASE WHEN x < 8 THEN x * 10 ELSE 16 * x END", "y * 3", "99", "CASE WHEN x < 8 THEN 0 ELSE 255 END"),
    ("CASE WHEN x % 5 = 0 THEN 0 ELSE 255 END", "CASE WHEN x % 5 = 0 THEN 0 ELSE 255 END", "CASE WHEN x % 5 = 0 THEN 0 ELSE 255 END", "255"),
)

_PX = """px AS (SELECT vec_id // 100 AS image_id, (vec_id % 100) * 16 + x AS pos, vec_id % 100 AS y, x,
  CAST(floor((CAST(embedding[4 * x + 1] AS DOUBLE) + 1.0) * 128) AS BIGINT) AS r, CAST(floor((CAST(embedding[4 * x + 2] AS DOUBLE) + 1.0) * 128) AS BIGINT) AS g,
  CAST(floor((CAST(embedding[4 * x + 3] AS DOUBLE) + 1.0) * 128) AS BIGINT) AS b,
  CAST(CASE WHEN label < 2 THEN 0 WHEN label < 5 THEN 255 ELSE floor((CAST(embedding[4 * x + 4] AS DOUBLE) + 1.0) * 128) END AS BIGINT) AS a
  FROM embeddings, (SELECT CAST(range AS BIGINT) AS x FROM range(16)) t)"""
_KIND = ", ".join("CAST(CASE m % 8 " + " ".join(f"WHEN {k} THEN {kind[i]}" for k, kind in enumerate(DRAWN)) + f" END AS BIGINT) AS {c}" for i, c in enumerate("rgba"))
_SCENE = _PX.replace("px AS (", "pxe AS (", 1) + f""", px AS (SELECT * FROM pxe UNION ALL SELECT m + 1000000 AS image_id, y * 16 + x AS pos, y, x, {_KIND}
  FROM (SELECT p_partkey // 48 AS m, p_partkey % 48 AS y FROM part), (SELECT CAST(range AS BIGINT) AS x FROM range(16)) t)"""
_ZONE = "CAST(CASE WHEN {0} = 0 THEN 0 WHEN {0} = 255 THEN 2 ELSE 1 END AS BIGINT)"
_SUMS = "CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"CAST(sum({s}) AS BIGINT) AS {s}" for s in H.SUMS[1:])
_EX = f""", ex AS (SELECT image_id, r AS k0, g AS k1, b AS k2, a AS k3, count(*) AS n, CAST(sum(r) AS BIGINT) AS sr, CAST(sum(g) AS BIGINT) AS sg, CAST(sum(b) AS BIGINT) AS sb,
  CAST(sum(a) AS BIGINT) AS sa, CAST(sum(a * r) AS BIGINT) AS sar, CAST(sum(a * g) AS BIGINT) AS sag, CAST(sum(a * b) AS BIGINT) AS sab FROM px GROUP BY ALL)"""
_GRID = "k0 * 16 // 256 AS k0, k1 * 16 // 256 AS k1, k2 * 16 // 256 AS k2, CASE WHEN k3 = 0 THEN 0 WHEN k3 = 255 THEN 15 ELSE 1 + (k3 - 1) * 14 // 254 END AS k3"
_HALF = "((2 * {0} + {1}) // (2 * {1}))"
_BINS = _EX + f""", co AS (SELECT image_id, k0, k1, k2, k3, {_SUMS} FROM (SELECT image_id, {_GRID}, n, sr, sg, sb, sa, sar, sag, sab FROM ex) GROUP BY image_id, k0, k1, k2, k3),
  bins AS (SELECT *, {_ZONE.format(_HALF.format("sa", "n"))} AS zone, row_number() OVER (PARTITION BY image_id ORDER BY k0, k1, k2, k3) - 1 AS bin_ord FROM co),
  means AS (SELECT *, {", ".join(_HALF.format("s" + c, "n") + " AS " + c for c in "rgba")}, {", ".join(_HALF.format("sa" + c, "n") + f" AS p{i}" for i, c in enumerate("rgb"))}, {_HALF.format("255 * sa", "n")} AS p3 FROM bins)"""
_PACK = "(r * 16777216 + g * 65536 + b * 256 + a)"
_PAL = _BINS + f""", palk AS (SELECT *, row_number() OVER (PARTITION BY image_id, zone ORDER BY n DESC, {_PACK}) AS rank FROM (
  SELECT image_id, zone, CASE WHEN zone = 0 THEN 0 ELSE r END AS r, CASE WHEN zone = 0 THEN 0 ELSE g END AS g, CASE WHEN zone = 0 THEN 0 ELSE b END AS b, CASE WHEN zone = 0 THEN 0 ELSE a END AS a, sum(n) AS n FROM means GROUP BY ALL)),
  pal AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY zone, rank) - 1 AS idx, r, g, b, a FROM palk WHERE rank <= {PER_ZONE})"""
_NEAR = """, pe AS (SELECT image_id, idx, {z} AS zone, r * a AS q0, g * a AS q1, b * a AS q2, 255 * a AS q3 FROM {pal}),
  pt AS (SELECT DISTINCT image_id, r, g, b, a, {z} AS zone, r * a AS p0, g * a AS p1, b * a AS p2, 255 * a AS p3 FROM px),
  near AS (SELECT image_id, r, g, b, a, arg_min(idx, (d2, idx)) AS idx, min(d2) AS d2 FROM (SELECT pt.*, idx, (p0-q0)*(p0-q0)+(p1-q1)*(p1-q1)+(p2-q2)*(p2-q2)+(p3-q3)*(p3-q3) AS d2 FROM pt JOIN pe USING (image_id, zone)) GROUP BY ALL)"""
_Z = _ZONE.format("a")
_N = _NEAR.format(z=_Z, pal="pal")
_ASG = _N + """, asg AS (SELECT px.image_id, pos, y, x, idx FROM px JOIN near USING (image_id, r, g, b, a)), freq AS (SELECT pal.image_id, pal.idx, count(asg.pos) AS n FROM pal LEFT JOIN asg ON asg.image_id = pal.image_id AND asg.idx = pal.idx GROUP BY ALL)"""
_W = "WITH RECURSIVE " + _PX
_ROW, _COL = "OVER (PARTITION BY image_id, y ORDER BY x)", "OVER (PARTITION BY image_id, x ORDER BY y)"
_TB = f"""WITH tb AS (SELECT page_id AS image_id, CAST(i // {WIDTH} AS BIGINT) AS y, CAST(i % {WIDTH} AS BIGINT) AS x, CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS v FROM (SELECT page_id, hex(encode(html)) AS h, unnest(range(0, octet_length(encode(html)))) AS i FROM pages)),
  nb AS (SELECT *, coalesce(lag(v) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS l, coalesce(lag(v) OVER (PARTITION BY image_id, x ORDER BY y), 0) AS u FROM tb),
  nc AS (SELECT *, coalesce(lag(u) OVER (PARTITION BY image_id, y ORDER BY x), 0) AS c FROM nb),
  fl AS (SELECT image_id, y, x, CAST(0 AS BIGINT) AS filter, v & 255 AS f FROM nc UNION ALL SELECT image_id, y, x, 1, (v - l) & 255 FROM nc UNION ALL SELECT image_id, y, x, 2, (v - u) & 255 FROM nc
  UNION ALL SELECT image_id, y, x, 3, (v - (l + u) // 2) & 255 FROM nc UNION ALL SELECT image_id, y, x, 4, (v - CASE WHEN abs(u - c) <= abs(l - c) AND abs(u - c) <= abs(l + u - 2 * c) THEN l WHEN abs(l - c) <= abs(l + u - 2 * c) THEN u ELSE c END) & 255 FROM nc),
  sc AS (SELECT image_id, y, filter, CAST(sum(CASE WHEN f < 128 THEN f ELSE 256 - f END) AS BIGINT) AS score FROM fl GROUP BY ALL)"""
_VT = "WITH vt AS (SELECT o_custkey % 200 AS image_id, o_orderkey AS gen, o_orderpriority AS palette, CAST(floor(o_totalprice / 100) AS BIGINT) AS len FROM orders), sm AS (SELECT image_id, arg_min(gen, (len, gen)) AS gen, min(len) AS len FROM vt GROUP BY image_id)"
_HD = """WITH hd AS (SELECT p_partkey AS image_id, p_partkey * 37 % 40000 AS width, CAST(p_size * 811 % 36000 AS BIGINT) AS height, CAST([1, 2, 4, 8, 16, 3][p_partkey % 6 + 1] AS BIGINT) AS depth, p_partkey % 8 AS color_type, p_partkey % 3 AS interlace FROM part),
  vh AS (SELECT *, CASE WHEN width < 1 OR height < 1 THEN 'dimensions' WHEN color_type NOT IN (0, 2, 3, 4, 6) THEN 'colour type'
  WHEN NOT CASE color_type WHEN 0 THEN depth IN (1, 2, 4, 8, 16) WHEN 3 THEN depth IN (1, 2, 4, 8) ELSE depth IN (8, 16) END THEN 'bit depth' WHEN interlace > 1 THEN 'interlace' ELSE 'ok' END AS verdict FROM hd)"""
_GEO = _HD + f""", ge AS (SELECT *, columns * depth * CASE color_type WHEN 2 THEN 3 WHEN 4 THEN 2 WHEN 6 THEN 4 ELSE 1 END AS bits FROM (SELECT vh.*, CAST(p.pass AS BIGINT) AS pass, CAST((greatest(width - x0, 0) + dx - 1) // dx AS BIGINT) AS columns, CAST((greatest(height - y0, 0) + dy - 1) // dy AS BIGINT) AS rows
  FROM vh JOIN (SELECT * FROM (VALUES {PASS_TABLE}) t(pass, x0, y0, dx, dy) UNION ALL SELECT 0, 0, 0, 1, 1) p ON (interlace = 1 AND dx + dy > 2) OR (interlace = 0 AND dx + dy = 2) WHERE verdict = 'ok') WHERE columns > 0 AND rows > 0)"""


def _classes() -> str:
    sides = {"l": f"lag({{0}}) {_ROW}", "r": f"lead({{0}}) {_ROW}", "u": f"lag({{0}}) {_COL}", "d": f"lead({{0}}) {_COL}"}
    ft = f", ft AS (SELECT px.*, {_Z} AS zone, r * a AS p0, g * a AS p1, b * a AS p2, 255 * a AS p3, {_PACK} AS colour FROM px)"
    cols = ", ".join(f"{w.format(c)} AS {s}_{c}" for s, w in sides.items() for c in ("p0", "p1", "p2", "p3", "zone", "colour"))
    step = lambda s: f"CASE WHEN {s}_p0 IS NULL THEN 0 ELSE greatest({', '.join(f'abs(p{i} - {s}_p{i})' for i in range(4))}) END"
    gt = lambda *xs: f"greatest({', '.join(xs)})"
    facing = {"l": "r", "r": "l", "u": "d", "d": "u"}
    steps = ", ".join(f"{step(s)} AS s{s}" for s in sides)
    beyond = ", ".join(f"{gt(*[f's{o}' for o in sides if o != facing[s]])} AS b{s}" for s in sides)
    past = ", ".join(f"coalesce({w.format('b' + s)}, 0) AS t{s}" for s, w in sides.items())
    mine = {s: gt(*[f"s{o}" for o in sides if o != s]) for s in sides}
    more = "CASE " + " ".join(f"WHEN s{s} = big THEN {gt(mine[s], 't' + s)}" for s in sides) + " END"
    same = " AND ".join(f"({s}_colour IS NULL OR {s}_colour = colour)" for s in sides)
    edge = " OR ".join(f"coalesce({s}_zone <> zone, false)" for s in sides)
    clash = lambda a, b: f"({a} <> 0 AND {b} <> 0 AND ({a} < 0) <> ({b} < 0))"
    return (
        ft + f", nb AS (SELECT *, {cols}, p0 + p1 + p2 AS s3 FROM ft), n2 AS (SELECT *, {steps}, ({same}) AS seed, ({edge}) AS edge, lead(s3) {_ROW} AS s3r FROM nb)"
        f", n3 AS (SELECT *, {gt(*['s' + s for s in sides])} AS big, {beyond}, lead(s3) {_COL} AS s3d, lead(s3r) {_COL} AS s3rd FROM n2)"
        f", n4 AS (SELECT *, {past}, {clash('(s3r - s3)', '(s3rd - s3d)')} OR {clash('(s3d - s3)', '(s3rd - s3r)')} AS r0 FROM n3)"
        f", n5 AS (SELECT *, {more} AS more, coalesce(r0, lag(r0) {_ROW}) AS r1 FROM n4), n6 AS (SELECT *, coalesce(r1, lag(r1) {_COL}, false) AS rough FROM n5)"
        ", n7 AS MATERIALIZED (SELECT *, (zone = 0 OR EXISTS (SELECT 1 FROM pal WHERE pal.image_id = n6.image_id AND pal.a = n6.a AND pal.r * pal.a = p0 AND pal.g * pal.a = p1 AND pal.b * pal.a = p2)) AS fixed FROM n6)"
        ", ed AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT image_id, pos, pos + {step_} AS other FROM n7 WHERE NOT fixed AND {s}_colour = colour" for s, step_ in (("l", -1), ("r", 1), ("u", -16), ("d", 16))) + ")"
        ", fl(image_id, pos) AS (SELECT image_id, pos FROM n7 WHERE seed AND NOT fixed UNION SELECT ed.image_id, ed.other FROM fl JOIN ed ON ed.image_id = fl.image_id AND ed.pos = fl.pos)"
        ", cls AS (SELECT n7.image_id, n7.pos, CASE WHEN zone = 0 THEN 'transparent' WHEN fixed THEN 'protected-exact'"
        " WHEN fl.pos IS NOT NULL THEN 'flat' WHEN edge OR (big >= 1020 AND more * 4 <= big) THEN 'hard-edge' WHEN rough THEN 'texture' WHEN zone = 2 THEN 'gradient-opaque' WHEN a < 64 THEN 'soft-shadow' ELSE 'gradient-alpha' END AS class"
        " FROM n7 LEFT JOIN fl ON fl.image_id = n7.image_id AND fl.pos = n7.pos)"
    )


_CLS = _W + _PAL + _classes()
_DIR = ", ".join(f"('{c}', '{r}', {str(b).lower()}, {n}, {m})" for c, r, b, n, m in regions.DIRECTIVES)
_GRADE = "coalesce((p0-{0}p0)*(p0-{0}p0)+(p1-{0}p1)*(p1-{0}p1)+(p2-{0}p2)*(p2-{0}p2)+(p3-{0}p3)*(p3-{0}p3), 0)"
_LG = ", ft AS (SELECT image_id, pos, y, x, r, g, b, a, r * a AS p0, g * a AS p1, b * a AS p2, 255 * a AS p3 FROM px), ls AS (SELECT *, " + ", ".join(
    f"{f}({p}) {w} AS {s}{p}" for s, f, w in (("l", "lag", _ROW), ("r", "lead", _ROW), ("u", "lag", _COL), ("d", "lead", _COL)) for p in ("p0", "p1", "p2", "p3")
) + " FROM ft), lg AS (SELECT image_id, pos, r, g, b, a, greatest(" + ", ".join(_GRADE.format(s) for s in "lrud") + ") AS gradient FROM ls)"


def _rank(source: str, keys: str) -> str:
    return f" SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY {keys}, idx) - 1 AS new_idx FROM {source}"


_MODE = f""", m AS (SELECT *, count(*) OVER (PARTITION BY image_id) <= {LIMIT} AS exact FROM ex), un AS (SELECT image_id, exact, k0, k1, k2, k3, n, sr, sg, sb, sa, sar, sag, sab FROM m WHERE exact
  UNION ALL SELECT image_id, exact, {_GRID}, n, sr, sg, sb, sa, sar, sag, sab FROM m WHERE NOT exact), gb AS (SELECT image_id, exact, k0, k1, k2, k3, {_SUMS} FROM un GROUP BY image_id, exact, k0, k1, k2, k3)"""
_SEEDS = """, sm AS (SELECT image_id, a AS alpha, sum(n) AS mass FROM means WHERE a BETWEEN 1 AND 254 GROUP BY ALL), sq AS (SELECT image_id, alpha, sum(mass) OVER (PARTITION BY image_id ORDER BY alpha) AS upto, mass, sum(mass) OVER (PARTITION BY image_id) AS total, least(count(*) OVER (PARTITION BY image_id), 8) AS k FROM sm),
  seeds AS (SELECT DISTINCT image_id, alpha FROM sq, range(1, 9) t(j) WHERE j <= k AND upto * 2 * k >= (2 * j - 1) * total AND (upto - mass) * 2 * k < (2 * j - 1) * total)"""
_SLOT = f""", reps AS (SELECT image_id, idx AS rep, r AS rr, g AS rg, b AS rb FROM pal WHERE a > 0), lad AS (SELECT DISTINCT image_id, a AS level FROM means WHERE a IN (0, 255) UNION SELECT image_id, alpha FROM seeds),
  nr AS (SELECT image_id, bin_ord, arg_min(rep, ((r-rr)*(r-rr)+(g-rg)*(g-rg)+(b-rb)*(b-rb), rep)) AS rep FROM means JOIN reps USING (image_id) GROUP BY ALL),
  nl AS (SELECT means.image_id, bin_ord, arg_min(level, (abs(level - a), level)) AS level FROM means JOIN lad ON lad.image_id = means.image_id AND {_ZONE.format('level')} = means.zone GROUP BY ALL),
  slot AS (SELECT image_id, rep, level, min(zone) AS zone, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sa) AS BIGINT) AS sa, CAST(sum(sar) AS BIGINT) AS sar, CAST(sum(sag) AS BIGINT) AS sag, CAST(sum(sab) AS BIGINT) AS sab, min(bin_ord) AS first_ord
  FROM (SELECT means.*, CAST(CASE WHEN zone = 0 THEN -1 ELSE nr.rep END AS BIGINT) AS rep, CAST(CASE WHEN zone = 0 THEN 0 ELSE coalesce(nl.level, a) END AS BIGINT) AS level FROM means LEFT JOIN nr USING (image_id, bin_ord) LEFT JOIN nl USING (image_id, bin_ord)) GROUP BY image_id, rep, level)"""
_CRC = "SELECT CAST(range AS BIGINT) AS i, CAST(range AS BIGINT) AS c FROM range(256)"
for _ in range(8):
    _CRC = f"SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM ({_CRC})"
_SQ = "(l.r*l.a-o.r*o.a)*(l.r*l.a-o.r*o.a)+(l.g*l.a-o.g*o.a)*(l.g*l.a-o.g*o.a)+(l.b*l.a-o.b*o.a)*(l.b*l.a-o.b*o.a)+(255*l.a-255*o.a)*(255*l.a-255*o.a)"
_FB = _W + _PAL + ", half AS (SELECT * FROM pal WHERE a <> 255)" + _NEAR.format(z=_Z, pal="half")
ORACLES = {
    "pixel_relation": _W + " SELECT * FROM px",
    "zone_counts": _W + f" SELECT image_id, {_Z} AS zone, count(*) AS n FROM px GROUP BY ALL",
    "guard_predicate": _W + " SELECT image_id, CAST(sum(CAST(a = 255 AS INT)) AS BIGINT) AS opaque, count(*) AS total, sum(CAST(a = 255 AS INT)) * 20000 < count(*) AS fires FROM px GROUP BY image_id",
    "premult_features": _W + f" SELECT image_id, pos, r * a AS p0, g * a AS p1, b * a AS p2, 255 * a AS p3, {_PACK} AS packed FROM px",
    "exact_histogram": _W + _EX + f" SELECT *, {_ZONE.format('k3')} AS zone, row_number() OVER (PARTITION BY image_id ORDER BY k0, k1, k2, k3) - 1 AS bin_ord FROM ex",
    "preclip_histogram": _W + _BINS + " SELECT * FROM bins",
    "mode_switch": _W + _EX + _MODE + f" SELECT *, {_ZONE.format(_HALF.format('sa', 'n'))} AS zone, row_number() OVER (PARTITION BY image_id ORDER BY k0, k1, k2, k3) - 1 AS bin_ord FROM gb",
    "bin_means": _W + _BINS + " SELECT image_id, bin_ord, r, g, b, a, p0, p1, p2, p3 FROM means",
    "zone_centroids": _W + _BINS + f" SELECT image_id, zone, n, {', '.join('CASE WHEN ' + _HALF.format('sa', 'n') + ' = 0 THEN 0 ELSE ' + _HALF.format('sa' + c, 'greatest(sa, 1)') + ' END AS ' + c for c in 'rgb')}, {_HALF.format('sa', 'n')} AS a FROM (SELECT image_id, zone, CAST(sum(n) AS BIGINT) AS n, CAST(sum(sa) AS BIGINT) AS sa, CAST(sum(sar) AS BIGINT) AS sar, CAST(sum(sag) AS BIGINT) AS sag, CAST(sum(sab) AS BIGINT) AS sab FROM bins GROUP BY image_id, zone)",
    "alpha_mass": _W + _BINS + " SELECT image_id, a AS alpha, CAST(sum(n) AS BIGINT) AS mass FROM means GROUP BY ALL",
    "alpha_quantile_seeds": _W + _BINS + _SEEDS + " SELECT * FROM seeds",
    "stride_sample": _W + _BINS + " SELECT image_id, bin_ord, n FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS c FROM bins) WHERE bin_ord % CAST(ceil(c / 100.0) AS BIGINT) = 0",
    "distinct_zones": _W + f" SELECT DISTINCT image_id, {_Z} AS zone FROM px",
    "seed_palette": _W + _PAL + " SELECT * FROM pal",
    "nearest_entry_zone": _W + _PAL + _N + " SELECT * FROM near",
    "nearest_with_fallback": _FB + f", rest AS (SELECT pt.* FROM pt WHERE zone <> 0 AND NOT EXISTS (SELECT 1 FROM pe WHERE pe.image_id = pt.image_id AND pe.zone = pt.zone)), fb AS (SELECT image_id, r, g, b, a, arg_min(idx, (clear, d2, idx)) AS idx, arg_min(d2, (clear, d2, idx)) AS d2 FROM (SELECT rest.image_id, r, g, b, a, idx, pe.zone = 0 AS clear, (p0-q0)*(p0-q0)+(p1-q1)*(p1-q1)+(p2-q2)*(p2-q2)+(p3-q3)*(p3-q3) AS d2 FROM rest JOIN pe USING (image_id)) GROUP BY ALL), un AS (SELECT * FROM near UNION ALL SELECT * FROM fb) SELECT pt.image_id, r, g, b, a, coalesce(idx, -1) AS idx, coalesce(d2, -1) AS d2 FROM pt LEFT JOIN un USING (image_id, r, g, b, a)",
    "remap_join": _W + _PAL + _ASG + " SELECT * FROM asg",
    "palette_frequency": _W + _PAL + _ASG + " SELECT * FROM freq",
    "palette_cleanup": _W + _PAL + _ASG + ", us AS (SELECT pal.*, min(idx) OVER (PARTITION BY image_id, r, g, b, a) AS first FROM pal WHERE EXISTS (SELECT 1 FROM asg WHERE asg.image_id = pal.image_id AND asg.idx = pal.idx)) SELECT image_id, idx, r, g, b, a, dense_rank() OVER (PARTITION BY image_id ORDER BY first) - 1 AS new_idx FROM us",
    "worst_served": _W + _PAL + f", pe AS (SELECT image_id, idx, {_Z} AS zone, r * a AS q0, g * a AS q1, b * a AS q2, 255 * a AS q3 FROM pal), nn AS (SELECT image_id, zone, bin_ord, {_PACK} AS packed, min((p0-q0)*(p0-q0)+(p1-q1)*(p1-q1)+(p2-q2)*(p2-q2)+(p3-q3)*(p3-q3)) AS d2 FROM means JOIN pe USING (image_id, zone) GROUP BY ALL) SELECT image_id, zone, arg_min(bin_ord, (-d2, packed, bin_ord)) AS bin_ord, max(d2) AS d2, arg_min(packed, (-d2, packed, bin_ord)) AS packed FROM nn GROUP BY image_id, zone",
    "refine_one_step": _W + _PAL + f", pe AS (SELECT image_id, idx, {_Z} AS zone, r * a AS q0, g * a AS q1, b * a AS q2, 255 * a AS q3 FROM pal), nn AS (SELECT image_id, n, sa, sar, sag, sab, bin_ord, arg_min(idx, (d2, idx)) AS idx FROM (SELECT m.image_id, m.n, sa, sar, sag, sab, bin_ord, idx, (p0-q0)*(p0-q0)+(p1-q1)*(p1-q1)+(p2-q2)*(p2-q2)+(p3-q3)*(p3-q3) AS d2 FROM means m JOIN pe USING (image_id, zone)) GROUP BY ALL), su AS (SELECT image_id, idx, sum(n) AS n, sum(sa) AS sa, sum(sar) AS sar, sum(sag) AS sag, sum(sab) AS sab FROM nn GROUP BY ALL) SELECT pal.image_id, pal.idx, {', '.join('CAST(CASE WHEN n IS NULL OR a = 0 THEN ' + c + ' ELSE ' + _HALF.format('sa' + c, 'greatest(sa, 1)') + ' END AS BIGINT) AS ' + c for c in 'rgb')}, CAST(CASE WHEN n IS NULL OR a = 0 THEN a WHEN a = 255 THEN 255 ELSE {_HALF.format('sa', 'n')} END AS BIGINT) AS a FROM pal LEFT JOIN su USING (image_id, idx)",
    "local_gradient": _W + _LG + " SELECT image_id, pos, gradient FROM lg",
    "adaptive_strength": _W + _PAL + _N + _LG + " SELECT lg.image_id, pos, CASE WHEN d2 + gradient = 0 THEN 0 ELSE d2 END AS num, CASE WHEN d2 + gradient = 0 THEN 1 ELSE d2 + gradient END AS den FROM lg JOIN near USING (image_id, r, g, b, a)",
    "flat_seeds": _CLS + " SELECT image_id, pos, seed FROM n6",
    "region_classes": _CLS + " SELECT image_id, pos, class FROM cls",
    "region_directives": _CLS + f" SELECT image_id, pos, region, barrier, CAST(num AS BIGINT) AS num, CAST(den AS BIGINT) AS den FROM cls JOIN (VALUES {_DIR}) t(class, region, barrier, num, den) USING (class)",
    "class_counts": _CLS + " SELECT image_id, class, count(*) AS n FROM cls GROUP BY ALL",
    "unit_strength": _CLS + ", ct AS (SELECT image_id, count(*) FILTER (class IN ('gradient-opaque', 'gradient-alpha', 'soft-shadow')) AS b, count(*) FILTER (class IN ('texture', 'flat')) AS n FROM cls GROUP BY image_id) SELECT image_id, CASE WHEN b = 0 THEN 0 ELSE b // gcd(b, b + n) END AS num, CASE WHEN b = 0 THEN 1 ELSE (b + n) // gcd(b, b + n) END AS den FROM ct",
    "bluenoise_remap": _W + _PAL + f", mk AS (SELECT *, ((CAST((my * 37 + mx * 11 + c * 23 + my * mx) % 64 AS DOUBLE) + 0.5) / 64.0 - 0.5) AS v FROM range(3) a(c), range(8) b(my), range(8) d(mx)), wd AS (SELECT my, mx, {', '.join(f'max(v) FILTER (c = {i}) * CAST({255.0 / 24 ** (1 / 3)!r} AS DOUBLE) AS n{i}' for i in range(3))} FROM mk GROUP BY ALL), mv AS (SELECT image_id, pos, a, {_Z} AS zone, {', '.join(f'CAST(greatest(0, least(65025, round_even(({c} + 1.0 * (0.25 * n{i} + 0.75 * ((n0 + n1 + n2) / 3.0))) * a, 0))) AS BIGINT) AS m{i}' for i, c in enumerate('rgb'))} FROM px JOIN wd ON y % 8 = my AND x % 8 = mx), pe AS (SELECT image_id, idx, {_Z} AS zone, r * a AS q0, g * a AS q1, b * a AS q2, 255 * a AS q3 FROM pal) SELECT image_id, pos, arg_min(idx, (d2, idx)) AS idx FROM (SELECT mv.image_id, pos, idx, (m0-q0)*(m0-q0)+(m1-q1)*(m1-q1)+(m2-q2)*(m2-q2)+(255*a-q3)*(255*a-q3) AS d2 FROM mv JOIN pe USING (image_id, zone)) GROUP BY image_id, pos",
    "row_filters": _TB + " SELECT image_id, y, filter, string_agg(printf('%02X', f), '' ORDER BY x) AS f FROM fl GROUP BY image_id, y, filter",
    "filter_residual": _TB + " SELECT * FROM sc",
    "best_filter": _TB + " SELECT image_id, y, arg_min(filter, (score, filter)) AS filter, min(score) AS score FROM sc GROUP BY image_id, y",
    "bit_packing": _W + _PAL + _ASG + " SELECT image_id, y, x // 2 AS x, CAST(sum((idx % 16) * CASE WHEN x % 2 = 0 THEN 16 ELSE 1 END) AS BIGINT) AS v FROM asg GROUP BY image_id, y, x // 2",
    "order_frequency": _W + _PAL + _ASG + _rank("freq", "n DESC"),
    "order_luminance": _W + _PAL + _rank("pal", "299 * r + 587 * g + 114 * b"),
    "order_channel": _W + _PAL + _rank("pal", "r, g, b, a"),
    "order_alpha_first": _W + _PAL + _rank("pal", "a = 255, a"),
    "order_alpha_frequency": _W + _PAL + _ASG + _rank("(SELECT pal.*, n FROM pal JOIN freq USING (image_id, idx))", "a = 255, n DESC, CASE WHEN a <> 255 THEN a END"),
    "order_transparent_front": _W + _PAL + ", h AS (SELECT *, sum(CAST(a <> 255 AS INT)) OVER (PARTITION BY image_id) AS soft, sum(CAST(a = 0 AS INT)) OVER (PARTITION BY image_id) AS clear FROM pal)" + _rank("h WHERE soft = 1 AND clear = 1", "a <> 0"),
    "spatial_adjacency": _W + _PAL + _ASG + f", p AS (SELECT image_id, idx AS i, lead(idx) {_ROW} AS j FROM asg UNION ALL SELECT image_id, idx, lead(idx) {_COL} FROM asg), q AS (SELECT * FROM p UNION ALL SELECT image_id, j, i FROM p) SELECT image_id, i, j, count(*) AS n FROM q WHERE i <> j GROUP BY ALL",
    "byte_cooccurrence": _W + _PAL + _ASG + " SELECT l.image_id, l.idx AS i, o.idx AS j, count(*) AS n FROM asg l JOIN asg o ON l.image_id = o.image_id AND l.y = o.y AND l.x // 2 = o.x // 2 AND l.x <> o.x AND l.idx <> o.idx GROUP BY ALL",
    "best_variant": _VT + " SELECT * FROM sm",
    "finalists": _VT + " SELECT image_id, palette, gen, len, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY len, gen) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id, palette ORDER BY len, gen) AS f FROM vt) WHERE f = 1) WHERE rank <= 3",
    "never_worse": _VT + " SELECT image_id, CASE WHEN len < 30 THEN len ELSE 30 END AS bytes, NOT (len < 30) AS fallback FROM sm",
    "mse": _W + _PAL + _ASG + f" SELECT l.image_id, CAST(sum({_SQ}) AS BIGINT) AS total, count(*) AS n FROM px l JOIN asg USING (image_id, pos) JOIN pal o ON o.image_id = asg.image_id AND o.idx = asg.idx GROUP BY l.image_id",
    "identity_check": _W + _PAL + _ASG + " SELECT l.image_id, l.pos FROM px l JOIN asg USING (image_id, pos) JOIN pal o ON o.image_id = asg.image_id AND o.idx = asg.idx WHERE NOT (l.r = o.r AND l.g = o.g AND l.b = o.b AND l.a = o.a)",
    "header_validation": _HD + " SELECT * FROM vh",
    "adam7_geometry": _GEO + " SELECT image_id, pass, columns, rows, (bits + 7) // 8 AS row_bytes FROM ge",
    "resource_limits": _GEO + " SELECT image_id, CAST(sum(rows * (1 + (bits + 7) // 8)) AS BIGINT) AS scan, CASE WHEN any_value(width) > 32768 OR any_value(height) > 32768 THEN 'dimension' WHEN any_value(width * height) > 67108864 THEN 'pixels' WHEN sum(rows * (1 + (bits + 7) // 8)) > 536870912 THEN 'scanlines' ELSE 'ok' END AS verdict FROM ge GROUP BY image_id",
    "chunk_framing": f"WITH tb AS (SELECT list(c ORDER BY i) AS t FROM ({_CRC})), bd AS (SELECT page_id, encode('tEXt') || encode(coalesce(html, '')) AS body FROM pages), bl AS (SELECT page_id, body, hex(body) AS h FROM bd), cr AS (SELECT page_id, body, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(body)), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), 4294967295) AS crc FROM bl, tb) SELECT page_id, crc, sha256(unhex(printf('%08X', octet_length(body) - 4)) || body || unhex(printf('%08X', crc))) AS sha, CAST(8 + octet_length(body) AS BIGINT) AS n FROM cr",
    "json_report": _VT + """, iz AS (SELECT image_id, CAST(sum(len) AS BIGINT) // (2 * count(*)) AS bytes_in, count(DISTINCT palette) AS palette_size FROM vt GROUP BY image_id) SELECT image_id, '{"schema_version":"tessera.report/1","bytes_in":' || bytes_in || ',"bytes_out":' || least(len, bytes_in) || ',"palette_size":' || palette_size || ',"candidate":"' || CASE WHEN len < bytes_in THEN 'encoded' ELSE 'input-verbatim' END || '","guard":"guarded","never_worse_fallback":' || CASE WHEN len < bytes_in THEN 'false' ELSE 'true' END || '}' AS report FROM sm JOIN iz USING (image_id)""",
    "remap_bins": _W + _PAL + _MODE + f""", gm AS (SELECT *, {_ZONE.format(_HALF.format('sa', 'n'))} AS zone, {', '.join(_HALF.format('sa' + c, 'n') + f' AS p{i}' for i, c in enumerate('rgb'))}, {_HALF.format('255 * sa', 'n')} AS p3 FROM gb),
  pe AS (SELECT image_id, idx, {_Z} AS zone, r * a AS q0, g * a AS q1, b * a AS q2, 255 * a AS q3 FROM pal), nb AS (SELECT image_id, exact, k0, k1, k2, k3, arg_min(idx, (d2, idx)) AS idx FROM (SELECT gm.*, idx, (p0-q0)*(p0-q0)+(p1-q1)*(p1-q1)+(p2-q2)*(p2-q2)+(p3-q3)*(p3-q3) AS d2 FROM gm JOIN pe USING (image_id, zone)) GROUP BY ALL),
  md AS (SELECT DISTINCT image_id, exact FROM gb), pk AS (SELECT px.image_id, pos, y, x, {', '.join(f'CASE WHEN exact THEN {c} ELSE {g} END AS k{i}' for i, (c, g) in enumerate(zip('rgba', ('r * 16 // 256', 'g * 16 // 256', 'b * 16 // 256', 'CASE WHEN a = 0 THEN 0 WHEN a = 255 THEN 15 ELSE 1 + (a - 1) * 14 // 254 END'))))} FROM px JOIN md USING (image_id))
  SELECT pk.image_id, pos, y, x, idx FROM pk LEFT JOIN nb USING (image_id, k0, k1, k2, k3)""",
    "slot_cooccurrence": _W + _PAL + _SEEDS + _SLOT + " SELECT * FROM slot",
    "rank_slots": _W + _PAL + _SEEDS + _SLOT + f""", nm AS (SELECT image_id, rep, level, zone, n, first_ord, {', '.join('CASE WHEN ' + _HALF.format('sa', 'n') + ' = 0 THEN 0 ELSE ' + _HALF.format('sa' + c, 'greatest(sa, 1)') + ' END AS ' + c for c in 'rgb')}, {_HALF.format('sa', 'n')} AS a FROM slot),
  hd AS (SELECT *, row_number() OVER (PARTITION BY image_id, zone ORDER BY n DESC, {_PACK}, first_ord) = 1 AS head FROM nm) SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY CASE WHEN head THEN zone ELSE 3 END, n DESC, {_PACK}, first_ord) - 1 AS rank FROM hd""",
    "hard_edge": _CLS + " SELECT image_id, pos, (edge OR (big >= 1020 AND more * 4 <= big)) AS hard FROM n6",
    "fewest_colors": _W + _PAL + f""", rk AS (SELECT *, {_Z} AS zone, r * a AS q0, g * a AS q1, b * a AS q2, 255 * a AS q3, row_number() OVER (PARTITION BY image_id, {_Z} ORDER BY idx) - 1 AS rank FROM pal),
  pz AS (SELECT image_id, pos, {_Z} AS zone, r * a AS p0, g * a AS p1, b * a AS p2, 255 * a AS p3 FROM px), er AS (SELECT pz.image_id, pos, CAST(k AS BIGINT) AS k, min((p0-q0)*(p0-q0)+(p1-q1)*(p1-q1)+(p2-q2)*(p2-q2)+(p3-q3)*(p3-q3)) AS d2 FROM pz JOIN rk USING (image_id, zone), range(1, {PER_ZONE + 1}) t(k) WHERE rank < k GROUP BY ALL),
  et AS (SELECT image_id, k, CAST(sum(d2) AS DOUBLE) / CAST(count(*) * 4 * {255**4} AS DOUBLE) <= CAST({ceiling(QUALITY)!r} AS DOUBLE) AS passes FROM er GROUP BY image_id, k) SELECT image_id, coalesce(min(k) FILTER (passes), max(k)) AS k, NOT bool_or(passes) AS fallback FROM et GROUP BY image_id""",
    "png_roundtrip": _W + _PAL + _ASG + " SELECT asg.image_id, count(*) AS n, sha256(unhex(string_agg(printf('%02X%02X%02X%02X', r, g, b, a), '' ORDER BY pos))) AS sha FROM asg JOIN pal ON pal.image_id = asg.image_id AND pal.idx = asg.idx GROUP BY asg.image_id",
}
ORACLES |= {f"scene_{name}": ORACLES[name].replace(_PX, _SCENE) for name in SCENES}
