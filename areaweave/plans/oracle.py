"""SQL for each registered query, for another engine (DuckDB dialect).

Written independently of the Spark code: brute-force joins on whole millidegrees,
and measures as plain aggregates over vertex and edge tables.
"""

from __future__ import annotations


from areaweave.settings import DEFAULT_RULES

# --- Fixed values: WGS84 and UTM, written out apart from the engine's -----------

ECC = 0.08181919084262149
SCALE = 6364902.166165086
FALSE_EASTING = 500000.0
SOUTH_NORTHING = 10000000.0
ALPHA = (
    0.0008377318206244698,
    7.608527773572307e-07,
    1.1976455033294527e-09,
    2.4291706072013587e-12,
    5.711757677865804e-15,
    1.4911177312583895e-17,
)
BETA = (
    0.0008377321640579488,
    5.905870152220203e-08,
    1.673482665283997e-10,
    2.1647980400627056e-13,
    3.787978046168605e-16,
    7.2487488906941545e-19,
)
DELTA = (
    0.003356551469132832,
    6.571873198628443e-06,
    1.7646404113085808e-08,
    5.3877537842559224e-11,
    1.7640074726322128e-13,
    6.056073876794177e-16,
)

ORACLES: dict[str, str] = {}

# --- shared tables -----------------------------------------------------------

# Named CTEs and the CTEs each of them needs.
_CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: str, body: str) -> None:
    _CTES[name] = (tuple(needs.split()), body)


def sql(needs: str, body: str) -> str:
    """``body`` behind every CTE it needs, in order."""
    listed: list[str] = []

    def add(name: str) -> None:
        if name not in listed:
            for other in _CTES[name][0]:
                add(other)
            listed.append(name)

    for name in needs.split():
        add(name)
    heads = ", ".join(f"{name} AS ({_CTES[name][1]})" for name in listed)
    return f"WITH {heads} {body}" if heads else body


def _places(name: str, base: str, null_when: str) -> None:
    """Places, their outline vertices (pos from 1, closed) and their edges."""
    cte(name, "", f"SELECT *, w // 2 AS h FROM ({base})")
    shape = (
        "CASE WHEN k % 3 = 0 THEN [[x0,y0],[x0+w,y0],[x0+w,y0+h],[x0+h,y0+h],[x0+h,y0+w],[x0,y0+w],[x0,y0]] "
        "ELSE [[x0,y0],[x0+w,y0],[x0+w,y0+w],[x0,y0+w],[x0,y0]] END"
    )
    cte(
        f"{name}_v",
        name,
        f"SELECT k, i, vs[i][1] AS x, vs[i][2] AS y FROM (SELECT k, vs, unnest(generate_series(1, len(vs))) AS i "
        f"FROM (SELECT k, {shape} AS vs FROM {name} WHERE NOT ({null_when})))",
    )
    cte(
        f"{name}_e",
        f"{name}_v",
        f"SELECT a.k, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {name}_v a "
        f"JOIN {name}_v b ON a.k = b.k AND b.i = a.i + 1",
    )
    cte(
        f"{name}_box",
        f"{name}_v",
        f"SELECT k, min(x) AS bx0, min(y) AS by0, max(x) AS bx1, max(y) AS by1 FROM {name}_v GROUP BY k",
    )


_places(
    "b",
    "SELECT n_nationkey::BIGINT AS k, 'Lga ' || (n_nationkey % 20) AS lga_name, "
    "'State ' || (n_nationkey // 5) AS state_name, "
    "CASE n_nationkey WHEN 16 THEN 'Other Place, Other State, Nigeria' WHEN 17 THEN NULL "
    "ELSE 'Lga ' || (n_nationkey % 20) || ', State ' || (n_nationkey // 5) || ', Nigeria' END AS display_name, "
    "2600 + 2400 * (n_nationkey % 5)::BIGINT - CASE WHEN n_nationkey = 19 THEN 30000 ELSE 0 END AS x0, "
    "4200 + 1900 * (n_nationkey // 5)::BIGINT AS y0, "
    "(CASE n_nationkey WHEN 7 THEN 1 WHEN 13 THEN 2000 ELSE 800 END)::BIGINT AS w FROM nation",
    "k = 11",
)
_places(
    "gz",
    "SELECT k, 'Lga ' || (k // 3) AS lga_name, 'State ' || (k % 7) AS state_name, "
    "CASE WHEN k % 16 = 5 THEN 'Other Place, Other State, Nigeria' WHEN k % 16 = 6 THEN NULL "
    "ELSE 'Lga ' || (k // 3) || ', State ' || (k % 7) || ', Nigeria' END AS display_name, "
    "2600 + (k * 2411) % 12000 - CASE WHEN k % 19 = 0 THEN 30000 ELSE 0 END AS x0, "
    "4100 + (k * 1907) % 9000 AS y0, "
    "CASE WHEN k % 17 = 3 THEN 2 WHEN k % 13 = 2 THEN 2000 ELSE 200 + (k * 37) % 500 END AS w "
    "FROM (SELECT c_custkey::BIGINT AS k FROM customer)",
    "k % 11 = 4",
)

_TAGS = ("highway", "building", "waterway", "natural", "landuse", "amenity")


def _tag_columns(**cases: str) -> str:
    return ", ".join(f"{cases.get(tag, 'NULL::VARCHAR')} AS \"{tag}\"" for tag in _TAGS)


cte(
    "pt",
    "",
    "SELECT 'node' AS element_type, osmid, 2500 + (osmid * 7919) % 12500 AS px, "
    "4000 + (osmid * 104729) % 10000 AS py, "
    + _tag_columns(
        highway="CASE WHEN osmid % 8 = 0 THEN 'traffic_signals' END",
        building="CASE WHEN osmid % 8 = 5 THEN 'yes' END",
        natural="CASE WHEN osmid % 8 = 7 THEN 'water' END",
        amenity="CASE osmid % 8 WHEN 1 THEN 'hospital' WHEN 2 THEN 'clinic' WHEN 3 THEN 'pharmacy' "
        "WHEN 4 THEN 'school' WHEN 5 THEN 'hospital' END",
    )
    + " FROM (SELECT o_orderkey::BIGINT AS osmid FROM orders)",
)
cte(
    "ln",
    "",
    "SELECT 'way' AS element_type, osmid, 2500 + (osmid * 7919) % 12400 AS bx, 4000 + (osmid * 4729) % 9900 AS bz, "
    + _tag_columns(
        highway="CASE osmid % 4 WHEN 0 THEN 'residential' WHEN 2 THEN 'primary' END",
        waterway="CASE WHEN osmid % 4 = 1 THEN 'stream' END",
    )
    + " FROM (SELECT p_partkey::BIGINT AS osmid FROM part)",
)
cte(
    "pg",
    "",
    "SELECT 'way' AS element_type, osmid, d, 2500 + (d * 7919) % 12400 AS bx, 4000 + (d * 4729) % 9900 AS bz, "
    "2 + d % 5 AS s, CASE WHEN osmid % 97 = 13 THEN 'null' WHEN osmid % 101 = 5 THEN 'empty' "
    "WHEN d % 50 = 7 THEN 'bowtie' ELSE 'ok' END AS state, "
    + _tag_columns(
        building="CASE WHEN d % 6 IN (0, 3) THEN 'yes' END",
        natural="CASE WHEN d % 6 = 4 THEN 'water' END",
        landuse="CASE WHEN d % 6 = 1 THEN 'farmland' END",
        amenity="CASE d % 6 WHEN 2 THEN 'school' WHEN 3 THEN 'hospital' WHEN 5 THEN 'bank' END",
    )
    + " FROM (SELECT osmid, CASE WHEN osmid % 40 = 39 THEN osmid - 1 ELSE osmid END AS d "
    "FROM (SELECT c_custkey::BIGINT AS osmid FROM customer))",
)
_PG_RING = (
    "CASE WHEN state = 'bowtie' THEN [[bx,bz],[bx+s,bz],[bx,bz+s],[bx+s,bz+s],[bx,bz]] "
    "ELSE [[bx,bz],[bx+s,bz],[bx+s,bz+s],[bx,bz+s],[bx,bz]] END"
)
# Every feature with a geometry; uid tells lines from polygons of the same id.
cte(
    "ft",
    "pt ln pg",
    "SELECT 'p' AS kind, 'p' || osmid AS uid, element_type, osmid, 'ok' AS state, [[px,py]] AS vs, "
    f"{', '.join(_quoted for _quoted in (chr(34) + t + chr(34) for t in _TAGS))} FROM pt UNION ALL "
    "SELECT 'l', 'l' || osmid, element_type, osmid, 'ok', [[bx,bz],[bx+40,bz+25],[bx+80,bz+10]], "
    f"{', '.join(chr(34) + t + chr(34) for t in _TAGS)} FROM ln UNION ALL "
    f"SELECT 'g', 'g' || osmid, element_type, osmid, state, {_PG_RING}, "
    f"{', '.join(chr(34) + t + chr(34) for t in _TAGS)} FROM pg WHERE state IN ('ok', 'bowtie')",
)
cte(
    "fv",
    "ft",
    "SELECT uid, kind, i, vs[i][1] AS x, vs[i][2] AS y "
    "FROM (SELECT uid, kind, vs, unnest(generate_series(1, len(vs))) AS i FROM ft)",
)
cte(
    "fe",
    "fv",
    "SELECT a.uid, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM fv a JOIN fv b "
    "ON a.uid = b.uid AND b.i = a.i + 1",
)
cte(
    "fbox",
    "fv",
    "SELECT uid, any_value(kind) AS kind, min(x) AS fx0, min(y) AS fy0, max(x) AS fx1, max(y) AS fy1 "
    "FROM fv GROUP BY uid",
)
_LAYERS = {
    "roads": "highway IS NOT NULL",
    "buildings": "building IS NOT NULL",
    "waterways": "waterway IS NOT NULL OR \"natural\" = 'water'",
    "landuse": "landuse IS NOT NULL",
    "health_facilities": "amenity IN ('hospital', 'clinic', 'pharmacy')",
    "schools": "amenity = 'school'",
}
# All tagged elements, those without a geometry included.
cte(
    "el",
    "pt ln pg",
    " UNION ALL ".join(
        f"SELECT '{kind}' || osmid AS uid, element_type, osmid, {', '.join(chr(34) + t + chr(34) for t in _TAGS)} FROM {t}"
        for kind, t in (("p", "pt"), ("l", "ln"), ("g", "pg"))
    ),
)
cte(
    "el_layer",
    "el",
    " UNION ALL ".join(
        f"SELECT uid, element_type, osmid, '{layer}' AS layer, {i} AS pos FROM el WHERE {test}"
        for i, (layer, test) in enumerate(_LAYERS.items())
    ),
)

# --- spatial predicates, brute force -----------------------------------------

_ON = (
    "(px BETWEEN least(x1, x2) AND greatest(x1, x2) AND py BETWEEN least(y1, y2) AND greatest(y1, y2) "
    "AND (x2 - x1) * (py - y1) = (y2 - y1) * (px - x1))"
)
_CROSS = (
    "((y1 > py) <> (y2 > py) AND CASE WHEN y2 > y1 THEN (py - y1) * (x2 - x1) > (px - x1) * (y2 - y1) "
    "ELSE (py - y1) * (x2 - x1) < (px - x1) * (y2 - y1) END)"
)
_IN = f"(bool_or({_ON}) OR count(*) FILTER (WHERE {_CROSS}) % 2 = 1)"


def _side(a: str, b: str, c: str) -> str:
    (ax, ay), (bx, by), (cx, cy) = (p.split() for p in (a, b, c))
    return f"sign(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax}))"


def _touch(p: str, q: str) -> str:
    p1, p2, q1, q2 = f"{p}.x1 {p}.y1", f"{p}.x2 {p}.y2", f"{q}.x1 {q}.y1", f"{q}.x2 {q}.y2"
    overlap = " AND ".join(
        f"least({p}.{a}1, {p}.{a}2) <= greatest({q}.{a}1, {q}.{a}2) "
        f"AND least({q}.{a}1, {q}.{a}2) <= greatest({p}.{a}1, {p}.{a}2)"
        for a in "xy"
    )
    return (
        f"({overlap} AND {_side(p1, p2, q1)} * {_side(p1, p2, q2)} <= 0 "
        f"AND {_side(q1, q2, p1)} * {_side(q1, q2, p2)} <= 0)"
    )


# Candidate pairs by box, then: vertex inside, edges touching, or place inside feature.
cte(
    "cand",
    "fbox b_box",
    "SELECT f.uid, f.kind, b.k FROM fbox f JOIN b_box b ON fx0 <= bx1 AND fx1 >= bx0 AND fy0 <= by1 AND fy1 >= by0",
)
cte(
    "hit",
    "cand fv fe b_e b_v",
    f"SELECT uid, k FROM (SELECT c.uid, c.k, v.i FROM cand c JOIN (SELECT uid, i, x AS px, y AS py FROM fv) v USING (uid) "
    f"JOIN b_e USING (k) GROUP BY c.uid, c.k, v.i, px, py HAVING {_IN}) UNION "
    f"SELECT c.uid, c.k FROM cand c JOIN fe p ON p.uid = c.uid JOIN b_e q ON q.k = c.k WHERE {_touch('p', 'q')} UNION "
    f"SELECT uid, k FROM (SELECT c.uid, c.k, v.i FROM cand c JOIN (SELECT k, i, x AS px, y AS py FROM b_v) v USING (k) "
    f"JOIN fe USING (uid) WHERE c.kind = 'g' GROUP BY c.uid, c.k, v.i, px, py HAVING {_IN})",
)

# --- projection --------------------------------------------------------------


def _forward(table: str, keep: str) -> str:
    """(keep, lon, lat, srid) -> (keep, srid, e, n)."""
    e = " + ".join(f"({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(ALPHA, 1))
    n = " + ".join(f"({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(ALPHA, 1))
    return (
        f"SELECT {keep}, srid, {FALSE_EASTING!r}::DOUBLE + {SCALE!r}::DOUBLE * (eta + {e}) AS e, "
        f"(CASE WHEN srid >= 32700 THEN {SOUTH_NORTHING!r} ELSE 0 END)::DOUBLE + {SCALE!r}::DOUBLE * (xi + {n}) AS n "
        f"FROM (SELECT {keep}, srid, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta "
        f"FROM (SELECT {keep}, srid, radians(lon - ((srid % 100) * 6 - 183)) AS lam, "
        f"sinh(atanh(sin(radians(lat))) - {ECC!r}::DOUBLE * atanh({ECC!r}::DOUBLE * sin(radians(lat)))) AS t FROM {table}))"
    )


def _inverse(table: str, keep: str) -> str:
    """(keep, e, n, srid) -> (keep, srid, lon, lat)."""
    x = " + ".join(f"({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(BETA, 1))
    y = " + ".join(f"({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(BETA, 1))
    lat = " + ".join(f"({c!r}) * sin({2 * j} * chi)" for j, c in enumerate(DELTA, 1))
    return (
        f"SELECT {keep}, srid, ((srid % 100) * 6 - 183) + degrees(lam) AS lon, degrees(chi + {lat}) AS lat "
        f"FROM (SELECT {keep}, srid, asin(sin(a) / cosh(h)) AS chi, atan2(sinh(h), cos(a)) AS lam "
        f"FROM (SELECT {keep}, srid, xi - ({x}) AS a, eta - ({y}) AS h "
        f"FROM (SELECT {keep}, srid, (n - (CASE WHEN srid >= 32700 THEN {SOUTH_NORTHING!r} ELSE 0 END)) / {SCALE!r}::DOUBLE AS xi, "
        f"(e - {FALSE_EASTING!r}) / {SCALE!r}::DOUBLE AS eta FROM {table})))"
    )


def _zone(lon: str, lat: str) -> str:
    return (
        f"(CASE WHEN {lat} >= 0 THEN 32600 ELSE 32700 END + "
        f"greatest(1, least(60, trunc(({lon} + 180) / 6)::INT + 1)))::INT"
    )


def _r(value: str, scale: str) -> str:
    return f"floor({value} * {scale} + 0.5)::BIGINT"


def _ring_measures(table: str, keys: str, x: str, y: str) -> str:
    """Vertices (keys, i, x, y of a closed ring) -> area and centroid by moments."""
    return (
        f"SELECT {keys}, abs(sum(c)) / 2 AS area, any_value(ox) + sum((ax + ex) * c) / (3 * sum(c)) AS cx, "
        f"any_value(oy) + sum((ay + ey) * c) / (3 * sum(c)) AS cy FROM (SELECT *, ax * ey - ex * ay AS c "
        f"FROM (SELECT p.*, p.px - o.px AS ax, p.py - o.py AS ay, q.px - o.px AS ex, q.py - o.py AS ey, o.px AS ox, o.py AS oy "
        f"FROM (SELECT *, {x} AS px, {y} AS py FROM {table}) p "
        f"JOIN (SELECT {keys}, i, {x} AS px, {y} AS py FROM {table}) q USING ({keys}) "
        f"JOIN (SELECT {keys}, i, {x} AS px, {y} AS py FROM {table}) o USING ({keys}) "
        f"WHERE q.i = p.i + 1 AND o.i = 1)) GROUP BY {keys}"
    )


def _checked(name: str) -> None:
    """Centroid, zone, area and verdict of every place with an outline."""
    cte(f"{name}_c", f"{name}_v", _ring_measures(f"{name}_v", "k", "x / 1000.0", "y / 1000.0"))
    cte(f"{name}_z", f"{name}_c", f"SELECT k, cx, cy, {_zone('cx', 'cy')} AS srid FROM {name}_c")
    cte(f"{name}_vz", f"{name}_v {name}_z", f"SELECT k, i, x / 1000.0 AS lon, y / 1000.0 AS lat, srid FROM {name}_v JOIN {name}_z USING (k)")
    cte(f"{name}_p", f"{name}_vz", _forward(f"{name}_vz", "k, i"))
    cte(f"{name}_a", f"{name}_p", _ring_measures(f"{name}_p", "k", "e", "n"))
    cte(
        f"{name}_ok",
        f"{name} {name}_z {name}_a",
        f"SELECT p.k, p.lga_name, p.state_name, p.display_name, z.cx, z.cy, coalesce(z.srid, 32631) AS srid, a.area AS area_m2, "
        "CASE WHEN z.k IS NULL THEN 'empty' WHEN NOT (z.cx BETWEEN 2.5 AND 15.0 AND z.cy BETWEEN 4.0 AND 14.0) THEN 'outside' "
        "WHEN a.area / 1000000 < 2 THEN 'small' WHEN a.area / 1000000 > 10000 THEN 'large' END AS reason_code "
        f"FROM {name} p LEFT JOIN {name}_z z USING (k) LEFT JOIN {name}_a a USING (k)",
    )


_checked("b")
_checked("gz")

_ID = "md5(lower(trim({}) || '|' || coalesce(trim({}), '')))"
cte("acc", "b_ok", f"SELECT *, {_ID.format('lga_name', 'state_name')} AS lga_id FROM b_ok WHERE reason_code IS NULL")
cte(
    "raw",
    "acc hit el_layer ft",
    "SELECT a.lga_id, a.srid, a.lga_name, a.state_name, l.layer, l.pos, l.element_type, l.osmid, l.uid, f.kind, f.state, f.vs "
    "FROM acc a JOIN hit USING (k) JOIN el_layer l USING (uid) JOIN ft f USING (uid)",
)
cte(
    "kept",
    "raw",
    "SELECT * FROM raw WHERE state = 'ok' QUALIFY row_number() OVER "
    "(PARTITION BY lga_id, layer, kind, vs ORDER BY element_type, osmid) = 1",
)
cte(
    "kept_v",
    "kept",
    "SELECT lga_id, layer, uid, i, srid, vs[i][1] / 1000.0 AS lon, vs[i][2] / 1000.0 AS lat "
    "FROM (SELECT *, unnest(generate_series(1, len(vs))) AS i FROM kept)",
)
cte("kept_p", "kept_v", _forward("kept_v", "lga_id, layer, uid, i"))
cte("kept_c", "kept_p kept", "SELECT * FROM (" + _ring_measures(
    "(SELECT p.* FROM kept_p p JOIN (SELECT DISTINCT uid, kind FROM kept) USING (uid) WHERE kind = 'g' "
    "AND layer IN ('health_facilities', 'schools'))", "lga_id, layer, uid", "e", "n") + ")")
# Final vertices: outlines of facilities are one point.
cte(
    "out_v",
    "kept kept_p kept_c",
    "SELECT k.lga_id, k.lga_name, k.state_name, k.layer, k.pos, k.element_type, k.osmid, k.srid, "
    "CASE k.kind WHEN 'p' THEN 'Point' WHEN 'l' THEN 'LineString' ELSE 'Polygon' END AS gtype, p.i - 1 AS i, p.e, p.n "
    "FROM kept k JOIN kept_p p USING (lga_id, layer, uid) LEFT JOIN kept_c c USING (lga_id, layer, uid) WHERE c.uid IS NULL "
    "UNION ALL SELECT k.lga_id, k.lga_name, k.state_name, k.layer, k.pos, k.element_type, k.osmid, k.srid, 'Point', 0, c.cx, c.cy "
    "FROM kept k JOIN kept_c c USING (lga_id, layer, uid)",
)
cte(
    "cnt",
    "out_v",
    "SELECT lga_id, lga_name, state_name, layer, pos, srid, CASE gtype WHEN 'Point' THEN 'point' WHEN 'LineString' THEN 'line' "
    "ELSE 'polygon' END AS geom_category, count(*) AS n FROM out_v WHERE i = 0 GROUP BY ALL",
)
_RULES_LIST = "[" + ", ".join(f"'{name}'" for name in DEFAULT_RULES) + "]"
cte(
    "grid",
    "acc",
    f"SELECT lga_id, lga_name, state_name, layer, list_position({_RULES_LIST}, layer)::INT - 1 AS position "
    f"FROM (SELECT *, unnest({_RULES_LIST}) AS layer FROM acc)",
)
cte("rawcnt", "raw", "SELECT lga_id, layer, count(*) AS n FROM raw GROUP BY ALL")

# --- requests ----------------------------------------------------------------

cte(
    "rq",
    "",
    "SELECT CASE WHEN id % 101 = 7 THEN '   ' WHEN id % 97 = 9 THEN 'Nowhere ' || k "
    "WHEN id % 6 = 1 THEN ' Lga ' || (k // 3) || '  ' ELSE 'Lga ' || (k // 3) END AS lga_name, "
    "CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN '' WHEN id % 6 = 2 THEN ' State ' || (k % 7) "
    "ELSE 'State ' || (k % 7) END AS state_name "
    "FROM (SELECT o_orderkey::BIGINT AS id, o_custkey::BIGINT AS k FROM orders)",
)
cte(
    "asked",
    "rq",
    f"SELECT DISTINCT {_ID.format('coalesce(l, chr(0)[2:])', 's')} AS lga_id, l AS lga_name, s AS state_name "
    "FROM (SELECT nullif(trim(lga_name), '') AS l, nullif(trim(state_name), '') AS s FROM rq)",
)
_MATCH = "lower(g.lga_name) = lower(a.lga_name) AND (a.state_name IS NULL OR lower(g.state_name) = lower(a.state_name))"
cte(
    "found",
    "asked gz",
    "SELECT a.lga_id, a.lga_name, a.state_name, min(g.k) AS k, count(g.k) AS matches "
    f"FROM asked a LEFT JOIN gz g ON {_MATCH} GROUP BY ALL",
)
_NOTE = (
    "CASE WHEN NOT contains(lower(display_name), lower(split_part(l, ' ', 1))) "
    "THEN 'The boundary''s display name does not mention the requested area ''' || l || '''; check it by hand.' END",
    "CASE WHEN NOT contains(lower(display_name), lower(s)) "
    "THEN 'The boundary''s display name does not mention the requested state ''' || s || '''; check it by hand.' END",
)


def _notes(lga: str, state: str) -> str:
    area = _NOTE[0].replace("lower(split_part(l,", f"lower(split_part({lga},").replace("|| l ||", f"|| {lga} ||")
    whole = _NOTE[1].replace("lower(s)", f"lower({state})").replace("|| s ||", f"|| {state} ||")
    return f"nullif(concat_ws('; ', {area}, {whole}), '')"


# --- tag rules ---------------------------------------------------------------

ORACLES["layer_counts_by_lga"] = sql(
    "grid rawcnt",
    "SELECT lga_name, state_name, layer, coalesce(n, 0)::BIGINT AS n FROM grid LEFT JOIN rawcnt USING (lga_id, layer)",
)
ORACLES["fx_features"] = sql(
    "el ft fbox pg",
    "SELECT el.element_type, el.osmid, el.highway, el.building, el.waterway, el.\"natural\", el.landuse, el.amenity, "
    "CASE el.uid[1] WHEN 'p' THEN 'Point' WHEN 'l' THEN 'LineString' WHEN 'g' THEN "
    "CASE WHEN ft.uid IS NOT NULL OR pg.state = 'empty' THEN 'Polygon' END END AS gtype, "
    "CASE WHEN ft.uid IS NOT NULL THEN len(ft.vs) WHEN pg.state = 'empty' THEN 0 END::INT AS n_vertices, "
    "fx0 * 10000 AS x0, fy0 * 10000 AS y0, fx1 * 10000 AS x1, fy1 * 10000 AS y1 "
    "FROM el LEFT JOIN ft USING (uid) LEFT JOIN fbox USING (uid) LEFT JOIN pg ON el.uid = 'g' || pg.osmid",
)
_FANOUT = "SELECT element_type, osmid, layer FROM el_layer"
ORACLES["layer_fanout"] = sql("el_layer", _FANOUT)
ORACLES["rule_membership"] = sql("el_layer", "SELECT DISTINCT element_type, osmid, layer FROM el_layer")
ORACLES["tag_any"] = sql("el", "SELECT element_type, osmid FROM el WHERE highway IS NOT NULL")
ORACLES["tag_equals"] = sql("el", "SELECT element_type, osmid FROM el WHERE amenity = 'school'")
ORACLES["tag_in"] = sql(
    "el", "SELECT element_type, osmid FROM el WHERE amenity IN ('hospital', 'clinic', 'pharmacy')"
)
ORACLES["unmatched_features"] = sql(
    "el el_layer", "SELECT element_type, osmid FROM el WHERE uid NOT IN (SELECT uid FROM el_layer)"
)
ORACLES["multi_layer_features"] = sql(
    "el_layer",
    "SELECT any_value(element_type) AS element_type, any_value(osmid) AS osmid, "
    "string_agg(layer, ',' ORDER BY pos) AS layers FROM el_layer GROUP BY uid HAVING count(*) > 1",
)

# --- zones, projection, measures ---------------------------------------------

ORACLES["utm_zone"] = (
    f"SELECT osmid, 'EPSG:' || {_zone('lon', 'lat')} AS crs, {_zone('lon', '0')} AS north_srid FROM "
    "(SELECT o_orderkey::BIGINT AS osmid, ((o_orderkey::BIGINT * 7919) % 360001 - 180000) / 1000.0 AS lon, "
    "((o_orderkey::BIGINT * 104729) % 180001 - 90000) / 1000.0 AS lat FROM orders)"
)
cte("ptz", "pt", f"SELECT osmid, px / 1000.0 AS lon, py / 1000.0 AS lat, {_zone('px / 1000.0', 'py')} AS srid FROM pt")
cte("ptf", "ptz", _forward("ptz", "osmid"))
cte("pti", "ptf", _inverse("ptf", "osmid"))
ORACLES["utm_forward_mm"] = sql("ptf", f"SELECT osmid, srid, {_r('e', '1000')} AS x, {_r('n', '1000')} AS y FROM ptf")
ORACLES["utm_inverse_1e7"] = sql(
    "pti", f"SELECT osmid, srid, {_r('lon', '10000000')} AS x, {_r('lat', '10000000')} AS y FROM pti"
)
cte(
    "sh",
    "fv ft",
    f"SELECT uid, kind, osmid, i, state, x / 1000.0 AS lon, y / 1000.0 AS lat, {_zone('(vs[1][1] / 1000.0)', 'vs[1][2]')} AS srid "
    "FROM fv JOIN ft USING (uid, kind) WHERE kind IN ('l', 'g')",
)
cte("shp", "sh", _forward("sh", "uid, kind, osmid, i, state"))


def _any_centroid(table: str, x: str, y: str) -> str:
    """Centroid per uid: by area for polygons that have one, else by length."""
    edge = (
        f"SELECT p.uid, p.kind, p.osmid, p.{x} AS ax, p.{y} AS ay, q.{x} AS ex, q.{y} AS ey, o.{x} AS ox, o.{y} AS oy "
        f"FROM {table} p JOIN {table} q ON p.uid = q.uid AND q.i = p.i + 1 JOIN {table} o ON o.uid = p.uid AND o.i = 1"
    )
    return (
        "SELECT uid, osmid, CASE kind WHEN 'l' THEN 'LineString' ELSE 'Polygon' END AS gtype, a2, "
        "CASE WHEN a2 <> 0 THEN ox + mx / (3 * a2) ELSE lx / l END AS cx, "
        "CASE WHEN a2 <> 0 THEN oy + my / (3 * a2) ELSE ly / l END AS cy "
        "FROM (SELECT uid, osmid, kind, any_value(ox) AS ox, any_value(oy) AS oy, sum(l) AS l, sum(l * (ax + ex) / 2) AS lx, "
        "sum(l * (ay + ey) / 2) AS ly, sum(c) AS a2, sum((ax + ex - 2 * ox) * c) AS mx, sum((ay + ey - 2 * oy) * c) AS my "
        "FROM (SELECT *, sqrt((ex - ax) * (ex - ax) + (ey - ay) * (ey - ay)) AS l, "
        "CASE WHEN kind = 'g' THEN (ax - ox) * (ey - oy) - (ex - ox) * (ay - oy) ELSE 0 END AS c "
        f"FROM ({edge})) GROUP BY uid, osmid, kind)"
    )


# Whole millidegrees keep a bowtie's zero area exactly zero.
cte("shd", "fv ft", "SELECT uid, kind, osmid, i, x, y FROM fv JOIN ft USING (uid, kind) WHERE kind IN ('l', 'g')")
ORACLES["centroid_deg"] = sql(
    "shd",
    f"SELECT osmid, gtype, {_r('cx', '10000')} AS lon, {_r('cy', '10000')} AS lat FROM ({_any_centroid('shd', 'x', 'y')})",
)
cte("shs", "shp", "SELECT * FROM shp WHERE state = 'ok'")
ORACLES["centroid_utm"] = sql(
    "shs",
    f"SELECT osmid, gtype, {_r('cx', '1000')} AS x, {_r('cy', '1000')} AS y FROM ({_any_centroid('shs', 'e', 'n')})",
)
ORACLES["ring_area_km2"] = sql(
    "shp",
    f"SELECT 'way' AS element_type, osmid, gtype, {_r('abs(a2) / 2', '10000')} AS area_cm2 FROM ({_any_centroid('shp', 'e', 'n')})",
)
ORACLES["geom_category"] = sql(
    "el pg",
    "SELECT el.element_type, el.osmid, CASE el.uid[1] WHEN 'p' THEN 'point' WHEN 'l' THEN 'line' ELSE 'polygon' END AS category "
    "FROM el LEFT JOIN pg ON el.uid = 'g' || pg.osmid WHERE pg.state IS DISTINCT FROM 'null'",
)

# --- boundary resolution -----------------------------------------------------

ORACLES["request_batch"] = sql("asked", "SELECT lga_id, lga_name, state_name FROM asked")
ORACLES["lookup_join"] = sql(
    "found gz",
    "SELECT f.lga_name, f.state_name, f.k AS position, f.matches, g.display_name FROM found f JOIN gz g USING (k)",
)
ORACLES["lookup_ambiguous"] = sql("found", "SELECT lga_name, state_name, matches FROM found WHERE matches > 1")
cte(
    "judged",
    "found gz_ok",
    "SELECT f.*, g.display_name, g.srid, g.area_m2, CASE WHEN f.lga_name IS NULL THEN 'blank_name' WHEN f.k IS NULL THEN 'no_match' "
    "ELSE g.reason_code END AS code FROM found f LEFT JOIN gz_ok g USING (k)",
)
ORACLES["lookup_rejects"] = sql(
    "judged", "SELECT lga_name, state_name, code AS reason_code FROM judged WHERE code IS NOT NULL"
)
ORACLES["boundary_soft_notes"] = sql(
    "judged",
    f"SELECT lga_id, lga_name, state_name, srid AS target_srid, {_r('area_m2', '1')} AS area_m2, matches > 1 AS ambiguous, "
    "'osm_geocode:' || concat_ws(', ', lga_name, state_name, 'Nigeria') AS boundary_source, "
    f"{_notes('lga_name', 'state_name')} AS validation_warnings FROM judged WHERE code IS NULL",
)
ORACLES["boundary_hard_checks"] = sql(
    "gz_ok",
    f"SELECT k, reason_code, srid AS target_srid, {_r('cx', '10000000')} AS lon, {_r('cy', '10000000')} AS lat, "
    f"{_r('area_m2', '1')} AS area_m2 FROM gz_ok",
)
ORACLES["target_crs"] = sql("gz_ok", "SELECT k, 'EPSG:' || srid AS crs FROM gz_ok")

# --- spatial join ------------------------------------------------------------

for _name, _kind in (("pip_join", "p"), ("line_intersects_join", "l"), ("polygon_intersects_join", "g")):
    ORACLES[_name] = sql("hit ft", f"SELECT k::INT AS k, osmid FROM hit JOIN ft USING (uid) WHERE kind = '{_kind}'")
ORACLES["pip_bucketed_equals_brute"] = sql(
    "pt gz_e gz_box",
    "SELECT k, count(*) AS n, sum(osmid)::BIGINT AS osmid_sum FROM (SELECT k, osmid FROM pt "
    "JOIN gz_box ON px BETWEEN bx0 AND bx1 AND py BETWEEN by0 AND by1 JOIN gz_e USING (k) "
    f"GROUP BY k, osmid, px, py HAVING {_IN}) GROUP BY k",
)



def _meets(kind: str, box: str, vertices: str, edges: str) -> str:
    """Places of the gazetteer and the features that meet them, by brute force."""
    pairs = f"SELECT f.uid, f.kind, b.k FROM {box} f JOIN gz_box b ON fx0 <= bx1 AND fx1 >= bx0 AND fy0 <= by1 AND fy1 >= by0 WHERE {kind}"
    return (
        f"cand_ AS MATERIALIZED ({pairs}), met_ AS (SELECT uid, k FROM (SELECT c.uid, c.k, v.i FROM cand_ c "
        f"JOIN (SELECT uid, i, x AS px, y AS py FROM {vertices}) v USING (uid) JOIN gz_e USING (k) GROUP BY c.uid, c.k, v.i, px, py HAVING {_IN}) "
        f"UNION SELECT c.uid, c.k FROM cand_ c JOIN {edges} p ON p.uid = c.uid JOIN gz_e q ON q.k = c.k WHERE {_touch('p', 'q')} "
        f"UNION SELECT uid, k FROM (SELECT c.uid, c.k, v.i FROM cand_ c JOIN (SELECT k, i, x AS px, y AS py FROM gz_v) v USING (k) "
        f"JOIN {edges} USING (uid) WHERE c.kind = 'g' GROUP BY c.uid, c.k, v.i, px, py HAVING {_IN}))"
    )


_PER_PLACE = "SELECT k, count(*) AS n, sum(osmid)::BIGINT AS osmid_sum FROM met_ JOIN {} USING (uid) GROUP BY k"
for _name, _kind in (("line_join_places", "l"), ("polygon_join_places", "g")):
    _base = sql("fv fe fbox ft gz_v gz_e gz_box", "")
    ORACLES[_name] = f"{_base.rstrip()}, {_meets(f"f.kind = '{_kind}'", 'fbox', 'fv', 'fe')} {_PER_PLACE.format('ft')}"
cte(
    "wide",
    "",
    "SELECT 'w' || osmid AS uid, osmid, CASE WHEN osmid % 3 = 1 THEN 'l' ELSE 'g' END AS kind, CASE osmid % 3 "
    "WHEN 0 THEN [[x0, y0], [x0 + 2500, y0], [x0 + 2500, y0 + 2500], [x0, y0 + 2500], [x0, y0]] "
    "WHEN 1 THEN [[x0, y0], [x0 + 3500, y0 + 900], [x0 + 300, y0 + 2500]] "
    "ELSE [[x0, y0], [x0 + 3000, y0], [x0 + 3000, y0 + 3000], [x0 + 2600, y0 + 3000], [x0 + 2600, y0 + 400], "
    "[x0 + 400, y0 + 400], [x0 + 400, y0 + 3000], [x0, y0 + 3000], [x0, y0]] END AS vs FROM (SELECT s_suppkey::BIGINT AS osmid, "
    "2300 + (s_suppkey::BIGINT * 7919) % 9000 AS x0, 3900 + (s_suppkey::BIGINT * 4729) % 7000 AS y0 FROM supplier)",
)
cte("wide_v", "wide", "SELECT uid, kind, i, vs[i][1] AS x, vs[i][2] AS y FROM (SELECT *, unnest(generate_series(1, len(vs))) AS i FROM wide)")
cte("wide_e", "wide_v", "SELECT a.uid, a.i, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM wide_v a JOIN wide_v b ON a.uid = b.uid AND b.i = a.i + 1")
cte("wide_box", "wide_v", "SELECT uid, any_value(kind) AS kind, min(x) AS fx0, min(y) AS fy0, max(x) AS fx1, max(y) AS fy1 FROM wide_v GROUP BY uid")
ORACLES["wide_join_places"] = (
    f"{sql('wide_v wide_e wide_box gz_v gz_e gz_box', '').rstrip()}, {_meets('true', 'wide_box', 'wide_v', 'wide_e')} {_PER_PLACE.format('wide')}"
)

# --- cleaning ----------------------------------------------------------------

ORACLES["drop_null_empty"] = sql("ft", "SELECT osmid, 'Polygon' AS gtype FROM ft WHERE kind = 'g'")
cte(
    "br",
    "",
    "SELECT osmid, 2500 + (osmid * 7919) % 12400 AS bx, 4000 + (osmid * 4729) % 9900 AS bz, 2 + osmid % 5 AS s, "
    "osmid % 6 AS defect FROM (SELECT s_suppkey::BIGINT AS osmid FROM supplier)",
)
ORACLES["validity_flags"] = sql(
    "ft br",
    "SELECT 'way' AS element_type, osmid, TRUE AS structure_ok, state = 'bowtie' AS self_crossing "
    "FROM ft WHERE kind = 'g' UNION ALL "
    "SELECT 'broken', osmid, defect IN (4, 5), defect IN (2, 3, 4) FROM br",
)
_BOWTIE = "[[bx,bz],[bx+s,bz],[bx,bz+s],[bx+s,bz+s],[bx,bz]]"
_SQUARE = "[[bx,bz],[bx+s,bz],[bx+s,bz+s],[bx,bz+s],[bx,bz]]"
ORACLES["structural_repair"] = sql(
    "br",
    "SELECT osmid, repair_status, (i - 1)::INT AS i, vs[i][1] * 10000 AS x, vs[i][2] * 10000 AS y FROM ("
    "SELECT osmid, repair_status, vs, unnest(CASE WHEN len(vs) = 0 THEN [NULL] ELSE generate_series(1, len(vs)) END) AS i FROM ("
    "SELECT osmid, CASE WHEN defect IN (0, 1, 2) THEN 'repaired' WHEN defect = 3 THEN 'emptied' WHEN defect = 4 THEN 'quarantined' "
    f"ELSE 'valid' END AS repair_status, CASE defect WHEN 3 THEN [] WHEN 4 THEN {_BOWTIE} ELSE {_SQUARE} END AS vs FROM br))",
)
ORACLES["id_fallback"] = sql(
    "ft el_layer pg",
    "SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY bx, bz, s, p.state, p.osmid) - 1 AS osmid, "
    "bx * 10000 AS x0, bz * 10000 AS y0, (bx + s) * 10000 AS x1 "
    "FROM ft JOIN el_layer l USING (uid) JOIN pg p ON ft.osmid = p.osmid WHERE ft.kind = 'g'",
)
ORACLES["dedupe_geometry"] = sql(
    "ft el_layer",
    "SELECT layer, element_type, osmid, copies FROM (SELECT l.layer, l.element_type, l.osmid, "
    "count(*) OVER (PARTITION BY l.layer, ft.kind, ft.vs) AS copies, "
    "row_number() OVER (PARTITION BY l.layer, ft.kind, ft.vs ORDER BY l.element_type, l.osmid) AS rn "
    "FROM ft JOIN el_layer l USING (uid)) WHERE rn = 1",
)
cte(
    "shl",
    "shp el_layer",
    "SELECT l.layer, l.uid, s.osmid, s.i, s.e, s.n FROM shp s JOIN el_layer l USING (uid) WHERE s.kind = 'g' AND s.state = 'ok'",
)
cte(
    "shl_c",
    "shl",
    _ring_measures("(SELECT * FROM shl WHERE layer IN ('health_facilities', 'schools'))", "layer, osmid", "e", "n"),
)
ORACLES["collapse_to_point"] = sql(
    "shl shl_c",
    f"SELECT layer, osmid, 'Polygon' AS gtype, (i - 1)::INT AS i, {_r('e', '1000')} AS x, {_r('n', '1000')} AS y FROM shl "
    "WHERE layer NOT IN ('health_facilities', 'schools') UNION ALL "
    f"SELECT layer, osmid, 'Point', 0, {_r('cx', '1000')}, {_r('cy', '1000')} FROM shl_c",
)
ORACLES["clean_layers_full"] = sql(
    "out_v",
    f"SELECT lga_id, layer, element_type, osmid, gtype, i::INT AS i, {_r('e', '1000')} AS x, {_r('n', '1000')} AS y FROM out_v",
)
ORACLES["quarantined_features"] = sql(
    "raw", "SELECT lga_id, layer, element_type, osmid, 'self_crossing' AS reason FROM raw WHERE state = 'bowtie'"
)

# --- export and audit --------------------------------------------------------

cte(
    "cats",
    "cnt",
    "SELECT lga_id, lga_name, state_name, layer, pos, string_agg(geom_category, ',' ORDER BY geom_category) AS categories, "
    "count(*) > 1 AS is_split, sum(n)::BIGINT AS n FROM cnt GROUP BY lga_id, lga_name, state_name, layer, pos",
)
ORACLES["split_categories"] = sql("cats", "SELECT lga_id, layer, categories, is_split, n FROM cats")
cte(
    "skip",
    "grid cats",
    "SELECT g.lga_id, g.lga_name, g.state_name, g.layer, g.position FROM grid g LEFT JOIN cats c USING (lga_id, layer) WHERE c.layer IS NULL",
)
ORACLES["skipped_layers"] = sql("skip", "SELECT lga_id, layer, position FROM skip")
ORACLES["export_manifest"] = sql(
    "cnt cats skip",
    "SELECT lga_id, layer, geom_category, CASE WHEN is_split THEN layer || '_' || geom_category ELSE layer END AS name, "
    "'out/geojson/lga_id=' || lga_id || '/layer=' || layer AS geojson_path, "
    "'out/layers/lga_id=' || lga_id || '/layer=' || layer || '/geom_category=' || geom_category AS path, "
    "cnt.n, 'exported' AS status FROM cnt JOIN cats USING (lga_id, layer) UNION ALL "
    "SELECT lga_id, layer, NULL, layer, NULL, NULL, 0, 'skipped' FROM skip",
)
_BROKEN = {
    "broken": "tag ''amenity'' must be True, a text or a list of texts",
    "worse": "selectors must be a non-empty mapping of tag key to value",
}
cte(
    "notes",
    "grid rawcnt acc",
    "SELECT lga_id, position, 'Layer ''' || layer || ''' returned no features in this area.' AS message "
    "FROM grid LEFT JOIN rawcnt USING (lga_id, layer) WHERE n IS NULL UNION ALL "
    "SELECT lga_id, 6, 'Layer ''markets'' returned no features in this area.' FROM acc UNION ALL "
    f"SELECT lga_id, 7, 'Layer ''broken'' failed to extract: {_BROKEN['broken']}' FROM acc UNION ALL "
    f"SELECT lga_id, 8, 'Layer ''worse'' failed to extract: {_BROKEN['worse']}' FROM acc",
)
ORACLES["warning_fold"] = sql(
    "acc notes",
    "SELECT lga_id, string_agg(message, ' | ' ORDER BY position) AS warnings FROM (SELECT lga_id, position, message FROM notes "
    f"UNION ALL SELECT lga_id, -1, 'Boundary validation: ' || {_notes(repr('Lga x'), 'state_name')} FROM acc "
    f"WHERE {_notes(repr('Lga x'), 'state_name')} IS NOT NULL) GROUP BY lga_id",
)
ORACLES["first_failure"] = sql(
    "acc", f"SELECT lga_id, 'Layer ''broken'' failed to extract: {_BROKEN['broken']}' AS message FROM acc"
)
ORACLES["run_records"] = sql(
    "acc cats skip grid rawcnt",
    "SELECT a.lga_name, a.state_name, 'output/' || lower(replace(trim(a.lga_name), ' ', '_')) AS output_label, "
    "'2024-01-01T00:00:00+00:00' AS timestamp_utc, 'EPSG:' || a.srid AS target_crs, "
    f"((SELECT count(*) FROM grid g LEFT JOIN rawcnt r USING (lga_id, layer) WHERE g.lga_id = a.lga_id AND r.n IS NULL) "
    f"+ CASE WHEN {_notes(repr('Lga x'), 'a.state_name')} IS NULL THEN 0 ELSE 1 END)::INT AS n_warnings, "
    "coalesce((SELECT string_agg(layer, ',' ORDER BY pos) FROM cats c WHERE c.lga_id = a.lga_id), '') AS exported, "
    "coalesce((SELECT string_agg(layer, ',' ORDER BY position) FROM skip s WHERE s.lga_id = a.lga_id), '') AS skipped, "
    "coalesce((SELECT string_agg(layer || '=' || replace(categories, ',', '+'), ',' ORDER BY pos) FROM cats c "
    "WHERE c.lga_id = a.lga_id AND is_split), '') AS split FROM acc a",
)
cte(
    "brq",
    "b",
    "SELECT lga_name, state_name FROM b UNION ALL SELECT 'Lga 0', NULL UNION ALL SELECT 'Lga 1', NULL UNION ALL SELECT 'Lga 9', NULL",
)
cte(
    "bres",
    "brq acc",
    f"SELECT {_ID.format('q.lga_name', 'q.state_name')} AS lga_id, q.lga_name, q.state_name, min_by(a.lga_id, a.k) AS place "
    "FROM brq q JOIN b_ok p ON p.lga_name = q.lga_name AND (q.state_name IS NULL OR p.state_name = q.state_name) "
    "LEFT JOIN acc a ON a.k = p.k GROUP BY q.lga_name, q.state_name HAVING min_by(p.reason_code, p.k) IS NULL "
    "AND min_by(a.lga_id, p.k) IS NOT NULL",
)
ORACLES["extract_lgas_full"] = sql(
    "bres cnt skip",
    "SELECT r.lga_id, r.lga_name, r.state_name, c.layer, c.geom_category, c.n, 'exported' AS status FROM bres r JOIN cnt c "
    "ON c.lga_id = r.place UNION ALL "
    "SELECT r.lga_id, r.lga_name, r.state_name, s.layer, NULL, 0, 'skipped' FROM bres r JOIN skip s ON s.lga_id = r.place",
)

# --- reports -----------------------------------------------------------------

ORACLES["layer_report"] = sql(
    "cnt", "SELECT lga_id, layer, 'EPSG:' || srid AS crs, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL"
)
ORACLES["compare_lgas_pivot"] = sql(
    "cats",
    "SELECT lga_id, "
    + ", ".join(f"(sum(n) FILTER (WHERE layer = '{layer}'))::BIGINT AS {layer}" for layer in DEFAULT_RULES)
    + " FROM cats GROUP BY lga_id",
)
ORACLES["layer_extent"] = sql(
    "out_v",
    "SELECT lga_id, layer, array_to_string(list_transform(string_split(layer, '_'), "
    "lambda w: upper(w[1]) || w[2:]), ' ') AS title, "
    "row_number() OVER (PARTITION BY lga_id ORDER BY CASE WHEN layer = 'roads' THEN -1 ELSE pos END) = 1 AS frames, "
    f"{_r('min(e)', '1000')} AS minx, {_r('min(n)', '1000')} AS miny, {_r('max(e)', '1000')} AS maxx, {_r('max(n)', '1000')} AS maxy "
    "FROM out_v GROUP BY lga_id, layer, pos",
)
cte("back", "out_v", _inverse("out_v", "lga_id, layer, osmid, gtype, i"))
ORACLES["preview_feed"] = sql(
    "back",
    "SELECT lga_id, layer, list_position(['landuse', 'waterways', 'roads', 'buildings', 'health_facilities', 'schools'], "
    f"layer)::INT - 1 AS draw_order, osmid, gtype, i::INT AS i, {_r('lon', '10000000')} AS x, {_r('lat', '10000000')} AS y FROM back",
)
ORACLES["run_reuse"] = sql(
    "asked",
    "SELECT lga_name, state_name FROM asked WHERE lga_id NOT IN (SELECT "
    + _ID.format("'Lga ' || (c_custkey // 3)", "'State ' || (c_custkey % 7)")
    + " FROM customer WHERE c_mktsegment = 'BUILDING')",
)
# Points of every place and layer on both days, as one text each.
cte(
    "day2",
    "pt",
    "SELECT element_type, osmid, CASE WHEN c = 1 AND osmid % 10 = 1 THEN px + 1 ELSE px END AS px, py, highway, building, waterway, "
    "\"natural\", landuse, CASE WHEN c = 2 AND osmid % 8 = 4 THEN 'hospital' ELSE amenity END AS amenity, "
    "unnest(CASE WHEN c = 4 AND osmid % 10 = 3 THEN [1, 2] ELSE [1] END) AS copy "
    "FROM (SELECT *, CASE WHEN py < 8000 THEN floor((px - 2600) / 2400) ELSE -1 END AS c FROM pt) WHERE c <> 0 OR osmid % 10 <> 0",
)
cte("days", "pt day2", "SELECT *, 1 AS copy, 1 AS day FROM pt UNION ALL BY NAME SELECT *, 2 AS day FROM day2")
cte(
    "day_hit",
    "days acc b_e b_box",
    "SELECT k, day, osmid, copy, px, py, highway, building, waterway, \"natural\", landuse, amenity FROM days "
    "JOIN acc ON true JOIN b_box USING (k) JOIN b_e USING (k) WHERE px BETWEEN bx0 AND bx1 AND py BETWEEN by0 AND by1 "
    f"GROUP BY ALL HAVING {_IN}",
)
cte(
    "day_rows",
    "day_hit",
    " UNION ALL ".join(
        f"SELECT k, day, '{layer} ' || osmid || ' ' || px || ' ' || py AS t FROM day_hit WHERE {test}" for layer, test in _LAYERS.items()
    ),
)
ORACLES["run_reuse_by_content"] = sql(
    "acc day_rows",
    "SELECT lga_id, lga_name, state_name FROM acc LEFT JOIN (SELECT k, "
    "coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE day = 1), '') = coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE day = 2), '') "
    "AS same FROM day_rows GROUP BY k) USING (k) "
    "WHERE NOT coalesce(same, true) OR substr(lga_name, 5)::INT % 4 = 3 OR substr(lga_name, 5)::INT % 5 = 2",
)
ORACLES["streamed_layers"] = ORACLES["clean_layers_full"]
_TOKEN = r"pk\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+"
ORACLES["redact_tokens"] = (
    f"SELECT doc_id, had_token, length(clean)::INT AS n_chars, md5(clean) AS text_md5 FROM (SELECT doc_id, "
    f"regexp_matches(t, '{_TOKEN}') AS had_token, regexp_replace(t, '{_TOKEN}', '', 'g') AS clean FROM (SELECT doc_id::BIGINT AS doc_id, "
    "CASE WHEN doc_id % 10 = 0 THEN text || ' pk.eyJ' || doc_id || '.x' || doc_id || ' end' ELSE text END AS t FROM documents))"
)
ORACLES["redact_pages"] = (
    f"SELECT page_id, regexp_matches(html, '{_TOKEN}') AS had_token, "
    f"md5(regexp_replace(html, '{_TOKEN}', '', 'g')) AS html_md5 FROM pages"
)
ORACLES["slug_and_title"] = sql(
    "rq",
    "SELECT lga_name, slug, 'output/' || slug AS output_label, array_to_string(list_transform(string_split(slug, '_'), "
    "lambda w: upper(w[1]) || w[2:]), ' ') AS title, n FROM (SELECT lga_name, lower(replace(trim(lga_name), ' ', '_')) AS slug, "
    "count(*) AS n FROM rq WHERE trim(lga_name) <> '' GROUP BY lga_name)",
)

# --- element assembly --------------------------------------------------------

cte(
    "wn",
    "ln",
    "SELECT osmid AS way_id, 0 AS pos, bx AS x, bz AS y FROM ln UNION ALL SELECT osmid, 1, bx + 40, bz + 25 FROM ln UNION ALL "
    "SELECT osmid, 2, bx + 80, bz + 10 FROM ln UNION ALL SELECT osmid, 3, bx, bz FROM ln WHERE osmid % 7 = 0",
)
ORACLES["way_assembly"] = sql(
    "wn", "SELECT way_id, 0::BIGINT AS missing, pos AS i, x * 10000 AS x, y * 10000 AS y FROM wn"
)
ORACLES["way_closed_to_polygon"] = sql(
    "wn",
    "SELECT way_id AS osmid, CASE WHEN way_id % 14 = 0 THEN 'Polygon' ELSE 'LineString' END AS gtype, "
    "count(*)::INT AS n_vertices FROM wn GROUP BY way_id",
)
ORACLES["relation_assembly"] = (
    "SELECT r AS relation_id, reason, CASE WHEN reason IS NULL THEN 2 END AS n_parts, CASE WHEN reason IS NULL THEN 3 END AS n_rings, "
    "CASE WHEN reason IS NULL THEN 475::BIGINT END AS area_millideg2 FROM (SELECT s_suppkey::BIGINT AS r, "
    "CASE WHEN s_suppkey % 7 = 3 THEN 'no_members' WHEN s_suppkey % 5 = 1 THEN 'member_missing' "
    "WHEN s_suppkey % 5 = 2 THEN 'member_not_closed' END AS reason FROM supplier)"
)

ORACLES["ring_stitching"] = (
    "WITH base AS (SELECT r, CASE WHEN (3 + r % 38) % 7 = 0 THEN 4 + r % 38 ELSE 3 + r % 38 END AS m, r % 2 = 0 OR r % 11 = 6 AS two, "
    "2500 + (r * 7919) % 12400 AS bx, 4000 + (r * 4729) % 9900 AS bz FROM (SELECT s_suppkey::BIGINT AS r FROM supplier)), "
    "first AS (SELECT *, (SELECT i FROM range(0, m) t(i) WHERE (i * 7 + r) % m = 0) AS i0 FROM base), "
    # Where the first way is drawn backwards, the ring runs backwards from that way's last node.
    "turned AS (SELECT *, (r + i0) % 3 = 0 AS back FROM first), "
    "walk AS (SELECT r, bx, bz, CASE WHEN back THEN [(i0 - s + 1 + m) % m, 500 + (i0 - s + m) % m] "
    "ELSE [(i0 + s) % m, 500 + (i0 + s) % m] END AS pair, s FROM turned, range(0, 41) t(s) WHERE s < m), "
    "stops AS (SELECT r, bx, bz, 2 * s + k AS step, pair[k + 1] AS n FROM walk, range(0, 2) u(k) UNION ALL "
    "SELECT r, bx, bz, 1000, CASE WHEN back THEN (i0 + 1) % m ELSE i0 END FROM turned), "
    "rings AS (SELECT r, string_agg((bx + CASE WHEN n < 500 THEN (n * 37) % 50 ELSE n - 440 END) || ' ' || "
    "(bz + CASE WHEN n < 500 THEN (n * n) % 53 ELSE n - 500 END), ',' ORDER BY step) AS ring FROM stops GROUP BY r), "
    "judged AS (SELECT r, two, bx, bz, CASE WHEN r % 11 = 4 THEN 'member_not_closed' WHEN r % 11 = 5 THEN 'ring_branches' "
    "WHEN r % 11 = 6 THEN 'ring_too_short' END AS reason FROM base) "
    "SELECT r AS relation_id, 0::INT AS part, ring, NULL AS reason FROM judged JOIN rings USING (r) WHERE reason IS NULL UNION ALL "
    "SELECT r, 1, array_to_string(list_transform([[0, 0], [20, 4], [10, 1], [30, 9], [0, 0]], "
    "lambda v: (bx + v[1]) || ' ' || (bz + v[2])), ','), NULL FROM judged WHERE reason IS NULL AND two UNION ALL "
    "SELECT r, NULL, NULL, reason FROM judged WHERE reason IS NOT NULL"
)

ORACLES["way_rejects"] = sql(
    "wn",
    "SELECT way_id, CASE WHEN way_id % 11 = 3 THEN 'no_nodes' ELSE 'node_missing' END AS reason "
    "FROM (SELECT DISTINCT way_id FROM wn) WHERE way_id % 11 = 3 OR way_id % 13 = 5",
)
ORACLES["relation_rejects"] = (
    "SELECT s_suppkey::BIGINT AS relation_id, s_suppkey::BIGINT * 10 + k AS way_id, "
    "CASE k WHEN 4 THEN 'hole_without_shell' ELSE 'unknown_role' END AS reason FROM supplier, (VALUES (4), (5)) AS t(k)"
)
ORACLES["relation_nesting"] = (
    "SELECT s_suppkey::BIGINT AS relation_id, part, CASE part WHEN 0 THEN '40,30' ELSE '20,10' END AS widths, "
    "2500 + (s_suppkey::BIGINT * 7919) % 12400 + 10 * part AS west FROM supplier, (VALUES (0), (1)) AS t(part)"
)
_TWICE = (
    "SELECT 'a' || osmid % 3 AS lga_id, osmid + copy * 1000000 AS osmid, osmid % 6 AS defect, copy "
    "FROM (SELECT s_suppkey::BIGINT AS osmid FROM supplier), (VALUES (0), (1)) AS t(copy) WHERE copy = 0 OR osmid % 2 = 0"
)
ORACLES["cleaning_audit"] = (
    "SELECT lga_id, 'landuse' AS layer, outcome, count(*) AS n FROM (SELECT lga_id, "
    "CASE WHEN defect = 3 THEN 'emptied' WHEN defect = 4 THEN 'quarantined' WHEN copy = 1 THEN 'duplicate' ELSE 'kept' END AS outcome "
    f"FROM ({_TWICE}) UNION ALL SELECT 'a' || s_suppkey % 3, 'null_geometry' FROM supplier WHERE s_suppkey % 10 = 0) GROUP BY ALL"
)
ORACLES["left_out_features"] = (
    "SELECT lga_id, osmid, CASE defect WHEN 3 THEN 'emptied' ELSE 'self_crossing' END AS reason "
    f"FROM ({_TWICE}) WHERE defect IN (3, 4)"
)
ORACLES["clean_projected_layers"] = (
    "SELECT 'landuse' AS layer, osmid, srid, 'Polygon' AS gtype, i, x * 1000 AS x, y * 1000 AS y FROM (SELECT osmid, srid, i, "
    "e + CASE WHEN i IN (1, 2) THEN s ELSE 0 END AS x, n + CASE WHEN i IN (2, 3) THEN s ELSE 0 END AS y FROM ("
    "SELECT s_suppkey::BIGINT AS osmid, (32631 + s_suppkey % 2)::INT AS srid, 400000 + (s_suppkey::BIGINT * 7919) % 200000 AS e, "
    "800000 + (s_suppkey::BIGINT * 4729) % 200000 AS n, 1000 + s_suppkey % 500 AS s FROM supplier), "
    "(VALUES (0), (1), (2), (3), (4)) AS t(i))"
)
ORACLES["export_round_trip"] = sql(
    "cnt", "SELECT lga_id, layer, sum(n)::BIGINT AS n FROM cnt WHERE layer <> 'roads' GROUP BY ALL"
)
ORACLES["runs_round_trip"] = sql(
    "acc", "SELECT lga_id, '2024-01-01T00:00:00+00:00' AS timestamp_utc, 1::BIGINT AS n FROM acc"
)
for _shuffled, _plain in (
    ("pip_shuffled", "pip_bucketed_equals_brute"),
    ("line_join_shuffled", "line_intersects_join"),
    ("polygon_join_shuffled", "polygon_intersects_join"),
):
    ORACLES[_shuffled] = ORACLES[_plain]

ORACLES["id_any_type"] = (
    "SELECT osmid AS n, CASE WHEN osmid % 3 <> 1 THEN osmid END AS osmid, "
    "CASE WHEN osmid % 2 = 0 THEN 'yes' ELSE 'no' END AS osmid_text FROM (SELECT c_custkey::BIGINT AS osmid FROM customer)"
)
ORACLES["names_from_tags"] = (
    "SELECT c_custkey::BIGINT AS osmid, CASE WHEN c_custkey % 3 = 0 THEN 'N' || c_custkey END AS name FROM customer"
)
ORACLES["assumed_wgs84"] = sql(
    "pg", "SELECT osmid, CASE WHEN state <> 'null' THEN CASE WHEN osmid % 3 = 0 THEN 32631 ELSE 4326 END END::INT AS srid FROM pg"
)
ORACLES["fallback_zone_notes"] = (
    "SELECT 'a' || s_suppkey % 5 AS lga_id, 'No boundary tells the zone of this area; EPSG:32631 is used.' AS message, "
    "1::BIGINT AS zones, 32631::INT AS first FROM supplier WHERE s_suppkey % 5 < 2 GROUP BY s_suppkey % 5"
)
ORACLES["snapshot_round_trip"] = sql(
    "cnt",
    "SELECT lga_id, layer, sum(n)::BIGINT AS n, step::INT AS step FROM cnt, (VALUES (1), (2), (3)) AS t(step) "
    "WHERE step < 3 OR layer <> 'roads' GROUP BY ALL",
)
ORACLES["extract_lgas_written"] = sql(
    "bres cnt",
    "SELECT r.lga_id, r.lga_name, r.state_name, c.layer, c.geom_category, c.n, 'exported' AS status "
    "FROM bres r JOIN cnt c ON c.lga_id = r.place",
)
ORACLES["boundary_files"] = sql(
    "b",
    "SELECT k::INT AS k, 'P' || k AS display_name, CASE WHEN k <> 11 THEN "
    "CASE WHEN k % 3 = 0 THEN w * w - (w - h) * (w - h) ELSE w * w END END::BIGINT AS area_millideg2, "
    "CASE WHEN k = 11 THEN 'no_geometry' END AS problem FROM b",
)
ORACLES["unreadable_inputs"] = (
    "SELECT layer, n::BIGINT AS n, CASE WHEN layer = 'schools' THEN 'unreadable' END AS problem, "
    "CASE WHEN layer = 'schools' THEN 'Layer ''schools'' failed to extract: 1 of its input files cannot be read.' END AS message "
    "FROM (SELECT CASE WHEN o_orderkey % 8 IN (1, 2, 3, 5) THEN 'health_facilities' ELSE 'roads' END AS layer, count(*) AS n "
    "FROM orders GROUP BY 1 UNION ALL SELECT 'schools', 0 UNION ALL SELECT 'landuse', 0)"
)
ORACLES["layer_report_full"] = sql(
    "cnt skip",
    "SELECT lga_id, layer, 'EPSG:' || srid AS crs, sum(n)::BIGINT AS n FROM cnt GROUP BY ALL UNION ALL SELECT lga_id, layer, NULL, 0 FROM skip",
)
ORACLES["node_points"] = sql(
    "wn",
    "SELECT 'node' AS element_type, way_id * 10 + pos AS osmid, x, y FROM wn WHERE pos < 3 AND (way_id * 10 + pos) % 3 <> 0",
)

# The union counted cell by cell, a millidegree each.
ORACLES["dissolved_centroid"] = (
    "WITH o AS (SELECT s_suppkey::BIGINT AS r, 2500 + (s_suppkey::BIGINT * 7919) % 12400 AS bx, 4000 + (s_suppkey::BIGINT * 4729) % 9900 AS bz, "
    "10 + s_suppkey % 7 AS shift FROM supplier), cells AS (SELECT r, bx + i AS x, bz + j AS y FROM o, range(-10, 40) a(i), range(0, 30) b(j) WHERE "
    "(i BETWEEN 0 AND 19 AND j BETWEEN 0 AND 19 AND NOT (i BETWEEN 6 AND 9 AND j BETWEEN 6 AND 9)) "
    "OR (i BETWEEN shift AND shift + 19 AND j BETWEEN 5 AND 24) OR (i BETWEEN 2 AND 6 AND j BETWEEN 2 AND 6) OR (i < 0 AND j < 10)) "
    "SELECT r, count(*) AS area_millideg2, floor(avg(x + 0.5) * 1000 + 0.5)::BIGINT AS x, floor(avg(y + 0.5) * 1000 + 0.5)::BIGINT AS y FROM cells GROUP BY r"
)
