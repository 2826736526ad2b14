"""DuckDB SQL of the registered queries."""

from __future__ import annotations

from dealscope.plans.catalogue import DISTRICTS, LINE, TRUTHS

_LINE = ", ".join(LINE)
_SHOWN = _LINE.replace("l_shipdate", "strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate")
_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_PRICED = """priced AS (
    SELECT *, l_extendedprice / nullif(l_quantity, 0) AS unit_price
    FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _place(key: str) -> str:
    return f"50.95e0 + ({key} * 7919 % 10007) / 10007e0 * 0.30e0 AS lat, 71.20e0 + ({key} * 104729 % 10007) / 10007e0 * 0.45e0 AS lon"


_CUSTOMERS = f"c AS (SELECT *, {_place('c_custkey')} FROM customer)"


def _km(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371.0088e0 * asin(sqrt(least(1e0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2)))))"


#: Places of the city.
_PLACES = {
    "center": (51.1282, 71.4306),
    "park": (51.1300, 71.4460),
    "embankment": (51.1215, 71.4330),
    "khan_shatyr": (51.1330, 71.4087),
    "mega_silkway": (51.0916, 71.4168),
    "asia_park": (51.1255, 71.4189),
    "keruen": (51.1274, 71.4162),
    "keruen_city": (51.1064, 71.4667),
    "saryarka": (51.1198, 71.3805),
}
_MALLS = list(_PLACES)[3:]
_D = {k: _km("lat", "lon", f"{p[0]}e0", f"{p[1]}e0") for k, p in _PLACES.items()}
_BANDED = f"""banded AS (
    SELECT ln(o_totalprice + 1) AS ln_price, (month(o_orderdate) >= 7)::int AS late, 1000 * {_D['center']} AS d_m
    FROM orders JOIN c ON o_custkey = c_custkey)"""


def _neighbours(km: float, value: str) -> str:
    return f"""WITH {_CUSTOMERS}, v AS (SELECT *, {value} AS val FROM c), s AS (
        SELECT a.c_custkey, count(b.val) AS n, avg(b.val) AS mean, median(b.val) AS median
        FROM v a JOIN v b ON a.c_custkey <> b.c_custkey AND abs(a.lat - b.lat) < {km / 100}
             AND {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {km} GROUP BY 1)"""


def _radius(km: float) -> str:
    return _neighbours(km, "c_acctbal") + " SELECT c_custkey, coalesce(n, 0) AS n, round(mean, 7) AS mean, round(median, 7) AS median FROM c LEFT JOIN s USING (c_custkey)"


def _segment(label: str, text: str) -> str:
    stop = "Kitchen area|Area|Type|Floor|Phone|Tags"
    # the other labels are marked first, so that an area within a kitchen area is not found
    marked = f"regexp_replace({text}, '({stop})', chr(1) || '\\1' || chr(2), 'g')"
    return f"nullif(trim(regexp_extract({marked}, chr(1) || '{label}' || chr(2) || '([^' || chr(1) || ']*)', 1), ' ,|-'), '')"


_TEXTS = """t AS (SELECT p_partkey, 'Price ' || trunc(p_retailprice)::bigint || ' Type ' || lower(p_brand) || ', Area ' || p_size || ',5 m2 Kitchen area 7 Floor '
    || (p_partkey % 9) || ' of 9' || CASE WHEN p_partkey % 2 = 0 THEN ' Phone yes Area 99' ELSE '' END || ' Tags a, b ,c' AS advert,
    'Phone no Type other' || p_size AS params FROM part)"""


def _field(label: str) -> str:
    return f"coalesce({_segment(label, 'advert')}, {_segment(label, 'params')})"


_LABELS = ("Kitchen area", "Area", "Type", "Floor", "Phone", "Tags")


def _corr(a: str, b: str) -> str:
    return f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 9) AS correlation FROM l"


_CORR = ("q", "l_extendedprice", "l_discount", "l_tax")


def _desc(c: str) -> str:
    return f"""SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 7) AS mean, round(stddev_samp({c}), 7) AS sd, round(min({c}), 7) AS min,
        round(quantile_cont({c}, 0.25), 7) AS q25, round(quantile_cont({c}, 0.5), 7) AS q50, round(quantile_cont({c}, 0.75), 7) AS q75, round(max({c}), 7) AS max FROM lineitem"""


_LOO = """CASE WHEN {k} IS NULL THEN 0e0 ELSE (coalesce(sum({v}) OVER (PARTITION BY {k}), 0) - coalesce({v}, 0)) / (count({v}) OVER (PARTITION BY {k}) - ({v} IS NOT NULL)::int + {s}e0) END"""

_CELL = "floor(lat / (500e0 / 111000e0))::bigint || '_' || floor(lon / (500e0 / (111000e0 * cos(radians(51.1e0)))))::bigint"

def _arc(angle: str) -> str:
    """The integral of cos(x) ** (df - 1) from 0 to the angle, by Simpson's rule; Student's t is its tail."""
    weight = "CASE WHEN i % 1000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"(list_sum(list_transform(range(0, 1001), lambda i: ({weight}) * pow(cos({angle} * i / 1000e0), df - 1))) * {angle} / 3000e0)"


_SUPPLIERS = f"s AS (SELECT s_suppkey, s_name, s_suppkey // 20 AS line, {_place('s_suppkey')} FROM supplier)"


def _segment_m(shrink: str = "cos(radians(lat))") -> str:
    """Metres from (lat, lon) to the segment (lat1, lon1) - (lat2, lon2), on the plane that touches at the place."""
    ax, ay, bx, by = f"(lon1 - lon) * {shrink}", "(lat1 - lat)", f"(lon2 - lon1) * {shrink}", "(lat2 - lat1)"
    t = f"greatest(0e0, least(1e0, coalesce(-({ax} * {bx} + {ay} * {by}) / nullif({bx} * {bx} + {by} * {by}, 0), 0)))"
    return f"1000 * 6371.0088e0 * radians(sqrt(pow({ax} + {t} * {bx}, 2) + pow({ay} + {t} * {by}, 2)))"


def _lines(stops: str, line: str) -> str:
    return f"g AS MATERIALIZED (SELECT * FROM (SELECT {line} AS line, lat AS lat1, lon AS lon1, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {stops} WINDOW w AS (PARTITION BY {line} ORDER BY s_suppkey)) WHERE lat2 IS NOT NULL)"


_DISTANCES = f"""SELECT c_custkey, 1000 * {_km('c.lat', 'c.lon', 's.lat', 's.lon')} AS m, s_name AS name FROM c, s"""
_NEAREST = f"""WITH {_CUSTOMERS}, {_SUPPLIERS}, {_lines('s', 'line')},
        a AS (SELECT c_custkey, unnest(min({{'m': m, 'name': name}})) FROM ({_DISTANCES}) GROUP BY 1),
        b AS (SELECT c_custkey, unnest(min({{'m': {_segment_m()}, 'name': line}})) FROM c, g GROUP BY 1)
        SELECT c_custkey, a.name AS station_name, round(a.m, 5) AS station_distance_m, b.name AS line_name, round(b.m, 5) AS line_distance_m FROM a JOIN b USING (c_custkey)"""


def _between_stations() -> str:
    rows = f"""{_SUPPLIERS}, stops AS (SELECT * FROM s WHERE s_suppkey <= 5), {_lines('stops', '1')},
        near AS (SELECT c_custkey, min(1000 * {_km('c.lat', 'c.lon', 'stops.lat', 'stops.lon')}) AS station_m FROM c, stops GROUP BY 1),
        line AS MATERIALIZED (SELECT c_custkey, min({_segment_m()}) AS d_m FROM c, g GROUP BY 1),
        banded AS (SELECT c_nationkey AS g, ln(o_totalprice + 1) AS y, (month(o_orderdate) >= 7)::int AS late, day(o_orderdate)::double AS d, d_m FROM orders JOIN c ON o_custkey = c_custkey JOIN near USING (c_custkey) JOIN line USING (c_custkey) WHERE station_m > 500)"""
    return _did_report(rows, (("l0", 1000), ("l1", 2500), ("l2", 5000)), 30000)


_BY_CENTRE = f"""banded AS (
            SELECT c_nationkey AS g, ln(o_totalprice + 1) AS y, (month(o_orderdate) >= 7)::int AS late, day(o_orderdate)::double AS d, 1000 * {_D['center']} AS d_m FROM orders JOIN c ON o_custkey = c_custkey)"""


def _normal_p(z: str) -> str:
    """Twice the upper tail of the normal distribution at |z|, by Simpson's rule; beyond 10 it is 0 to 20 places."""
    weight = "CASE WHEN i % 1000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = f"least(abs({z}), 10e0)"
    return f"(1 - 2 * list_sum(list_transform(range(0, 1001), lambda i: ({weight}) * exp(-0.5e0 * pow({at} * i / 1000e0, 2)))) * {at} / 3000e0 / sqrt(2 * pi()))"


def _did_report(banded: str = _BY_CENTRE, bands: tuple[tuple[str, int], ...] = (("d0", 5000), ("d5", 10000), ("d10", 15000)), most: int = 40000) -> str:
    """Cell means and one slope give the regression of three saturated bands; each coefficient is a weighted sum of the rows."""
    cell = " ".join(f"WHEN d_m < {end} THEN '{k}'" for k, end in bands)
    names = ", ".join(f"('{k}')" for k, _ in bands)
    return f"""WITH RECURSIVE {_CUSTOMERS}, {banded},
        x AS MATERIALIZED (SELECT *, CASE {cell} ELSE 'control' END AS cell FROM banded WHERE d_m <= {most}),
        cells AS MATERIALIZED (SELECT cell, late, count(*)::double AS m, avg(y) AS my, avg(d) AS md FROM x GROUP BY 1, 2),
        slope AS MATERIALIZED (SELECT sum((d - md) * (d - md)) AS s, sum((d - md) * (y - my)) / sum((d - md) * (d - md)) AS b, count(*)::double AS n, count(DISTINCT g) AS gg FROM x JOIN cells USING (cell, late)),
        weights AS (SELECT band, cells.*, CASE WHEN cell = band THEN 2 * late - 1 WHEN cell = 'control' THEN 1 - 2 * late ELSE 0 END AS w FROM (VALUES {names}) AS v(band), cells),
        sums AS MATERIALIZED (SELECT band, sum(w * md) AS wd, sum(w * (my - b * md)) AS coefficient, sum(m) FILTER (cell = band AND late = 0)::bigint AS n_before, sum(m) FILTER (cell = band AND late = 1)::bigint AS n_after FROM weights, slope GROUP BY 1),
        scores AS (SELECT band, g, sum((w / m - wd * (d - md) / s) * (y - my - b * (d - md))) AS h FROM x JOIN weights USING (cell, late) JOIN sums USING (band), slope GROUP BY 1, 2),
        errors AS (SELECT band, sqrt(any_value(gg / (gg - 1e0) * (n - 1) / (n - 9)) * sum(h * h)) AS error, any_value(gg - 1)::double AS df FROM scores, slope GROUP BY 1),
        whole AS MATERIALIZED (SELECT gg - 1e0 AS df FROM slope), whole_arc AS MATERIALIZED (SELECT df, {_arc('(pi() / 2)')} AS half FROM whole),
        search(low, high, k) AS (SELECT 0e0, pi() / 2, 0 UNION ALL
            SELECT CASE WHEN {_arc('((low + high) / 2)')} < 0.95e0 * half THEN (low + high) / 2 ELSE low END, CASE WHEN {_arc('((low + high) / 2)')} < 0.95e0 * half THEN high ELSE (low + high) / 2 END, k + 1 FROM search, whole_arc WHERE k < 50),
        quantile AS (SELECT sqrt(df) * tan(low) AS q FROM search, whole WHERE k = 50),
        found AS (SELECT band, n_before, n_after, n_before + n_after AS n, coefficient, error, atan(abs(coefficient / error) / sqrt(df)) AS angle, df FROM sums JOIN errors USING (band))
        SELECT band, n_before, n_after, n, round(coefficient, 9) AS coefficient, round(error, 9) AS error, round(1 - {_arc('angle')} / half, 7) AS p, round(100 * (exp(coefficient) - 1), 5) AS effect_pct,
            round(100 * (exp(coefficient - q * error) - 1), 5) AS low_pct, round(100 * (exp(coefficient + q * error) - 1), 5) AS high_pct FROM found JOIN whole_arc USING (df), quantile"""


def _hierarchical(rounds: int = 6) -> str:
    """The rounds of the model written out, one after the other."""
    cell = _CELL.replace("500e0", "5000e0")
    parts = [
        f"{_CUSTOMERS}",
        f"""b AS MATERIALIZED (SELECT c_custkey AS id, c_custkey % 50 <> 0 AS fit, ln(abs(c_acctbal) + 1000) AS y, (c_custkey % 13)::double AS x1, (c_custkey % 5)::double AS x2, lat, lon, n_regionkey::varchar AS g1, {cell} AS g2,
            CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || c_nationkey END AS g3, coalesce(CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment || c_nationkey END, 'none') || '|' || (c_custkey % 11) AS g4
            FROM c JOIN nation ON c_nationkey = n_nationkey)""",
        f"""e AS MATERIALIZED (SELECT p.id AS i, q.id AS j, exp(-0.5e0 * pow({_km('p.lat', 'p.lon', 'q.lat', 'q.lon')} / 0.1e0, 2)) AS w FROM b p JOIN b q ON p.fit AND q.fit AND p.id <> q.id AND abs(p.lat - q.lat) < 0.005
            AND {_km('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 0.5)""",
        "near AS MATERIALIZED (SELECT i AS id, sum(w) AS sw, CASE WHEN sum(w * w) > 0 THEN sum(w) * sum(w) / sum(w * w) ELSE 0 END AS kn FROM e GROUP BY 1)",
        "s0 AS MATERIALIZED (SELECT *, 0e0 AS loc FROM b)",
    ]
    for k in range(1, rounds + 1):
        parts += [
            f"""m{k} AS (SELECT var_pop(x1) AS aa, var_pop(x2) AS bb, covar_pop(x1, x2) AS ab, covar_pop(x1, y - loc) AS ay, covar_pop(x2, y - loc) AS by_, avg(x1) AS ma, avg(x2) AS mb, avg(y - loc) AS my FROM s{k - 1} WHERE fit)""",
            f"""f{k} AS MATERIALIZED (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS p, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM m{k})""",
            f"""r{k} AS MATERIALIZED (SELECT b.*, my - p * ma - q * mb + p * x1 + q * x2 AS attr, CASE WHEN fit THEN y - (my - p * ma - q * mb + p * x1 + q * x2) END AS v FROM b, f{k})""",
        ]
        before = f"r{k}"
        for level, shrink in enumerate((2, 1, 2, 2), 1):
            effect = _LOO.format(k=f"g{level}", v="v", s=shrink)
            parts.append(f"l{k}_{level} AS MATERIALIZED (SELECT * REPLACE (v - {effect} AS v), count(v) OVER (PARTITION BY g{level}) - (v IS NOT NULL)::int AS n{level}, {effect} AS e{level} FROM {before})")
            before = f"l{k}_{level}"
        parts.append(f"w{k} AS MATERIALIZED (SELECT i AS id, sum(w * v) AS wv FROM e JOIN {before} ON j = id GROUP BY 1)")
        parts.append(f"""s{k} AS MATERIALIZED (SELECT {before}.*, e1 + e2 + e3 + e4 + coalesce(CASE WHEN sw > 1e-12 THEN wv / sw ELSE 0 END * sw / (sw + 3), 0) AS loc, coalesce(kn, 0) AS kn FROM {before} LEFT JOIN near USING (id) LEFT JOIN w{k} USING (id))""")
    return ",\n        ".join(parts)


_HIERARCHICAL = _hierarchical()


def _listing(k: str = "p_partkey") -> str:
    """What the made listings hold, by their keys and not by parsing."""
    names = "[" + ", ".join(f"'{d}'" for d in DISTRICTS) + "]"
    return f"""k AS (SELECT *, {k} % 17 = 0 AS failed FROM part), l AS (SELECT {k} AS source_row,
        CASE WHEN NOT failed AND {k} % 11 <> 0 THEN {k} * 12345 + 5000000 END AS price_tenge,
        NOT failed AND {k} % 11 <> 0 AND {k} % 4 = 1 AS price_is_installment,
        CASE WHEN NOT failed AND {k} % 7 <> 5 THEN 'Астана' END AS city,
        CASE WHEN NOT failed AND {k} % 7 <> 5 THEN {names}[({k} % 6 + 1)::int] END AS district,
        CASE WHEN NOT failed THEN split_part(lower(p_brand), ' ', 1) END AS building_type,
        CASE WHEN NOT failed AND {k} % 3 <> 0 THEN p_name END AS complex_name,
        CASE WHEN NOT failed THEN ({k} % 40 + 1990)::int END AS build_year,
        CASE WHEN NOT failed THEN {k} % 40 + 1990 >= CASE WHEN {k} % 19 = 0 THEN 2025 ELSE 2026 END END AS is_under_construction,
        CASE WHEN NOT failed AND {k} % 5 <> 0 THEN ({k} % 9 + 1)::int END AS floor,
        CASE WHEN NOT failed AND {k} % 5 <> 0 THEN 9 END AS floor_total,
        CASE WHEN NOT failed AND {k} % 5 <> 0 THEN {k} % 9 + 1 = 1 END AS floor_is_first,
        CASE WHEN NOT failed AND {k} % 5 <> 0 THEN {k} % 9 + 1 = 9 END AS floor_is_last,
        CASE WHEN NOT failed THEN {k} % 90 + 20.5e0 END AS area_total_m2,
        CASE WHEN NOT failed THEN ({k} % 9 + 6)::double END AS kitchen_area_m2,
        CASE WHEN failed OR {k} % 13 = 0 THEN 'unknown' WHEN {k} % 4 = 1 THEN 'rough' WHEN {k} % 4 = 2 THEN 'fresh_renovation' WHEN {k} % 4 = 3 THEN 'needs_renovation' ELSE 'unknown' END AS apartment_condition,
        CASE WHEN NOT failed AND {k} % 13 = 0 THEN 'раздельный' END AS bathroom,
        CASE WHEN NOT failed AND {k} % 13 <> 0 THEN {k} % 2 = 0 END AS balcony_glazed,
        CASE WHEN NOT failed AND {k} % 13 <> 0 THEN false END AS former_dormitory,
        CASE WHEN failed THEN NULL WHEN {k} % 90 + 20.5 <= 30 THEN 'studio' WHEN {k} % 90 + 20.5 <= 45 THEN '1-room' WHEN {k} % 90 + 20.5 <= 65 THEN '2-room' WHEN {k} % 90 + 20.5 <= 90 THEN '3-room' ELSE '4+room' END AS rooms_bucket_estimated,
        NOT failed AS rooms_estimate_is_heuristic,
        CASE WHEN NOT failed AND {k} % 13 <> 0 THEN 'решетки|видео|охрана' ELSE '' END AS security,
        CASE WHEN failed THEN 'status=error, no advert_info/parameters to parse' ELSE concat_ws('|', CASE WHEN {k} % 13 = 0 THEN 'pipe-delimited parameters fallback detected' END,
            CASE WHEN {k} % 11 = 0 THEN 'price not found in advert_info' END, CASE WHEN {k} % 7 = 5 THEN 'district prefix not found in advert_info' END) END AS warnings FROM k)"""


_PARSED = (
    "price_tenge", "district", "building_type", "complex_name", "build_year", "floor", "area_total_m2", "kitchen_area_m2",
    "apartment_condition", "bathroom", "balcony", "door", "phone", "internet", "parking", "furnished", "flooring", "ceiling_height_m",
)


def _coverage() -> str:
    rows = []
    for c in _PARSED:
        here = "apartment_condition <> 'unknown'" if c == "apartment_condition" else f"{c} IS NOT NULL" if c in ("price_tenge", "district", "building_type", "complex_name", "build_year", "floor", "area_total_m2", "kitchen_area_m2", "bathroom") else "false"
        rows.append(f"SELECT 'present_{c}' AS metric, count(*) FILTER ({here})::double AS value FROM l")
    return f"""WITH {_listing()} SELECT 'rows' AS metric, count(*)::double AS value FROM l UNION ALL SELECT 'errors', count(*) FILTER (warnings LIKE 'status=error%')::double FROM l
        UNION ALL SELECT 'pipe_fallbacks', count(*) FILTER (warnings LIKE 'pipe%')::double FROM l UNION ALL {' UNION ALL '.join(rows)}
        UNION ALL SELECT 'priced_and_placed', count(*) FILTER (price_tenge IS NOT NULL AND district IS NOT NULL)::double FROM l"""


def _solved(design: str, names: list[str], columns: list[str]) -> str:
    """Least squares of ``y`` on ``columns`` of ``design`` by Gauss and Jordan on the normal equations: name, coefficient and error.

    The matrix has X'X, X'y and the unit matrix side by side; a step clears one column.
    """
    p = len(columns)
    cells = [[f"sum({a} * {b})" for b in [*columns, "y"]] + [f"{float(k == j)}e0" for j in range(p)] for k, a in enumerate(columns)]
    matrix = "[" + ", ".join("[" + ", ".join(row) + "]" for row in cells) + "]"
    step = f"list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {2 * p + 2}), lambda j: CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END))"
    texts = "[" + ", ".join(f"'{x}'" for x in names) + "]"
    fitted = " + ".join(f"m[{k}][{p + 1}] * {c}" for k, c in enumerate(columns, 1))
    return f"""{design}, jordan AS (SELECT 1 AS k, {matrix} AS m FROM x UNION ALL SELECT k + 1, {step} FROM jordan WHERE k <= {p}),
        solved AS MATERIALIZED (SELECT m FROM jordan WHERE k = {p + 1}), rest AS MATERIALIZED (SELECT sum(pow(y - ({fitted}), 2)) / (count(*) - {p}) AS s FROM x, solved),
        i AS (SELECT unnest(range(1, {p + 1})) AS i), coefficients AS (SELECT {texts}[i] AS name, m[i][{p + 1}] AS coefficient, sqrt(s * m[i][{p + 1} + i]) AS error FROM i, solved, rest)"""


def _formula_coefficients() -> str:
    p = "p AS (SELECT p_partkey, p_size::double AS x, p_retailprice / 100 + p_size % 7 AS y, substr(p_brand, 7, 1) AS maker, p_partkey % 2 AS half FROM part)"
    makers = [str(k) for k in range(2, 10)]
    levels = ", ".join(f"(maker = '{k}')::int::double AS t{k}, (maker = '{k}')::int::double * half AS h{k}" for k in makers)
    design = _spline_steps(p) + f", x AS MATERIALIZED (SELECT *, 1e0 AS one, {levels} FROM d3)"
    names = ["Intercept", *[f"C(maker)[T.{k}]" for k in makers], *[f"bs(p_size, df=5, degree=3)[{k}]" for k in range(5)], "half", *[f"C(maker)[T.{k}]:half" for k in makers]]
    columns = ["one", *[f"t{k}" for k in makers], *[f"n3_{k}" for k in range(1, 6)], "half", *[f"h{k}" for k in makers]]
    return f"WITH RECURSIVE {_solved(design, names, columns)} SELECT name, round(coefficient, 6) AS coefficient, round(error, 6) AS error FROM coefficients"


def _formula_predictions() -> str:
    makers = [str(k) for k in range(2, 10)]
    levels = ", ".join(f"(maker = '{k}')::int::double AS t{k}" for k in makers)
    columns = ["one", *[f"t{k}" for k in makers], "size", "size2"]
    rows = f"r AS MATERIALIZED (SELECT p_partkey, 1e0 AS one, p_size::double AS size, pow(p_size, 2) AS size2, p_retailprice / 100 + p_size % 7 AS y, {levels} FROM (SELECT *, substr(p_brand, 7, 1) AS maker FROM part))"
    design = f"{rows}, x AS MATERIALIZED (SELECT * FROM r WHERE p_partkey % 2 = 1 OR p_partkey % 3 = 0)"
    fitted = " + ".join(f"m[{k}][{len(columns) + 1}] * {c}" for k, c in enumerate(columns, 1))
    return f"WITH RECURSIVE {_solved(design, columns, columns)} SELECT p_partkey, round({fitted}, 6) AS predicted, round(y - ({fitted}), 6) AS residual FROM r, solved"


def _spline_steps(rows: str) -> str:
    """Cubic B-splines of ``p.x`` on the knots a a a a u v b b b b; degree by degree, as columns."""
    knots = ["a", "a", "a", "a", "u", "v", "b", "b", "b", "b"]
    steps = [f"{rows}, k AS (SELECT min(x) AS a, max(x) AS b, quantile_cont(x, 1/3e0) AS u, quantile_cont(x, 2/3e0) AS v FROM p)"]
    spans = [f"(x >= {knots[i]} AND x {'<=' if knots[i + 1] == 'b' else '<'} {knots[i + 1]})::int::double AS n0_{i}" if knots[i] != knots[i + 1] else f"0e0 AS n0_{i}" for i in range(9)]
    steps.append(f"d0 AS (SELECT *, {', '.join(spans)} FROM p, k)")
    for d in (1, 2, 3):
        terms = []
        for i in range(9 - d):
            lo, hi = (knots[i], knots[i + d]), (knots[i + 1], knots[i + d + 1])
            t = [f"(x - {lo[0]}) / ({lo[1]} - {lo[0]}) * n{d - 1}_{i}"] if lo[0] != lo[1] else []
            t += [f"({hi[1]} - x) / ({hi[1]} - {hi[0]}) * n{d - 1}_{i + 1}"] if hi[0] != hi[1] else []
            terms.append(f"{' + '.join(t) or '0e0'} AS n{d}_{i}")
        steps.append(f"d{d} AS (SELECT *, {', '.join(terms)} FROM d{d - 1})")
    return ", ".join(steps)


def _spline() -> str:
    return f"WITH {_spline_steps('p AS (SELECT p_partkey, p_retailprice AS x FROM part)')} SELECT p_partkey, {', '.join(f'round(n3_{i}, 7) + 0 AS bs{i}' for i in range(1, 6))} FROM d3"


_VIF = {"l_quantity": ("l_extendedprice", "l_discount"), "l_extendedprice": ("l_quantity", "l_discount"), "l_discount": ("l_quantity", "l_extendedprice")}


ORACLE_SQL: dict[str, str] = {
    "price_signals": f"""WITH {_PRICED}, g AS (SELECT *, median(unit_price) OVER b AS brand_median, count(unit_price) OVER b AS brand_count,
            percent_rank() OVER (PARTITION BY p_brand ORDER BY unit_price) AS rank_in_brand FROM priced WINDOW b AS (PARTITION BY p_brand))
        SELECT {_KEYS}, p_brand, round(unit_price, 9) AS unit_price, round(brand_median, 9) AS brand_median, brand_count, brand_count < 5 AS brand_insufficient_n,
            round(rank_in_brand, 9) AS rank_in_brand, round(unit_price / nullif(brand_median, 0), 9) AS relative
        FROM g ORDER BY relative, {_KEYS}, unit_price LIMIT 200""",
    "unit_price_features": f"""WITH u AS (SELECT *, l_extendedprice / nullif(l_quantity, 0) AS u, year(l_shipdate)::int AS y FROM lineitem)
        SELECT {_KEYS}, round(u, 9) AS unit_price, round(CASE WHEN u > 0 THEN ln(u) END, 9) AS ln_unit_price, round(CASE WHEN l_quantity > 0 THEN ln(l_quantity) END, 9) AS ln_quantity,
            y AS ship_year, greatest(0, 1998 - y)::int AS age,
            CASE WHEN l_quantity <= 30 THEN 'studio' WHEN l_quantity <= 45 THEN '1-room' WHEN l_quantity <= 65 THEN '2-room' WHEN l_quantity <= 90 THEN '3-room' ELSE '4+room' END AS size_class,
            least(greatest(l_quantity, 5), 40)::double AS clipped, (l_returnflag = 'N')::int AS not_returned,
            (l_quantity >= 0 AND l_quantity < 10)::int AS b10, (l_quantity >= 10 AND l_quantity < 30)::int AS b30, (l_quantity >= 30 AND l_quantity < 50)::int AS b50,
            l_returnflag || '|' || l_linestatus AS flags, round((l_discount + l_tax) / 2, 9) AS mean_rate, round_even(l_quantity / 4, 0)::double AS quarter FROM u""",
    "fit_filter_reasons": f"""WITH {_PRICED}, x AS (SELECT *, CASE WHEN unit_price IS NULL THEN 'no_price' WHEN l_quantity < 5 THEN 'small' WHEN l_quantity > 45 THEN 'large'
            WHEN unit_price < 950 THEN 'cheap' WHEN unit_price > 1900 THEN 'dear' ELSE '' END AS reason FROM priced)
        SELECT {_KEYS}, reason, reason = '' AS fit_ok, coalesce(unit_price BETWEEN 1000 AND 1500, false) AS middle FROM x""",
    "landmark_features": f"""WITH {_CUSTOMERS} SELECT c_custkey, round({_D['center']}, 9) AS distance_to_center_km, round({_D['park']}, 9) AS distance_to_park_km, {_D['park']} < 1 AS near_park_1km,
            round({_D['embankment']}, 9) AS distance_to_embankment_km, {_D['embankment']} < 1 AS near_embankment_1km,
            {', '.join(f'{_D[m]} < 1 AS mall_{m}_1km' for m in _MALLS)}, {' OR '.join(f'{_D[m]} < 1' for m in _MALLS[1:])} AS near_mall_1km FROM c""",
    "landmark_table": f"""WITH {_CUSTOMERS}, m(name, mlat, mlon) AS (VALUES {', '.join(f"('{m}', {_PLACES[m][0]}e0, {_PLACES[m][1]}e0)" for m in _MALLS)}), d AS (
            SELECT c_custkey, name, {_km('lat', 'lon', 'mlat', 'mlon')} AS km FROM c, m)
        SELECT c_custkey, name, round(km, 9) AS distance_km, row_number() OVER (PARTITION BY c_custkey ORDER BY km, name) = 1 AS nearest FROM d""",
    "grid_cells_count": f"WITH {_CUSTOMERS} SELECT {_CELL} AS cell, count(*) AS n FROM c GROUP BY 1",
    "tile_coordinates": f"""WITH s AS (SELECT s_suppkey, {_place('s_suppkey')} FROM supplier), t AS (
            SELECT s_suppkey, floor((lon + 180) / 360 * 2048)::int AS x, floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 2048)::int AS y FROM s)
        SELECT *, round(x / 2048e0 * 360 - 180, 9) AS west, round(degrees(atan((exp(pi() * (1 - 2 * y / 2048e0)) - exp(-pi() * (1 - 2 * y / 2048e0))) / 2)), 9) AS north FROM t""",
    "group_median_min_n": f"WITH {_PRICED} SELECT p_brand, round(median(unit_price), 9) AS median, count(unit_price) AS count, count(unit_price) < 2000 AS insufficient_n FROM priced GROUP BY 1",
    "percentile_rank_in_group": f"WITH {_PRICED} SELECT {_KEYS}, p_brand, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY unit_price), 9) AS pct FROM priced",
    "dedup_keep_first": f"SELECT {_SHOWN} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_LINE}) AS n FROM lineitem) WHERE n = 1",
    "dedup_two_pass": f"""WITH l AS (SELECT *, CASE WHEN l_linenumber <> 7 THEN l_orderkey % 100 + 0.25e0 END AS lat, (l_partkey % 20)::double AS lon,
            CASE WHEN l_suppkey % 3 = 0 THEN 'c' || (l_suppkey % 50) END AS complex_name, trunc(l_extendedprice / 5000)::int AS price, CASE WHEN l_tax > 0.01 THEN l_linenumber END AS floor FROM lineitem),
        a AS (SELECT *, row_number() OVER (PARTITION BY lat, lon, l_quantity, price ORDER BY {_LINE}) AS n1 FROM l),
        b AS (SELECT *, CASE WHEN complex_name IS NOT NULL THEN 'cx:' || complex_name ELSE 'll:' || coalesce(round(lat, 4)::varchar, 'nan') || ',' || round(lon, 4)::varchar END AS place
            FROM a WHERE lat IS NULL OR n1 = 1),
        d AS (SELECT *, row_number() OVER (PARTITION BY place, l_quantity, price, floor, l_linenumber ORDER BY {_LINE}) AS n2 FROM b)
        SELECT {_SHOWN} FROM d WHERE floor IS NULL OR (lat IS NULL AND complex_name IS NULL) OR n2 = 1""",
    "duplicate_audit": "SELECT coalesce(sum(n), 0)::bigint AS members, coalesce(sum(n - 1), 0)::bigint AS extra, count(*) AS groups FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)",
    "radius_neighbour_stats_3km": _radius(3.0),
    "radius_neighbour_stats_1km": _radius(1.0),
    "spatial_relative_price": _neighbours(3.0, "abs(c_acctbal) + 100") + """ SELECT c_custkey, coalesce(n, 0) AS n, round(val / mean, 9) AS ratio, round(val / mean - 1, 9) AS pct, coalesce(n, 0) >= 3 AS reliable FROM v LEFT JOIN s USING (c_custkey)""",
    "kernel_loo_smooth": f"""WITH {_CUSTOMERS}, e AS (SELECT a.c_custkey AS i, b.c_acctbal AS v, exp(-0.5e0 * pow({_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} / 0.5e0, 2)) AS w
            FROM c a JOIN c b ON a.c_custkey <> b.c_custkey AND abs(a.lat - b.lat) < 0.02 AND {_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 2),
        s AS (SELECT i, sum(w * v) AS wv, sum(w) AS sw, sum(w * w) AS w2 FROM e GROUP BY i), m AS (SELECT *, CASE WHEN sw > 1e-12 THEN wv / sw ELSE 0 END AS smooth FROM s)
        SELECT i AS c_custkey, round(smooth, 7) AS smooth, round(CASE WHEN w2 > 0 THEN sw * sw / w2 ELSE 0 END, 7) AS n_eff, round(sw, 7) AS sum_w, round(smooth * sw / (sw + 3), 7) AS shrunk FROM m""",
    "loo_eb_effect": f"""WITH x AS (SELECT *, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS v FROM customer)
        SELECT c_custkey, round({_LOO.format(k='c_nationkey', v='v', s=2)}, 7) AS effect, count(v) OVER (PARTITION BY c_nationkey) - (v IS NOT NULL)::int AS n_others FROM x""",
    "nested_eb_levels": f"""WITH x AS (SELECT *, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey),
        a AS (SELECT *, {_LOO.format(k='n_regionkey', v='v', s=2)} AS l1 FROM x), a2 AS (SELECT *, v - l1 AS r1 FROM a),
        b AS (SELECT *, {_LOO.format(k='c_nationkey', v='r1', s=1)} AS l2, count(r1) OVER (PARTITION BY c_nationkey) - 1 AS k FROM a2), b2 AS (SELECT *, r1 - l2 AS r2 FROM b),
        d AS (SELECT *, {_LOO.format(k='c_mktsegment', v='r2', s=2)} AS l3 FROM b2)
        SELECT c_custkey, round(l1 + l2 + l3, 7) AS location, k AS c_nationkey_n_others FROM d""",
    "ols_two_predictor": """WITH s AS (SELECT count(*)::double AS n, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_quantity, l_extendedprice) AS ay,
            covar_pop(l_discount, l_extendedprice) AS b_y, var_pop(l_extendedprice) AS yy, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
        f AS (SELECT *, (ay * bb - b_y * ab) / (aa * bb - ab * ab) AS p, (b_y * aa - ay * ab) / (aa * bb - ab * ab) AS q FROM s), g AS (SELECT *, (p * ay + q * b_y) / yy AS r2 FROM f)
        SELECT unnest(['n', 'r2', 'r2_adjusted', 'b_const', 'b_l_quantity', 'b_l_discount']) AS name,
            unnest([round(n, 4), round(r2, 4), round(1 - (1 - r2) * (n - 1) / (n - 3), 4), round(my - p * ma - q * mb, 4), round(p, 4), round(q, 4)]) AS value FROM g""",
    "ols_residuals": f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
        SELECT {_KEYS}, round(a + b * l_quantity, 5) AS predicted, round(l_extendedprice - (a + b * l_quantity), 5) AS residual FROM lineitem, f""",
    "cluster_robust_se": f"""WITH {_CUSTOMERS}, d AS (SELECT c_nationkey AS g, c_acctbal AS y, lat - 51 AS x FROM c),
        f AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, sum(x) AS sx, sum(x * x) AS sxx, count(*)::double AS n, count(DISTINCT g) AS gg FROM d),
        s AS (SELECT g, sum(y - a - b * x) AS u, sum(x * (y - a - b * x)) AS w FROM d, f GROUP BY g), m AS (SELECT sum(u * u) AS uu, sum(u * w) AS uw, sum(w * w) AS ww FROM s),
        v AS (SELECT *, n * sxx - sx * sx AS det, gg / (gg - 1e0) * (n - 1) / (n - 2) AS k FROM f, m)
        SELECT 'const' AS name, round(a, 4) AS coefficient, round(sqrt(k * (sxx * sxx * uu - 2 * sxx * sx * uw + sx * sx * ww)) / det, 4) AS error, gg AS clusters FROM v
        UNION ALL SELECT 'x', round(b, 4), round(sqrt(k * (sx * sx * uu - 2 * n * sx * uw + n * n * ww)) / det, 4), gg FROM v""",
    "did_band_counts": f"""WITH {_CUSTOMERS}, {_BANDED}, x AS (SELECT late, CASE WHEN d_m < 5000 THEN 'd0' WHEN d_m < 10000 THEN 'd5' WHEN d_m < 15000 THEN 'd10' ELSE 'control' END AS band FROM banded WHERE d_m <= 40000)
        SELECT band, count(*) FILTER (late = 0) AS n_before, count(*) FILTER (late = 1) AS n_after FROM x GROUP BY band""",
    "did_two_by_two": f"""WITH {_CUSTOMERS}, {_BANDED}, m AS (SELECT avg(ln_price) FILTER (late = 1 AND d_m < 12000) - avg(ln_price) FILTER (late = 0 AND d_m < 12000)
            - avg(ln_price) FILTER (late = 1 AND d_m >= 12000) + avg(ln_price) FILTER (late = 0 AND d_m >= 12000) AS b,
            count(*) FILTER (late = 0 AND d_m < 12000) AS n0, count(*) FILTER (late = 1 AND d_m < 12000) AS n1 FROM banded WHERE d_m <= 40000)
        SELECT 'inner' AS band, n0 AS n_before, n1 AS n_after, n0 + n1 AS n, round(b, 9) AS coefficient, round(100 * (exp(b) - 1), 4) AS effect_pct FROM m""",
    "robust_z_composite": """WITH x AS (SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN -c_acctbal END AS a, CASE WHEN c_custkey % 5 <> 0 THEN -(c_acctbal * 2 + c_custkey % 100) END AS b FROM customer),
        m AS (SELECT median(a) AS ma, median(b) AS mb FROM x), s AS (SELECT median(abs(a - ma)) * 1.4826e0 AS sa, median(abs(b - mb)) * 1.4826e0 AS sb FROM x, m),
        z AS (SELECT c_custkey, (a - ma) / sa AS za, (b - mb) / sb AS zb FROM x, m, s)
        SELECT c_custkey, round((coalesce(za, 0) + coalesce(zb, 0)) / nullif((za IS NOT NULL)::int + (zb IS NOT NULL)::int, 0), 7) AS score FROM z""",
    "iqr_outliers": f"""WITH {_PRICED}, x AS (SELECT p_brand, l_extendedprice * (1 + (l_orderkey % 97 = 0)::int * 4) AS v FROM priced),
        q AS (SELECT p_brand, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, count(*) AS k FROM x GROUP BY 1 HAVING count(*) >= 10)
        SELECT p_brand, count(*) AS n, count(*) FILTER (v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1)) AS outliers,
            round(count(*) FILTER (v < q1 - 1.5e0 * (q3 - q1) OR v > q3 + 1.5e0 * (q3 - q1)) / count(*)::double, 9) AS share FROM x JOIN q USING (p_brand) GROUP BY 1""",
    "ratio_sanity": f"""WITH m AS (SELECT l_returnflag, median(l_extendedprice) AS med FROM lineitem GROUP BY 1)
        SELECT {_KEYS}, round(l_extendedprice / nullif(med, 0), 9) AS ratio FROM lineitem JOIN m USING (l_returnflag) WHERE l_extendedprice / nullif(med, 0) < 0.2e0 OR l_extendedprice / nullif(med, 0) > 2""",
    "range_sanity": "SELECT count(*) FILTER (o_totalprice <= 0 OR o_totalprice < 1000) AS malformed, count(*) FILTER (year(o_orderdate) < 1993) AS early, count(*) FILTER (year(o_orderdate) > 1997) AS late FROM orders",
    "missingness_profile": """WITH x AS (SELECT count(*) AS n, count(*) FILTER (l_discount > 0.02e0) AS a, count(*) FILTER (l_quantity < 40) AS b, count(*) FILTER (l_returnflag <> 'N') AS c FROM lineitem)
        SELECT unnest(['discount', 'quantity', 'flag']) AS column_name, unnest([a, b, c]) AS present, unnest([n - a, n - b, n - c]) AS missing, round(unnest([a, b, c]) / n::double, 9) AS coverage FROM x""",
    "value_counts": "SELECT p_brand, count(*) AS n FROM part GROUP BY 1",
    "group_size_distribution": """SELECT count(*) AS groups, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n >= 5) AS large_groups, coalesce(sum(n) FILTER (n >= 5), 0)::bigint AS rows_in_large
        FROM (SELECT count(*) AS n FROM events WHERE user_id IS NOT NULL GROUP BY user_id)""",
    "correlation_matrix_long": "WITH l AS (SELECT *, CASE WHEN l_quantity > 10 THEN l_quantity END AS q FROM lineitem) " + " UNION ALL ".join(_corr(a, b) for i, a in enumerate(_CORR) for b in _CORR[i:]),
    "describe_numeric": " UNION ALL ".join(_desc(c) for c in ("l_quantity", "l_extendedprice", "l_discount")),
    "histogram_log10": "SELECT least(60, floor((log10(l_extendedprice) - 2) / ((6e0 - 2) / 60))::int + 1) AS bin, count(*) AS n FROM lineitem WHERE log10(l_extendedprice) BETWEEN 2 AND 6 GROUP BY 1",
    "quantile_list": "SELECT unnest([0.01e0, 0.05e0, 0.1e0, 0.5e0, 0.9e0, 0.95e0, 0.99e0]) AS point, round(unnest(quantile_cont(o_totalprice, [0.01, 0.05, 0.1, 0.5, 0.9, 0.95, 0.99])), 7) AS value FROM orders",
    "reliability_waterfall": """SELECT CASE WHEN c_custkey % 3 = 0 THEN 'building' WHEN k >= 65 THEN 'complex' WHEN c_acctbal > 0 THEN 'kernel' ELSE 'thin' END AS bucket, count(*) AS n
        FROM (SELECT *, count(c_acctbal) OVER (PARTITION BY c_nationkey) AS k FROM customer) GROUP BY 1""",
    "topk_overlap": """WITH o AS (SELECT *, o_totalprice + o_orderkey % 1000 * 10 AS other FROM orders), a AS (SELECT o_orderkey FROM o ORDER BY o_totalprice, o_orderkey LIMIT 300), b AS (SELECT o_orderkey FROM o ORDER BY other, o_orderkey LIMIT 300)
        SELECT count(*) AS common, round(count(*) / 300e0, 9) AS overlap FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""",
    "resume_anti_join": "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80)",
    "set_difference": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "set_union_members": "SELECT k, k IN (SELECT c_custkey FROM customer) AND k IN (SELECT s_suppkey FROM supplier) AS both FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier)",
    "id_assignment": "SELECT event_id, (SELECT max(user_id) FROM events) + row_number() OVER (ORDER BY event_id::varchar) AS row_id FROM events WHERE event_type = 'purchase'",
    "constant_columns": "SELECT 'same' AS column_name, 1::bigint AS n_distinct",
    "category_encode": "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::int AS priority FROM orders",
    "scaled_ints": "SELECT o_orderkey, round_even(o_totalprice * 0.001e0, 0)::bigint AS price_k, round_even(o_orderkey / 4e0, 0)::bigint AS quarter FROM orders",
    "label_segmentation": f"WITH {_TEXTS} SELECT p_partkey, {', '.join(f'{_field(k)} AS {k.lower().replace(chr(32), chr(95))}' for k in _LABELS)} FROM t",
    "parsed_values": f"""WITH {_TEXTS}, f AS (SELECT p_partkey, {_field('Area')} AS a, {_field('Floor')} AS f, {_field('Phone')} AS p, {_field('Type')} AS ty, {_field('Tags')} AS g FROM t)
        SELECT p_partkey, replace(regexp_extract(a, '([0-9]+([.,][0-9]+)?)', 1), ',', '.')::double AS area, regexp_extract(f, '([0-9]+) +of +([0-9]+)', 1)::int AS floor, regexp_extract(f, '([0-9]+) +of +([0-9]+)', 2)::int AS floors,
            CASE WHEN p LIKE 'yes%' THEN true WHEN p LIKE 'no%' THEN false END AS phone, split_part(ty, ' ', 1) AS type, array_to_string(list_transform(string_split(g, ','), lambda x: trim(x)), '|') AS tags FROM f""",
    "url_id_extract": """SELECT page_id, regexp_extract(url || '/a/show/' || page_id, '/a/show/([0-9]+)', 1) AS show_id, nullif(regexp_extract(url, '/a/show/([0-9]+)', 1), '') AS no_id, 1 AS n_ids,
        ((length(html) - length(replace(html, '<p>', ''))) // 3)::int AS paragraphs FROM pages""",
    "page_coordinates": "SELECT page_id, '51.' || (page_id % 997 + 1000) AS lat, '71.' || (page_id % 991 + 1000) AS lon, '' AS none FROM pages",
    "warnings_histogram": """SELECT 'large' AS warning, count(*) AS n FROM lineitem WHERE l_quantity > 40 HAVING count(*) > 0 UNION ALL SELECT 'no discount', count(*) FROM lineitem WHERE l_discount = 0 HAVING count(*) > 0
        UNION ALL SELECT 'returned', count(*) FROM lineitem WHERE l_returnflag = 'R' HAVING count(*) > 0""",
    "json_export_rows": """SELECT '[' || n_nationkey || ',"' || n_name || '",' || n_regionkey || ',null]' AS row_json FROM nation""",
    "modes_by_group": "SELECT p_brand, p_size AS mode_size FROM (SELECT p_brand, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_size) AS k FROM part GROUP BY 1, 2) WHERE k = 1",
    "name_index": "SELECT n_nationkey, dense_rank() OVER (ORDER BY n_name) - 1 AS name_index FROM nation",
    "did_report": _did_report(),
    "did_between_stations": _between_stations(),
    "nearest_stations": _NEAREST,
    "formula_coefficients": _formula_coefficients(),
    "formula_predictions": _formula_predictions(),
    "hierarchical_residual": f"""WITH {_HIERARCHICAL},
        z AS MATERIALIZED (SELECT *, CASE WHEN fit THEN attr + loc END AS predicted, CASE WHEN fit THEN y - (attr + loc) END AS resid, CASE WHEN fit THEN n4 ELSE 0 END AS building_n, CASE WHEN fit AND g3 IS NOT NULL THEN n3 ELSE 0 END AS complex_n FROM s6),
        t AS MATERIALIZED (SELECT *, fit AND (building_n >= 2 OR complex_n >= 3 OR kn >= 10) AS reliable, building_n + 0.5e0 * complex_n + 0.5e0 * kn AS n_eff FROM z), g AS (SELECT stddev_pop(resid) FILTER (reliable) AS sigma FROM t)
        SELECT id AS c_custkey, fit AS fit_ok, building_n AS building_n_others, complex_n AS complex_n_others, round_even(kn, 2) AS kernel_eff_n, reliable AS residual_reliable, round(exp(predicted), 3) AS predicted_price_m2,
            round(predicted, 7) AS predicted_ln_price_m2, round(resid, 7) AS hier_residual_ln, round(exp(resid) - 1, 7) AS residual_pct, round(CASE WHEN fit THEN n_eff END, 7) AS residual_n_eff,
            round(resid / (sigma * sqrt(1 + 1 / greatest(n_eff, 1))), 7) AS residual_z FROM t, g""",
    "hierarchical_coefficients": f"""WITH {_HIERARCHICAL},
        o AS MATERIALIZED (SELECT *, y - loc AS t FROM s6 WHERE fit),
        a AS MATERIALIZED (SELECT count(*)::double AS n, sum(x1) AS p, sum(x2) AS q, sum(x1 * x1) AS pp, sum(x1 * x2) AS pq, sum(x2 * x2) AS qq, sum(t) AS t0, sum(x1 * t) AS t1, sum(x2 * t) AS t2, count(DISTINCT g2) AS gg FROM o),
        d AS MATERIALIZED (SELECT *, n * (pp * qq - pq * pq) - p * (p * qq - pq * q) + q * (p * pq - pp * q) AS det FROM a),
        h AS MATERIALIZED (SELECT *, (pp * qq - pq * pq) / det AS i00, (q * pq - p * qq) / det AS i01, (p * pq - q * pp) / det AS i02, (n * qq - q * q) / det AS i11, (p * q - n * pq) / det AS i12, (n * pp - p * p) / det AS i22 FROM d),
        c3 AS MATERIALIZED (SELECT *, i00 * t0 + i01 * t1 + i02 * t2 AS c0, i01 * t0 + i11 * t1 + i12 * t2 AS c1, i02 * t0 + i12 * t1 + i22 * t2 AS c2 FROM h),
        u AS (SELECT g2, sum(t - c0 - c1 * x1 - c2 * x2) AS u0, sum(x1 * (t - c0 - c1 * x1 - c2 * x2)) AS u1, sum(x2 * (t - c0 - c1 * x1 - c2 * x2)) AS u2 FROM o, c3 GROUP BY 1),
        v AS (SELECT sqrt(sum(pow(i00 * u0 + i01 * u1 + i02 * u2, 2))) AS v0, sqrt(sum(pow(i01 * u0 + i11 * u1 + i12 * u2, 2))) AS v1, sqrt(sum(pow(i02 * u0 + i12 * u1 + i22 * u2, 2))) AS v2 FROM u, c3),
        w AS (SELECT sqrt(gg / (gg - 1e0) * (n - 1) / (n - 3)) AS k, c0, c1, c2, v0, v1, v2 FROM c3, v)
        SELECT unnest(['const', 'x1', 'x2']) AS name, round(unnest([c0, c1, c2]), 7) AS coefficient, round(unnest([k * v0, k * v1, k * v2]), 7) AS error, round(unnest([c0 / (k * v0), c1 / (k * v1), c2 / (k * v2)]), 7) AS statistic,
            round(unnest([{_normal_p("c0 / (k * v0)")}, {_normal_p("c1 / (k * v1)")}, {_normal_p("c2 / (k * v2)")}]), 7) + 0 AS p FROM w""",
    "hierarchical_figures": f"""WITH {_HIERARCHICAL}, z AS (SELECT *, y - (attr + loc) AS resid, CASE WHEN g3 IS NOT NULL THEN n3 ELSE 0 END AS complex_n FROM s6 WHERE fit)
        SELECT count(*) AS n_fit, round(stddev_pop(resid) FILTER (n4 >= 2 OR complex_n >= 3 OR kn >= 10), 7) AS sigma, round(1 - sum(resid * resid) / (var_pop(y) * count(*)), 7) AS r2_loo FROM z""",
    "hedonic_design": f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN least(greatest(ln(p_size * 12), ln(15)), ln(400)) END AS area, CASE WHEN p_partkey % 7 <> 0 THEN least(p_partkey % 100, 80)::double END AS age,
            CASE WHEN p_partkey % 3 <> 0 AND 2 + (p_size % 40) / 10e0 BETWEEN 2.2e0 AND 4.5e0 THEN 2 + (p_size % 40) / 10e0 END AS tall, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 12 END AS floor, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey % 13 END AS floors,
            coalesce(CASE WHEN p_partkey % 4 <> 0 THEN p_type END, 'unknown') AS building_type, coalesce(CASE WHEN p_partkey % 6 <> 0 THEN p_brand END, 'unknown') AS apartment_condition, coalesce(CASE WHEN p_partkey % 9 <> 0 THEN (p_partkey % 4)::varchar END, 'unknown') AS rooms_bucket,
            {', '.join(f"(p_partkey % {n + 2} <> 0 AND p_partkey % {n + 3} = 0)::int AS {c}" for n, c in enumerate(TRUTHS))} FROM part), m AS (SELECT median(area) AS ma, median(age) AS mg, median(tall) AS mt FROM p)
        SELECT p_partkey, round(coalesce(area, ma), 7) AS ln_area, round(coalesce(age, mg), 7) AS building_age, round(coalesce(tall, mt), 7) AS ceiling_height_m, round(coalesce(CASE WHEN floors > 0 THEN floor / floors::double END, 0.5), 7) AS floor_rel,
            (tall IS NULL)::int AS ceiling_miss, (floor IS NULL)::int AS floor_miss, building_type, apartment_condition, rooms_bucket, {', '.join(TRUTHS)} FROM p, m""",
    "html_div_text": """SELECT page_id, trim(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '\\s+', ' ', 'g')) AS ad_text FROM pages""",
    "listing_fields": f"WITH {_listing()} SELECT * REPLACE (price_is_installment::varchar AS price_is_installment, is_under_construction::varchar AS is_under_construction, floor_is_first::varchar AS floor_is_first, floor_is_last::varchar AS floor_is_last, balcony_glazed::varchar AS balcony_glazed, former_dormitory::varchar AS former_dormitory, rooms_estimate_is_heuristic::varchar AS rooms_estimate_is_heuristic, price_tenge::double AS price_tenge, build_year::double AS build_year, floor::double AS floor, floor_total::double AS floor_total) FROM l",
    "parse_coverage": _coverage(),
    "listing_pages": """SELECT p_partkey::varchar AS url, p_name || ' & ' || p_brand || ' inner text' AS advert_info, CASE WHEN p_partkey % 3 = 0 THEN 'few' ELSE 'size ' || p_size || ' and more' END AS parameters,
        '51.' || p_partkey AS lat, '71.' || p_partkey AS lon FROM part""",
    "page_texts": """SELECT p_partkey, (p_partkey * 1001)::int AS found, p_name || ' & а<' || p_brand AS cleaned, '<\\/b>' || p_name AS safe, (p_partkey % 5 + 1)::int AS rooms FROM part""",
    "windowed_event_counts": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(date_trunc('hour', ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", event_type, count(*) AS n FROM events GROUP BY ALL""",
    "spline_basis": _spline(),
    "design_columns": """WITH m AS (SELECT median(o_totalprice) AS med FROM orders WHERE o_orderkey % 4 <> 0), f AS (SELECT o_orderpriority AS mode FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        o AS (SELECT o_orderkey, round(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice ELSE med END, 7) AS price, CASE WHEN o_orderpriority = '5-LOW' THEN mode ELSE o_orderpriority END AS priority FROM orders, m, f)
        SELECT *, (priority = '2-HIGH')::int AS priority_1, (priority = '3-MEDIUM')::int AS priority_2, (priority = '4-NOT SPECIFIED')::int AS priority_3 FROM o""",
    "variance_inflation": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(v, 6) AS vif, v > 10 AS high FROM (SELECT (1 - pow(corr({a}, {b}), 2)) / (1 + 2 * corr({c}, {a}) * corr({c}, {b}) * corr({a}, {b}) - pow(corr({c}, {a}), 2) - pow(corr({c}, {b}), 2) - pow(corr({a}, {b}), 2)) AS v FROM lineitem)"
        for c, (a, b) in _VIF.items()
    ),
    "cross_validation": """WITH l AS (SELECT (l_orderkey % 5)::int AS fold, l_quantity AS x, l_extendedprice AS y FROM lineitem),
        f AS (SELECT a.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM (SELECT DISTINCT fold FROM l) a JOIN l ON l.fold <> a.fold GROUP BY 1)
        SELECT fold, count(*) AS n, round(sqrt(avg(pow(y - a - b * x, 2))), 4) AS rmse, round(1 - avg(pow(y - a - b * x, 2)) / var_pop(y), 8) AS r2 FROM l JOIN f USING (fold) GROUP BY 1""",
    "leave_one_group_out": """WITH f AS (SELECT a.p_brand, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS a FROM (SELECT DISTINCT p_brand FROM part) a JOIN part ON part.p_brand <> a.p_brand GROUP BY 1)
        SELECT p_brand, count(*) AS n, round(sqrt(avg(pow(p_retailprice - a - b * p_size, 2))), 5) AS rmse, round(1 - avg(pow(p_retailprice - a - b * p_size, 2)) / var_pop(p_retailprice), 7) AS r2 FROM part JOIN f USING (p_brand) GROUP BY 1""",
    "residuals_by_fitted": """WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), p AS (SELECT a + b * l_quantity AS fit, l_extendedprice - (a + b * l_quantity) AS e FROM lineitem, f),
        m AS (SELECT min(fit) AS lo, max(fit) AS hi FROM p)
        SELECT least(20, floor((fit - lo) / (hi - lo) * 20)::int + 1) AS bin, count(*) AS n, round(avg(fit), 3) AS mean_fitted, round(avg(e), 3) AS mean_residual, round(stddev_samp(e), 3) AS sd_residual FROM p, m GROUP BY 1""",
    "population_z_scores": "SELECT c_custkey, round(-(c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 7) AS z FROM customer",
    "constant_per_group": "SELECT l_returnflag, 'of ' || l_returnflag AS label FROM lineitem GROUP BY l_returnflag",
    "checked_orders": "SELECT o_orderkey, (o_totalprice < 150000)::int AS low, (o_totalprice >= 150000)::int AS high, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
    "standard_names": """SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'France' WHEN 'CHINA' THEN 'China' ELSE n_name END AS n_name,
        round(CASE WHEN n_nationkey >= 8 THEN 5e0 ELSE 3e0 * coalesce(n_nationkey * 2e0 / nullif(n_regionkey * 4e0, 0), 1) END, 9) AS expected FROM nation""",
    "tile_grid": f"""WITH {_CUSTOMERS}, e AS (SELECT floor((min(lon) + 180) / 360 * 16384)::int AS x0, floor((max(lon) + 180) / 360 * 16384)::int AS x1, floor((1 - asinh(tan(radians(max(lat)))) / pi()) / 2 * 16384)::int AS y0,
            floor((1 - asinh(tan(radians(min(lat)))) / pi()) / 2 * 16384)::int AS y1 FROM c), xs AS (SELECT unnest(range(x0, x1 + 1))::int AS x FROM e), ys AS (SELECT unnest(range(y0, y1 + 1))::int AS y FROM e)
        SELECT x, y, round(x / 16384e0 * 360 - 180, 9) AS west, round(degrees(atan((exp(pi() * (1 - 2 * y / 16384e0)) - exp(-pi() * (1 - 2 * y / 16384e0))) / 2)), 9) AS north FROM xs, ys""",
    "user_sessions": """WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true)::int AS begins FROM events WHERE ts IS NOT NULL),
        s AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
        SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS "end", count(*) AS n, round(sum(value), 5) AS total FROM s GROUP BY user_id, k""",
    "price_changes": """WITH e AS (SELECT user_id || '|' || event_type AS key, ts, event_id, floor(value / 10)::bigint AS price FROM events),
        c AS (SELECT *, lag(price) OVER (PARTITION BY key ORDER BY ts, event_id) AS before FROM e)
        SELECT key, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS time, before, price AS now FROM c WHERE before <> price""",
}
