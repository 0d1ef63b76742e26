"""Scalar functions as Spark column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def present(c: str) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def number(c: str, low: float | None = 0.0, high: float | None = None) -> Column:
    """Text or number to double; null for what is not finite or out of range."""
    v = F.expr(f"try_cast({c} as double)")
    ok = ~F.isnan(v) & (F.abs(v) != float("inf"))
    if low is not None:
        ok &= v >= low
    if high is not None:
        ok &= v <= high
    return F.when(ok, v)


def metres(c: str, default: float | None = None, most: float | None = None) -> Column:
    """The leading number of a length tag such as '2.5 m', within 0 and most, else default."""
    v = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:m|metres|meters)?\s*$", 1).try_cast("double")
    ok = v > 0 if most is None else (v > 0) & (v <= most)
    return F.coalesce(F.when(ok, v), F.lit(default).cast("double"))


def label_key(c: str) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


#: Letters with their plain forms, by place.
ACCENTED, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def tokens(c: str, stop: tuple[str, ...] = ()) -> Column:
    """Distinct accent-folded words of a name without stop words."""
    folded = F.translate(F.lower(c), ACCENTED, PLAIN)
    words = F.filter(F.split(folded, "[^a-z0-9]+"), lambda x: x != "")
    return F.array_distinct(F.array_except(words, F.array(*map(F.lit, stop)).cast("array<string>")))


def numbers_in(c: str) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.cast("double"))


def angle_delta(bearing: Column, heading: Column) -> Column:
    """Difference in (-180, 180]."""
    d = F.pmod(bearing - heading, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def rounded_people(n: Column) -> Column:
    """Head counts by size: to 1, 10, 100 or 1000, half to even."""
    step = F.when(n < 100, 1).when(n < 1000, 10).when(n < 10000, 100).otherwise(1000)
    return (F.bround(n / step) * step).cast("long")


def bpr(volume: Column, capacity: Column, alpha: float = 0.15, power: float = 4.0, most: float = 10.0) -> Column:
    """Delay factor of a road by volume over capacity."""
    return F.least(1 + alpha * F.pow(volume / capacity, F.lit(power)), F.lit(most))


def quadkey(lon: Column, lat: Column, zoom: int) -> Column:
    """Quadkey of the tile that holds a point."""
    n = 1 << zoom
    y = F.radians(lat)
    x = F.floor((lon + 180) / 360 * n).cast("long")
    row = F.floor((1 - F.log(F.tan(y) + 1 / F.cos(y)) / math.pi) / 2 * n).cast("long")
    digits = [F.shiftright(x, b).bitwiseAND(F.lit(1)) + 2 * F.shiftright(row, b).bitwiseAND(F.lit(1)) for b in range(zoom - 1, -1, -1)]
    return F.concat(*(d.cast("string") for d in digits))


def unit_hash(*parts: Column) -> Column:
    """A draw in [0, 1) that depends on its parts alone, so on no partitioning."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(*parts), 11), F.lit(1 << 53)) / float(1 << 53)


def digest_draw(*parts: Column) -> Column:
    """A draw in [0, 1) from the SHA-256 of its parts, joined by colons; other engines get the same one."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def utm_to_lonlat(x: Column, y: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates on the WGS 84 ellipsoid, by the inverse Krüger series to third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    b = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    d = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (y - (0.0 if north else 1e7)) / (0.9996 * radius)
    eta = (x - 500000.0) / (0.9996 * radius)
    xi1 = xi - sum((v * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, v in enumerate(b)), F.lit(0.0))
    eta1 = eta - sum((v * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, v in enumerate(b)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((v * F.sin(2 * (j + 1) * chi) for j, v in enumerate(d)), F.lit(0.0))
    lon = F.lit(6 * zone - 183.0) + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
    return lon, F.degrees(lat)


def lonlat_to_utm(lon: Column, lat: Column, zone: int, north: bool = True) -> tuple[Column, Column]:
    """UTM coordinates of longitude and latitude on the WGS 84 ellipsoid, by the Krüger series to third order."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    q = 2 * math.sqrt(n) / (1 + n)
    s, away = F.sin(F.radians(lat)), F.radians(lon - (6 * zone - 183.0))
    t = F.sinh(F.atanh(s) - q * F.atanh(q * s))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east = eta + sum((v * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, v in enumerate(alpha)), F.lit(0.0))
    up = xi + sum((v * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, v in enumerate(alpha)), F.lit(0.0))
    return 0.9996 * radius * east + 500000.0, 0.9996 * radius * up + (0.0 if north else 1e7)


def softmax_at(p: Column, temperature: Column) -> Column:
    """Probabilities sharpened or flattened by a temperature, and brought to sum one again."""
    raised = F.transform(p, lambda v: F.pow(F.greatest(v, F.lit(1e-12)), 1 / temperature))
    return F.transform(raised, lambda v: v / F.aggregate(raised, F.lit(0.0), lambda s, x: s + x))


def pick(p: Column, u: Column) -> Column:
    """Zero-based place of the first running sum of p above u; the last sum counts as one."""
    sums = F.transform(F.sequence(F.lit(1), F.size(p)), lambda i: F.aggregate(F.slice(p, 1, i), F.lit(0.0), lambda s, x: s + x))
    at = F.array_position(F.transform(sums, lambda s: s > u), F.lit(True)).cast("int")
    return F.when(at > 0, at - 1).otherwise(F.size(p) - 1)


def ring_area(ring: Column) -> Column:
    """Shoelace area of a ring of structs x, y."""
    n = F.size(ring)
    nxt = F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1))
    return F.abs(F.aggregate(F.zip_with(ring, nxt, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of structs x, y."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crosses = F.zip_with(
        ring, nxt,
        lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]),
    )
    return F.size(F.filter(crosses, lambda c: F.coalesce(c, F.lit(False)))) % 2 == 1


def on_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies on an edge of a ring of structs x, y."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def on(p: Column, q: Column) -> Column:
        turn = (q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"])
        return (turn == 0) & x.between(F.least(p["x"], q["x"]), F.greatest(p["x"], q["x"])) & y.between(F.least(p["y"], q["y"]), F.greatest(p["y"], q["y"]))

    return F.exists(F.zip_with(ring, nxt, on), lambda c: c)


#: Phrases that ask for a whole city, in three languages.
CITYWIDE = (
    r"city[- ]?wide|across (the )?(city|beirut)|all (of )?beirut|(the )?whole (city|of beirut)|throughout (the city|beirut)|everywhere|all buildings|every building|"
    r"toute la ville|tout beyrouth|l'ensemble de (la ville|beyrouth)|partout|"
    r"كل بيروت|كامل بيروت|جميع أنحاء بيروت|كل المدينة|كامل المدينة|في جميع أنحاء المدينة"
)


def asks_citywide(c: str, phrases: str = CITYWIDE) -> Column:
    return F.coalesce(F.col(c).rlike(f"(?i){phrases}"), F.lit(False))


def way_id(c: str) -> Column:
    """The number of 'way/123', else null."""
    return F.regexp_extract(c, r"^way/([0-9]+)$", 1).try_cast("long")


def osm_id(c: str) -> Column:
    """'way/123' of a record id such as 'w123@4', else null."""
    kind = F.regexp_extract(c, r"^([nwr])([0-9]+)@[0-9]+$", 1)
    name = F.when(kind == "n", "node").when(kind == "w", "way").when(kind == "r", "relation")
    return F.concat_ws("/", name, F.when(name.isNotNull(), F.regexp_extract(c, r"^([nwr])([0-9]+)@[0-9]+$", 2)))


def years_since(event: Column, start: Column) -> Column:
    """Years from an event to a start, null for events that are not known by then."""
    return F.when(event <= start, start - event)


def normalised(p: Column, unknown: int) -> Column:
    """Probabilities by their sum; a row without any becomes the unknown label."""
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return F.when(total > 0, F.transform(p, lambda x: x / total)).otherwise(F.transform(p, lambda x, i: F.when(i == unknown, 1.0).otherwise(0.0)))


def noise_words(delta: Column) -> Column:
    """Plain words for a change of sound level in dB: steps at 1, 3, 5 and 10."""
    size, louder = F.abs(delta), delta > 0
    way = F.when(louder, "louder").otherwise("quieter")
    return (
        F.when(delta.isNull(), None).when(size < 1, "No audible change").when(size < 3, F.concat(F.lit("Barely noticeable: slightly "), way))
        .when(size < 5, F.concat(F.lit("Noticeable: "), way)).when(size < 10, F.concat(F.lit("Clearly "), way)).otherwise(F.concat(F.lit("Much "), way))
    )


def loudness(delta: Column) -> Column:
    """Perceived loudness doubles with every 10 dB."""
    return F.bround(F.pow(F.lit(2.0), delta / 10), 2)


def heading(c: str) -> Column:
    """Grid angle (east 0, north 90) of a compass tag, a point of the rose or degrees; null for anything else."""
    raw, out = F.upper(F.trim(c)), F.col(c).try_cast("double")
    for i, name in enumerate(("N", "NE", "E", "SE", "S", "SW", "W", "NW")):
        out = F.when(raw == name, 45.0 * i).otherwise(out)
    return F.when(~F.isnan(out) & (F.abs(out) < float("inf")), F.pmod(90 - out, F.lit(360.0)))


def answer_text(metric: Column, value: Column) -> Column:
    """A value in the words of its metric: shares in percent, heights in metres, areas in square metres, else a number."""
    return (
        F.when(value.isNull(), "n/a").when(metric.startswith("p_"), F.concat(F.format_number(F.bround(value * 100, 0), 0), F.lit("%")))
        .when(metric == "height_m", F.concat(F.format_string("%.1f", value), F.lit(" m")))
        .when(metric == "footprint_area_m2", F.concat(F.format_number(F.bround(value, 0), 0), F.lit(" m²"))).otherwise(F.format_string("%.0f", F.bround(value, 0)))
    )


def filled(own: Column, other: Column) -> Column:
    """own's tags, and other's for keys that own lacks."""
    return F.map_concat(own, F.map_filter(other, lambda k, v: ~F.map_contains_key(own, k) & v.isNotNull()))


#: A pair of decimal degrees.
PAIR = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*[,;]\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"


def location(c: str) -> tuple[Column, Column, Column]:
    """Kind (point, object, query, none), latitude and longitude, and the object id or words, of a text: a pair of degrees, a
    geo: link, a map link with a marker, an object or a view, or a name."""
    text = F.trim(c)
    plain = F.regexp_replace(text, "^geo:", "")
    view = r"#map=[0-9.]+/(-?[0-9.]+)/(-?[0-9.]+)"
    marker = F.concat_ws(",", F.nullif(F.regexp_extract(text, r"[?&]mlat=(-?[0-9.]+)", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"[?&]mlon=(-?[0-9.]+)", 1), F.lit("")))
    thing = F.regexp_extract(text, r"openstreetmap\.org/((?:node|way|relation)/[0-9]+)/?(?:[?#].*)?$", 1)
    link = text.rlike(r"^(https://|www\.|openstreetmap\.)")
    lat = F.when(plain.rlike(PAIR), F.regexp_extract(plain, PAIR, 1)).when(link & marker.contains(","), F.split(marker, ",")[0])
    lat = lat.when(link & (thing == "") & text.rlike(view), F.regexp_extract(text, view, 1)).try_cast("double")
    lon = F.when(plain.rlike(PAIR), F.regexp_extract(plain, PAIR, 2)).when(link & marker.contains(","), F.split(marker, ",")[1])
    lon = lon.when(link & (thing == "") & text.rlike(view), F.regexp_extract(text, view, 2)).try_cast("double")
    good = lat.between(-90, 90) & lon.between(-180, 180)
    kind = F.when(F.coalesce(good, F.lit(False)), "point").when(thing != "", "object").when(link | (F.coalesce(text, F.lit("")) == "") | lat.isNotNull(), "none").otherwise("query")
    words = F.when(kind == "object", thing).when(kind == "query", text)
    return kind, F.when(kind == "point", F.struct(lat.alias("lat"), lon.alias("lon"))), words
