"""Tag parsing, traffic, scores, clocks and labels as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Segment classes that are walked on, and those without cars (fixed values).
WALKABLE = ("residential", "living_street", "tertiary", "secondary", "primary", "unclassified", "footway", "pedestrian", "path")
CAR_FREE = ("footway", "path", "pedestrian", "steps", "track")
#: Traffic class by highway; others are class 2. Defaults by class: mph and lanes (fixed values).
TRAFFIC_CLASS = {"footway": 0, "path": 0, "pedestrian": 0, "steps": 0, "track": 0, "living_street": 1, "residential": 2, "unclassified": 2, "tertiary": 3, "secondary": 4, "primary": 5}
DEFAULT_MPH = {1: 10, 2: 25, 3: 30, 4: 35, 5: 40}
DEFAULT_LANES = {1: 1, 2: 2, 3: 2, 4: 4, 5: 4}
#: Parts of place categories that are open at night (fixed values).
NIGHT = ("bar", "pub", "night_club", "brewery", "restaurant", "food", "coffee", "cafe", "grocery", "convenience", "pharmacy", "drugstore", "hotel", "motel", "theater", "cinema", "liquor", "gas_station", "fitness", "gym")
FEET = 0.3048


def walkable(highway: Column, length: Column, least: float = 25.0) -> Column:
    return highway.isin(*WALKABLE) & (length >= least)


def first_of(tags: Column) -> Column:
    """A list-valued tag's first entry; null and empty lists give the empty string."""
    return F.coalesce(F.get(tags, F.lit(0)), F.lit(""))


def joined(tags: Column) -> Column:
    return F.coalesce(F.array_join(tags, ", "), F.lit(""))


def category_of(places: Column) -> Column:
    """The primary category in lower case of a struct column, the empty string where it is unknown."""
    return F.coalesce(F.lower(places["primary"]), F.lit(""))


def category(raw: Column) -> Column:
    """The primary category of a JSON string, lower case; bad JSON and null give the empty string."""
    return F.lower(F.coalesce(F.get_json_object(raw, "$.primary"), F.lit("")))


def at_night(name: Column) -> Column:
    return name.rlike("|".join(NIGHT))


def lookup(key: Column, table: dict, other) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[key], F.lit(other))


def traffic_class(highway: Column) -> Column:
    return lookup(highway, TRAFFIC_CLASS, 2)


def car_free(highway: Column) -> Column:
    return F.coalesce(highway.isin(*CAR_FREE), F.lit(False)).cast("int")


def first_number(tag: Column, cls: Column, defaults: dict, other: int) -> Column:
    """The tag's first run of digits, else the class's default."""
    digits = F.regexp_extract(F.coalesce(tag, F.lit("")), r"(\d+)", 1)
    return F.when(digits != "", digits.cast("double")).otherwise(lookup(cls, defaults, other).cast("double"))


def sidewalk(highway: Column, tag: Column) -> Column:
    t = F.lower(F.coalesce(tag, F.lit("")))
    return F.when(car_free(highway) == 1, 1.0).when(t.isin("both", "left", "right", "yes", "separate"), 1.0).when(t.isin("no", "none"), 0.0).otherwise(0.5)


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def speed_risk(mph: Column) -> Column:
    return 1 / (1 + F.exp(-(mph - 35) / 6))


def day_safety(free: Column, mph: Column, lanes: Column, walk: Column) -> Column:
    """0.92 where no cars go, else one minus speed risk scaled by lanes and eased by a sidewalk; null inputs stay null."""
    risk = speed_risk(mph) * clip(1 + 0.1 * (lanes - 2), 0.8, 1.5) * (1 - 0.5 * F.coalesce(walk, F.lit(0.5)))
    return F.round(F.when(free.isNotNull(), F.when(free == 1, 0.92).otherwise(1 - clip(risk, 0.0, 1.0))), 3)


def gtfs_hour(clock: Column) -> Column:
    """The hour of HH:MM:SS, over 23 too; anything else null."""
    head = F.split(clock, ":")[0]
    return F.when(head.rlike(r"^\s*\d+\s*$"), F.trim(head).cast("int"))


def leaf_on(month: Column) -> Column:
    return F.coalesce(month.between(4, 10), F.lit(False))


def octant(degrees: Column) -> Column:
    return F.floor(F.pmod(degrees, F.lit(360.0)) / 45).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + F.floor((lon + 180) / 6).cast("int") + 1


def bbox_of(lat: Column, lon: Column, metres: Column) -> Column:
    dlat = metres / 111320.0
    dlon = metres / (F.lit(111320.0) * F.cos(F.radians(lat)))
    return F.struct((lon - dlon).alias("min_lon"), (lat - dlat).alias("min_lat"), (lon + dlon).alias("max_lon"), (lat + dlat).alias("max_lat"))


def equirectangular(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    return F.hypot((lon2 - lon1) * 111000.0 * F.cos(F.radians(lat1)), (lat2 - lat1) * 111000.0)


#: WGS84's half axis and flattening, and the grid's scale on a zone's middle meridian (fixed values).
AXIS, FLAT, SCALE_0 = 6378137.0, 1 / 298.257223563, 0.9996
EAST_0, SOUTH_0 = 500_000.0, 10_000_000.0
_N = FLAT / (2 - FLAT)
#: The rectifying radius, and coefficients of the series between conformal and rectifying latitude, either way.
RADIUS = AXIS / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
FORTH = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BACK = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)

#: From conformal to geographic latitude.
TRUE = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def zone_of(lon: Column) -> Column:
    """The six-degree zone of a longitude, 1 to 60; longitudes beyond 180 come round."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm(lon: Column, lat: Column, zone: int | Column | None = None, south: Column | None = None) -> tuple[Column, Column]:
    """(easting, northing) of WGS84 degrees by the Kruger series to fourth order; better than a millimetre within a zone.

    zone is a number, a column (each row its own), or each row's own by its longitude; south of the equator, or where
    ``south`` says so, northings count from ten million metres down.
    """
    z = zone_of(lon) if zone is None else F.lit(zone) if isinstance(zone, int) else zone
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lon - (z * 6.0 - 183.0))
    sin = F.sin(phi)
    t = F.sinh(F.atanh(sin) - F.lit(e) * F.atanh(F.lit(e) * sin))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(FORTH, 1):
        east = east + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    down = F.when(lat < 0 if south is None else south, F.lit(SOUTH_0)).otherwise(F.lit(0.0))
    return F.lit(EAST_0) + F.lit(SCALE_0 * RADIUS) * east, F.lit(SCALE_0 * RADIUS) * north + down


def from_utm(east: Column, north: Column, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """(lon, lat) in WGS84 degrees of an easting and northing; the way back from utm, to a millimetre within a zone."""
    z, down = F.lit(zone) if isinstance(zone, int) else zone, F.lit(south) if isinstance(south, bool) else south
    xi = (north - F.when(down, F.lit(SOUTH_0)).otherwise(F.lit(0.0))) / (SCALE_0 * RADIUS)
    eta = (east - EAST_0) / (SCALE_0 * RADIUS)
    xi_0, eta_0 = xi, eta
    for j, c in enumerate(BACK, 1):
        xi = xi - F.lit(c) * F.sin(2 * j * xi_0) * F.cosh(2 * j * eta_0)
        eta = eta - F.lit(c) * F.cos(2 * j * xi_0) * F.sinh(2 * j * eta_0)
    conformal = F.asin(F.sin(xi) / F.cosh(eta))
    phi = conformal
    for j, c in enumerate(TRUE, 1):
        phi = phi + F.lit(c) * F.sin(2 * j * conformal)
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (z * 6.0 - 183.0), F.degrees(phi)


def answer(raw: Column) -> Column:
    """A model's answer as L, R, tie or skip, by its first choice word."""
    word = F.regexp_extract(F.upper(F.coalesce(raw, F.lit(""))), r"\b(LEFT|RIGHT|SAME|NEITHER|BOTH)\b", 1)
    return F.when(word == "LEFT", "L").when(word == "RIGHT", "R").when(word.isin("SAME", "BOTH", "NEITHER"), "tie").otherwise("skip")


def rater_name(raw: Column) -> Column:
    return F.substring(F.regexp_replace(F.trim(raw), r"[^A-Za-z0-9 _-]", ""), 1, 30)


def bias_flag(r: Column) -> Column:
    return F.when(F.abs(r) >= 0.4, "WATCH").when(F.abs(r) >= 0.2, "mild").otherwise("clean")


def tier(share: Column) -> Column:
    return F.when(share == 1, "unanimous").when(share >= 0.7, "strong").otherwise("split")


def wkt_line(xs: Column, ys: Column) -> Column:
    point = F.zip_with(xs, ys, lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string")))
    return F.concat(F.lit("LINESTRING ("), F.array_join(point, ", "), F.lit(")"))


def night_clock(clock: Column) -> Column:
    """HHMM strings from 2000 to 0559, compared as text."""
    return (clock >= "2000") | (clock <= "0559")


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """Whether text contains one of the words."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def verdict(r: Column, least: float = 0.03) -> Column:
    return F.when(r < -least, "tracks fewer").when(r > least, "tracks more").otherwise("flat")


def exposure_verdict(rho: Column, coef: Column, least: float = 0.03) -> Column:
    """What a feature tracks once exposure is taken out: fewer only if the partial rank correlation and the linear coefficient agree."""
    return F.when((rho < -least) & (coef < 0), "tracks fewer").when(rho > least, "tracks more").otherwise("flat")


def order_verdict(rho: Column, least: float = 0.10) -> Column:
    """Whether counts fall as a safety score rises."""
    return F.when(rho < -least, "supported").otherwise("weak")


def transfer_verdict(gap: Column, lowest: Column, most: float = 0.05, least: float = 0.65) -> Column:
    """Whether a model holds where it has not been fitted: small gaps to the pooled fit, and agreement everywhere."""
    return F.when((gap <= most) & (lowest >= least), "generalizes").otherwise("does not cleanly generalize")


#: Classes of label masks, by number.
MASK_CLASSES = ("road", "sidewalk", "building", "pole", "vegetation", "sky")


def class_share(mask: Column, number: int) -> Column:
    """The share of a mask's pixels with this class; null for an empty or missing mask."""
    return F.size(F.filter(mask, lambda x: x == number)) / F.nullif(F.size(mask), F.lit(0))


def taken_at(raw: Column) -> Column:
    """A capture time as a UTC timestamp: from epoch milliseconds (a number, or digits in a string), or a timestamp's own text."""
    text = raw.cast("string")
    return F.when(text.rlike(r"^-?\d+$"), F.timestamp_millis(text.try_cast("bigint"))).otherwise(text.try_cast("timestamp"))


def locator_percent(lon: Column, lat: Column, box: tuple[Column, Column, Column, Column]) -> tuple[Column, Column]:
    """Percent from the left and from the top of a map that shows the box (min_lon, min_lat, max_lon, max_lat); null if it has no width or height."""
    left, low, right, top = box
    return 100 * (lon - left) / F.nullif(right - left, F.lit(0.0)), 100 * (top - lat) / F.nullif(top - low, F.lit(0.0))


def geoid(*parts: Column, widths: tuple[int, ...] = (2, 3, 6, 1)) -> Column:
    """A census place's id: state, county, tract and block group as digits of fixed widths, one after the other."""
    return F.concat(*[F.lpad(p.cast("string"), w, "0") for p, w in zip(parts, widths, strict=False)])
