"""Geography, weather, stadium and stat-line formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c, clip

# Earth radius, degrees per time-zone hour, league and park references, wind signs.
EARTH_KM = 6371.0
DEG_PER_HOUR = 15.0
PORCH_FEET = 330.0
AIR_REF = 1013.25 / 294.26
PULL_DEG = 15.0
PLATE_XY = (125.42, 198.27)
EDGE_X_HALF = 0.83
EDGE_LO, EDGE_HI = 0.67, 1.33
WIND_RADIAL = {
    "Out To Cf": 1.0, "Out To Lf": 0.8, "Out To Rf": 0.8, "In From Cf": -1.0, "In From Lf": -0.8, "In From Rf": -0.8,
    "L To R": 0.0, "R To L": 0.0, "Calm": 0.0, "None": 0.0, "Varies": 0.0,
}
CARRY_CENTER, CARRY_OPPOSITE = 0.7, 0.2


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    dl = F.radians(_c(lon2) - _c(lon1))
    s1, s2 = F.sin((b - a) / 2), F.sin(dl / 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(s1 * s1 + F.cos(a) * F.cos(b) * s2 * s2))


def zone_shift_hours(lon_from, lon_to) -> Column:
    return (_c(lon_to) - _c(lon_from)) / DEG_PER_HOUR


def ip_to_outs(ip) -> Column:
    """Innings notation 5.2 (five innings, two outs) to 17 outs."""
    v = F.coalesce(_c(ip).try_cast("double"), F.lit(0.0))
    whole = F.floor(v)
    return (whole * 3 + F.round((v - whole) * 10)).cast("long")


def base_runs(h, bb, hbp, tb, hr, ab) -> Column:
    """Sequencing-free run estimate A*B/(B+C)+D."""
    h, bb, hbp, tb, hr, ab = map(_c, (h, bb, hbp, tb, hr, ab))
    on = h + bb + hbp - hr
    adv = 1.1 * (1.4 * tb - 0.6 * h - 3.0 * hr + 0.1 * (bb + hbp))
    outs = F.greatest(ab - h, F.lit(1.0))
    return on * adv / F.greatest(adv + outs, F.lit(1e-9)) + hr


def spray_angle(x, y) -> Column:
    return F.degrees(F.atan2(_c(x) - PLATE_XY[0], PLATE_XY[1] - _c(y)))


def pulled(angle, right_handed) -> Column:
    return F.when(_c(right_handed), _c(angle) < -PULL_DEG).otherwise(_c(angle) > PULL_DEG)


def zone_location(x, z, top, bottom) -> Column:
    """Distance from the zone centre scaled so that 1.0 is the edge on the worse axis."""
    x, z, top, bottom = map(_c, (x, z, top, bottom))
    xs = F.abs(x) / EDGE_X_HALF
    zs = F.abs(z - (top + bottom) / 2) / clip((top - bottom) / 2, 0.1)
    return F.greatest(xs, zs)


def shadow_band(loc) -> Column:
    return (_c(loc) > EDGE_LO) & (_c(loc) <= EDGE_HI)


def count_state(balls, strikes) -> Column:
    b, s = _c(balls), _c(strikes)
    return (
        F.when((b == 0) & (s == 0), "first").when((b == 3) & (s == 2), "full").when(s > b, "ahead")
        .when(b > s, "behind").otherwise("even")
    )


def air_density(pressure, temp_f) -> Column:
    return _c(pressure) / ((_c(temp_f) - 32) * 5 / 9 + 273.15)


def wind_radial(direction) -> Column:
    pairs = [x for k, v in WIND_RADIAL.items() for x in (F.lit(k), F.lit(v))]
    return F.element_at(F.create_map(*pairs), F.initcap(_c(direction)))


def wind_out(speed, direction, closed) -> Column:
    return F.when(_c(closed), 0.0).otherwise(_c(speed) * wind_radial(direction))


def wind_pull(speed, direction, right_handed, closed, pull_share) -> Column:
    """Wind component helping the hitter's pull field, weighted by how often the hitter pulls."""
    d = F.initcap(_c(direction))
    field = F.upper(F.substring(F.element_at(F.split(d, " "), -1), 1, 1))
    field = F.when(d.rlike("^(Out To|In From) [LCR]f$"), field)
    sign = F.when(d.startswith("Out"), 1.0).when(d.startswith("In"), -1.0)
    pull_field = F.when(_c(right_handed), "L").otherwise("R")
    w = (
        F.when(field == pull_field, 1.0).when(field == "C", CARRY_CENTER)
        .when(field.isNotNull(), CARRY_OPPOSITE).otherwise(0.0)
    )
    zero = F.lit(0.0)
    return F.when(_c(closed), zero).otherwise(
        F.coalesce(_c(speed), zero) * F.coalesce(F.when(field.isNotNull(), sign), zero) * w * _c(pull_share)
    )


def porch(fence) -> Column:
    return PORCH_FEET - _c(fence)
