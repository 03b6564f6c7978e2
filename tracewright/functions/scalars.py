"""Column expressions: geometry, missing values, keys, folds and ids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0
STANDOFF_RANGE_M = (0.2, 20.0)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the files and NULL in every plan."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c).alias(f.name)
        cols.append(c)
    return df.select(*cols)


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def along_bearing_m(lat: Column, lon: Column, lat0: float, lon0: float, bearing_deg: float) -> Column:
    """Distance along a fixed bearing from an origin (flat-earth projection)."""
    brg = F.radians(F.lit(float(bearing_deg)))
    north = (lat - lat0) * METRES_PER_DEGREE
    east = (lon - lon0) * METRES_PER_DEGREE * F.cos(F.radians(F.lit(float(lat0))))
    return north * F.cos(brg) + east * F.sin(brg)


def locked(lat: Column, lon: Column) -> Column:
    """1.0 where both coordinates are present."""
    return (lat.isNotNull() & lon.isNotNull()).cast("double")


def first_difference(lo: Column, hi: Column, spacing_m: Column | float) -> Column:
    """Gradient across heads at -d and +d."""
    return (hi - lo) / (2.0 * _as_col(spacing_m))


def second_difference(lo: Column, mid: Column, hi: Column, spacing_m: Column | float) -> Column:
    d = _as_col(spacing_m)
    return (hi + lo - 2.0 * mid) / (d * d)


def standoff_m(amplitude: Column, curvature: Column, nominal_m: Column | float) -> Column:
    """Distance implied by a 1/r^3 falloff, r = sqrt(12 |a| / |a''|), kept in a plausible band."""
    r = finite(F.sqrt(safe_div(12.0 * F.abs(amplitude), F.abs(curvature))))
    r = F.coalesce(F.when(r > 0, r), _as_col(nominal_m))
    lo, hi = STANDOFF_RANGE_M
    return F.greatest(F.lit(lo), F.least(F.lit(hi), r))


def vector_magnitude(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def vector_inclination_deg(x: Column, y: Column, z: Column) -> Column:
    return F.degrees(F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), safe_div(z, vector_magnitude(x, y, z))))))


def vector_declination_deg(x: Column, y: Column) -> Column:
    return F.degrees(F.atan2(y, x))


def deterministic_id(survey: Column, version: Column, idx: Column, chainage: Column) -> Column:
    """24 hex digits of the sha256 of the four key parts; equal inputs give equal ids."""
    key = F.concat_ws("|", survey, version, idx.cast("string"), F.format_string("%.3f", chainage.cast("double")))
    return F.substring(F.sha2(key, 256), 1, 24)


def group_key(line: Column, chainage: Column, block_m: float) -> Column:
    return F.concat_ws("::", line.cast("string"), F.floor(chainage / block_m).cast("long").cast("string"))


def hash_fold(key: Column, folds: int) -> Column:
    """The sha256 of the key, read as an integer, modulo ``folds``.

    Eight digits at a time by plain expressions: compiled code, which a function of arrays is not.
    """
    digest, out = F.sha2(key.cast("string"), 256), F.lit(0).cast("long")
    for k in range(8):
        part = F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
        # both factors are below ``folds``, so that no step leaves 63 bits
        out = F.pmod(out * F.lit((1 << 32) % folds).cast("long") + part, F.lit(folds).cast("long"))
    return out


def class_label(defect: Column, interference: Column) -> Column:
    return F.when(defect, "defect").when(interference, "interference").otherwise("background")


def consequence(kind: Column, weights: Mapping[str, float]) -> Column:
    """Class to weight; an unknown class gives NULL."""
    out = F.lit(None).cast("double")
    for name, weight in weights.items():
        out = F.when(kind == name, F.lit(float(weight))).otherwise(out)
    return out


def argmax_class(probabilities: Column, classes: Sequence[str]) -> Column:
    """First class with the largest probability."""
    names = F.array(*[F.lit(c) for c in classes])
    return F.element_at(names, F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def days_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / F.lit(86_400e6)


def _as_col(v: Column | float) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))
