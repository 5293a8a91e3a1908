"""Column expressions: names, finite values, directions, shape rules and payload settings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_name(name: Column) -> Column:
    """Lower case, runs of other signs than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def kind_suffix(stem: Column) -> tuple[Column, Column]:
    """(body, kind) of a file stem that ends in _label, _labels or _mask; kind is null for others."""
    end = F.regexp_extract(stem, "(?i)^(.*)_(labels?|mask)$", 2)
    kind = F.when(F.lower(end).startswith("label"), "label").when(F.lower(end) == "mask", "mask")
    return F.when(kind.isNull(), stem).otherwise(F.regexp_extract(stem, "(?i)^(.*)_(labels?|mask)$", 1)), kind


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix."""
    n = F.least(F.length(a), F.length(b))
    differs = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: F.substr(a, k, F.lit(1)) != F.substr(b, k, F.lit(1)))
    return F.coalesce(F.get(differs, 0) - 1, n)


def whole_prefix(text: Column, shared: Column, source: Column) -> Column:
    """``shared`` moved back to the last sign that is no letter or digit, unless the prefix ends between words: c1 is no beginning of c10_mito."""
    at = lambda t, k: F.substr(t, k, F.lit(1))
    word = lambda c: c.rlike("[A-Za-z0-9]")
    splits = (shared > 0) & word(at(text, shared)) & (word(at(text, shared + 1)) | word(at(source, shared + 1)))
    back = F.length(F.regexp_extract(F.substr(text, F.lit(1), shared), "^(.*[^A-Za-z0-9])?[A-Za-z0-9]*$", 1))
    return F.when(splits, back).otherwise(shared)


def finite(value: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def finite_columns(df: DataFrame) -> DataFrame:
    return df.select(*[finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema])


def narrowed(df: DataFrame) -> DataFrame:
    """Doubles and lists of doubles as single precision: the last projection before a report is written."""

    def cast(f: T.StructField) -> Column:
        if f.dataType == T.DoubleType():
            return F.col(f.name).cast("float").alias(f.name)
        if f.dataType == T.ArrayType(T.DoubleType()):
            return F.col(f.name).cast("array<float>").alias(f.name)
        return F.col(f.name)

    return df.select(*[cast(f) for f in df.schema])


def direction(z: Column | None, y: Column, x: Column) -> dict[str, Column]:
    """Distance and unit direction of an offset, with azimuth and elevation (3-D) or the angle (2-D) in degrees.

    Without length, all but the distance are null. Planes have no z values at all.
    """
    dist = F.sqrt((z * z if z is not None else F.lit(0.0)) + y * y + x * x)
    unit = lambda v: F.when(dist > 0, F.try_divide(v, dist))
    out = {"polar_dist_um": dist, "polar_ny": unit(y), "polar_nx": unit(x)}
    angle = F.degrees(F.atan2(unit(y), unit(x)))
    if z is None:
        return out | {"polar_angle_deg": angle}
    return out | {"polar_nz": unit(z), "polar_az_deg": angle, "polar_el_deg": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), unit(z)))))}


def cone_angle(dot: Column) -> Column:
    """Degrees between two unit vectors with this product."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))


def roundness(volume: Column, surface: Column, flat: bool = False) -> Column:
    """Boundary of the ball (disc) of equal size over the boundary; may exceed 1."""
    ball = 2 * F.sqrt(F.lit(math.pi) * volume) if flat else F.cbrt(F.lit(36 * math.pi) * volume * volume)
    return F.try_divide(ball, surface)


def smoothing_sigma(sphericity: Column, fill: Column, low: float = 0.5, high: float = 1.5) -> Column:
    """Smoothing width by how ball-like an instance is; the middle where a measure is missing."""
    ball = F.sqrt(F.greatest(F.lit(0.0), sphericity * F.least(F.lit(1.0), fill / (math.pi / 6))))
    value = low + (high - low) * ball
    missing = sphericity.isNull() | fill.isNull() | F.isnan(value)  # greatest() would skip a null
    return F.when(missing, F.lit((low + high) / 2)).otherwise(value)


def surface_choice(aspect: Column, sphericity: Column, branches: Column, skeleton: Column) -> Column:
    """tube, ellipsoid or mesh; an aspect below 1 is unknown."""
    known = F.when(aspect >= 1, aspect)
    return (
        F.when(skeleton & (known >= 3) & (branches >= 1), "tube")
        .when((sphericity >= 0.75) & (known <= 3), "ellipsoid").otherwise("mesh")
    )


def ellipsoid_ok(r1: Column, r2: Column, r3: Column, stretch: float = 100.0) -> Column:
    """Whether three radii make a drawable ellipsoid."""
    whole = finite(r1).isNotNull() & finite(r2).isNotNull() & finite(r3).isNotNull()
    good = (F.least(r1, r2, r3) > 0) & (F.try_divide(F.greatest(r1, r2, r3), F.cbrt(r1 * r2 * r3)) <= stretch)
    return F.coalesce(whole & good, F.lit(False))


def noun(text: Column, word: str) -> Column:
    """``object`` as a whole word replaced by the run's noun."""
    return F.regexp_replace(F.regexp_replace(text, r"\bobjects\b", plural(word)), r"\bobject\b", word.split("/")[0])


def plural(word: str) -> str:
    """``a/b`` names an irregular plural; no double s."""
    one, _, many = word.partition("/")
    return many or (one if one.endswith("s") else one + "s")


def digest(*parts: Column) -> Column:
    """Sixteen hexadecimal digits of the settings, null as the word null."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]), 256), 1, 16)


def stars(p: Column) -> Column:
    return F.when(p < 1e-4, "****").when(p < 1e-3, "***").when(p < 1e-2, "**").when(p < 0.05, "*").otherwise("ns")


def ramp(t: Column) -> Column:
    """The colour of a value between 0 and 1: magenta to cyan."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    two = lambda v: F.lower(F.lpad(F.hex(F.round(v).cast("int")), 2, "0"))
    return F.concat(F.lit("#"), two(255 * (1 - inside)), two(255 * inside), F.lit("ff"))


def id_cast(value: Column) -> Column:
    """A label id: null for nothing, an empty text and NaN."""
    text = F.nullif(F.trim(value.cast("string")), F.lit(""))
    return F.when(F.lower(text).isin("nan", "none"), None).otherwise(text).try_cast("double").cast("long")


def unit_vector(nz: Column, ny: Column, nx: Column) -> Column:
    """The direction in array order, or null if a part is missing."""
    whole = nz.isNotNull() & ny.isNotNull() & nx.isNotNull()
    return F.when(whole, F.array(nz, ny, nx))


def memory_estimate(voxels: Column, entities: Column) -> Column:
    """Bytes that one object needs at its peak when it is measured whole."""
    return (voxels * (2 * entities + 4) * 3.5).cast("long")


def box_text(ends: list[tuple[Column, Column]]) -> Column:
    return F.concat_ws(",", *[F.concat_ws(":", a.cast("string"), b.cast("string")) for a, b in ends])
