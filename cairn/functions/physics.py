"""The physical model: work at the joints, roughness and walking speed, by grade."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Measured grades and factors of joint work, one branch each way.
DESCENT = ((-0.15, -0.10, 0.0), (1.69, 1.24, 1.00))
ASCENT = ((0.0, 0.10, 0.15), (1.00, 1.18, 1.57))
#: Surfaces without roughness, paved ones, and the speed model's coefficients.
SMOOTH = ["asphalt", "concrete", "concreteplates", "paved", "pavingstones", "compacted", "finegravel", "gravel"]
PAVED = ["asphalt", "concrete", "paved", "paving_stones"]
ROUGH = 1.28
SPEED = {"paved": (1.580, -0.00389, -0.00726, -0.00218), "path": (1.580, -0.00389, -0.00965, -0.00248), "pathless": (None, -0.00731, -0.00965, -0.00187)}
PATHLESS_BASE = {"forest": 1.443, "water": 1.443, "unknown": 1.536}
LEAST_KMH = 0.2


def hermite(x: tuple[float, ...], y: tuple[float, ...]) -> list[tuple[float, float, float, float, float, float]]:
    """Pieces (from, width, y0, y1, m0, m1) of the shape-preserving cubic through points."""
    w = [b - a for a, b in zip(x, x[1:])]
    s = [(b - a) / v for a, b, v in zip(y, y[1:], w)]

    def end(w0: float, w1: float, s0: float, s1: float) -> float:
        m = ((2 * w0 + w1) * s0 - w0 * s1) / (w0 + w1)
        return 0.0 if m * s0 <= 0 else 3 * s0 if s0 * s1 < 0 and abs(m) > 3 * abs(s0) else m

    inner = 0.0 if s[0] * s[1] <= 0 else 3 * (w[0] + w[1]) / ((2 * w[1] + w[0]) / s[0] + (2 * w[0] + w[1]) / s[1])
    m = [end(w[0], w[1], s[0], s[1]), inner, end(w[1], w[0], s[1], s[0])]
    return [(x[i], w[i], y[i], y[i + 1], m[i], m[i + 1]) for i in (0, 1)]


PIECES = hermite(*DESCENT) + hermite(*ASCENT)


def joint_work(grade: Column) -> Column:
    """Work at the joints over that on the flat; constant beyond the measured grades."""
    out = F.when(grade <= DESCENT[0][0], DESCENT[1][0]).when(grade >= ASCENT[0][2], ASCENT[1][2])
    for x0, w, y0, y1, m0, m1 in PIECES:
        t = (grade - x0) / w
        t2 = t * t
        t3 = t2 * t
        value = (2 * t3 - 3 * t2 + 1) * y0 + (t3 - 2 * t2 + t) * (w * m0) + (3 * t2 - 2 * t3) * y1 + (t3 - t2) * (w * m1)
        out = out.when(grade < x0 + w, value)
    return out


def roughness(terrain: Column, surface: Column | None = None) -> Column:
    smooth = terrain.isin("pavement", "road")
    if surface is not None:
        smooth = smooth | F.coalesce(F.lower(F.regexp_replace(surface, "[^0-9A-Za-z]", "")).isin(SMOOTH), F.lit(False))
    return F.when(smooth, 1.0).otherwise(ROUGH)


def speed_kmh(grade: Column, terrain: Column, kind: Column | None = None, surface: Column | None = None, hill_deg: Column | None = None) -> Column:
    """Walking speed.  hill_deg: the hillside's slope, at least the walking slope's own."""
    slope = F.degrees(F.atan(grade))
    hill = F.abs(slope) if hill_deg is None else F.greatest(F.coalesce(hill_deg, F.lit(0.0)), F.abs(slope))
    hill, slope = F.least(hill, F.lit(40.0)), F.least(F.greatest(slope, F.lit(-40.0)), F.lit(40.0))
    paved = terrain == "pavement"
    if surface is not None:
        paved = paved | F.coalesce(F.lower(F.trim(surface)).isin(PAVED), F.lit(False))

    def by(model: str, base: Column | float) -> Column:
        _, b, c, d = SPEED[model]
        return F.greatest(F.exp(base + b * hill + c * slope + d * F.pow(slope, 2)), F.lit(LEAST_KMH))

    out = F.when(paved, by("paved", SPEED["paved"][0]))
    if kind is not None:
        base = F.lit(SPEED["path"][0])
        for value in sorted(set(PATHLESS_BASE.values())):
            base = F.when(terrain.isin([k for k, v in PATHLESS_BASE.items() if v == value]), value).otherwise(base)
        out = out.when(kind == "bushwhack", by("pathless", base))
    return out.otherwise(by("path", SPEED["path"][0]))


def pace_scaled(seconds: Column, flat_kmh: Column | float) -> Column:
    """Time at a walker's own speed on the flat, from the model's time."""
    return seconds * exp(SPEED["path"][0]) / flat_kmh


def population_time(seconds: Column, flat_kmh: Column | float) -> Column:
    """The model's time from that of a walker with this speed on the flat."""
    return seconds * flat_kmh / exp(SPEED["path"][0])
