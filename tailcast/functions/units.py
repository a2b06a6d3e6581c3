"""Unit conversion as affine column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_A_DAY = 86400

# Each unit as factor and offset to the first unit of its kind.
KINDS: dict[str, dict[str, tuple[float, float]]] = {
    "temperature": {"degK": (1, 0), "degC": (1, 273.15), "degF": (5 / 9, 459.67 * 5 / 9)},
    "length": {"m": (1, 0), "mm": (0.001, 0), "cm": (0.01, 0), "km": (1000, 0), "inch": (0.0254, 0)},
    "speed": {"m s-1": (1, 0), "km h-1": (1 / 3.6, 0), "knot": (1852 / 3600, 0), "mph": (0.44704, 0)},
    "rate": {"mm d-1": (1, 0), "m d-1": (1000, 0), "mm s-1": (SECONDS_A_DAY, 0), "m s-1 rain": (1000 * SECONDS_A_DAY, 0)},
    "flux": {"kg m-2 s-1": (1, 0), "kg m-2 d-1": (1 / SECONDS_A_DAY, 0)},
    "pressure": {"Pa": (1, 0), "hPa": (100, 0), "kPa": (1000, 0)},
    "share": {"1": (1, 0), "%": (0.01, 0)},
}

# Other spellings.
SPELLINGS = {
    "K": "degK", "deg_k": "degK", "kelvin": "degK", "C": "degC", "deg_c": "degC", "celsius": "degC", "F": "degF",
    "kg/m2/s": "kg m-2 s-1", "m/s": "m s-1", "km/h": "km h-1", "kmh": "km h-1", "kt": "knot",
    "mm day-1": "mm d-1", "mm/day": "mm d-1", "mm/d": "mm d-1", "percent": "%",
}

# What a period's letter makes of a rate's unit.
RATE_NAMES = {"D": ("d-1", "day-1"), "M": ("m-1", "month-1"), "Q": ("q-1", "season-1"), "Y": ("yr-1", "year-1"), "A": ("yr-1", "year-1")}


def factors(source: str, target: str) -> tuple[float, float]:
    """``a`` and ``b`` of target = a * source + b; ValueError if the kinds differ."""
    s, t = SPELLINGS.get(source, source), SPELLINGS.get(target, target)
    if s == t:
        return 1.0, 0.0
    if s == "kg m-2 s-1" and t == "mm d-1":  # a kilogram of water on a square metre is a millimetre deep
        return float(SECONDS_A_DAY), 0.0
    for kind in KINDS.values():
        if s in kind and t in kind:
            (a, b), (c, d) = kind[s], kind[t]
            return a / c, (b - d) / c
    raise ValueError(f"can't convert {source} to {target}")


def convert_units(value: Column, source: str, target: str) -> Column:
    a, b = factors(source, target)
    return value * F.lit(a) + F.lit(b)


def rate_after_sum(unit: str, input_freq: str, output_freq: str) -> str:
    """A rate's unit once its values are summed: ``mm day-1`` by month is ``mm month-1``."""
    for short, long in (RATE_NAMES[input_freq[0]],):
        for old, new in ((long, RATE_NAMES[output_freq[0]][1]), (short, RATE_NAMES[output_freq[0]][0])):
            if unit.endswith(old):
                return unit.removesuffix(old) + new
    return unit


def scaled(value: Column, by: float | str, time: Column | None = None) -> Column:
    """Divided by a number, or by ``days_in_month`` of ``time``."""
    if by == "days_in_month":
        return value / F.day(F.last_day(time))
    return F.try_divide(value, F.lit(float(by)))
