"""Quantities in common units: a multi-pattern automaton finds unit and scale names near the figure, and a broadcast join converts.

The figure is read from the value itself. Unit and scale names are matched by one Aho-Corasick automaton in the value, in its unit and
scale fields and next to the figure in the claim; overlapping matches give way to the longest. The nearest field that names a unit decides, and so for
scales. What remains ambiguous is settled by context: `m` is a million after a currency and a metre elsewhere. Whole numbers of any size convert exactly.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

# Unit -> (dimension, common unit, factor as a fraction), and the names of units and scales.
FACTORS = {
    "INR": ("money", "INR", 1, 1), "USD": ("money", "USD", 1, 1), "EUR": ("money", "EUR", 1, 1),
    "percent": ("ratio", "bps", 100, 1), "bps": ("ratio", "bps", 1, 1), "permille": ("ratio", "bps", 10, 1),
    "kg": ("mass", "kg", 1, 1), "g": ("mass", "kg", 1, 1000), "tonne": ("mass", "kg", 1000, 1), "quintal": ("mass", "kg", 100, 1), "lb": ("mass", "kg", 45359237, 100000000), "oz": ("mass", "kg", 45359237, 1600000000),
    "m": ("length", "m", 1, 1), "km": ("length", "m", 1000, 1), "cm": ("length", "m", 1, 100), "mm": ("length", "m", 1, 1000), "ft": ("length", "m", 3048, 10000), "inch": ("length", "m", 254, 10000), "yd": ("length", "m", 9144, 10000), "mi": ("length", "m", 1609344, 1000), "nmi": ("length", "m", 1852, 1),
    "m2": ("area", "m2", 1, 1), "km2": ("area", "m2", 1000000, 1), "ft2": ("area", "m2", 9290304, 100000000), "yd2": ("area", "m2", 83612736, 100000000), "acre": ("area", "m2", 40468564224, 10000000), "ha": ("area", "m2", 10000, 1), "mi2": ("area", "m2", 2589988110336, 1000000),
    "kwh": ("energy", "kwh", 1, 1), "wh": ("energy", "kwh", 1, 1000), "mwh": ("energy", "kwh", 1000, 1), "gwh": ("energy", "kwh", 1000000, 1), "twh": ("energy", "kwh", 1000000000, 1), "kj": ("energy", "kwh", 1, 3600), "mj": ("energy", "kwh", 10, 36), "gj": ("energy", "kwh", 10000, 36), "tj": ("energy", "kwh", 10000000, 36),
    "second": ("duration", "hour", 1, 3600), "minute": ("duration", "hour", 1, 60), "hour": ("duration", "hour", 1, 1), "day": ("duration", "hour", 24, 1), "week": ("duration", "hour", 168, 1),
    "each": ("count", "each", 1, 1),
}
UNIT_NAMES = {
    "INR": "inr, rs, rs., ₹, rupee, rupees, indian rupee, indian rupees, re.", "USD": "usd, us$, $, us dollar, us dollars, u.s. dollars, dollar, dollars, us $", "EUR": "eur, €, euro, euros",
    "percent": "%, percent, per cent, pct, pct., percentage, percentage point, percentage points, pp, ppt, p.p.", "bps": "bps, bp, basis point, basis points, bps.", "permille": "‰, per mille",
    "kg": "kg, kgs, kg., kgs., kilo, kilos, kilogram, kilograms, kilogramme, kilogrammes", "g": "gram, grams, gm, gms", "tonne": "t, tonne, tonnes, metric ton, metric tons, metric tonne, metric tonnes, mt, ton, tons", "quintal": "quintal, quintals, qtl, qtls, qtl.", "lb": "lb, lbs, lb., lbs., pound, pounds", "oz": "oz, ounce, ounces",
    "m": "m, metre, metres, meter, meters, mtr, mtrs", "km": "km, kms, km., kms., kilometre, kilometres, kilometer, kilometers", "cm": "cm, centimetre, centimetres, centimeter, centimeters", "mm": "mm, millimetre, millimetres, millimeter, millimeters", "ft": "ft, ft., foot, feet", "inch": "inch, inches", "yd": "yd, yds, yard, yards", "mi": "mi, mile, miles", "nmi": "nautical mile, nautical miles",
    "m2": "m2, m², sqm, sq m, sq. m, sq. m., sq mt, sq. mt., sq. mt, sq.m., sq.m, sq. mtr., square metre, square metres, square meter, square meters", "km2": "km2, km², sq km, sq. km, sq. km., sqkm, square kilometre, square kilometres, square kilometers", "ft2": "ft2, ft², sqft, sq ft, sq. ft., sq. ft, sq.ft., sq.ft, square foot, square feet", "yd2": "sq yd, sq. yd., square yard, square yards", "acre": "acre, acres", "ha": "ha, hectare, hectares", "mi2": "sq mi, square mile, square miles",
    "kwh": "kwh, kilowatt hour, kilowatt hours, kilowatt-hour, kilowatt-hours", "wh": "wh, watt hours, watt-hours", "mwh": "mwh, megawatt hour, megawatt hours, megawatt-hour, megawatt-hours", "gwh": "gwh, gigawatt hour, gigawatt hours, gigawatt-hour, gigawatt-hours", "twh": "twh, terawatt hours, terawatt-hours", "kj": "kj, kilojoule, kilojoules", "mj": "mj, megajoule, megajoules", "gj": "gj, gigajoule, gigajoules", "tj": "tj, terajoule, terajoules",
    "second": "s, sec, secs, second, seconds", "minute": "min, mins, min., mins., minute, minutes", "hour": "h, hr, hrs, hr., hrs., hour, hours", "day": "d, day, days", "week": "wk, wks, week, weeks",
    "each": "no., nos, nos., number, numbers, unit, units, each, piece, pieces, pcs, count",
}
SCALE_NAMES = {
    2: "hundred, hundreds", 3: "k, thousand, thousands, '000, ’000, 000s, thd", 5: "lakh, lakhs, lac, lacs, lakh., lac.", 6: "mn, mn., mln, million, millions, mio", 7: "cr, cr., crs, crs., crore, crores", 8: "ten crore, ten crores",
    9: "bn, bn., bln, billion, billions", 10: "thousand crore, thousand crores, '000 crore, '000 crores", 12: "tn, tn., trn, trillion, trillions, lakh crore, lakh crores, lac crore, lac crores",
}

_NUMBER = re.compile(r"(\d{1,3}(?:[,\u00a0\u2007\u2009\u202f ]\d{2,3})+(?![\d])(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)(?:[eE]([+-]?\d{1,4})(?!\w)|\s?[x×*]\s?10(?:\^|\*\*)\s?([+-]?\d{1,4})(?!\w))?")
#: What may stand between a figure and its scale or unit.
_GAP = re.compile(r"[\s\u00a0\u202f,()\[\]]*(?:in\s+)?")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for code, names in UNIT_NAMES.items():
        for name in names.split(", "):
            a.add_word(name, (len(name), "unit", code))
    for power, names in SCALE_NAMES.items():
        for name in names.split(", "):
            a.add_word(name, (len(name), "scale", power))
    a.make_automaton()
    return a


def matches(text: str) -> list[tuple[int, int, str, str | int]]:
    """(start, end, unit | scale, code), leftmost and longest, of names that stand alone: no letter or, before a word, no digit ends in them."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    low = re.sub("[\u00a0\u2007\u2009\u202f]", " ", low)
    found = []
    for end, (n, kind, code) in automaton().iter(low):
        start, after = end + 1 - n, end + 1
        if low[start].isalpha() and start and low[start - 1].isalpha():
            continue
        if low[end].isalpha() and after < len(low) and (low[after].isalpha() or low[after] in "²³"):
            continue
        if low[end].isalpha() and after < len(low) and low[after].isdigit():
            continue
        if low[start] in "'’" and start and low[start - 1].isalnum():
            continue
        found.append((start, after, kind, code))
    found.sort(key=lambda m: (m[0], -m[1]))
    out, at = [], 0
    for m in found:
        if m[0] >= at:
            out.append(m)
            at = m[1]
    return out


def read_number(text: str) -> tuple[int, int, int, int] | None:
    """(mantissa with sign, decimals, start, end) of the first figure, a power of ten taken off the decimals. A minus before it or parentheses around it make it negative."""
    for m in _NUMBER.finditer(text):
        start, end = m.span()
        if start and text[start - 1] in "'’":  # '000 is a scale
            continue
        whole, _, part = re.sub(r"[^\d.]", "", m.group(1)).partition(".")
        value = int((whole + part)[:4300] or "0")
        before = text[:start].rstrip()
        minus = bool(before) and before[-1] in "-−–" and not (len(before) > 1 and before[-2].isalnum())
        minus |= bool(before) and before[-1] == "(" and text[end : end + 4].lstrip().startswith(")")
        minus |= bool(re.match(r"^\(\s*[^\d()]*$", before)) and text.rstrip().endswith(")")
        lost = max(0, len(whole) + len(part) - 4300)  # digits that no whole number within BIGINT turns on
        return (-value if minus else value), len(part) - lost - int(m.group(2) or m.group(3) or 0), start, end
    return None


def _beside(text: str, start: int, end: int) -> tuple[str | None, int | None]:
    """The unit and scale that stand right after the figure at start:end, or the unit right before it."""
    unit: str | None = None
    scale: int | None = None
    # longer than any two names beside each other, and cut where no name can be cut in two
    text = text[: end + 80]
    if start > 80:
        text, start, end = " " + text[start - 60 :], 61, end - start + 61
    named = matches(text[:start] + "|" * (end - start) + text[end:])  # '000 may be glued to its figure
    at = _GAP.match(text, end).end()
    after = {m[0]: m for m in named}
    while (m := after.get(at)) is not None and (unit is None or scale is None):
        if m[2] == "unit":
            if unit is not None:
                break
            unit = m[3]
        else:
            if scale is not None:
                break
            scale = m[3]
        at = _GAP.match(text, m[1]).end()
    if unit is None or unit == "m":
        head = text[:start].rstrip(" \u00a0\u202f-−(~<>≥≤")
        before = next((m for m in named if m[1] == len(head) and m[2] == "unit"), None)
        if before is not None:
            if unit == "m" and FACTORS[before[3]][0] == "money":
                scale = 6 if scale is None else scale
            unit = before[3] if unit is None or FACTORS[before[3]][0] == "money" else unit
    return unit, scale


def _in_field(text: str | None) -> tuple[str | None, int | None]:
    unit: str | None = None
    scale: int | None = None
    for _, _, kind, code in matches(text) if text else ():
        if kind == "unit":
            if code == "m" and unit is not None and FACTORS[unit][0] == "money" and scale is None:
                scale = 6
            elif unit is None or (unit == "m" and FACTORS[code][0] == "money"):
                scale = 6 if unit == "m" and scale is None else scale
                unit = code
        elif scale is None:
            scale = code
    return unit, scale


_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")


def _plain(text: str) -> str:
    """Compatibility forms (wide digits, special blanks) and invisible characters give way to ordinary ones."""
    return text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))


def read_quantity(value_json: str | None, claim: str | None) -> tuple[int, int, str] | None:
    """(mantissa, power of ten, unit) of a quantity, or None where no figure can be read."""
    try:
        value = json.loads(value_json) if value_json else None
    except ValueError:
        value = None
    raw = value.get("raw") if isinstance(value, dict) else None
    if not isinstance(raw, str):
        raw = None if raw is None or isinstance(raw, (bool, dict, list)) else str(raw)
    if not raw or (number := read_number(raw := _plain(raw))) is None:
        return None
    mantissa, decimals, start, end = number
    texts = [_plain(value[k]) if isinstance(value.get(k), str) else None for k in ("unit", "scale")]
    near = [_in_field(raw[:start] + "|" + raw[end:]), _in_field(texts[0]), _in_field(texts[1])]
    if claim:
        claim = _plain(claim)
        figure = re.compile(r"(?<!\d)(?<!\d[.,])" + re.escape(raw[start:end]) + r"(?![\d]|[.,]\d)")
        seen = [_beside(claim, *m.span()) for m in figure.finditer(claim)]
        near.append(next((x for x in reversed(seen) if x != (None, None)), (None, None)))
    unit = next((u for u, _ in near if u is not None), None) or "each"
    # a scale field decides over the unit field's words, the value's own words over both
    scale = next((s for _, s in (near[0], near[2], near[1], *near[3:]) if s is not None), 0)
    if len(near) > 3 and near[3][1] == 12 and scale in (5, 7):
        scale = 12  # a lakh, or a crore, of what the claim spells as a lakh crore
    if unit == "m" and FACTORS.get(next((u for u, _ in near if u and u != "m"), ""), ("",))[0] == "money":
        unit, scale = next(u for u, _ in near if u and u != "m"), scale or 6
    if FACTORS[unit][0] == "ratio":
        scale = 0
    return mantissa, scale - decimals, unit


_SCHEMA = "mantissa string, power int, unit string"


def _reading(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [read_quantity(v, c) for v, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([str(r[0]) if r else None for r in read], pa.string()), pa.array([r[1] if r else None for r in read], pa.int32()), pa.array([r[2] if r else None for r in read], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "mantissa", "power", "unit"])

    return run


def whole(mantissa: int, power: int, num: int, den: int) -> int | None:
    """mantissa * 10**power * num / den as a whole number, halves away from zero; None beyond BIGINT."""
    digits = len(str(abs(mantissa)))
    if not mantissa or digits + power < -40:
        return 0
    if digits + power > 40:
        return None
    n, d = abs(mantissa) * num * 10 ** max(power, 0), den * 10 ** max(-power, 0)
    value = (2 * n + d) // (2 * d) * (1 if mantissa > 0 else -1)
    return value if -(2**63) <= value < 2**63 else None


def _converted(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [whole(int(m), p, n, d) for m, p, n, d in zip(*(batch.column(c).to_pylist() for c in ("mantissa", "power", "num", "den")))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("common_unit"), pa.array(values, pa.int64())], [id_col, "common_unit", "common_value"])

    return run


def conversions(common_units: DataFrame) -> DataFrame:
    """unit, common_unit, num, den of the units whose common unit is listed; as many rows as FACTORS has."""
    rows = [(u, d, c, n, m) for u, (d, c, n, m) in FACTORS.items()]
    schema = "unit string, dimension string, common_unit string, num long, den long"
    return common_units.sparkSession.createDataFrame(rows, schema).join(common_units.select("dimension", "common_unit").distinct(), ["dimension", "common_unit"], "left_semi").select("unit", "common_unit", "num", "den")


def to_common_units(quantities: DataFrame, common_units: DataFrame, *, id_col: str = "fact_id", value_col: str = "value_json", claim_col: str = "claim_text") -> DataFrame:
    """(id_col, common_unit, common_value): readable quantities in whole common units, halves away from zero.

    Rows without a readable figure (null or broken JSON, nil, a dash), with a value beyond BIGINT, or of a unit without a common unit give
    no row; figures may have any number of digits, and powers of ten as in 1.5e6 or 1.5 x 10^6. A figure without any unit is 'each'. Repeated rows stay repeated; other columns are dropped. The
    conversion factors are a fixed table, so they are broadcast whatever the data.
    """
    ship(quantities.sparkSession)
    kind = quantities.schema[id_col].dataType.simpleString()
    read = quantities.select(id_col, value_col, claim_col).mapInArrow(_reading(id_col), f"`{id_col}` {kind}, {_SCHEMA}").where("unit is not null")
    met = read.join(F.broadcast(conversions(common_units)), "unit")
    return met.select(id_col, "mantissa", "power", "num", "den", "common_unit").mapInArrow(_converted(id_col), f"`{id_col}` {kind}, common_unit string, common_value long").where("common_value is not null")


def unread_quantities(facts: DataFrame, common_units: DataFrame) -> DataFrame:
    """The quantities of facts that were not normalized, repeated deliveries once."""
    wanted = facts.where("value_kind = 'quantity' and value_normalized is null").select("fact_id", "value_json", "claim_text").dropDuplicates(["fact_id"])
    return to_common_units(wanted, common_units)
