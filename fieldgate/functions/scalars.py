"""Money, numbers, dates and addresses as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FUZZY_THRESHOLD

# Abbreviations of streets and directions, and words that start a unit.
SUFFIXES = {
    "AVE": "AVENUE", "AV": "AVENUE", "AVEN": "AVENUE", "ST": "STREET", "STR": "STREET", "RD": "ROAD", "DR": "DRIVE", "DRV": "DRIVE", "LN": "LANE", "CT": "COURT", "BLVD": "BOULEVARD", "BLV": "BOULEVARD",
    "PKWY": "PARKWAY", "PKY": "PARKWAY", "PARKWY": "PARKWAY", "HWY": "HIGHWAY", "PL": "PLACE", "TER": "TERRACE", "TERR": "TERRACE", "CIR": "CIRCLE", "TRL": "TRAIL", "PLZ": "PLAZA", "SQ": "SQUARE", "EXPY": "EXPRESSWAY", "LP": "LOOP",
}
DIRECTIONS = {"N": "NORTH", "S": "SOUTH", "E": "EAST", "W": "WEST", "NE": "NORTHEAST", "NW": "NORTHWEST", "SE": "SOUTHEAST", "SW": "SOUTHWEST"}
UNITS = ["SUITE", "STE", "UNIT", "APT", "APARTMENT", "FLOOR", "FL", "RM", "ROOM", "BLDG", "BUILDING", "DEPT"]


def trim(c: Column) -> Column:
    """All white space, not just spaces."""
    return F.regexp_replace(c, "\\A[\\s\\u00a0]+|[\\s\\u00a0]+\\z", "")


def half_up(c: Column, places: int = 0) -> Column:
    """Halves towards positive infinity."""
    scale = F.lit(float(10**places))
    return F.floor(c * scale + 0.5) / scale


def strict_currency(c: Column) -> Column:
    s = trim(c)
    return F.when(s.rlike("\\A\\$\\d{1,3}(,\\d{3})*\\z"), F.regexp_replace(s, "[$,]", "").try_cast("bigint"))


def loose_currency(c: Column) -> Column:
    pattern = "\\A(?i)\\$?\\s*(\\d+(?:,\\d{3})*(?:\\.\\d+)?)\\s*([KMB])?\\z"

    def of(s: Column) -> Column:
        base = F.regexp_replace(F.regexp_extract(s, pattern, 1), ",", "").try_cast("double")
        unit = F.upper(F.substring(s, -1, 1))
        scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
        return F.when(s.rlike(pattern), F.floor(base * scale + 0.5).cast("bigint"))

    return F.get(F.transform(F.array(trim(c)), of), F.lit(0))


def currency(c: Column, mode: str) -> Column:
    return strict_currency(c) if mode == "strict" else loose_currency(c)


def format_usd(c: Column) -> Column:
    x = c.cast("double")
    text = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.floor(F.abs(x) + 0.5), 0))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), "--").otherwise(text)


def format_usd_compact(c: Column) -> Column:
    x = c.cast("double")
    size, sign = F.abs(x), F.when(x < 0, "-").otherwise("")
    short = lambda scale, form: F.concat(sign, F.format_string(f"$%{form}", size / scale))
    return (
        F.when(x.isNull() | F.isnan(x) | (size == float("inf")), "--")
        .when(size >= 1e9, short(1e9, ".2fB"))
        .when(size >= 1e6, short(1e6, ".1fM"))
        .when(size >= 1e3, short(1e3, ".1fK"))
        .otherwise(format_usd(c))
    )


def tokens(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("bigint")


def model_number(c: Column) -> Column:
    """A number in a model's answer: currency signs, commas and white space go; what is no finite number is null."""
    x = F.nullif(F.regexp_replace(c.cast("string"), "[$,\\s]", ""), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def model_text(c: Column) -> Column:
    return F.nullif(trim(c.cast("string")), F.lit(""))


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def cost_text(c: Column) -> Column:
    return F.format_string("$%.4f", c)


def iso_date(c: Column) -> Column:
    """A real date written yyyy-MM-dd; anything else is null."""
    s = trim(c)
    return F.when(s.rlike("\\A\\d{4}-\\d{2}-\\d{2}\\z"), F.try_to_date(s, "yyyy-MM-dd"))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)


def months_between(a: Column, b: Column) -> Column:
    """Calendar months plus the days' difference over 30.44."""
    return (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a)) + (F.day(b) - F.day(a)) / F.lit(30.44)


def format_date(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("--"))


def normalize_address(c: Column) -> Column:
    s = F.upper(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, "#", " UNIT ")
    s = F.regexp_replace(s, "[.,;:'\"()\\-/\\\\]", " ")
    s = F.trim(F.regexp_replace(s, "\\s+", " "))
    for unit in UNITS:
        s = F.regexp_replace(s, f"\\b{unit}\\b\\s*[A-Z0-9-]*", " ")
    words = F.array_remove(F.split(s, " +"), "")
    table = F.create_map(*(F.lit(x) for pair in (SUFFIXES | DIRECTIONS).items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def street_token(c: Column) -> Column:
    """The longest word of a normalised address that tells it from others, the first of equals."""
    common = sorted({*SUFFIXES, *SUFFIXES.values(), *DIRECTIONS, *DIRECTIONS.values()})
    words = F.filter(F.split(normalize_address(c), " "), lambda w: (F.length(w) >= 4) & ~w.rlike("\\A\\d") & ~w.isin(common))
    return F.aggregate(words, F.lit(None).cast("string"), lambda a, w: F.when(a.isNull() | (F.length(w) > F.length(a)), w).otherwise(a))


def location_key(address: Column, zip: Column) -> Column:
    return F.concat(normalize_address(address), F.lit("|"), trim(F.coalesce(zip, F.lit(""))))


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def match_prepared(raw_a: Column, norm_a: Column, zip_a: Column, raw_b: Column, norm_b: Column, zip_b: Column, fuzzy: bool, threshold: float = FUZZY_THRESHOLD) -> Column:
    """struct(match, score, basis) of two addresses in trimmed upper case, their normal forms and zips; none of them null."""
    result = lambda match, score, basis: F.struct(F.lit(match).alias("match"), score.cast("double").alias("score"), F.lit(basis).alias("basis"))
    none = result(False, F.lit(0.0), "none")
    out = F.when((raw_a != "") & (raw_a == raw_b) & (zip_a == zip_b), result(True, F.lit(1.0), "exact-raw"))
    if not fuzzy:
        return out.otherwise(none)
    close = similarity(norm_a, norm_b)
    return (
        out.when((norm_a == "") | (norm_b == ""), none)
        .when((norm_a == norm_b) & (zip_a == zip_b), result(True, F.lit(1.0), "exact-normalized"))
        .when((zip_a != "") & (zip_a == zip_b), F.when(close >= threshold, result(True, close, "fuzzy")).otherwise(result(False, close, "none")))
        .otherwise(none)
    )


def raw_address(c: Column) -> Column:
    return F.upper(trim(F.coalesce(c, F.lit(""))))


def match_addresses(address_a: Column, zip_a: Column, address_b: Column, zip_b: Column, fuzzy: bool = False, threshold: float = FUZZY_THRESHOLD) -> Column:
    clean = lambda z: trim(F.coalesce(z.cast("string"), F.lit("")))
    return match_prepared(raw_address(address_a), normalize_address(address_a), clean(zip_a), raw_address(address_b), normalize_address(address_b), clean(zip_b), fuzzy, threshold)
