"""Timestamps in mixed notations, normalised to epoch milliseconds with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and their common short forms, German and English.
MONTHS = {
    "jan": 1, "januar": 1, "jänner": 1, "january": 1, "feb": 2, "februar": 2, "february": 2, "mar": 3, "mär": 3, "mrz": 3,
    "märz": 3, "march": 3, "apr": 4, "april": 4, "mai": 5, "may": 5, "jun": 6, "juni": 6, "june": 6, "jul": 7, "juli": 7,
    "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "okt": 10, "oktober": 10,
    "october": 10, "nov": 11, "november": 11, "dec": 12, "dez": 12, "dezember": 12, "december": 12,
}
# Zone abbreviations and their offsets from UTC in minutes.
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "mez": 60, "cet": 60, "bst": 60, "west": 60, "mesz": 120, "cest": 120,
    "eet": 120, "eest": 180, "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420,
}

_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"(?:\s*(Z|(?:UTC|GMT|UT)?[+-]\d{1,2}(?::?\d{2})?|[A-Za-z]{2,5}))?(?:\s*(?:\[[A-Za-z_/+-]+\]|\([A-Za-z ]+\)))?"
_DAY = r"(?:[A-Za-zäöü]{2,10}\.?,?\s+)?"

#: Ordered cascade; each pattern is anchored and names which of its groups holds what.
PATTERNS: list[tuple[str, dict[str, int]]] = [
    (rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:T|\s+){_TIME}{_ZONE}$", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "z": 8}),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))?{_ZONE}$", {"y": 1, "mo": 2, "d": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "z": 8}),
    (rf"(?i)^{_DAY}(\d{{1,2}})\.?\s+({_NAMES})\.?\s+(\d{{4}}|\d{{2}}),?\s+(?:um\s+)?{_TIME}(?:\s*Uhr)?{_ZONE}$", {"d": 1, "mon": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "z": 8}),
    (rf"(?i)^{_DAY}(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}}),?\s+(?:um\s+)?{_TIME}(?:\s*Uhr)?{_ZONE}$", {"d": 1, "mo": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "z": 8}),
    (rf"(?i)^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}}),?\s+{_TIME}\s*([AP]M)?{_ZONE}$", {"mo": 1, "d": 2, "y": 3, "h": 4, "mi": 5, "s": 6, "f": 7, "ap": 8, "z": 9}),
]


def _parts(s: Column) -> Column:
    """The fields of the first pattern of the cascade that matches, as text; null when none does."""
    found = None
    for pattern, where in PATTERNS:
        get = lambda k, p=pattern, w=where: F.regexp_extract(s, p, w[k]) if k in w else F.lit("")
        fields = F.struct(*(get(k).alias(k) for k in ("y", "mo", "mon", "d", "h", "mi", "s", "f", "ap", "z")))
        found = F.when(s.rlike(pattern), fields) if found is None else found.when(s.rlike(pattern), fields)
    return found


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once: a lambda's variable isn't inlined at each of its uses."""
    return F.transform(F.array(value), body)[0]


def _int(c: Column) -> Column:
    return F.when(c == "", F.lit(0)).otherwise(c.try_cast("int"))


def _offset_minutes(z: Column) -> Column:
    """Minutes east of UTC; null for an empty, unknown or impossible zone."""
    low = F.lower(z)
    named = F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))
    shape = r"^(?:utc|gmt|ut)?([+-])(\d{1,2}):?(\d{2})?$"
    hours, minutes = _int(F.regexp_extract(low, shape, 2)), _int(F.regexp_extract(low, shape, 3))
    sign = F.when(F.regexp_extract(low, shape, 1) == "-", -1).otherwise(1)
    numeric = F.when((hours <= 14) & (minutes <= 59), sign * (hours * 60 + minutes))
    return F.when(low.rlike(shape), numeric).otherwise(F.try_element_at(named, low))


def normalize_timestamps(df: DataFrame, column: str, out: str = "utc_ms", default_zone: str | Column = "Europe/Berlin", ambiguous: str = "null", nonexistent: str = "null") -> DataFrame:
    """df with column `out`: the instant of the text in `column` as milliseconds since 1970 in UTC, rounded down.

    default_zone: the zone of a time without one, as a name or a column (a joined lookup by source).
    ambiguous: 'null', 'earlier' or 'later' for a local time that occurs twice; nonexistent: 'null' or 'shift' for one
    that is skipped (then moved on by the length of the gap).
    Null, empty, unreadable and impossible values, and dates without a time, give null. Rows are kept as they are,
    repeated ones included; an existing column named `out` is replaced.
    """
    zone = F.lit(default_zone) if isinstance(default_zone, str) else default_zone
    named = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))

    def fields(p: Column) -> Column:
        year = F.when(F.length(p["y"]) == 2, 2000 + _int(p["y"])).otherwise(_int(p["y"]))
        month = F.when(p["mon"] != "", F.try_element_at(named, F.lower(p["mon"]))).otherwise(_int(p["mo"]))
        half = F.when(_int(p["h"]).between(1, 12), _int(p["h"]) % 12 + F.when(F.upper(p["ap"]) == "PM", 12).otherwise(0))
        hour = F.when(p["ap"] == "", _int(p["h"])).otherwise(half)
        return F.struct(year.alias("y"), month.alias("mo"), _int(p["d"]).alias("d"), hour.alias("h"), _int(p["mi"]).alias("mi"), _int(p["s"]).alias("s"), F.rpad(F.substring(p["f"], 1, 3), 3, "0").cast("int").alias("ms"), p["z"].alias("z"), _offset_minutes(p["z"]).alias("off"))

    def local(x: Column) -> Column:
        leap = ((x["y"] % 4 == 0) & (x["y"] % 100 != 0)) | (x["y"] % 400 == 0)
        days = F.when(x["mo"] == 2, F.when(leap, 29).otherwise(28)).when(x["mo"].isin(4, 6, 9, 11), 30).otherwise(31)
        good = x["mo"].between(1, 12) & x["d"].between(1, 31) & (x["d"] <= days) & x["h"].between(0, 23) & x["mi"].between(0, 59) & x["s"].between(0, 59) & (x["y"] >= 1)
        return F.when(good, F.unix_date(F.make_date(x["y"], x["mo"], x["d"])).cast("long") * 86400 + x["h"] * 3600 + x["mi"] * 60 + x["s"])

    def wall(loc: Column) -> Column:
        back = lambda u: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(u), zone))

        def resolve(u: Column) -> Column:
            first, second = back(u - 3600) == loc, back(u + 3600) == loc
            none = F.lit(None).cast("long")
            repeated = {"null": none, "earlier": F.when(first, u - 3600).otherwise(u), "later": F.when(second, u + 3600).otherwise(u)}[ambiguous]
            return F.when(back(u) != loc, {"null": none, "shift": u}[nonexistent]).when(first | second, repeated).otherwise(u)

        return _let(F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(loc), zone)), resolve)

    def instant(x: Column) -> Column:
        seconds = lambda loc: F.when(x["z"] == "", wall(loc)).when(x["off"].isNotNull(), loc - x["off"] * 60)
        return _let(local(x), lambda loc: F.when(loc.isNotNull(), seconds(loc)) * 1000 + x["ms"])

    def read(s: Column) -> Column:
        epoch = F.when(s.rlike(r"^\d{9,10}$"), s.try_cast("long") * 1000).when(s.rlike(r"^\d{12,13}$"), s.try_cast("long")).when(s.rlike(r"^\d{15,16}$"), F.floor(s.try_cast("long") / 1000))
        return F.when(s.rlike(r"^\d+$"), epoch).otherwise(_let(_parts(s), lambda p: F.when(p.isNotNull(), _let(fields(p), instant))))

    text = F.trim(F.regexp_replace(F.col(column), r"[\s\u00a0\u2007\u202f]+", " "))
    return df.withColumn(out, _let(text, read).cast("long"))
