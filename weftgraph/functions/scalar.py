"""Scalar functions of property-graph queries as Column functions.

They follow graph-query semantics where Spark's differ: nulls in, nulls out; blanks of every kind are trimmed; substring
counts from 0; ceil and floor give doubles; casts give null for what they can't parse; ranges that run backwards are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Value = Column | str | int | float | bool | None

_BLANKS = r"\s"


def lit(value: Value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_BLANKS}+|{_BLANKS}+$", "")


def ltrim(s: Column) -> Column:
    return F.regexp_replace(s, rf"^{_BLANKS}+", "")


def rtrim(s: Column) -> Column:
    return F.regexp_replace(s, rf"{_BLANKS}+$", "")


def substring(s: Column, start: Value, length: Value | None = None) -> Column:
    """From the 0-based start; to the end without a length."""
    return F.substring(s, lit(start) + 1, lit(length) if length is not None else F.length(s))


def left(s: Column, n: Value) -> Column:
    return F.left(s, lit(n))


def right(s: Column, n: Value) -> Column:
    return F.right(s, lit(n))


def split(s: Column, delimiter: str) -> Column:
    """Split at a plain string, not at a pattern."""
    return F.split(s, "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E")


def matches(s: Column, pattern: str) -> Column:
    """True if the whole string matches."""
    return s.rlike(rf"\A(?:{pattern})\z")


def ceil(x: Column) -> Column:
    return F.ceil(x).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x).cast("double")


def round_half_up(x: Column, digits: int | None = None) -> Column:
    """Ties towards plus infinity without digits, away from zero with."""
    return F.floor(x.cast("double") + 0.5).cast("double") if digits is None else F.round(x, digits)


def to_integer(x: Column) -> Column:
    """Through double, so that '3.7' is 3; null if it isn't a number."""
    return x.cast("string").try_cast("double").try_cast("bigint")


def to_float(x: Column) -> Column:
    return x.cast("string").try_cast("double")


def to_boolean(x: Column) -> Column:
    text = F.lower(trim(x.cast("string")))
    return F.when(text == "true", True).when(text == "false", False)


def size(x: Column, is_text: bool = False) -> Column:
    """Elements of a list, characters of a text."""
    return (F.length(x) if is_text else F.when(x.isNotNull(), F.size(x))).cast("long")


def head(xs: Column) -> Column:
    return F.get(xs, 0)


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def tail(xs: Column) -> Column:
    return F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))


def item(xs: Column, index: Value) -> Column:
    """0-based, negative from the end, null outside."""
    i = lit(index)
    return F.when(i >= 0, F.get(xs, i)).otherwise(F.try_element_at(xs, F.when(i < 0, i).otherwise(-1).cast("int")))


def slice_list(xs: Column, start: Value | None = None, stop: Value | None = None) -> Column:
    """xs[start..stop], 0-based, stop excluded; negative bounds count from the end, both are clamped."""
    n = F.size(xs)

    def bound(v: Value | None, default: Column) -> Column:
        if v is None:
            return default
        v = lit(v)
        return F.least(F.greatest(F.when(v < 0, n + v).otherwise(v), F.lit(0)), n)

    a, b = bound(start, F.lit(0)), bound(stop, n)
    return F.slice(xs, a + 1, F.greatest(b - a, F.lit(0)))


def range_list(first: Value, final: Value, step: int = 1) -> Column:
    """Both ends included; empty if the step leads away from the end."""
    a, b = lit(first).cast("long"), lit(final).cast("long")
    forward = b >= a if step > 0 else b <= a
    empty = F.array().cast("array<bigint>")
    return F.when(forward, F.sequence(a, F.when(forward, b).otherwise(a), F.lit(step).cast("long"))).otherwise(empty)


def in_list(x: Column, xs: Column) -> Column:
    """Three-valued: null if x is null or is not found beside a null."""
    return F.exists(xs, lambda v: v == x)


def all_in(xs: Column, test: Callable[[Column], Column]) -> Column:
    return F.forall(xs, test)


def any_in(xs: Column, test: Callable[[Column], Column]) -> Column:
    return F.exists(xs, test)


def none_in(xs: Column, test: Callable[[Column], Column]) -> Column:
    return ~F.exists(xs, test)


def single_in(xs: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(xs, test)) == 1


def reduce_list(xs: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """kind: the type of the result, to which start is cast."""
    return F.aggregate(xs, start.cast(kind), lambda acc, x: step(acc, x).cast(kind))


def comprehension(xs: Column, keep: Callable[[Column], Column] | None = None, make: Callable[[Column], Column] | None = None) -> Column:
    kept = F.filter(xs, keep) if keep else xs
    return F.transform(kept, make) if make else kept


def integer_divide(a: Column, b: Column) -> Column:
    """Towards zero; by zero: null."""
    return F.call_function("div", a, F.when(b != 0, b))


def xor(a: Column, b: Column) -> Column:
    return (a | b) & ~(a & b)


def date(value: Column | None = None) -> Column:
    return F.current_date() if value is None else F.to_date(value)


def datetime(value: Column | None = None) -> Column:
    return F.current_timestamp() if value is None else F.to_timestamp(value)


def local_datetime(value: Column | None = None) -> Column:
    return (F.current_timestamp() if value is None else value).cast("timestamp_ntz")


def local_time(value: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if value is None else value, "HH:mm:ss.SSS")


def date_of(parts: dict[str, Value]) -> Column:
    """date({year, month, day}), or {year, week, dayOfWeek}, {year, ordinalDay}; what is missing is the first. A date that
    does not exist is null."""
    year = lit(parts["year"]).cast("int")
    if "week" in parts:
        monday = F.date_trunc("week", F.make_date(year, lit(1), lit(4))).cast("date")
        return F.date_add(monday, ((lit(parts["week"]) - 1) * 7 + lit(parts.get("dayOfWeek", 1)) - 1).cast("int"))
    if "ordinalDay" in parts:
        return F.date_add(F.make_date(year, lit(1), lit(1)), (lit(parts["ordinalDay"]) - 1).cast("int"))
    made = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), *[F.lpad(lit(parts.get(p, 1)).cast("string"), 2, "0") for p in ("month", "day")])
    return F.try_to_date(made, "yyyy-MM-dd") if hasattr(F, "try_to_date") else F.try_to_timestamp(made, lit("yyyy-MM-dd")).cast("date")


def datetime_of(parts: dict[str, Value]) -> Column:
    """datetime({year, month, day, hour, minute, second, millisecond}), in the session's zone."""
    at = lambda p, unit: lit(parts.get(p, 0)).cast("double") * unit
    seconds = at("hour", 3600) + at("minute", 60) + at("second", 1) + at("millisecond", 0.001)
    return date_of(parts).cast("timestamp") + F.make_interval(secs=seconds)


def time_of(parts: dict[str, Value]) -> Column:
    """A time of day as an interval from midnight, which orders, adds and subtracts."""
    at = lambda p, unit: lit(parts.get(p, 0)).cast("double") * unit
    return F.make_dt_interval(lit(0), lit(0), lit(0), at("hour", 3600) + at("minute", 60) + at("second", 1) + at("millisecond", 0.001))


def time_of_day(value: Column) -> Column:
    """The time of day of a timestamp, as time_of() has it."""
    return F.make_dt_interval(lit(0), lit(0), lit(0), F.hour(value) * 3600 + F.minute(value) * 60 + F.date_part(lit("second"), value))


#: The parts of an ISO 8601 duration, in order.
_ISO_PARTS = (("years", "Y"), ("months", "M"), ("weeks", "W"), ("days", "D"), ("hours", "H"), ("mins", "M"), ("secs", "S"))
_ISO = r"^(-)?P(?:(-?\d+)Y)?(?:(-?\d+)M)?(?:(-?\d+)W)?(?:(-?\d+)D)?(?:T(?:(-?\d+)H)?(?:(-?\d+)M)?(?:(-?\d+(?:\.\d+)?)S)?)?$"


def duration_from(text: Column) -> Column:
    """duration('P1Y2M10DT2H30M1.5S') as an interval; null for another text, as for one without any part."""
    sign = F.when(F.regexp_extract(text, _ISO, 1) == "-", -1).otherwise(1)
    part = lambda i, kind: F.coalesce(F.nullif(F.regexp_extract(text, _ISO, i + 2), lit("")).cast(kind), lit(0).cast(kind)) * sign
    made = F.make_interval(**{name: part(i, "decimal(18,6)" if name == "secs" else "int") for i, (name, _) in enumerate(_ISO_PARTS)})
    return F.when(text.rlike(_ISO) & ~text.rlike("^-?PT?$|T$"), made)


def duration_of(parts: dict[str, Value]) -> Column:
    """duration({years, months, weeks, days, hours, minutes, seconds})."""
    names = {"minutes": "mins", "seconds": "secs"}
    return F.make_interval(**{names.get(k, k): lit(x) for k, x in parts.items()})


def timestamp() -> Column:
    """Milliseconds since 1970."""
    return F.unix_millis(F.current_timestamp())


def duration(months: Value = 0, days: Value = 0, seconds: Value = 0) -> Column:
    return F.make_interval(months=lit(months), days=lit(days), secs=lit(seconds))


def point(x: Value, y: Value) -> Column:
    return F.struct(lit(x).cast("double").alias("x"), lit(y).cast("double").alias("y"))


def geo_point(longitude: Value, latitude: Value) -> Column:
    return F.struct(lit(longitude).cast("double").alias("longitude"), lit(latitude).cast("double").alias("latitude"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean, of points."""
    return F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2)


def geo_distance(a: Column, b: Column, radius: float = 6_371_009.0) -> Column:
    """Metres on a sphere, of geo points."""
    la, lb = F.radians(a["latitude"]), F.radians(b["latitude"])
    half = F.sin((lb - la) / 2) ** 2 + F.cos(la) * F.cos(lb) * F.sin(F.radians(b["longitude"] - a["longitude"]) / 2) ** 2
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(half)))


#: Name in graph queries -> Column function, for the ones that need no wrapper above as well.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "toLower": F.lower,
    "toUpper": F.upper,
    "trim": trim,
    "ltrim": ltrim,
    "rtrim": rtrim,
    "replace": lambda s, a, b: F.replace(s, lit(a), lit(b)),
    "substring": substring,
    "left": left,
    "right": right,
    "split": split,
    "reverse": F.reverse,
    "toString": lambda x: x.cast("string"),
    "abs": F.abs,
    "ceil": ceil,
    "floor": floor,
    "sign": F.signum,
    "round": round_half_up,
    "rand": F.rand,
    "toInteger": to_integer,
    "toFloat": to_float,
    "toBoolean": to_boolean,
    "sqrt": F.sqrt,
    "exp": F.exp,
    "log": F.ln,
    "log10": F.log10,
    "e": F.e,
    "pi": F.pi,
    "sin": F.sin,
    "cos": F.cos,
    "tan": F.tan,
    "asin": F.asin,
    "acos": F.acos,
    "atan": F.atan,
    "atan2": F.atan2,
    "radians": F.radians,
    "degrees": F.degrees,
    "size": size,
    "length": size,
    "head": head,
    "tail": tail,
    "last": last,
    "range": range_list,
    "coalesce": F.coalesce,
    "exists": lambda x: x.isNotNull(),
    "randomUUID": F.uuid,
    "timestamp": timestamp,
    "date": date,
    "datetime": datetime,
    "localdatetime": local_datetime,
    "time": local_time,
    "localtime": local_time,
    "duration": duration,
    "duration_from": duration_from,
    "duration_of": duration_of,
    "date_of": date_of,
    "datetime_of": datetime_of,
    "time_of": time_of,
    "time_of_day": time_of_day,
    "point": point,
    "distance": distance,
    "geo_distance": geo_distance,
}
