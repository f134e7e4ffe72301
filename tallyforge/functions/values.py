"""Numbers, dates, flags: tolerant coercions. Nothing here raises under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(38,2)"
AMOUNT = r"(?iU)(?<![\w:])(?:₹\s*|Rs\.?\s*|INR\s*)?(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?)(?![\w:])"
TIME = r"\d{1,2}:\d{2}(?::\d{2})?"
DMY = r"\b(\d{1,2})[\/\-.](\d{1,2})[\/\-.](\d{2,4})\b"
YMD = r"\b(\d{4})[\/\-.](\d{1,2})[\/\-.](\d{1,2})\b"
ISO = r"^\d{4}-\d{2}-\d{2}$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, inside array functions too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_float(c: Column, default: float | None = None) -> Column:
    """Finite double, else the default."""
    x = c.try_cast("double")
    ok = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return ok if default is None else F.coalesce(ok, F.lit(default))


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def bare_amount(c: Column) -> Column:
    """Text without currency marks, thousands commas and outer blanks."""
    return F.trim(F.replace(F.regexp_replace(F.trim(c), r"(?i)(?:₹|rs\.?|inr)", ""), F.lit(","), F.lit("")))


def parse_amount(c: Column) -> Column:
    """Non-negative finite double."""
    return let(bare_amount(c).try_cast("double"), amount)


def amount(x: Column) -> Column:
    """The number if it is non-negative and finite; no number is over infinity in Spark's order but NaN."""
    return F.when((x >= 0) & (x < float("inf")), x)


def money_half_up(c: Column) -> Column:
    """Exact money, half up; accounting parentheses and negatives are rejected."""
    return bare_money(bare_amount(c))


def bare_money(t: Column) -> Column:
    """Money of a text that ``bare_amount`` has cleaned."""
    x = t.try_cast("decimal(38,10)")
    return F.when((x >= 0) & ~(t.startswith("(") & t.endswith(")")), x.try_cast(MONEY))


def money_half_even(c: Column) -> Column:
    x = bare_amount(c).try_cast("decimal(38,10)")
    return F.bround(x, 2).try_cast(MONEY)


def to_bool(c: Column, default: bool | None = False) -> Column:
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "yes", "y", "1", "1.0"), True).when(t.isin("false", "no", "n", "0", "0.0"), False).otherwise(F.lit(default).cast("boolean"))


def to_count(c: Column, low: int = 0, high: int = 10_000) -> Column:
    """Integer-valued number in range, else null."""
    x = safe_float(c)
    return F.when((x == F.floor(x)) & x.between(low, high), x).cast("int")


def confidence(c: Column, digits: int = 4) -> Column:
    """Struct of value (clipped, rounded) and valid; null counts as a valid 0."""
    x = safe_float(c)
    valid = c.isNull() | (x.isNotNull() & x.between(0, 1))
    return F.struct(F.round(clip(F.coalesce(x, F.lit(0.0))), digits).alias("value"), valid.alias("valid"))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    """``yyyy-MM-dd`` of integer parts, two-digit years in this century; null if no calendar date of 1900 to 2100."""

    def made(parts: Column) -> Column:
        y, m, d = parts[0], parts[1], parts[2]
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        two = lambda n: F.lpad(n.cast("string"), 2, "0")
        return F.when(y.between(1900, 2100) & m.between(1, 12) & (d >= 1) & (d <= days), F.concat_ws("-", y.cast("string"), two(m), two(d)))

    return let(F.array(year, month, day), lambda p: let(F.array(F.when(p[0] < 100, p[0] + 2000).otherwise(p[0]), p[1], p[2]), made))


def first_date(c: Column) -> Column:
    """First day-first match if it is a date, else first year-first match if it is one."""
    part = lambda p, i: F.nullif(F.regexp_extract(c, p, i), F.lit("")).try_cast("int")
    return F.coalesce(iso_date(part(DMY, 3), part(DMY, 2), part(DMY, 1)), iso_date(part(YMD, 1), part(YMD, 2), part(YMD, 3)))


def date_in_order(c: Column, order: str = "DMY") -> Column:
    """Whole text as a date: year first, else day or month first as ordered; null if it is none."""
    t = F.trim(c)
    ymd, dmy = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$", r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})$"
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    known = calendar(part(ymd, 1), part(ymd, 2), part(ymd, 3))
    if order == "YMD":
        return known
    day, month = (1, 2) if order == "DMY" else (2, 1)
    year = part(dmy, 3)
    return F.coalesce(known, calendar(F.when(year < 100, year + 2000).otherwise(year), part(dmy, month), part(dmy, day)))


def calendar(year: Column, month: Column, day: Column) -> Column:
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(F.try_to_date(text, "yyyy-MM-dd").isNotNull(), text)


def date_problem(c: Column) -> Column:
    """Warning code of a date text, null if it is fine or missing."""
    return F.when(c.isNull(), None).when(~c.rlike(ISO), "date_format_invalid").when(F.try_to_date(c, "yyyy-MM-dd").isNull(), "date_invalid_calendar_value")


def replace_matches(c: Column, pattern: str, f) -> Column:
    """Every match of the pattern replaced by ``f(match)``."""
    found, pieces = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    rest = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))
    joined = F.array_join(F.zip_with(found, rest, lambda m, p: F.concat(f(m), F.coalesce(p, F.lit("")))), "")
    return F.when(F.size(found) > 0, F.concat(F.get(pieces, F.lit(0)), joined)).otherwise(c)


def normalize_dates(c: Column) -> Column:
    """Day-first, then year-first dates in a text to ISO; only day 1-31 and month 1-12 are checked."""
    dmy, ymd = r"\b(\d{1,2})([./\-])(\d{1,2})([./\-])(\d{2,4})\b", r"\b(\d{4})([./\-])(\d{1,2})([./\-])(\d{1,2})\b"

    def rewritten(pattern: str, at: tuple[int, int, int]):
        def f(m: Column) -> Column:
            y, mo, d = (F.regexp_extract(m, pattern, i).cast("int") for i in at)
            y = F.when(y < 100, y + 2000).otherwise(y)
            return F.when(d.between(1, 31) & mo.between(1, 12), F.format_string("%04d-%02d-%02d", y, mo, d)).otherwise(m)

        return f

    return replace_matches(replace_matches(c, dmy, rewritten(dmy, (5, 3, 1))), ymd, rewritten(ymd, (1, 3, 5)))


def amounts(line: Column, low: float = 0.0, high: float = 1_000_000.0) -> Column:
    """All amounts of a line in range, in order; a line that is only a time has none."""
    spaced = F.regexp_replace(line, r"(?<=\d)(?=[A-Za-z])", " ")
    none = F.array().cast("array<double>")

    def found(t: Column) -> Column:
        numbers = F.transform(F.regexp_extract_all(t, F.lit(AMOUNT), F.lit(1)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
        return F.when(F.trim(t).rlike(f"^{TIME}$"), none).otherwise(F.filter(numbers, lambda x: amount(x).between(low, high)))

    return F.when(line.rlike(r"(?U)\d"), let(spaced, found)).when(line.isNotNull(), none)


def tier(c: Column, medium: float = 0.90, low: float = 0.70) -> Column:
    return F.when(c >= medium, "high").when(c >= low, "medium").otherwise("low")


def codes(*pairs: tuple[Column, str]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.filter(F.array(*[F.when(cond, F.lit(code)) for cond, code in pairs]), lambda x: x.isNotNull())


def shown_confidence(c: Column) -> Column:
    """A confidence as shown: numbers over 1 are percentages, the result lies in 0..1; what is no finite number is null."""
    number = c.try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(finite > 1, finite / 100).otherwise(finite))) + finite * 0


def percent_text(c: Column) -> Column:
    """A shown confidence in per cent with one digit; a dash where there is none."""
    return F.coalesce(F.concat(F.call_function("format_number", shown_confidence(c) * 100, F.lit("0.0")), F.lit("%")), F.lit("\u2014"))


def money_text(c: Column) -> Column:
    """An amount with two digits, without grouping; a dash where it is no finite number."""
    number = c.try_cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    return F.coalesce(F.call_function("format_number", finite, F.lit("0.00")), F.lit("\u2014"))
