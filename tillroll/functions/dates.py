"""Date and time parsing and parts (row-local)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.numeric import SENTINELS_DATE

# Date patterns, each with the text shape it needs.  Parsing is only tried on
# text of the right shape, so a failed parse (an exception inside the
# expression) is the exception, not the rule.
YMD = ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$")
DMY = ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$")
# Tried, in order, after year-month-day and day-month-year: a fixed,
# reproducible stand-in for free-form date guessing.
EXTRA_DATE_PATTERNS = [
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyy-M-d H:m", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$"),
    ("d-M-yyyy H:m:s", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("d-M-yyyy H:m", r"^\d{1,2}-\d{1,2}-\d{4} \d{1,2}:\d{1,2}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("d MMM yyyy", r"^\d{1,2} [a-z]{3} \d{4}$"),
    ("MMM d yyyy", r"^[a-z]{3} \d{1,2} \d{4}$"),
    ("MMM d, yyyy", r"^[a-z]{3} \d{1,2}, \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [a-z]+ \d{4}$"),
    ("MMMM d yyyy", r"^[a-z]+ \d{1,2} \d{4}$"),
    ("MMMM d, yyyy", r"^[a-z]+ \d{1,2}, \d{4}$"),
]
TIME_PATTERNS = [
    ("h:ma", r"^\d{1,2}:\d{1,2}(AM|PM)$"),
    ("H:m:s", r"^\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("H:m", r"^\d{1,2}:\d{1,2}$"),
]


def _anchored_union(shapes: Sequence[str]) -> str:
    """'^(?:a|b|c)$' from anchored shapes '^a$', '^b$', '^c$' (fails fast)."""
    return "^(?:" + "|".join(sh[1:-1] for sh in shapes) + ")$"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date(c: str | Column) -> Column:
    """``Y-m-d`` else ``d-m-Y`` else null (unpadded parts accepted,
    trailing text rejected).  Date/timestamp input is passed through."""
    c = _col(c)
    text = c.cast("string")
    typed = F.typeof(c).isin("date", "timestamp", "timestamp_ntz")
    return F.when(typed, c.try_cast("date")).otherwise(F.coalesce(*[
        F.when(text.rlike(shape), F.try_to_date(text, p)) for p, shape in (YMD, DMY)]))


def _lenient_text(text: Column) -> Column:
    """Lower, '/' -> '-', sentinels -> null."""
    s = F.translate(F.lower(text), "/", "-")
    return F.when(~s.isin(SENTINELS_DATE), s)


def _lenient_shape(extra_patterns: Sequence[tuple[str, str]]) -> str:
    """All shapes in one, as the text is written, before it is lowered and translated."""
    return "(?i)" + _anchored_union([shape for _, shape in (YMD, DMY, *extra_patterns)]).replace("-", "[-/]").replace("a[-/]z", "a-z")


def _lenient_date(s: Column, extra_patterns: Sequence[tuple[str, str]]) -> Column:
    tries = [F.when(s.rlike(shape), F.try_to_date(s, p)) for p, shape in (YMD, DMY)]
    tries += [F.when(s.rlike(shape), F.to_date(F.try_to_timestamp(s, F.lit(p))))
              for p, shape in extra_patterns]
    return F.coalesce(*tries)


def parse_date_lenient(c: str | Column,
                       extra_patterns: Sequence[tuple[str, str]] = tuple(EXTRA_DATE_PATTERNS)
                       ) -> Column:
    """Trim, lower, '/' -> '-', sentinels -> null, then T1, then the
    fixed ordered list of extra patterns."""
    text = F.trim(_col(c).cast("string"))
    # one combined shape test first: text that fits no pattern costs one regex
    return F.when(text.rlike(_lenient_shape(extra_patterns)), _lenient_date(_lenient_text(text), extra_patterns))


def reads_as_date(c: str | Column) -> Column:
    """Whether ``parse_date_lenient`` finds a date in a text.

    Every pattern ends with a digit, and begins with one or holds a blank, which
    rules out most other text without a regex.  The patterns are tried in a
    lambda: the text is lowered and translated once for all of them, and they
    stay out of the method generated for a caller's other expressions (one too
    long isn't compiled to machine code)."""
    text, digits = F.trim(_col(c)), list("0123456789")
    plausible = F.substring(text, -1, 1).isin(digits) & (F.substring(text, 1, 1).isin(digits) | F.contains(text, F.lit(" ")))
    s = F.when(text.rlike(_lenient_shape(EXTRA_DATE_PATTERNS)), _lenient_text(text))
    return F.when(plausible, F.exists(F.array(s), lambda x: _lenient_date(x, EXTRA_DATE_PATTERNS).isNotNull())).otherwise(False)


def _parts(c: str | Column) -> Column:
    return F.translate(F.trim(_col(c).cast("string")), "/", "-")


def layout_votes(df: DataFrame, columns: Sequence[str]) -> dict[str, bool]:
    """Whether the dates of each column have the month first, in one pass.
    Only values that can be read in one way vote, those with a first or second
    number above 12; without a majority for the month the day comes first."""
    def votes(c: str, part: int) -> Column:
        s = _parts(F.col(c))
        one, other = (F.split_part(s, F.lit("-"), F.lit(k)).try_cast("int") for k in (part, 3 - part))
        return F.count_if(F.when(s.rlike(DMY[1]), one.between(13, 31) & other.between(1, 12)))

    # a fixed number of counts reaches the driver
    row = df.agg(*[votes(c, part).alias(f"{i}_{part}") for i, c in enumerate(columns) for part in (1, 2)]).first()
    return {c: row[f"{i}_2"] > row[f"{i}_1"] for i, c in enumerate(columns)}


def parse_date_voted(c: str | Column, month_first: bool) -> Column:
    """A date of its column's layout; year-month-day, and what only the other
    layout can read, are read as they stand."""
    s = _parts(c)
    both = [F.when(s.rlike(DMY[1]), F.try_to_date(s, p)) for p in ("M-d-yyyy", DMY[0])]
    return F.coalesce(F.when(s.rlike(YMD[1]), F.try_to_date(s, YMD[0])), *(both if month_first else both[::-1]))


def _read_time(c: str | Column) -> Column:
    c = F.upper(F.trim(_col(c)))
    any_shape = _anchored_union([shape for _, shape in TIME_PATTERNS])
    return F.when(c.rlike(any_shape), F.coalesce(*[
        F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(p))) for p, shape in TIME_PATTERNS]))


def parse_time(c: str | Column) -> Column:
    """``h:mm am/pm`` else ``H:mm:ss`` else ``H:mm``, unpadded parts
    accepted; a time of day on the base day 1900-01-01 (TimestampNTZ)."""
    t = _read_time(c)
    return F.make_timestamp_ntz(F.lit(1900), F.lit(1), F.lit(1),
                                F.hour(t), F.minute(t), F.second(t))


def reads_as_time(c: str | Column) -> Column:
    """Whether ``parse_time`` finds a time in a text, without taking it apart."""
    text = F.array(_col(c))
    return F.when(F.contains(_col(c), F.lit(":")), F.exists(text, lambda x: _read_time(x).isNotNull())).otherwise(False)


def time_of_day(c: str | Column) -> Column:
    """T6: 'HH:mm:ss' text of a timestamp."""
    return F.date_format(_col(c), "HH:mm:ss")


def event_flag(c: str | Column, start: str, end: str) -> Column:
    """1 when start <= c <= end, else 0."""
    c = _col(c)
    return F.when((c >= F.lit(start).cast("date")) & (c <= F.lit(end).cast("date")), 1).otherwise(0)


def date_tokens(c: str | Column) -> Column:
    """Digit tokens of a raw date text split on space, '-' and '/', as a
    distinct array of ints (used by the run repair rules)."""
    parts = F.split(F.trim(F.regexp_replace(_col(c), "[ -]", "/")), "/")
    digits = F.filter(parts, lambda p: p.rlike(r"^\d+$"))
    return F.array_distinct(F.transform(digits, lambda p: p.try_cast("long")))
