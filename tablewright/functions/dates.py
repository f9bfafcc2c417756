"""Date and time tests on text, and parsing."""

from __future__ import annotations

import re
from math import pi

from pyspark.sql import Column, functions as F

# The eleven whole-value date patterns.
WHOLE_PATTERNS = [
    r"^\d{4}-\d{1,2}-\d{1,2}$",
    r"^\d{4}/\d{1,2}/\d{1,2}$",
    r"^\d{4}\.\d{1,2}\.\d{1,2}$",
    r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}(:\d{1,2})?$",
    r"^\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{1,2}(:\d{1,2})?$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{8}$",
    r"^\d{1,2}:\d{1,2}(:\d{1,2})?$",
    r"^\d{1,2}/\d{1,2}/\d{4}$",
    r"^\d{4}년\s*\d{1,2}월\s*\d{1,2}일$",
]

# The eight leading date patterns.
LEADING_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{4}/\d{2}/\d{2}",
    r"\d{2}/\d{2}/\d{2}",
    r"\d{8}",
    r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
    r"\d{2}:\d{2}:\d{2}",
]

# Column-name words that mark a date column.
DATE_WORDS = ["date", "time", "dt", "datetime", "timestamp", "created", "updated"]
SERIES_WORDS = ["date", "time", "datetime", "timestamp"]

# Formats tried in order; the first that parses wins.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd",
           "MM/dd/yyyy", "dd-MM-yyyy", "yyyyMMdd", "yyyy'년' MM'월' dd'일'"]


def _any(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def matches_datetime(c: Column) -> Column:
    """The trimmed value is wholly a date, date-time or time."""
    return F.trim(c).rlike(_any(WHOLE_PATTERNS))


def matches_datetime_prefix(c: Column) -> Column:
    """The trimmed value starts with a date or time."""
    return F.trim(c).rlike("^(?:" + "|".join(LEADING_PATTERNS) + ")")


def _shape(form: str) -> str:
    """What any text of the format looks like: fields are digits, all else stands as it is."""
    parts = re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z']+)", form)
    return r"^[+-]?" + "".join(r"[0-9]+" if field else re.escape(quoted or literal) for quoted, field, literal in parts) + "$"


def parse_datetime(c: Column) -> Column:
    """Timestamp without zone; text no format fits gives null. Formats are tried on texts of their shape only: a failed
    attempt costs a hundred times the comparison."""
    text = F.trim(c)
    tried = [F.when(text.rlike(_shape(f)), F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz")) for f in FORMATS]
    return F.when(text.rlike("^[+-]?[0-9]"), F.coalesce(*tried))


def season(month: Column) -> Column:
    return (F.when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer")
            .when(month.isin(9, 10, 11), "autumn").otherwise("winter"))


def datetime_parts(t: Column) -> dict[str, Column]:
    """year, month, day, hour, weekday (Monday 0), quarter, is_weekend, season."""
    return {"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "weekday": F.weekday(t),
            "quarter": F.quarter(t), "is_weekend": F.weekday(t) >= 5, "season": season(F.month(t))}


PERIODS = {"hour": 24, "day": 31, "month": 12, "weekday": 7}


def cyclical_encode(part: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a repeating part."""
    angle = F.lit(2 * pi) * part.cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)
