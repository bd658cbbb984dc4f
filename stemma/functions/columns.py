"""Column functions: lenient dates and numbers, ISO time, files, matrices and date shifts."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from stemma.errors import QuestionError

_DATES = ("%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d", "%d-%m-%Y", "%Y/%m/%d", "%d.%m.%Y")


def parse_date(text: str | datetime.datetime) -> datetime.datetime:
    """ISO dates and times, and day-month-year; times with a zone become UTC."""
    if isinstance(text, datetime.datetime):
        return text
    for form in _DATES:
        try:
            found = datetime.datetime.strptime(str(text), form)
        except ValueError:
            continue
        return found.astimezone(datetime.timezone.utc).replace(tzinfo=None) if found.tzinfo else found
    raise QuestionError(f"{text} is not a date")


def to_number(value) -> float:
    """The number that a text starts with, else 0."""
    if isinstance(value, (int, float)):
        return float(value)
    found = re.match(r"\s*[+-]?(\d+(\.\d+)?|\.\d+)([eE][+-]?\d+)?", str(value))
    return float(found[0]) if found else 0.0


def to_integer(value) -> int | float:
    """``to_number``, exact for whole numbers of 64 bits."""
    whole = value if isinstance(value, int) else int(value) if re.match(r"\s*[+-]?\d+\s*\Z", str(value)) else None
    if whole is None and (v := to_number(value)).is_integer():
        whole = int(v)
    return float(whole) if whole is not None and abs(whole) >= 2**63 else to_number(value) if whole is None else whole


def iso_time(c: Column) -> Column:
    return F.date_format(c.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def numeric_text(c: Column) -> Column:
    """The number that a text is: digits, perhaps with a fraction; else null."""
    return F.when(c.rlike(r"\A\d+(\.\d+)?\z"), c.try_cast("double"))


def matrix_row(c: Column, width: int) -> Column:
    """A row, or as many nulls; its numbers keep the type in which they are stored."""
    return F.coalesce(c, F.array_repeat(F.lit(None), width))


def matrix_slice(c: Column, options: Sequence[str], names: Sequence[str]) -> Column:
    if not names or (wrong := [n for n in names if n not in options]):
        raise QuestionError("Invalid slice for matrix: " + (", ".join(map(str, wrong)) if names else "no columns"))
    return F.array(*(F.get(c, F.lit(list(options).index(n))) for n in names))


def hmac_sha256(key: str, message: Column) -> Column:
    """Hexadecimal, lower case."""
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in raw)) for x in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def shift_days(root_id: Column, salt: str) -> Column:
    """Whole days, 0 to 364: the HMAC of a root record's identifier as a fraction of 2^256, times 365, cut off."""
    top = F.conv(F.substring(hmac_sha256(salt, root_id.cast("string")), 1, 13), 16, 10).cast("double")
    return F.floor(top / F.lit(float(2**52)) * 365).cast("int")


def shifted(time: Column, root_id: Column, salt: str) -> Column:
    """``time`` moved back by the root record's days; null without a root record."""
    return (time.cast("timestamp_ntz") - F.make_dt_interval(shift_days(root_id, salt))).cast("timestamp_ntz")
