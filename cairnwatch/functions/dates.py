"""Dates in the forms that catalogues use, as ISO text, by Column functions alone.

A text is cut into numbers and words. Times, weekdays, ordinals and joining words go; a month
name is the month; the other numbers are put in order by the rules of common flexible parsers:
a number above 31 is the year, month comes before day unless it is above 12, and years of two
digits lie within fifty years of today. What a text lacks is taken from `today`, the day no
further than its month's last. Anything else is ''.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names by number, and words without meaning for a date.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
JOINING = ["at", "on", "and", "ad", "of", "t", "m"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
_TIME = r"(?:(?<=\d)t|\s|^)\s*\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:[ap]\.?m\b\.?)?\s*(?:z\b|utc\b|gmt\b)?\s*(?:[+-]\d{2}:?\d{2})?"


def _month_numbers() -> dict[str, int]:
    names = {n: i + 1 for i, n in enumerate(MONTHS)}
    return names | {n[:3]: i for n, i in names.items()} | {"sept": 9}


def flexible_date(c: Column, today: Column | None = None) -> Column:
    """The date of a text as yyyy-MM-dd; '' for null, blank or unreadable texts.

    ISO dates stay as they are and month/day/year is turned, even where no such day exists.
    """
    today = F.current_date() if today is None else today
    text = F.trim(F.coalesce(c, F.lit("")))
    turned = F.split(text, "/")
    american = F.concat_ws("-", turned[2], F.lpad(turned[0], 2, "0"), F.lpad(turned[1], 2, "0"))
    return F.when(text == "", "").when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), american).otherwise(F.coalesce(_parsed(text, today), F.lit("")))


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body(c) with c computed once: expressions are trees, in which a part used often would stand often."""
    return F.get(F.transform(F.array(c), body), 0)


def _parsed(text: Column, today: Column) -> Column:
    low = F.regexp_replace(F.lower(text), _TIME, " ")
    low = F.regexp_replace(low, r"(?<=\d)t(?=\s|$)", " ")
    low = F.regexp_replace(low, r"(?<=\d)(?:st|nd|rd|th)\b", " ")
    days = "|".join(f"{d}|{d[:3]}" for d in WEEKDAYS) + "|tues|thur|thurs"
    low = F.regexp_replace(low, rf"\b(?:{days}|{'|'.join(JOINING)})\b", " ")
    # Whole stamps without separators: yyyymmdd, with or without a time, and yymmdd.
    low = F.regexp_replace(low, r"\b(\d{4})(\d{2})(\d{2})(?:\d{4}(?:\d{2})?)?\b", "$1 $2 $3")
    low = F.regexp_replace(low, r"^\s*(\d{2})(\d{2})(\d{2})\s*$", "$1 $2 $3")
    return _let(low, lambda t: F.when(F.trim(t) == "", F.when(text.contains(":"), F.date_format(today, "yyyy-MM-dd"))).when(~t.rlike(r"[^a-z0-9\s.,;/'-]"), _let(F.regexp_extract_all(t, F.lit(r"[a-z]+|\d+"), 0), lambda tokens: _of_tokens(tokens, today))))


def _of_tokens(tokens: Column, today: Column) -> Column:
    numbers = _month_numbers()
    months = F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv])
    # Of each token its value, 0 for a word that is no month, whether it is a month, and whether it can only be a year.
    part = lambda t: _let(F.coalesce(F.try_element_at(months, t), t.try_cast("int"), F.lit(0)), lambda v: F.struct(v.alias("v"), t.rlike("^[a-z]").alias("m"), (~t.rlike("^[a-z]") & ((v > 31) | (F.length(t) > 2))).alias("y"), (F.length(t) > 2).alias("w")))
    return F.when(F.size(tokens).between(1, 3) & ~F.exists(tokens, lambda t: (F.length(t) > 4) & ~t.rlike("^[a-z]")), _let(F.transform(tokens, part), lambda got: _let(_order(got), lambda o: _dated(got, o, today))))


#: Places of year, month and day among one, two or three parts; -1 where there is none.
_PLACES = {"ymd": (0, 1, 2), "ydm": (0, 2, 1), "mdy": (2, 0, 1), "dmy": (2, 1, 0), "myd": (1, 0, 2), "dym": (1, 2, 0), "ym": (0, 1, -1), "my": (1, 0, -1), "md": (-1, 0, 1), "dm": (-1, 1, 0), "y": (0, -1, -1), "m": (-1, 0, -1), "d": (-1, -1, 0)}


def _order(got: Column) -> Column:
    """The order of the parts, as letters."""
    month = lambda i: F.coalesce(F.get(got, i)["m"], F.lit(False))
    year = lambda i: F.get(got, i)["y"]
    n = F.size(got)
    three = F.when(month(0), F.when(year(1), "myd").otherwise("mdy")).when(month(1), F.when(year(0), "ymd").otherwise("dmy")).when(month(2), F.when(year(1), "dym").otherwise("ydm"))
    three = three.when(year(0), "ymd").when(F.get(got, 0)["v"] > 12, "dmy").otherwise("mdy")
    two = F.when(month(0), F.when(year(1), "my").otherwise("md")).when(month(1), F.when(year(0), "ym").otherwise("dm")).when(year(0), "ym").when(year(1), "my").otherwise("md")
    one = F.when(month(0), "m").when(year(0), "y").otherwise("d")
    return F.when(n == 3, three).when(n == 2, two).otherwise(one)


def _dated(got: Column, order: Column, today: Column) -> Column:
    places = F.create_map(*[x for o, p in _PLACES.items() for x in (F.lit(o), F.array(*map(F.lit, p)))])
    taken = _let(places[order], lambda p: F.transform(p, lambda i: F.when(i >= 0, F.get(got, i))))
    now = F.year(today)

    def whole(ymd: Column) -> Column:
        y, m, d = (F.get(ymd, i) for i in range(3))
        near = y["v"] + now - now % 100
        near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
        year = F.when(y.isNull(), now).when((y["v"] < 100) & ~y["w"], near).otherwise(y["v"])
        month = F.when(m.isNull(), F.month(today)).otherwise(m["v"])
        first = F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lit("01")), "yyyy-MM-dd")
        odd = F.exists(ymd, lambda x: x["m"] & (x["v"] == 0)) | y["m"] | d["m"]
        return _let(F.when(~F.coalesce(odd, F.lit(False)), first), lambda f: _let(F.when(d.isNull(), F.least(F.dayofmonth(today), F.dayofmonth(F.last_day(f)))).otherwise(d["v"]), lambda day: F.when((day >= 1) & (day <= F.dayofmonth(F.last_day(f))), F.date_format(F.date_add(f, day - 1), "yyyy-MM-dd"))))

    return _let(taken, whole)
