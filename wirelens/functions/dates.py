"""Dates of feeds, listings and pages. The present is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirelens.functions.text import extract, fold, matches, path, squeeze

#: Russian month names in the genitive, as dates use them.
MONTHS = ("января", "февраля", "марта", "апреля", "мая", "июня", "июля", "августа", "сентября", "октября", "ноября", "декабря")
#: The same in the nominative, as headings use them.
MONTHS_ALONE = ("январь", "февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь")


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def month_number(name: Column) -> Column:
    return F.try_element_at(_map({m: i for i, m in enumerate(MONTHS, 1)}), name)


def month_name(number: Column, names: tuple[str, ...] = MONTHS) -> Column:
    return F.try_element_at(_map(dict(enumerate(names, 1))), number)


def rfc822(text: Column) -> Column:
    """Timestamp of a feed's date like 'Fri, 21 Aug 2026 10:05:00 GMT'; null if it is none."""
    bare = squeeze(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""))
    short = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss[ z][ Z]"))
    return F.coalesce(short, F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm[ z][ Z]")))


def iso(text: Column) -> Column:
    """Timestamp of an ISO date, one without a zone in the session's; null if it is none."""
    return text.try_cast("timestamp")


def _at(year: Column, month: Column, day: Column, hour: Column, minute: Column, zone: Column) -> Column:
    return F.try_make_timestamp(year, month, day, hour, minute, F.lit(0), zone)


def _number(text: Column, pattern: str, group: int) -> Column:
    return extract(text, pattern, group).try_cast("int")


def publication_date(text: Column, zone: Column, now: Column) -> Column:
    """Timestamp of a listing's date in the source's zone; null if it is none.

    Today, yesterday and the day before with a time; minutes or hours ago; dd.mm.yyyy; day, month and year with or
    without a time; day and month, of the last year if they would be more than a week ahead.
    """
    t = fold(squeeze(text))
    local = F.from_utc_timestamp(now, zone)
    relative, ago = r"^(сегодня|вчера|позавчера),?\s+(?:в\s+)?(\d{1,2}):(\d{2})$", r"^(\d+)\s+(минут|час)\w*\s+назад$"
    dotted, full = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})$", r"^(\d{1,2})\s+([а-яё]+),?\s+(\d{4})(?:,?\s+(\d{1,2}):(\d{2}))?$"
    short = r"^(\d{1,2})\s+([а-яё]+)(?:\s+в)?(?:\s+(\d{1,2}):(\d{2}))?$"

    back = F.try_element_at(_map({"сегодня": 0, "вчера": 1, "позавчера": 2}), extract(t, relative, 1))
    day = F.date_sub(local.cast("date"), back)
    by_day = _at(F.year(day), F.month(day), F.dayofmonth(day), _number(t, relative, 2), _number(t, relative, 3), zone)

    seconds = extract(t, ago, 1).try_cast("long") * F.when(extract(t, ago, 2) == "час", 3600).otherwise(60)
    by_age = F.date_trunc("minute", F.timestamp_seconds(F.unix_timestamp(now) - seconds))

    by_dots = _at(_number(t, dotted, 3), _number(t, dotted, 2), _number(t, dotted, 1), F.lit(0), F.lit(0), zone)
    zero = lambda c: F.coalesce(c, F.lit(0))
    by_name = _at(_number(t, full, 3), month_number(extract(t, full, 2)), _number(t, full, 1), zero(_number(t, full, 4)), zero(_number(t, full, 5)), zone)

    def of_year(year: Column) -> Column:
        return _at(year, month_number(extract(t, short, 2)), _number(t, short, 1), zero(_number(t, short, 3)), zero(_number(t, short, 4)), zone)

    this = of_year(F.year(local))
    by_short = F.when(this > now + F.expr("INTERVAL 7 DAYS"), of_year(F.year(local) - 1)).otherwise(this)
    return F.when(matches(t, relative), by_day).when(matches(t, ago), by_age).when(matches(t, dotted), by_dots).when(matches(t, full), by_name).when(matches(t, short), by_short)


def url_date(url: Column, pattern: str, zone: Column) -> Column:
    """Local midnight of the year, month and day that pattern finds in a URL's path; null if there is none."""
    p = path(url)
    return _at(_number(p, pattern, 1), _number(p, pattern, 2), _number(p, pattern, 3), F.lit(0), F.lit(0), zone)


def long_date(at: Column, missing: str = "Дата неизвестна") -> Column:
    """Day, month in words and year of a timestamp."""
    return F.when(at.isNull(), missing).otherwise(F.concat_ws(" ", F.dayofmonth(at).cast("string"), month_name(F.month(at)), F.year(at).cast("string")))


def event_date_label(value: Column) -> Column:
    """A partial date (year, year and month, or day) in words."""
    year, month = F.substring(value, 1, 4), F.substring(value, 6, 2).try_cast("int")
    day = value.try_cast("date")
    return (
        F.when(value.rlike(r"^\d{4}$"), F.concat(value, F.lit(" год")))
        .when(value.rlike(r"^\d{4}-\d{2}$"), F.concat(month_name(month, MONTHS_ALONE), F.lit(" "), year, F.lit(" г.")))
        .otherwise(F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), month_name(F.month(day)), F.lit(" "), F.year(day).cast("string"), F.lit(" г.")))
    )
