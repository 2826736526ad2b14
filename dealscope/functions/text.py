"""Parsing of labelled free text as column expressions; no user-defined functions."""

from __future__ import annotations

import html
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from dealscope.functions.numeric import col, flag

#: Labels of a listing, the more specific before the more general.
LABELS = (
    "Тип дома",
    "Жилой комплекс",
    "Год постройки",
    "Этаж",
    "Площадь кухни",
    "Площадь",
    "Состояние квартиры",
    "Санузел",
    "Балкон остеклён",
    "Балкон",
    "Дверь",
    "Телефон",
    "Интернет",
    "Парковка",
    "Квартира меблирована",
    "Пол",
    "Высота потолков",
    "Безопасность",
    "Бывшее общежитие",
    "Возможен обмен",
)
#: City, and patterns of a district, a price and an instalment.
CITY = "Астана"
DISTRICT = r"(?U)Астана,\s*(?:([А-Яа-яёЁ\-\s]+?)\s*р-н|р-н\s+([А-Яа-яёЁ\-]+))\s*показать на карте"
PRICE = r"(?U)(\d[\d\s]*)\s*₸"
INSTALMENT = "Рассрочка"
EDGE = r"(?U)^[ \t,|—–\-\s]+|[ \t,|—–\-\s]+$"

_BEFORE, _AFTER = "\u0001", "\u0002"


def filled(c: Column) -> Column:
    """The text, or null where empty."""
    return F.nullif(c, F.lit(""))


def segments(text: Column | str, labels: Sequence[str] = LABELS) -> Column:
    """array<struct<k, v>> of each label and the text up to the next one, edges trimmed."""
    pattern = "(" + "|".join(re.escape(x) for x in labels) + ")"
    marked = F.regexp_replace(F.coalesce(col(text), F.lit("")), pattern, f"{_BEFORE}$1{_AFTER}")
    parts = F.slice(F.split(marked, _BEFORE), 2, F.lit(1 << 30))
    return F.transform(parts, lambda p: F.struct(F.split(p, _AFTER)[0].alias("k"), F.regexp_replace(F.split(p, _AFTER)[1], EDGE, "").alias("v")))


def labelled(found: Column, label: str) -> Column:
    """Value of the label's first occurrence; null where absent or empty."""
    return filled(F.try_element_at(F.filter(found, lambda x: x["k"] == label), F.lit(1))["v"])


def gap_filled(first: Column, second: Column) -> Column:
    return F.coalesce(filled(first), filled(second))


def price(text: Column | str, pattern: str = PRICE) -> Column:
    """The first price, white space within it removed."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(col(text), F.lit("")), pattern, 1), r"(?U)\s+", "").try_cast("bigint")


def district(text: Column | str, pattern: str = DISTRICT) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    return F.trim(F.coalesce(filled(F.regexp_extract(t, pattern, 1)), filled(F.regexp_extract(t, pattern, 2))))


def first_number(text: Column | str) -> Column:
    """The first number, with decimal comma or point."""
    return F.replace(F.regexp_extract(col(text), r"(\d+(?:[.,]\d+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def floor_pair(text: Column | str, word: str = "из") -> tuple[Column, Column]:
    """(floor, floors) of "a из b"; null where absent."""
    pattern = rf"(?U)(\d+)\s+{word}\s+(\d+)"
    return F.regexp_extract(col(text), pattern, 1).try_cast("int"), F.regexp_extract(col(text), pattern, 2).try_cast("int")


def leading_year(text: Column | str) -> Column:
    return F.regexp_extract(col(text), r"^(\d{4})", 1).try_cast("int")


def yes_no(text: Column | str, yes: str = "да", no: str = "нет") -> Column:
    t = F.lower(F.trim(col(text)))
    return F.when(t.startswith(yes), True).when(t.startswith(no), False)


#: Phrases for the state of a flat.
CONDITIONS = {"черновая отделка": "rough", "свежий ремонт": "fresh_renovation"}


def condition(text: Column | str) -> Column:
    t = F.lower(F.trim(F.coalesce(col(text), F.lit(""))))
    out = F.when(t == "", "unknown")
    for phrase, name in CONDITIONS.items():
        out = out.when(t == phrase, name)
    return out.otherwise("needs_renovation")


def first_token(text: Column | str) -> Column:
    return filled(F.split(F.trim(col(text)), r"(?U)\s+")[0])


def comma_list(text: Column | str) -> Column:
    """Trimmed items; an empty array where there is no text."""
    none = F.array().cast("array<string>")
    return F.when(filled(F.coalesce(col(text), F.lit(""))).isNotNull(), F.transform(F.split(col(text), ","), lambda x: F.trim(x))).otherwise(none)


def pipe_fallback(text: Column | str, pattern: str = DISTRICT) -> Column:
    return flag(col(text).contains(" | ") & col(text).rlike(pattern))


def messages(*rules: tuple[Column, str]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(flag(rule), text) for rule, text in rules]))


def mentions(list_col: Column | str, part: str) -> Column:
    return F.exists(col(list_col), lambda x: x.contains(part))


def decoded(text: Column | str) -> Column:
    """Character references of HTML decoded; null stays null."""

    @pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(html.unescape, na_action="ignore")

    return run(col(text))


def clean(text: Column | str) -> Column:
    """Character references decoded, white space, the no-break kind too, to single spaces; trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(decoded(text), F.lit("")), r"(?U)[\s\u00a0]+", " "))


def first_match(text: Column | str, patterns: Sequence[str], group: int = 1) -> Column:
    """The group of the first pattern that is found, else the empty text."""
    return F.coalesce(*[filled(F.regexp_extract(F.coalesce(col(text), F.lit("")), p, group)) for p in patterns], F.lit(""))


#: Places of coordinates in a listing page, in order.
LAT_PATTERNS = (
    r'(?i)"lat"\s*:\s*"?([45]\d\.\d+)"?',
    r"(?i)'lat'\s*:\s*'?([45]\d\.\d+)'?",
    r"(?i)(?:lat|latitude)[^0-9-]{0,80}([45]\d\.\d+)",
)
LON_PATTERNS = (
    r'(?i)"lon(?:gitude)?"\s*:\s*"?([67]\d\.\d+)"?',
    r'(?i)"lng"\s*:\s*"?([67]\d\.\d+)"?',
    r"(?i)'lon(?:gitude)?'\s*:\s*'?([67]\d\.\d+)'?",
    r"(?i)'lng'\s*:\s*'?([67]\d\.\d+)'?",
    r"(?i)(?:lon|lng|longitude)[^0-9-]{0,80}([67]\d\.\d+)",
)


def latitude(page: Column | str) -> Column:
    return first_match(page, LAT_PATTERNS)


def longitude(page: Column | str) -> Column:
    return first_match(page, LON_PATTERNS)


def show_id(url: Column | str, end: bool = False) -> Column:
    """Digits of /a/show/<digits>; with ``end``, a url that does not end so raises."""
    found = filled(F.regexp_extract(F.coalesce(col(url), F.lit("")), r"/a/show/(\d+)" + ("$" if end else ""), 1))
    return F.coalesce(found, F.raise_error(F.lit("url without an id")).cast("string")) if end else found


def show_ids(page: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(col(page), F.lit(r"/a/show/(\d+)"), F.lit(1)))


def spaced_count(text: Column | str, pattern: str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(text), pattern, 1), r"(?U)\s+", "").try_cast("int")


def script_safe(text: Column | str) -> Column:
    return F.replace(col(text), F.lit("</"), F.lit("<\\/"))


def occurrences(text: Column | str, part: str) -> Column:
    return ((F.length(col(text)) - F.length(F.replace(col(text), F.lit(part), F.lit("")))) / len(part)).cast("int")
