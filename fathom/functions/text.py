"""Text, date and recoding expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import as_column


def date_part(c: Column | str) -> Column:
    """The date before the ``T`` of an ISO timestamp text; NULL where it is not a date."""
    return F.try_to_date(F.split_part(as_column(c), F.lit("T"), F.lit(1)), "yyyy-MM-dd")


def parse_date(c: Column | str) -> Column:
    return F.try_to_date(as_column(c), "yyyy-MM-dd")


def date_text(c: Column | str) -> Column:
    return F.date_format(as_column(c), "yyyy-MM-dd")


def truncate_text(c: Column | str, width: int = 16) -> Column:
    """Cut to ``width`` characters in all, the last three being dots."""
    c = as_column(c)
    return F.when(F.length(c) > width, F.concat(F.left(c, F.lit(width - 3)), F.lit("..."))).otherwise(c)


def first_token(c: Column | str, separator: str = "_") -> Column:
    return F.split_part(as_column(c), F.lit(separator), F.lit(1))


def or_na_text(c: Column | str) -> Column:
    """Text in which a missing value is written out as ``NA``."""
    return F.coalesce(as_column(c).cast("string"), F.lit("NA"))


def subject_matches(subject: str, pattern_column: Column | str) -> Column:
    """True where the column, read as a pattern, occurs in the fixed subject."""
    return F.rlike(F.lit(subject), as_column(pattern_column))


def first_match(c: Column | str, rules: Sequence[tuple[str, str]]) -> Column:
    """The text of the first rule whose pattern occurs in ``c``; ``c`` itself where none does."""
    c = as_column(c)
    result = None
    for pattern, text in rules:
        hit = F.rlike(c, F.lit(pattern))
        result = F.when(hit, F.lit(text)) if result is None else result.when(hit, F.lit(text))
    return c if result is None else result.otherwise(c)


def clean_names(names: Iterable[str]) -> list[str]:
    """Lower snake_case names, made unique with ``_2``, ``_3`` and so on."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        words = name.replace("%", "_percent_").replace("#", "_number_")
        words = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", words)
        words = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", words)
        base = re.sub(r"[^0-9a-z]+", "_", words.lower()).strip("_") or "x"
        if base[0].isdigit():
            base = "x" + base
        seen[base] = seen.get(base, 0) + 1
        candidate = base if seen[base] == 1 else f"{base}_{seen[base]}"
        while candidate in result:
            seen[base] += 1
            candidate = f"{base}_{seen[base]}"
        result.append(candidate)
    return result


def with_clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))
