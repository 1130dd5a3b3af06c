"""Small expression helpers."""

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def joined(values: Column, separator: str = ",") -> Column:
    return F.array_join(values, separator)


def lines_of(text: Column) -> Column:
    """Lines of a text; a trailing newline yields a last empty line."""
    return F.split(F.regexp_replace(text, r"\r\n", "\n"), "\n", -1)


def numbered(values: Column, body: Callable[[Column, Column], Column]) -> Column:
    """``transform`` with a 1-based position."""
    return F.transform(values, lambda v, i: body(v, i + 1))


def compact(values: Column) -> Column:
    """Drop NULL entries."""
    return F.filter(values, lambda v: v.isNotNull())
