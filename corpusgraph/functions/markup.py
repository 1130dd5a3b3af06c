"""Attribute extraction from HTML text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def without_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")


def tag_attribute(html: Column, tag: str, attribute: str) -> Column:
    """Values of one attribute of every ``tag``, in order.

    Quoted in either way or bare, of any length.
    """
    head = rf"(?is)<{tag}(?![A-Za-z0-9_])[^>]*>"
    tags = F.regexp_extract_all(without_comments(html), F.lit(head), F.lit(0))
    value = (
        rf"(?is)(?<![A-Za-z0-9_\-]){attribute}\s*=\s*"
        r"(?:\"([^\">]*)\"|'([^'>]*)'|([^\s\"'>][^\s>]*))"
    )

    def read(text: Column) -> Column:
        bare = F.regexp_extract(text, value, 3)
        quoted = F.concat(F.regexp_extract(text, value, 1), F.regexp_extract(text, value, 2))
        return (
            F.when(~text.rlike(value), F.lit(None))
            .when(bare == "", quoted)
            .otherwise(bare)
        )

    return F.filter(F.transform(tags, read), lambda v: v.isNotNull())
