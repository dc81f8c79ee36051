"""Text columns: slugs, names, labels, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column, empty: str = "model") -> Column:
    squeezed = F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_")
    bare = F.regexp_replace(squeezed, r"^_+|_+$", "")
    return F.when(bare == "", F.lit(empty)).otherwise(bare)


def sanitize_class_name(name: Column) -> Column:
    """Letters, digits, ``_ - .`` stay; everything else becomes ``_``; blank becomes ``class``."""
    bare = F.trim(name)
    return F.when(bare == "", F.lit("class")).otherwise(
        F.regexp_replace(bare, r"[^\p{L}\p{N}_.\-]", "_")
    )


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without directories and last extension (a leading dot is not an extension)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1))


def title_label(text: Column, empty: str = "-") -> Column:
    words = F.trim(F.regexp_replace(text, "_", " "))
    return F.when(words == "", F.lit(empty)).otherwise(F.initcap(words))


def metric_text(value: Column) -> Column:
    """Thousands separators for whole numbers, else five decimals without trailing zeros."""
    number = value.cast("double")
    whole = F.format_number(number, 0)
    fraction = F.regexp_replace(F.regexp_replace(F.format_string("%.5f", number), "0+$", ""), r"\.$", "")
    return (
        F.when(number.isNull(), F.lit("-"))
        .when(number == F.floor(number), whole)
        .otherwise(fraction)
    )


def short_number(value: float | int) -> str:
    """Three significant digits, the form used inside feature names."""
    return f"{float(value):.3g}"


def parse_names(names: Column) -> Column:
    """Comma or newline separated names to trimmed tokens, in order, blanks dropped."""
    pieces = F.split(F.regexp_replace(names, ",", "\n"), r"\r\n|\n|\r")
    return F.filter(F.transform(pieces, lambda t: F.trim(t)), lambda t: t != "")
