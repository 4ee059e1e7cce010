"""Expressions that turn receipt fields into keys and codes."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_date(text: Column) -> Column:
    """DATE from text; NULL, not an error, when the text is no date."""
    return text.try_cast("date")


def transaction_id(date: Column, store_id: Column, customer_id: Column) -> Column:
    """First 16 hex digits of sha-256 over ``date|store|customer``.

    ``date`` is a DATE, so every spelling of one day hashes alike, and receipts
    of one customer in one store on one day become one transaction.
    """
    key = F.concat_ws("|", date.cast("string"), store_id.cast("string"), customer_id.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 16)


def year_month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def tokens(products_raw: Column) -> Column:
    return F.split(F.trim(products_raw), " ")


def whole_number(token: Column) -> Column:
    """Number in a text, NULL for anything else.

    The pattern is tried first because a failed cast is far dearer than a
    failed match; the cast still guards against numbers that are too long.
    """
    numeric = token.rlike(r"^\s*[+-]?[0-9]+\s*$")
    return F.when(numeric, token.try_cast("bigint"))


def product_codes(products_raw: Column) -> Column:
    """Numeric tokens of a space-separated text; anything else is left out."""
    return F.filter(F.transform(tokens(products_raw), whole_number), lambda code: code.isNotNull())
