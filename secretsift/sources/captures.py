"""Captured pages and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Stands for an escaped backslash while other escapes are undone.
_HELD = "\ue000"


def _undo_json_escapes(body: Column) -> Column:
    """Slash and printable-ASCII escapes of JSON text, as a re-serialiser writes them."""
    held = F.replace(body, F.lit("\\\\"), F.lit(_HELD))
    slashes = F.replace(held, F.lit("\\/"), F.lit("/"))
    pieces = F.split(slashes, r"\\u00(?=[2-7][0-9a-fA-F])", -1)

    def piece(text: Column, i: Column) -> Column:
        code = F.conv(F.substring(text, 1, 2), 16, 10).cast("int")
        sign = F.when(code.isin(0x22, 0x5C, 0x7F), F.concat(F.lit("\\u00"), F.substring(text, 1, 2)))
        return F.when(i == 0, text).otherwise(
            F.concat(sign.otherwise(F.char(code)), F.substring(text, 3, 1 << 30))
        )

    joined = F.array_join(F.transform(pieces, piece), "")
    plain = F.when(F.contains(slashes, F.lit("\\u00")), joined).otherwise(slashes)
    return F.replace(plain, F.lit(_HELD), F.lit("\\\\"))


def normalise_responses(captures: DataFrame) -> DataFrame:
    """Add ``html``: JSON answers wrapped as a page, other bodies as they are.

    A JSON body counts only if it parses. Its escapes are undone so that tags
    inside its strings read as tags.
    """
    body = F.col("body")
    is_json = F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("application/json"))
    # As the one member of a list, so that text after the value makes it invalid.
    listed = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]")))
    valid = F.size(F.try_variant_get(listed, "$", "array<variant>")) == 1
    wrapped = F.concat(F.lit("<html><body>"), _undo_json_escapes(body), F.lit("</body></html>"))
    return captures.withColumn("html", F.when(is_json & valid, wrapped).otherwise(body))


def valid_pages(pages: DataFrame) -> DataFrame:
    """Pages whose body arrived."""
    return pages.where(F.col("html").isNotNull())


def page_status(pages: DataFrame, usable: Column) -> DataFrame:
    """``(page_id, url, status)`` with ``ok`` or ``failed`` for every page."""
    ok = F.col("html").isNotNull() & F.coalesce(usable, F.lit(False))
    return pages.select(
        "page_id", "url", F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("status")
    )


def failed_urls(pages: DataFrame, usable: Column) -> DataFrame:
    """The addresses of pages that could not be used."""
    return page_status(pages, usable).where(F.col("status") == "failed").select("url").distinct()
