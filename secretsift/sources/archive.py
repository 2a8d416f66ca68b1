"""URLs from a web-archive index."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, functions as F

from secretsift import schemas
from secretsift.functions.text import WHITESPACE, strip
from secretsift.operators.topk import first_per_group
from secretsift.session import INTENDED, REFERENCE, check_semantics

# Media types a scan has no use for, as patterns.
EXCLUDED_MIME_TYPES = (
    "warc/revisit image/avif image/jpeg image/jpg image/png image/svg.xml image/gif image/tiff "
    "image/webp image/bmp image/vnd image/x-icon image/vnd.microsoft.icon font/ttf font/woff "
    "font/woff2 font/x-woff2 font/x-woff font/otf audio/mpeg audio/wav audio/webm audio/aac "
    "audio/ogg video/mp4 video/mpeg video/webm video/ogg video/mp2t video/x-msvideo video/x-flv "
    "application/font-woff application/font-woff2 application/x-font-woff "
    "application/x-font-woff2 application/vnd.ms-fontobject application/font-sfnt "
    "application/vnd.android.package-archive binary/octet-stream application/octet-stream "
    "application/pdf application/x-font-ttf application/x-font-otf video/3gpp "
    "application/font-ttf audio/mp3 audio/x-wav image/pjpeg audio/basic application/font-otf"
).split()
INCLUDED_STATUS = (200, 202)
YEARS_BACK = 2


def archive_rows(payloads: DataFrame, semantics: str = REFERENCE) -> DataFrame:
    """URLs of an archive answer ``(fqdn, status, body)``, one column ``url``.

    The answer is a JSON list of one-value rows under a header row. ``reference``
    strips the list marks and cuts at commas, so a comma in a URL breaks it;
    ``intended`` parses the JSON.
    """
    answers = payloads.where(F.col("status") == 200)
    if check_semantics(semantics) == INTENDED:
        parsed = F.from_json("body", schemas.ARCHIVE_ROWS)
        cells = F.flatten(F.slice(parsed, F.lit(2), F.greatest(F.size(parsed), F.lit(1))))
    else:
        text = F.translate(F.lower(strip(F.translate("body", '[]"', ""))), "\n", "")
        pieces = F.split(text, ",", -1)
        cells = F.slice(pieces, F.lit(2), F.size(pieces))
    urls = answers.select(F.explode(cells).alias("cell")).where(F.length("cell") > 1)
    return urls.select(F.lower(F.btrim("cell", F.lit(WHITESPACE))).alias("url")).distinct()


def usable_captures(
    cdx: DataFrame, year: int | None = None, semantics: str = REFERENCE
) -> DataFrame:
    """The first capture of each URL key: ``(fqdn, urlkey, original)``.

    Only captures of the last years with a usable status and media type count; an
    unknown media type is usable. In
    ``reference`` a media type must match an excluded pattern whole; ``intended``
    also drops types that start with one.
    """
    end = "" if check_semantics(semantics) == INTENDED else "$"
    mime = "^(?:" + "|".join(EXCLUDED_MIME_TYPES) + ")" + end
    year = year or datetime.date.today().year
    first, after = f"{year - YEARS_BACK}-01-01", f"{year + 1}-01-01"
    usable = cdx.where(
        F.col("statuscode").isin(*INCLUDED_STATUS)
        & (F.col("ts") >= F.lit(first).cast("timestamp"))
        & (F.col("ts") < F.lit(after).cast("timestamp"))
        & ~F.coalesce(F.rlike("mimetype", F.lit(mime)), F.lit(False))
    )
    # Captures of one key and moment are told apart by their address.
    collapsed = usable.groupBy("fqdn", "urlkey").agg(
        F.min(F.struct("ts", "original")).alias("first")
    )
    return collapsed.select("fqdn", "urlkey", F.col("first.original").alias("original"))


def archive_captures(
    cdx: DataFrame,
    year: int | None = None,
    limit: int | None = None,
    semantics: str = REFERENCE,
) -> DataFrame:
    """Archived URLs worth a scan: per host the first ``limit`` keys in key order, or all."""
    keys = usable_captures(cdx, year, semantics)
    return keys if limit is None else first_per_group(keys, ["fqdn"], ["urlkey"], limit)
