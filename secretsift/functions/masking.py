"""How a found secret is shown."""

from pyspark.sql import Column, functions as F


def mask(secret: Column) -> Column:
    """At most a quarter and at most four characters, then stars."""
    shown = F.least(F.lit(4), F.floor(F.length(secret) / 4).cast("int"))
    return F.concat(F.left(secret, shown), F.lit("***"))


def fingerprint(secret: Column) -> Column:
    """SHA-256 of the raw value, to compare findings without storing them."""
    return F.sha2(secret, 256)
