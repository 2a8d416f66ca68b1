"""secretsift: leaked-credential analytics over captured web data, on Spark DataFrames."""

from secretsift.session import REFERENCE, INTENDED, check_semantics

__all__ = ["REFERENCE", "INTENDED", "check_semantics"]
