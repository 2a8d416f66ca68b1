"""Fixed schemas of the tables the jobs read and write."""

from pyspark.sql import types as T

SEED_LINES = T.StructType([T.StructField("value", T.StringType())])

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CAPTURES = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("body", T.StringType()),
])

# One exported answer of a passive source about one seed domain.
PAYLOADS = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
])

CDX = T.StructType([
    T.StructField("fqdn", T.StringType()),
    T.StructField("urlkey", T.StringType()),
    T.StructField("original", T.StringType()),
    T.StructField("mimetype", T.StringType()),
    T.StructField("statuscode", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
])

SUFFIX_RULES = T.StructType([
    T.StructField("rule", T.StringType()),
    T.StructField("private", T.BooleanType()),
])

CERTIFICATES = T.ArrayType(T.StructType([T.StructField("name_value", T.StringType())]))

DOMAIN_REPORT = T.StructType([
    T.StructField("response_code", T.StringType()),
    T.StructField("subdomains", T.ArrayType(T.StringType())),
])

ARCHIVE_ROWS = T.ArrayType(T.ArrayType(T.StringType()))

# Where a resource stands in its page: kind of element, element, item in it.
POSITION = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("tag_no", T.IntegerType()),
    T.StructField("item_no", T.IntegerType()),
])

FINDINGS = T.StructType([
    T.StructField("base_url", T.StringType()),
    T.StructField("resource_url", T.StringType()),
    T.StructField("registered_domain", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("masked", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
])
