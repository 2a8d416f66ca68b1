"""URL rules as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from secretsift.functions.text import let, once, strip
from secretsift.session import INTENDED, REFERENCE, check_semantics

# Name extensions of binary content.
BYTE_EXTENSIONS = (
    "jpg png gif jpeg bmp webp woff2 woff ico svg mp3 mp4 mpeg mpg avi zip rar tar gz pdf ttf "
    "exe xml app"
).split()

# Schemes whose relative references can be resolved against a base.
HIERARCHICAL_SCHEMES = ["", "http", "https", "ftp", "file", "ws", "wss", "sftp"]


def normalise_domain(c: Column) -> Column:
    """Domain as typed by a user: no commas or blanks, lower case."""
    return strip(F.lower(F.translate(c, ", \n", "")))


def normalise_subdomain(c: Column) -> Column:
    """Certificate-style host name: lower case, wildcard labels removed."""
    return F.replace(F.lower(c), F.lit("*."), F.lit(""))


def strip_list_marks(c: Column) -> Column:
    """Remove brackets and double quotes of a list written as text."""
    return F.translate(c, '[]"', "")


def before(c: Column, *marks: str) -> Column:
    """Text up to the first of some marks."""
    for mark in marks:
        c = F.substring_index(c, mark, 1)
    return c


def from_char(c: Column, start: Column | int) -> Column:
    """Text from a position, counted from one, to the end."""
    return F.substr(c, start if isinstance(start, Column) else F.lit(start))


def _contains(c: Column, text: str) -> Column:
    return F.contains(c, F.lit(text))


def host_of(c: Column) -> Column:
    """Host of anything that looks like a URL, with or without a scheme.

    User info, port, and dots at the end are dropped; letter case is kept.
    """
    scheme = F.regexp_replace(c, r"^(?:[A-Za-z0-9+.\-]+:)?//", "")
    no_scheme = F.when(_contains(c, "//"), scheme).otherwise(c)
    no_user = F.substring_index(before(no_scheme, "/", "?", "#"), "@", -1)

    def name(host: Column) -> Column:
        text = strip(before(host, ":"))
        for dot in ("\u3002", "\uff0e", "\uff61"):
            text = F.replace(text, F.lit(dot), F.lit("."))
        bracketed = F.startswith(host, F.lit("[")) & _contains(host, "]")
        address = F.concat(before(host, "]"), F.lit("]"))
        return F.when(bracketed, address).otherwise(F.rtrim(text, F.lit(".")))

    return let(no_user, name)


def page_key(c: Column) -> Column:
    """What two addresses of one page have in common.

    The scheme, a port that goes with it, the fragment and slashes at the end are dropped, and
    the host is put in lower case. Path and query stay as they are.
    """
    bare = F.regexp_replace(F.substring_index(c, "#", 1), r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[^/?]*", 0)), ":(?:80|443)?$", "")
    rest = F.regexp_replace(bare, "^[^/?]*", "")
    return F.regexp_replace(F.concat(host, rest), "/+$", "")


def ensure_scheme(c: Column) -> Column:
    """Prefix ``https://`` unless the URL is already absolute over HTTP."""
    return F.when(
        F.startswith(c, F.lit("https://")) | F.startswith(c, F.lit("http://")), c
    ).otherwise(F.concat(F.lit("https://"), c))


def clean_url(c: Column, semantics: str = REFERENCE) -> Column:
    """Undo JSON escaping and repeated slashes.

    ``reference`` turns a leading ``//`` into ``/``. ``intended`` keeps
    protocol-relative URLs and drops a query that holds escaped content.
    """
    intended = check_semantics(semantics) == INTENDED
    plain = F.replace(F.replace(c, F.lit('\\"'), F.lit('"')), F.lit("\\/"), F.lit("/"))
    if intended:
        plain = F.regexp_replace(plain, r"\?[^\r\n]*=\\[^\r\n]*", "")
    slashes = F.regexp_replace(plain, r"\\+", "/")
    repeated = r"(?<!:)(?<!^)/{2,}" if intended else r"(?<!:)/{2,}"
    single = F.regexp_replace(slashes, repeated, "/")
    return strip(F.when(_contains(c, "\\") | _contains(c, "//"), single).otherwise(c), "\"'")


def is_byte_content(c: Column, semantics: str = REFERENCE) -> Column:
    """True for URLs of images, fonts, media, archives and programs.

    ``reference`` wants a quote before the dot, as its pattern does, and finds the
    extension anywhere. ``intended`` compares the extension of the path; XML is
    content there.
    """
    if check_semantics(semantics) == REFERENCE:
        pattern = r"(?iu)[\p{L}\p{N}_/.]'\.(?:" + "|".join(BYTE_EXTENSIONS) + ")"
        return F.contains(c, F.lit("'.")) & F.rlike(c, F.lit(pattern))
    wanted = "|".join(e for e in BYTE_EXTENSIONS if e != "xml")
    path = F.regexp_extract(ensure_scheme(c), r"^https?://[^/?#]*([^?#]*)", 1)
    return F.rlike(path, F.lit(r"(?i)\.(?:" + wanted + r")\z"))


def _scheme(c: Column) -> Column:
    """Scheme in lower case, empty if there is none."""
    head = before(c, ":")
    valid = _contains(c, ":") & F.rlike(head, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*\z"))
    return F.when(valid, F.lower(head)).otherwise("")


def _tidy(c: Column) -> Column:
    """Drop what browsers drop: control characters in front, line breaks and tabs."""
    c = F.ltrim(c, F.lit("".join(map(chr, range(0x21)))))
    for mark in "\t\r\n":
        c = F.replace(c, F.lit(mark), F.lit(""))
    return c


def _fold_dots(path: Column) -> Column:
    """Remove ``.`` and ``..`` segments of a path."""
    segments = F.split(path, "/", -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    folder = F.when(F.rlike(path, F.lit(r"/\.\.?\z")), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    return F.array_join(F.concat(kept, folder), "/")


def _prefixed(mark: str, c: Column) -> Column:
    return F.when(c != "", F.concat(F.lit(mark), c)).otherwise("")


def _rooted(c: Column) -> Column:
    missing = (c != "") & ~F.startswith(c, F.lit("/"))
    return F.when(missing, F.concat(F.lit("/"), c)).otherwise(c)


def resolve_urls(df: DataFrame, base: str, link: str, out: str) -> DataFrame:
    """Resolve column ``link`` against column ``base`` (RFC 3986, lenient form).

    Written in steps, so that each piece of a URL is computed once per row, and
    with plain text functions where a row needs no regular expression.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != out]
    both = ("_l", "_b")
    step = df.select(*keep, F.col(link).alias("_l0"), F.col(base).alias("_b0"))
    step = step.withColumns({s: _tidy(F.col(s + "0")) for s in both})
    step = step.withColumns({s + "s": _scheme(F.col(s)) for s in both})
    # Rest after the scheme, network location, rest after that.
    step = step.withColumns({
        s + "r": F.when(F.col(s + "s") != "", from_char(F.col(s), F.length(s + "s") + 2))
        .otherwise(F.col(s)) for s in both
    })
    located = {s: F.startswith(s + "r", F.lit("//")) for s in both}
    step = step.withColumns({
        s + "n": F.when(located[s], before(from_char(F.col(s + "r"), 3), "/", "?", "#"))
        .otherwise("") for s in both
    })
    step = step.withColumns({
        s + "a": F.when(located[s], from_char(F.col(s + "r"), F.length(s + "n") + 3))
        .otherwise(F.col(s + "r")) for s in both
    })
    # Text before the fragment, path in it, and from those query and fragment.
    step = step.withColumns({s + "h": before(F.col(s + "a"), "#") for s in both})
    step = step.withColumns({s + "f": before(F.col(s + "h"), "?") for s in both})
    query = {s: from_char(F.col(s + "h"), F.length(s + "f") + 2) for s in both}
    step = step.withColumns({
        "_lq": query["_l"], "_bq": query["_b"], "_lg": from_char(F.col("_la"), F.length("_lh") + 2),
    })
    params = {s: _contains(F.col(s + "f"), ";") for s in both}
    step = step.withColumns({
        s + "p": F.when(params[s], F.regexp_extract(s + "f", r"(?s)^((?:.*/)?[^/;]*)", 1))
        .otherwise(F.col(s + "f")) for s in both
    } | {
        s + "m": F.when(params[s], F.regexp_extract(s + "f", r"(?s)^(?:.*/)?[^/;]*;([^/]*)\z", 1))
        .otherwise("") for s in both
    })
    name = F.length(F.substring_index("_bp", "/", -1))
    folder = F.when(F.col("_bp") == "", F.lit("/")).otherwise(
        F.substr("_bp", F.lit(1), F.length("_bp") - name)
    )
    joined = F.when(F.startswith("_lp", F.lit("/")), F.col("_lp")).otherwise(
        F.regexp_replace(F.concat(folder, F.col("_lp")), "/{2,}", "/")
    )
    step = step.withColumn("_j", joined)
    dotted = _contains(F.col("_j"), "/.")
    step = step.withColumn("_d", F.when(dotted, _fold_dots(F.col("_j"))).otherwise(F.col("_j")))
    scheme = F.when(F.col("_bs") != "", F.concat(F.col("_bs"), F.lit(":"))).otherwise("")
    own_tail = F.concat(
        _prefixed(";", F.col("_lm")), _prefixed("?", F.col("_lq")), _prefixed("#", F.col("_lg"))
    )
    base_root = F.concat(scheme, _prefixed("//", F.col("_bn")))
    same_page = F.concat(
        base_root, _rooted(F.col("_bp")), _prefixed(";", F.col("_bm")),
        _prefixed("?", F.when(F.col("_lq") != "", F.col("_lq")).otherwise(F.col("_bq"))),
        _prefixed("#", F.col("_lg")),
    )
    target = F.when(F.col("_d") == "", F.lit("/")).otherwise(F.col("_d"))
    other_scheme = (F.col("_ls") != "") & (F.col("_ls") != F.col("_bs"))
    other_host = F.concat(scheme, F.lit("//"), F.col("_ln"), _rooted(F.col("_lp")), own_tail)
    result = (
        F.when(F.col("_b0") == "", F.col("_l0"))
        .when(F.col("_l0") == "", F.col("_b0"))
        .when(other_scheme | ~F.col("_bs").isin(HIERARCHICAL_SCHEMES), F.col("_l0"))
        .when(F.col("_ln") != "", other_host)
        .when((F.col("_lp") == "") & (F.col("_lm") == ""), same_page)
        .otherwise(F.concat(base_root, _rooted(target), own_tail))
    )
    return once(step, **{out: result}).select(*keep, out)
