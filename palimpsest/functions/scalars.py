"""Scalar functions over commits and refs, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The latest time that is held as a number of seconds.
LAST_SECOND = (1 << 63) - 1


def object_id(kind: str, data: Column) -> Column:
    """SHA-1 of `<kind> <bytes>\\0` and the data."""
    body = data.cast("binary")
    return F.sha1(F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(body).cast("string").cast("binary"), F.unhex(F.lit("00")), body))


def ident(text: Column) -> Column:
    """`Name <email> seconds +hhmm` as a struct with ts_status Valid, Overflow or NonNumeric; an invalid time counts as 0."""
    name = F.trim(F.regexp_extract(text, r"^([^<]*)<", 1))
    email = F.regexp_extract(text, r"<([^>]*)>", 1)
    stamp = F.regexp_extract(text, r"> *([^ ]+)", 1)
    zone = F.regexp_extract(text, r"([+-]\d{4}) *$", 1)
    digits = stamp.rlike(r"^\d+$")
    number = F.when(digits, stamp).try_cast("bigint")
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    seconds = sign * (F.coalesce(F.substring(zone, 2, 2).try_cast("int"), F.lit(0)) * 3600 + F.coalesce(F.substring(zone, 4, 2).try_cast("int"), F.lit(0)) * 60)
    status = F.when(~digits, "NonNumeric").when(number.isNull(), "Overflow").otherwise("Valid")
    return F.struct(name.alias("name"), email.alias("email"), F.coalesce(number, F.lit(0).cast("bigint")).alias("ts"), seconds.cast("int").alias("tz_secs"), status.alias("ts_status"))


def short_author(name: Column, email: Column) -> Column:
    """The local part of the address, else the name."""
    return F.coalesce(F.nullif(F.split_part(email, F.lit("@"), F.lit(1)), F.lit("")), name)


def subject(message: Column) -> Column:
    """The first line."""
    return F.split(message, "\n")[0]


def first_text_line(message: Column) -> Column:
    """The first line that isn't blank, trimmed, else `(no subject)`."""
    return F.coalesce(F.get(F.filter(F.transform(F.split(message, "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit("(no subject)"))


def creator_date(tagger: Column, committer: Column) -> Column:
    """When an object was made: the tagger's time, else the committer's, else 0."""
    return F.coalesce(tagger, committer, F.lit(0)).cast("long")


def host_quoted(text: Column, language: str) -> Column:
    """A text as a string of a host language: shell, perl, python or tcl."""
    if language == "shell":
        return F.concat(F.lit("'"), F.replace(F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("!"), F.lit("'\\!'")), F.lit("'"))
    if language in ("perl", "python"):
        body = text
        for raw, shown in (("\\", "\\\\"), ("'", "\\'"), *([("\n", "\\n")] if language == "python" else [])):
            body = F.replace(body, F.lit(raw), F.lit(shown))
        return F.concat(F.lit("'"), body, F.lit("'"))
    body = F.regexp_replace(text, r'([\[\]{}$\\"])', r"\\$1")
    for raw, shown in (("\f", "\\f"), ("\r", "\\r"), ("\n", "\\n"), ("\t", "\\t"), ("\v", "\\v")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    return F.concat(F.lit('"'), body, F.lit('"'))


def annotation(message: Column, n: int) -> Column:
    """The first n non-blank lines, joined by blanks."""
    return F.array_join(F.slice(F.filter(F.transform(F.split(message, "\n"), lambda x: F.trim(x)), lambda x: x != ""), 1, n), " ")


def strip_comments(text: Column, mark: str = "#") -> Column:
    """Without comment lines, trailing blanks, runs of blank lines, and blank lines at both ends."""
    out = F.regexp_replace(text, rf"(?m)^{mark}[^\n]*(\n|$)", "")
    out = F.regexp_replace(out, r"[ \t\r]+\n", "\n")
    out = F.regexp_replace(out, r"[ \t\r]+$", "")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(out, r"^\n+", ""), r"\n+$", "")


def revert_subject(text: Column) -> Column:
    """The subject of a commit that reverts one: reverting a revert is a reapplication."""
    inner = F.regexp_extract(text, r'^Revert "(.*)"$', 1)
    return (
        F.when(text.rlike(r'^Revert "Reapply ".*""$') | text.rlike(r'^Reapply ".*"$'), F.concat(F.lit('Revert "'), text, F.lit('"')))
        .when(inner != "", F.concat(F.lit('Reapply "'), inner, F.lit('"')))
        .otherwise(F.concat(F.lit('Revert "'), text, F.lit('"')))
    )


def date_modes(ts: Column, tz_secs: Column) -> dict[str, Column]:
    """A time in each of the fixed date formats, in its own zone."""
    local = F.timestamp_seconds(ts + tz_secs)
    sign = F.when(tz_secs < 0, "-").otherwise("+")
    size = F.abs(tz_secs)
    hours, minutes = F.lpad((size / 3600).cast("int").cast("string"), 2, "0"), F.lpad(F.expr("1").cast("int") * ((size % 3600) / 60).cast("int").cast("string"), 2, "0")
    zone, strict = F.concat(sign, hours, minutes), F.concat(sign, hours, F.lit(":"), minutes)
    return {
        "short": F.date_format(local, "yyyy-MM-dd"),
        "iso": F.concat(F.date_format(local, "yyyy-MM-dd HH:mm:ss"), F.lit(" "), zone),
        "iso_strict": F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), F.when(tz_secs == 0, "Z").otherwise(strict)),
        "rfc": F.concat(F.date_format(local, "EEE, d MMM yyyy HH:mm:ss"), F.lit(" "), zone),
        "raw": F.concat(ts.cast("string"), F.lit(" "), zone),
        "unix": ts.cast("string"),
    }


def relative_date(ts: Column, now: int) -> Column:
    """`N units ago` against a given now."""
    age = F.lit(now) - ts
    out = None
    for least, size, unit in ((31536000, 31536000, "year"), (2592000, 2592000, "month"), (604800, 604800, "week"), (86400, 86400, "day"), (3600, 3600, "hour"), (60, 60, "minute"), (0, 1, "second")):
        n = F.floor(age / size)
        text = F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago"))
        out = F.when(age >= least, text) if out is None else out.when(age >= least, text)
    return out.otherwise("in the future")


def short_ref(name: Column) -> Column:
    return F.regexp_replace(name, "^refs/(heads|tags|remotes)/", "")


def version_key(name: Column) -> Column:
    """A sort key: segments between dots and dashes, numbers by value (as padded text, after which words come), fewer segments first."""
    segments = F.split(name, "[.-]")
    return F.array_join(F.transform(segments, lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("0"), F.lpad(s, 20, "0"))).otherwise(F.concat(F.lit("1"), s))), "\u0001")


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 6, "0")


def c_quoted(path: Column) -> Column:
    """In double quotes with escapes where a path holds quotes, backslashes, tabs or line ends."""
    body = path
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    return F.when(body == path, path).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def parse_size(text: Column) -> Column:
    """`12`, `3k`, `4m`, `5g` in bytes."""
    number = F.regexp_extract(text, r"^(\d+)[kKmMgG]?$", 1).try_cast("bigint")
    unit = F.lower(F.regexp_extract(text, r"([kKmMgG]?)$", 1))
    return number * F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)


def parent_dir(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def path_prefixes(path: Column) -> Column:
    """A path and all of its directories."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def trailers(message: Column) -> Column:
    """(key, value) structs of the last paragraph, where all of its lines are trailers."""
    paragraph = F.element_at(F.split(F.trim(message), r"\n\n+"), -1)
    lines = F.split(paragraph, "\n")
    good = F.forall(lines, lambda x: x.rlike(r"^[A-Za-z0-9-]+: "))
    parsed = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z0-9-]+): ", 1).alias("key"), F.regexp_extract(x, "^[A-Za-z0-9-]+: (.*)$", 1).alias("value")))
    return F.when(good & (F.size(F.split(F.trim(message), r"\n\n+")) > 1), parsed).otherwise(F.array().cast("array<struct<key:string,value:string>>"))


def valid_ref_name(name: Column) -> Column:
    """The rules of reference names: components, dots, control characters, locks."""
    return (
        name.rlike("/")
        & ~name.rlike(r"(^|/)\.|\.\.|\.lock(/|$)|//|^/|/$|\.$|@\{|[\x00-\x20\x7f~^:?*\[\\]")
        & (name != "@")
    )
