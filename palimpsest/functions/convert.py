"""Conversions of texts as columns: dates, Unicode forms, urls, path checks, text filters, JSON programs.

What built-in functions express is built from them; the rest are Arrow-batched functions that compute each distinct value of a batch once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import codecs, dates


def per_value(kind: str, compute: Callable):
    """A column function that computes each distinct value of a batch once; nulls stay null."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        results = [compute(v) for v in distinct]
        return pd.Series([results[c] if c >= 0 else None for c in codes], dtype=object)

    return run


# dates ---------------------------------------------------------------------------------------------


def exact_seconds(text: Column) -> Column:
    """Seconds of `@n`, a bare epoch of five digits and more, ISO 8601, RFC 3339 and `YYYY-MM-DD HH:MM:SS +hhmm`; null for other texts.

    Built-in functions only: the parts are cut out and put together, impossible days are null.
    """
    t = F.trim(text)
    epoch = F.regexp_extract(t, r"^@?(\d{5,18})(?: [+-]\d{4})?$", 1)
    form = r"^(\d{4})[-./](\d\d?)[-./](\d\d?)(?:[T ](\d\d?):(\d\d)(?::(\d\d)(?:\.\d+)?)?)?\s*(Z|[+-]\d\d:?\d\d)?$"
    part = lambda i: F.coalesce(F.regexp_extract(t, form, i).try_cast("int"), F.lit(0))
    valid = (part(4) < 24) & (part(5) < 60) & (part(6) < 60)
    zone = F.replace(F.regexp_extract(t, form, 7), F.lit(":"), F.lit(""))
    shift = F.when(zone.isin("", "Z"), 0).otherwise(F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60))
    known = (part(2).between(1, 12) & part(3).between(1, 28)) | _long_day(part(1), part(2), part(3))
    local = F.unix_date(F.when(known, F.make_date(F.when(known, part(1)).otherwise(1), F.when(known, part(2)).otherwise(1), F.when(known, part(3)).otherwise(1)))).cast("long") * 86400
    seconds = local + part(4) * 3600 + part(5) * 60 + part(6) - shift
    return F.when(epoch != "", epoch.try_cast("bigint")).when(t.rlike(form) & valid, seconds)


def _long_day(year: Column, month: Column, day: Column) -> Column:
    """Whether a day from the 29th on is in its month."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    last = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31).otherwise(0)
    return (day > 28) & (day <= last)


def approximate_seconds(text: Column, now: int) -> Column:
    """Seconds of an approximate date against a given now."""
    return per_value("long", lambda v: dates.approximate(v, now))(text)


def epoch_token(line: Column) -> Column:
    """The epoch of an identity line: its last token but one; 0 where that is no number."""
    tokens = F.split(F.trim(line), r"\s+")
    return F.coalesce(F.try_element_at(tokens, F.lit(-2)).try_cast("bigint"), F.lit(0).cast("bigint"))


# names, urls, paths ----------------------------------------------------------------------------------


def precomposed(text: Column) -> Column:
    """Unicode normal form C."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(per_value("string", lambda v: unicodedata.normalize("NFC", v))(text))


def rewritten_url(url: Column, rules: dict[str, str]) -> Column:
    """Of the rules (prefix -> replacement) the one with the longest prefix is applied; without one the url stays."""
    out = url
    for prefix in sorted(rules, key=lambda p: (len(p), p)):
        out = F.when(url.startswith(prefix), F.concat(F.lit(rules[prefix]), F.substring(url, F.lit(len(prefix) + 1), F.length(url)))).otherwise(out)
    return out


def url_basename(url: Column) -> Column:
    """The last component of a url, without slashes at its end and `.git`."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(url, "/+$", ""), "([^/:]*)$", 1), r"\.git$", "")


def fetched(line: Column) -> Column:
    """A FETCH_HEAD line as a struct: oid, for_merge, kind, name, url."""
    note = F.element_at(F.split(line, "\t"), 3)
    named = r"^(branch|tag|remote-tracking branch) '([^']*)' of (.*)$"
    return F.struct(
        F.element_at(F.split(line, "\t"), 1).alias("oid"),
        (F.element_at(F.split(line, "\t"), 2) == "").alias("for_merge"),
        F.nullif(F.regexp_extract(note, named, 1), F.lit("")).alias("kind"),
        F.nullif(F.regexp_extract(note, named, 2), F.lit("")).alias("name"),
        F.when(note.rlike(named), F.regexp_extract(note, named, 3)).otherwise(note).alias("url"),
    )


#: Checks of identity lines, with their severity: ids and severities are fixed values.
IDENT_CHECKS = {
    "missingNameBeforeEmail": ("error", r"^<"),
    "badName": ("error", r"^[^<]*>"),
    "missingEmail": ("error", r"^[^<>]*$"),
    "missingSpaceBeforeEmail": ("error", r"^[^<>]*[^<> ]<"),
    "badEmail": ("error", r"^[^<>]*<[^>]*(<|$)"),
    "missingSpaceBeforeDate": ("error", r"^[^<>]*<[^<>]*>(?! )"),
    "zeroPaddedDate": ("error", r"^[^<>]*<[^<>]*> 0\d"),
    "badDateOverflow": ("error", r"^[^<>]*<[^<>]*> (?!0)(\d{20,}|9[3-9]\d{17}|92[3-9]\d{16})"),
    "badDate": ("error", r"^[^<>]*<[^<>]*> (\D|\d+(?! )\D|\d+$|$)"),
    "badTimezone": ("error", r"^[^<>]*<[^<>]*> \d+ (?![+-]\d{4}$)"),
}


def ident_faults(line: Column) -> Column:
    """(id, severity) of the first fault of an identity line, null for a good one."""
    out = None
    for name, (severity, regex) in IDENT_CHECKS.items():
        value = F.struct(F.lit(name).alias("id"), F.lit(severity).alias("severity"))
        out = F.when(line.rlike(regex), value) if out is None else out.when(line.rlike(regex), value)
    return out


def unsafe_path(path: Column) -> Column:
    """Whether a path must not be checked out: empty, absolute, with `.`, `..` or empty components, or one that a file system takes for `.git`.

    Case is ignored, as are characters that HFS+ leaves out and, for NTFS, blanks, dots and a stream name behind the name and its short form.
    """
    # zero-width and direction characters, which HFS+ ignores in names: fixed values
    bare = F.regexp_replace(F.lower(path), "[\u200c-\u200f\u202a-\u202e\u206a-\u206f\ufeff]", "")
    return path.rlike(r"^$|^/|//|(^|[/\\])\.\.?([/\\]|$)|/$") | bare.rlike(r"(^|[/\\])(\.git|git~1)[ .]*(:[^/\\]*)?([/\\]|$)")


def in_cone(path: Column, directories: list[str]) -> Column:
    """Sparse cone: files at the top, all below the directories, and files that lie directly in what is above them."""
    parent = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    out = parent == ""
    for d in directories:
        d = d.strip("/")
        above = ["/".join(d.split("/")[:n]) for n in range(1, d.count("/") + 1)]
        out = out | path.startswith(f"{d}/")
        out = out | parent.isin(*above) if above else out
    return out


def relative_path(path: Column, prefix: str) -> Column:
    """A path as seen from a directory; null outside it."""
    p = prefix.rstrip("/") + "/"
    return F.when(path.startswith(p), F.substring(path, F.lit(len(p) + 1), F.length(path)))


def compact_rename(old: Column, new: Column) -> Column:
    """`a/{b => c}/d`: common directories of both names once; built-in functions only."""
    a, b = F.split(old, "/"), F.split(new, "/")
    least = F.least(F.size(a), F.size(b))
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    agree = lambda x, y, n: F.coalesce(F.array_min(F.filter(steps(n), lambda i: F.element_at(x, i) != F.element_at(y, i))) - 1, n)
    head = agree(a, b, least - 1)
    tail = agree(F.reverse(a), F.reverse(b), least - head)
    middle = lambda x: F.array_join(F.slice(x, head + 1, F.size(x) - head - tail), "/")
    braces = F.concat(F.lit("{"), middle(a), F.lit(" => "), middle(b), F.lit("}"))
    whole = F.array_join(F.concat(F.slice(a, F.lit(1), head), F.array(braces), F.slice(a, F.size(a) - tail + 1, tail)), "/")
    return F.when((head == 0) & (tail == 0), F.concat(old, F.lit(" => "), new)).otherwise(whole)


def stat_graph(added: Column, deleted: Column, most: Column, width: int) -> Column:
    """`+++--`: changes as a graph of at most `width` signs, scaled where the largest change of the listing is wider."""
    scaled = lambda n: F.when(most <= width, n).when(n == 0, 0).otherwise(1 + F.floor(n * (width - 1) / most))
    total = scaled(added + deleted)
    plus = F.when(most <= width, added).when(added < deleted, F.when(added > 0, F.greatest(scaled(added), F.lit(1))).otherwise(0)).otherwise(total - scaled(deleted))
    return F.concat(F.repeat(F.lit("+"), plus.cast("int")), F.repeat(F.lit("-"), (total - plus).cast("int")))


# content filters -----------------------------------------------------------------------------------


def clean(text: Column, ident: bool = False) -> Column:
    """What is stored of a file: line ends without CR and, with ident, `$Id$` without a value."""
    out = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(out, r"\$Id:[^$\n]*\$", r"\$Id\$") if ident else out


def smudge(text: Column, oid: Column | None = None, crlf: bool = False) -> Column:
    """What is checked out of a stored file: `$Id$` with the blob's id, line ends with CR."""
    out = text
    if oid is not None:
        parts = F.split(text, r"\$Id\$")
        out = F.array_join(parts, "\u0000")
        out = F.replace(out, F.lit("\u0000"), F.concat(F.lit("$Id: "), oid, F.lit(" $")))
    return F.replace(out, F.lit("\n"), F.lit("\r\n")) if crlf else out


#: Converters by name; more can be registered.
CONVERTERS: dict[str, Callable[[str], str]] = {
    "strip-tags": lambda v: re.sub(r"<[^>]*>", "", v),
    "hex": lambda v: v.encode().hex(),
}


def textconv(text: Column, path: Column, drivers: list[tuple[str, str]]) -> Column:
    """Texts for a diff: the last (glob, converter) that fits a path converts its text; each distinct text of a batch once."""
    from .patterns import glob_regex

    out = text
    for pattern, name in drivers:
        out = F.when(path.rlike(glob_regex(pattern, pathname=False)), per_value("string", CONVERTERS[name])(text)).otherwise(out)
    return out


def span_similarity(old: Column, new: Column, top: int = 60000) -> Column:
    """The span-hash score of two blobs."""

    @F.pandas_udf("long")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([codecs.similarity((x or "").encode(), (y or "").encode(), top) for x, y in zip(a, b, strict=True)])

    return run(old, new)


def break_scores(old: Column, new: Column, top: int = 60000) -> Column:
    """(src_copied, literal_added, dissimilarity) of a rewrite: how much of the old blob is kept, what is new, and how much of it went."""

    @F.pandas_udf("src_copied long, literal_added long, dissimilarity long")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b, strict=True):
            x, y = (x or "").encode(), (y or "").encode()
            one, two = codecs.spans(x), codecs.spans(y)
            kept = min(len(x), sum(min(n, two[h]) for h, n in one.items()))
            rows.append((kept, max(len(y) - kept, 0), (len(x) - kept) * top // len(x) if x else 0))
        return pd.DataFrame(rows, columns=["src_copied", "literal_added", "dissimilarity"])

    return run(old, new)


# JSON programs -------------------------------------------------------------------------------------

_TOKEN = re.compile(r'\s*("(?:[^"\\]|\\.)*"|-?\d+(?:\.\d+)?|\.\.|[.|,()\[\]{}:]|==|!=|<=|>=|<|>|\+|-|\*|/|[A-Za-z_]\w*)')


class JsonProgram:
    """A program of paths, pipes, commas, comparisons, arithmetic, select, map, length, keys, not, and, or, [..]."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise ValueError(f"not a program: {source[at:]}")
            self.tokens.append(m[1])
            at = m.end()
        self.at = 0
        self.run = self._pipe()
        if self.at != len(self.tokens):
            raise ValueError(f"unexpected {self.tokens[self.at]}")

    def _next(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at] in wanted:
            self.at += 1
            return self.tokens[self.at - 1]
        return None

    def _pipe(self):
        left = self._comma()
        while self._next("|"):
            right = self._comma()
            left = (lambda f, g: lambda v: [y for x in f(v) for y in g(x)])(left, right)
        return left

    def _comma(self):
        left = self._binary(0)
        while self._next(","):
            right = self._binary(0)
            left = (lambda f, g: lambda v: f(v) + g(v))(left, right)
        return left

    _LEVELS = (("or",), ("and",), ("==", "!=", "<", "<=", ">", ">="), ("+", "-"), ("*", "/"))
    _DO = {
        "or": lambda a, b: _true(a) or _true(b), "and": lambda a, b: _true(a) and _true(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
        "<": lambda a, b: _rank(a) < _rank(b), "<=": lambda a, b: _rank(a) <= _rank(b), ">": lambda a, b: _rank(a) > _rank(b), ">=": lambda a, b: _rank(a) >= _rank(b),
        "+": lambda a, b: b if a is None else a if b is None else {**a, **b} if isinstance(a, dict) else a + b, "-": lambda a, b: [x for x in a if x not in b] if isinstance(a, list) else a - b,
        "*": lambda a, b: a * b, "/": lambda a, b: a / b,
    }

    def _binary(self, level: int):
        if level == len(self._LEVELS):
            return self._postfix()
        left = self._binary(level + 1)
        while op := self._next(*self._LEVELS[level]):
            right = self._binary(level + 1)
            left = (lambda f, g, do: lambda v: [do(a, b) for b in g(v) for a in f(v)])(left, right, self._DO[op])
        return left

    def _postfix(self):
        f = self._term()
        while True:
            if self._next("."):
                f = self._chained(f, self._field(self._name()))
            elif self._next("["):
                f = self._chained(f, self._bracket())
            else:
                return f

    @staticmethod
    def _chained(f, g):
        return lambda v: [y for x in f(v) for y in g(x)]

    def _name(self) -> str:
        token = self.tokens[self.at]
        self.at += 1
        return json.loads(token) if token.startswith('"') else token

    @staticmethod
    def _field(name: str):
        return lambda v: [None if v is None else v.get(name)]

    def _bracket(self):
        if self._next("]"):
            return lambda v: list(v.values() if isinstance(v, dict) else v or [])
        inner = self._pipe()
        if not self._next("]"):
            raise ValueError("] is missing")

        def get(v):
            out = []
            for i in inner(v):
                if v is None:
                    out.append(None)
                elif isinstance(v, dict):
                    out.append(v.get(i))
                else:
                    out.append(v[int(i)] if -len(v) <= i < len(v) else None)
            return out

        return get

    def _term(self):
        if self._next("."):
            if self.at < len(self.tokens) and (self.tokens[self.at][0] == '"' or re.match(r"[A-Za-z_]", self.tokens[self.at])):
                return self._field(self._name())
            return lambda v: [v]
        if self._next("("):
            f = self._pipe()
            if not self._next(")"):
                raise ValueError(") is missing")
            return f
        if self._next("["):
            if self._next("]"):
                return lambda v: [[]]
            f = self._pipe()
            if not self._next("]"):
                raise ValueError("] is missing")
            return lambda v: [f(v)]
        token = self._name() if self.tokens[self.at][0] != '"' else None
        if token is None:
            text = json.loads(self.tokens[self.at])
            self.at += 1
            return lambda v: [text]
        if re.fullmatch(r"-?\d+(\.\d+)?", token):
            number = json.loads(token)
            return lambda v: [number]
        if token in ("true", "false", "null"):
            value = {"true": True, "false": False, "null": None}[token]
            return lambda v: [value]
        if token in ("select", "map"):
            self.at += 1
            f = self._pipe()
            if not self._next(")"):
                raise ValueError(") is missing")
            if token == "map":
                return lambda v: [[y for x in v for y in f(x)]]
            return lambda v: [v for x in f(v) if _true(x)]
        if token in _PLAIN:
            return (lambda do: lambda v: do(v))(_PLAIN[token])
        raise ValueError(f"unknown: {token}")

    def __call__(self, text: str | None) -> str | None:
        """No value is null, one is itself, more are an array."""
        out = self.run(json.loads(text)) if text is not None else []
        value = None if not out else out[0] if len(out) == 1 else out
        return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _true(v) -> bool:
    return v is not None and v is not False


def _rank(v) -> tuple:
    """Order across kinds: null, false, true, numbers, texts, arrays, objects."""
    kinds = (type(None), bool, (int, float), str, list, dict)
    kind = 1 if v is False else 2 if v is True else 0 if v is None else next(i for i, k in enumerate(kinds) if isinstance(v, k)) + 1
    return kind, (0 if v is None or isinstance(v, bool) else v if not isinstance(v, dict) else sorted(v))


_PLAIN = {
    "length": lambda v: [0 if v is None else abs(v) if isinstance(v, (int, float)) else len(v)],
    "keys": lambda v: [sorted(v) if isinstance(v, dict) else list(range(len(v)))],
    "not": lambda v: [not _true(v)],
    "empty": lambda v: [],
    "add": lambda v: [None if not v else sum(v) if isinstance(v[0], (int, float)) else "".join(v)],
    "type": lambda v: ["null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"],
}


def json_program(text: Column, program: str) -> Column:
    """A JSON program over a column of JSON texts; its result as JSON."""
    return per_value("string", JsonProgram(program))(text)


# line results --------------------------------------------------------------------------------------


def coalesced(lines: DataFrame, by: list[str], same: list[str], number: str = "line_no") -> DataFrame:
    """(by…, begin, end, same…): runs of neighbouring lines that agree in `same`."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(number)
    new = F.lag(number).over(order).isNull() | (F.lag(number).over(order) != F.col(number) - 1)
    for c in same:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(order))
    marked = lines.withColumn("__new", F.when(new, 1).otherwise(0)).withColumn("__run", F.sum("__new").over(order))
    return marked.groupBy(*by, "__run", *same).agg(F.min(number).alias("begin"), F.max(number).alias("end")).select(*by, "begin", "end", *same)
