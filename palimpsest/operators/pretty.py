"""The log format language: `%` placeholders and named formats as one column.

A commit row has oid, tree, parents (array<string>), author_name, author_email, author_ts, author_tz, committer_name, committer_email,
committer_ts, committer_tz, message and, where a format names them, decorations (array<string>), mark, notes, selector, reflog_subject,
mapped_author_name, mapped_author_email, mapped_committer_name and mapped_committer_email.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import date_modes
from .refs import padded

_PLACEHOLDER = re.compile(
    r"%(?P<hex>x[0-9a-fA-F]{2})|%(?P<pad><\(|>\(|>>\(|><\()(?P<width>\d+)(?:,(?P<cut>trunc|ltrunc|mtrunc))?\)|%C\([^)]*\)|%C(?:red|green|blue|reset)|%w\([^)]*\)"
    r"|%(?P<sign>[+\- ]?)(?P<name>[ac][neNEdDrtiIsl]|g[dDs]|G\?|[HhTtPpsfbBnNdDmS%])"
)

#: Named formats: fixed values.  Headers of all but oneline and reference begin with the id; messages are indented by four blanks.
NAMED = {
    "oneline": "%H %s",
    "short": "commit %H%nAuthor: %an <%ae>%n%n{subject}%n",
    "medium": "commit %H%n{merge}Author: %an <%ae>%nDate:   %ad%n%n{message}%n",
    "full": "commit %H%n{merge}Author: %an <%ae>%nCommit: %cn <%ce>%n%n{message}%n",
    "fuller": "commit %H%n{merge}Author:     %an <%ae>%nAuthorDate: %ad%nCommit:     %cn <%ce>%nCommitDate: %cd%n%n{message}%n",
    "reference": "%h (%s, %as)",
    "email": "From %H Mon Sep 17 00:00:00 2001%nFrom: %an <%ae>%nDate: %aD%nSubject: [PATCH] %s%n%n%b%n",
    "raw": "commit %H%ntree %T%n{parents}author %an <%ae> {araw}%ncommitter %cn <%ce> {craw}%n%n{message}%n",
}


def subject_line(message: Column) -> Column:
    """The first paragraph of a message on one line."""
    first = F.element_at(F.split(F.regexp_replace(message, r"^\n+", ""), r"\n[ \t]*\n"), 1)
    return F.trim(F.regexp_replace(first, r"\s*\n\s*", " "))


def body_text(message: Column) -> Column:
    """What follows the first paragraph, with one line end at its end."""
    rest = F.regexp_extract(F.regexp_replace(message, r"^\n+", ""), r"(?s)^.*?\n[ \t]*\n\s*(.*)$", 1)
    return F.when(rest == "", "").otherwise(F.concat(F.regexp_replace(rest, r"\s+$", ""), F.lit("\n")))


def sanitised(subject: Column) -> Column:
    """A subject as a file name: runs of other characters than letters, digits, `.` and `_` are one dash; dots don't repeat or end it."""
    out = F.regexp_replace(subject, r"[^A-Za-z0-9._]+", "-")
    return F.regexp_replace(F.regexp_replace(out, r"\.{2,}", "."), r"^-+|[-.]+$", "")


def default_date(ts: Column, tz: Column) -> Column:
    """`Thu Jan 1 00:00:00 1970 +0000`."""
    zone = F.split(date_modes(ts, tz)["raw"], " ")[1]
    return F.concat(F.date_format(F.timestamp_seconds(ts + tz), "EEE MMM d HH:mm:ss yyyy"), F.lit(" "), zone)


def _person(letter: str, what: str, now: int | None) -> Column:
    who = {"a": "author", "c": "committer"}[letter]
    ts, tz = F.col(f"{who}_ts"), F.col(f"{who}_tz")
    if what in "nel":
        return {"n": F.col(f"{who}_name"), "e": F.col(f"{who}_email"), "l": F.split_part(f"{who}_email", F.lit("@"), F.lit(1))}[what]
    if what in "NE":
        return F.col(f"mapped_{who}_{'name' if what == 'N' else 'email'}")
    if what == "d":
        return default_date(ts, tz)
    if what == "r":
        from ..functions.scalars import relative_date

        if now is None:
            raise ValueError("relative dates need now")
        return relative_date(ts, now)
    return date_modes(ts, tz)[{"D": "rfc", "t": "unix", "i": "iso", "I": "iso_strict", "s": "short"}[what]]


def _value(name: str, short: int, now: int | None) -> Column:
    if len(name) == 2 and name[0] in "ac":
        return _person(name[0], name[1], now)
    if name in ("gd", "gD", "gs"):
        return F.col("reflog_subject" if name == "gs" else "selector")
    decorations = lambda: F.array_join("decorations", ", ")
    return {
        "H": lambda: F.col("oid"),
        "h": lambda: F.substring("oid", 1, short),
        "T": lambda: F.col("tree"),
        "t": lambda: F.substring("tree", 1, short),
        "P": lambda: F.array_join("parents", " "),
        "p": lambda: F.array_join(F.transform("parents", lambda x: F.substring(x, 1, short)), " "),
        "s": lambda: subject_line(F.col("message")),
        "f": lambda: sanitised(subject_line(F.col("message"))),
        "b": lambda: body_text(F.col("message")),
        "B": lambda: F.concat(F.regexp_replace("message", r"\s+$", ""), F.lit("\n")),
        "n": lambda: F.lit("\n"),
        "N": lambda: F.col("notes"),
        "d": lambda: F.when(F.size("decorations") > 0, F.concat(F.lit(" ("), decorations(), F.lit(")"))).otherwise(""),
        "D": lambda: F.when(F.size("decorations") > 0, decorations()).otherwise(""),
        "m": lambda: F.col("mark"),
        "S": lambda: F.col("source"),
        "G?": lambda: F.lit("N"),
        "%": lambda: F.lit("%"),
    }[name]()


def pretty(template: str, short: int = 7, now: int | None = None) -> Column:
    """A template as one column; columns that it doesn't name are never read.

    `%<(n)`, `%>(n)` and `%><(n)` pad the placeholder behind them (`,trunc`, `,ltrunc`, `,mtrunc` cut it to that width, with two dots); `%+x` puts a
    line end and `% x` a blank before a value that isn't empty; `%-x` takes line ends before an empty one away; colours and wraps are left out.
    """
    if template in NAMED:
        return _named(template, short, now)
    parts: list[Column] = []
    at, pad = 0, None
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > at:
            parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m["hex"]:
            parts.append(F.lit(chr(int(m["hex"][1:], 16))))
        elif m["pad"]:
            pad = (m["pad"], int(m["width"]), m["cut"])
        elif m["name"]:
            value = F.coalesce(_value(m["name"], short, now).cast("string"), F.lit(""))
            if pad:
                value, pad = _fitted(value, *pad), None
            if m["sign"] in ("+", " "):
                value = F.when(value != "", F.concat(F.lit("\n" if m["sign"] == "+" else " "), value)).otherwise("")
            elif m["sign"] == "-" and parts:
                before = F.concat(*parts)
                parts = [F.when(value == "", F.regexp_replace(before, r"\n+$", "")).otherwise(before)]
            parts.append(value)
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def _fitted(value: Column, kind: str, width: int, cut: str | None) -> Column:
    if cut:
        n, keep = F.length(value), width - 2
        short = {
            "trunc": F.concat(F.substring(value, 1, keep), F.lit("..")),
            "ltrunc": F.concat(F.lit(".."), F.right(value, F.lit(keep))),
            "mtrunc": F.concat(F.substring(value, 1, keep // 2), F.lit(".."), F.right(value, F.lit(keep - keep // 2))),
        }[cut]
        value = F.when(n > width, short).otherwise(value)
    return padded(value, width, {"<(": "left", "><(": "middle"}.get(kind, "right"))


def _named(name: str, short: int, now: int | None) -> Column:
    indented = lambda text: F.regexp_replace(F.regexp_replace(text, r"\s*$", ""), r"(?m)^", "    ")
    n = F.size("parents")
    raw = lambda who: date_modes(F.col(f"{who}_ts"), F.col(f"{who}_tz"))["raw"]
    extra = {
        "{subject}": lambda: indented(subject_line(F.col("message"))),
        "{message}": lambda: indented(F.col("message")),
        "{merge}": lambda: F.when(n > 1, F.concat(F.lit("Merge: "), _value("p", short, now), F.lit("\n"))).otherwise(""),
        "{parents}": lambda: F.concat_ws("", F.transform("parents", lambda x: F.concat(F.lit("parent "), x, F.lit("\n")))),
        "{araw}": lambda: raw("author"),
        "{craw}": lambda: raw("committer"),
    }
    parts = [extra[piece]() if piece in extra else pretty(piece, short, now) for piece in re.split(r"(\{\w+\})", NAMED[name]) if piece]
    return F.concat(*parts)


def person_matches(who: str, pattern: str, icase: bool = False) -> Column:
    """Whether `name <email>` of the author or committer fits an expression."""
    line = F.concat(F.col(f"{who}_name"), F.lit(" <"), F.col(f"{who}_email"), F.lit(">"))
    return line.rlike(("(?i)" if icase else "") + pattern)


def message_matches(patterns: list[str], message: Column, all_match: bool = False, invert: bool = False, icase: bool = False) -> Column:
    """Whether some line of a message fits some (or, with all_match, each) of the expressions."""
    flags = "(?im)" if icase else "(?m)"
    out = None
    for p in patterns:
        hit = message.rlike(flags + p)
        out = hit if out is None else out & hit if all_match else out | hit
    return ~out if invert else out
