"""The revision language, from text to DataFrames.

`main..topic`, `^a b`, `a...b`, `tag~3^2`, `branch@{2}`, `branch@{date}`, `:/text`: names become (name, oid) rows through
ordinary joins; only the few names of one expression are ever on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import approximate
from . import graph, log
from .refs import resolve_short


@dataclass(frozen=True)
class Name:
    """A base name with its steps: ('~', n), ('^', n), ('@', n or text), ('peel', type)."""

    base: str
    steps: tuple = ()


@dataclass
class Selection:
    """Names that count, names that don't, and pairs of a symmetric difference."""

    positive: list[Name] = field(default_factory=list)
    negative: list[Name] = field(default_factory=list)
    symmetric: list[tuple[Name, Name]] = field(default_factory=list)


def parse_name(text: str) -> Name:
    if text.startswith(":/"):
        return Name(text)
    m = re.match(r"^([^~^@]*|@)(?=$|[~^]|@\{)", text)
    if not m:
        raise ValueError(f"not a revision: {text}")
    base, rest, steps = m[1] or "HEAD", text[m.end() :], []
    base = "HEAD" if base == "@" else base
    while rest:
        if m := re.match(r"~(\d*)", rest):
            steps.append(("~", int(m[1] or 1)))
        elif m := re.match(r"\^\{([a-z/]*)\}", rest):
            steps.append(("peel", m[1]))
        elif m := re.match(r"\^(\d*)", rest):
            steps.append(("^", int(m[1] or 1)))
        elif m := re.match(r"@\{(\d+)\}", rest):
            steps.append(("@", int(m[1])))
        elif m := re.match(r"@\{([^}]+)\}", rest):
            steps.append(("@", m[1]))
        else:
            raise ValueError(f"not a revision: {text}")
        rest = rest[m.end() :]
    return Name(base, tuple(steps))


def parse(tokens: list[str]) -> Selection:
    """The names of a command's revisions; --not turns the sense of those that follow."""
    out, turned = Selection(), False
    for token in tokens:
        if token == "--not":
            turned = not turned
        elif "..." in token:
            a, b = (parse_name(x or "HEAD") for x in token.split("...", 1))
            out.symmetric.append((a, b))
        elif ".." in token:
            a, b = (parse_name(x or "HEAD") for x in token.split("..", 1))
            (out.positive if turned else out.negative).append(a)
            (out.negative if turned else out.positive).append(b)
        else:
            away = token.startswith("^") != turned
            (out.negative if away else out.positive).append(parse_name(token.lstrip("^")))
    return out


class Resolver:
    """Names to commits, against tables of one repository."""

    def __init__(self, refs: DataFrame, edges: DataFrame, commits: DataFrame, reflog: DataFrame | None = None, now: int = 0):
        self.refs, self.edges, self.commits, self.reflog, self.now = refs, edges, commits, reflog, now

    def one(self, name: Name) -> DataFrame:
        """(oid): no row for a name that stands for nothing."""
        spark = self.refs.sparkSession
        if name.base.startswith(":/"):
            hit = self.commits.filter(F.col("subject").rlike(name.base[2:])).orderBy(F.desc("ts"), "oid").limit(1).select("oid")
        else:
            names = spark.createDataFrame([(name.base,)], "name string")
            hit = resolve_short(names, self.refs).select("oid", "refname")
            whole = self.commits.filter(F.col("oid").cast("string") == name.base).select("oid")
            hit = hit.select("oid").union(whole).limit(1)
        for step, value in name.steps:
            if step == "~":
                for _ in range(value):
                    hit = self.parent(hit, 1)
            elif step == "^":
                hit = self.parent(hit, value) if value else hit
            elif step == "@":
                hit = self.logged(name.base, value)
        return hit

    def parent(self, hit: DataFrame, n: int) -> DataFrame:
        return hit.join(self.edges.filter(F.col("ord") == n), "oid").select(F.col("parent").alias("oid"))

    def logged(self, base: str, value) -> DataFrame:
        if self.reflog is None:
            raise ValueError("no reference log")
        own = self.reflog.filter(F.col("ref").cast("string") == base)
        if isinstance(value, int):
            return log.selector(own, value + 1).filter(F.col("n") == value).select(F.col("new_id").alias("oid"))
        at = approximate(value, self.now)
        return own.filter(F.col("ts") <= at).orderBy(F.desc("seq")).limit(1).select(F.col("new_id").alias("oid"))

    def select(self, selection: Selection) -> DataFrame:
        """(oid): what the positive names reach and the negative ones don't."""

        def reached(names: list[Name]) -> DataFrame:
            tips = None
            for n in names:
                tips = self.one(n) if tips is None else tips.union(self.one(n))
            return graph.walk(tips.select(F.lit(0).alias("tip"), "oid"), self.edges).select("oid").distinct()

        out = reached(selection.positive) if selection.positive else None
        if out is not None and selection.negative:
            out = out.join(reached(selection.negative), "oid", "left_anti")
        for a, b in selection.symmetric:
            left, right = reached([a]), reached([b])
            both = left.join(right, "oid", "left_anti").union(right.join(left, "oid", "left_anti"))
            out = both if out is None else out.union(both)
        if out is None:
            raise ValueError("no revision is asked for")
        return out.distinct()
