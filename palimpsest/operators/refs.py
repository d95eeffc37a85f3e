"""Reference operators: format language, sorting, pages, resolution of short names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import short_ref, version_key

#: The rules by which a short name stands for a reference, in order: fixed values.
SHORT_RULES = ["{}", "refs/{}", "refs/tags/{}", "refs/heads/{}", "refs/remotes/{}", "refs/remotes/{}/HEAD"]


_PIECE = re.compile(r"%\([^)]*\)|%%|%[0-9a-fA-F]{2}|[^%]+|%")


def _atom(name: str, atoms: dict[str, Column]) -> Column:
    base, _, option = name.partition(":")
    if name in atoms:
        return atoms[name]
    if base in atoms and option == "short":
        return short_ref(atoms[base]) if base == "refname" else F.substring(atoms[base].cast("string"), 1, 7)
    if base in atoms and re.fullmatch(r"(lstrip|strip|rstrip)=-?\d+", option):
        kind, n = option.split("=")
        parts, k = F.split(atoms[base], "/"), int(n)
        if kind == "rstrip":
            return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - k, F.lit(0)) if k >= 0 else F.least(F.lit(-k), F.size(parts))), "/")
        return F.array_join(F.slice(parts, F.lit(k + 1), F.size(parts)) if k >= 0 else F.slice(parts, F.greatest(F.size(parts) + k + 1, F.lit(1)), F.size(parts)), "/")
    raise ValueError(f"unknown atom: {name}")


def _joined(parts: list[Column]) -> Column:
    return F.concat(*parts) if parts else F.lit("")


def format_column(template: str, atoms: dict[str, Column]) -> Column:
    """A `%(atom)` template as one column; `%%` is a percent sign, `%xx` a character by its hex code.

    `%(align:width[,right|middle])…%(end)` pads, `%(if[:equals=x|:notequals=x])…%(then)…[%(else)…]%(end)` chooses: what stands between if and then
    is compared, or has to hold more than blanks.  Atoms that a template doesn't name are never computed: the plan's columns are pruned.
    """
    pieces = _PIECE.findall(template)
    at = 0

    def until(*stops: str) -> tuple[Column, str]:
        nonlocal at
        parts: list[Column] = []
        while at < len(pieces):
            piece = pieces[at]
            at += 1
            if piece in stops:
                return _joined(parts), piece
            if piece.startswith("%(align:"):
                width, _, side = piece[8:-1].partition(",")
                inner, _ = until("%(end)")
                parts.append(padded(inner, int(width), side or "left"))
            elif piece.startswith("%(if"):
                test, value = piece[4:-1].lstrip(":").partition("=")[::2]
                asked, _ = until("%(then)")
                yes, stop = until("%(else)", "%(end)")
                no = until("%(end)")[0] if stop == "%(else)" else F.lit("")
                holds = asked == value if test == "equals" else asked != value if test == "notequals" else F.trim(asked) != ""
                parts.append(F.when(holds, yes).otherwise(no))
            elif piece.startswith("%("):
                parts.append(F.coalesce(_atom(piece[2:-1], atoms).cast("string"), F.lit("")))
            elif piece == "%%":
                parts.append(F.lit("%"))
            elif re.fullmatch("%[0-9a-fA-F]{2}", piece):
                parts.append(F.lit(chr(int(piece[1:], 16))))
            else:
                parts.append(F.lit(piece))
        if stops:
            raise ValueError(f"{stops[-1]} is missing")
        return _joined(parts), ""

    return until()[0]


def padded(text: Column, width: int, side: str) -> Column:
    """Blanks up to a width; a longer text stays whole."""
    n = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    before = F.lit(0) if side == "left" else n if side == "right" else F.floor(n / 2).cast("int")
    return F.concat(F.repeat(F.lit(" "), before), text, F.repeat(F.lit(" "), n - before))


def sort_keys(keys: list[str]) -> list[Column]:
    """Sort keys as given on a command line: the last is the primary one, - reverses, version: compares versions, icase: leaves case out, refname breaks ties."""
    out = []
    for key in [*reversed(keys), "refname"]:
        down = key.startswith("-")
        name = key.lstrip("-")
        column = version_key(F.col(name.split(":", 1)[1])) if name.startswith(("version:", "v:")) else F.lower(F.col(name[6:])) if name.startswith("icase:") else F.col(name)
        out.append(column.desc() if down else column.asc())
    return out


def page_after(refs: DataFrame, marker: str, size: int) -> DataFrame:
    """The page of names that follows a marker, with more telling whether another page follows."""
    following = refs.filter(F.col("refname") > marker).orderBy("refname").limit(size + 1)
    numbered = following.withColumn("n", F.row_number().over(Window.orderBy("refname")))
    return numbered.withColumn("more", F.max("n").over(Window.partitionBy()) > size).filter(F.col("n") <= size)


def resolve_short(names: DataFrame, refs: DataFrame) -> DataFrame:
    """(name, refname, oid, matches): the first rule under which a short name exists, and how many do."""
    full = F.array(*[F.replace(F.lit(rule), F.lit("{}"), F.col("name")) for rule in SHORT_RULES])
    tried = names.select("name", F.posexplode(full).alias("rule", "refname"))
    found = tried.join(refs.select("refname", "oid"), "refname")
    return found.groupBy("name").agg(F.min_by(F.struct("refname", "oid"), "rule").alias("x"), F.count("*").alias("matches")).select("name", "x.refname", "x.oid", "matches")


def abbreviations(ids: DataFrame, column: str = "id", least: int = 7) -> DataFrame:
    """(id, short): the shortest prefix of at least `least` characters that no other id shares.

    Neighbours in sorted order share the most, so that two window looks a row suffice; ids are dealt by their first
    `least` characters, as an id shares fewer with those of another part: each part is a small fraction of the whole.
    """
    d = ids.select(F.col(column).alias("id")).distinct().withColumn("fan", F.substring("id", 1, least))
    near = Window.partitionBy("fan").orderBy("id")

    def shared(other: Column) -> Column:
        n = F.length("id")
        same = F.filter(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("id"), F.lit(1), i) == F.substring(other, F.lit(1), i))
        return F.when(other.isNull(), 0).otherwise(F.size(same))

    with_near = d.withColumn("before", F.lag("id").over(near)).withColumn("after", F.lead("id").over(near))
    length = F.greatest(F.lit(least), shared(F.col("before")) + 1, shared(F.col("after")) + 1)
    return with_near.select("id", F.substring(F.col("id"), F.lit(1), length).alias("short"))
