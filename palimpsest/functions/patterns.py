"""Compilers of patterns to Spark columns: globs, path patterns, ref patterns, boolean search expressions.

Patterns become regular expressions without look-around, so that the JVM's engine and others agree on them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str, pathname: bool = True) -> str:
    """A glob as an anchored regular expression.

    With pathname, * and ? stop at a slash; **/ stands for any directories, /** for everything inside, ** alone for anything.
    """
    out, i, n = [], 0, len(pattern)
    one = "[^/]" if pathname else "(?s:.)"
    while i < n:
        c = pattern[i]
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            stars = j - i
            left = i == 0 or pattern[i - 1] == "/"
            if pathname and stars >= 2 and left and j < n and pattern[j] == "/":
                out.append("(?:.*/)?")
                j += 1
            elif pathname and stars >= 2 and left and j == n:
                out.append(".*")
            elif pathname:
                out.append("[^/]*")
            else:
                out.append(".*")
            i = j
        elif c == "?":
            out.append(one)
            i += 1
        elif c == "[":
            j = i + 1
            if j < n and pattern[j] in "!^":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:
                out.append(r"\[")
                i += 1
            else:
                body = pattern[i + 1 : j].replace("\\", "\\\\")
                negated = body[:1] in ("!", "^")
                body = body[1:] if negated else body
                body = body.replace("[", r"\[").replace("^", r"\^") if not body.startswith("[:") else f"[{body}]"
                out.append(f"[{'^/' if negated and pathname else '^' if negated else ''}{body}]")
                i = j + 1
        elif c == "\\" and i + 1 < n:
            out.append(re.escape(pattern[i + 1]))
            i += 2
        else:
            out.append(re.escape(c))
            i += 1
    return "^" + "".join(out) + "$"


def simple_glob(pattern: str) -> str:
    """* and ? only, both crossing slashes: the patterns of tag listings."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def ref_matches(name: Column, pattern: str) -> Column:
    """A full name, a prefix up to a slash, or a glob."""
    bare = pattern.rstrip("/")
    out = (name == pattern) | name.startswith(f"{bare}/")
    return out | name.rlike(glob_regex(pattern)) if any(c in pattern for c in "*?[") else out


def tail_matches(name: Column, pattern: str) -> Column:
    """A match from the end, on whole components."""
    return name.rlike(f"(^|/){re.escape(pattern)}$")


@dataclass(frozen=True)
class PathPattern:
    """A path pattern with its magic words."""

    pattern: str
    exclude: bool = False
    icase: bool = False
    literal: bool = False
    glob: bool = False
    top: bool = False

    @classmethod
    def parse(cls, text: str) -> PathPattern:
        """`path`, `:(word,word)path`, `:!path`, `:^path`, `:/path`."""
        words: set[str] = set()
        if text.startswith(":(") and ")" in text:
            inner, text = text[2:].split(")", 1)
            words = {w.split(":")[0] for w in inner.split(",")}
        elif text.startswith(":"):
            text = text[1:]
            while text[:1] in ("!", "^", "/"):
                words.add("top" if text[0] == "/" else "exclude")
                text = text[1:]
        return cls(text, "exclude" in words, "icase" in words, "literal" in words, "glob" in words, "top" in words)

    def column(self, path: Column) -> Column:
        """Whether a path is the pattern, lies below it, or fits it as a glob."""
        pattern = self.pattern.rstrip("/")
        if self.icase:
            path, pattern = F.lower(path), pattern.lower()
        if pattern in ("", "."):
            return F.lit(True)
        out = (path == pattern) | path.startswith(pattern + "/")
        if not self.literal and any(c in pattern for c in "*?["):
            # without the word glob a star crosses slashes
            regex = glob_regex(pattern, pathname=self.glob)
            out = out | path.rlike(regex) | path.rlike(regex[:-1] + "/")
        return out


def pathspec(path: Column, patterns: list[str]) -> Column:
    """Any of the positive patterns (all paths, without one) and none of the excluding ones."""
    parsed = [PathPattern.parse(p) for p in patterns]
    wanted, barred = F.lit(not any(not p.exclude for p in parsed)), F.lit(False)
    for p in parsed:
        if p.exclude:
            barred = barred | p.column(path)
        else:
            wanted = wanted | p.column(path)
    return wanted & ~barred


def _rule_regex(body: str) -> tuple[str, bool]:
    """The expression that a path (without a slash at its end) has to fit, and whether the rule is for directories alone."""
    directory = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    regex = glob_regex(body.lstrip("/"))[1:]
    return ("^" if anchored else "(?:^|/)") + regex, directory


def _rule_lines(rules: list[str]) -> list[str]:
    """Rules without comments, blank lines and trailing blanks; a backslash keeps a leading # or ! and a blank at the end."""
    kept = [re.sub(r"(?<!\\) +$", "", rule) for rule in rules]
    return [rule for rule in kept if rule and not rule.startswith("#")]


def path_steps(path: Column) -> Column:
    """(path, is_dir) of each directory above a path, from the top, and of the path itself; a slash at its end makes it a directory."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    n = F.size(parts)
    step = lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("path"), ((i < n) | path.endswith("/")).alias("is_dir"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), step)).otherwise(F.array().cast("array<struct<path:string,is_dir:boolean>>"))


def ignore_rules(path: Column, rules: list[str]) -> Column:
    """Whether ordered ignore rules leave a path out.

    Each directory above the path is asked first, from the top: what lies in an excluded one is out and can't be taken back.
    At each step the last rule that fits decides; ! takes back; a rule that ends in / is for directories alone.
    """
    parsed = []
    for rule in _rule_lines(rules):
        negated = rule.startswith("!")
        body = rule[1:] if negated else rule.removeprefix("\\") if rule[:2] in ("\\!", "\\#") else rule
        parsed.append((*_rule_regex(body), negated))

    def out(step: Column) -> Column:
        decided = F.lit(False)
        for regex, directory, negated in parsed:
            fits = step["path"].rlike(regex)
            decided = F.when(fits & step["is_dir"] if directory else fits, not negated).otherwise(decided)
        return decided

    return F.exists(path_steps(path), out)


def path_attributes(path: Column, rules: list[str], names: list[str]) -> dict[str, Column]:
    """For each name the value that ordered attribute rules give a path: `set`, `unset`, a value, or null where unspecified.

    A rule is a pattern and words `name`, `-name`, `!name` or `name=value`; the last that fits decides, for each name on its own.
    """
    out = {name: F.lit(None).cast("string") for name in names}
    for rule in _rule_lines(rules):
        pattern, *words = rule.split()
        regex, directory = _rule_regex(pattern)
        if directory:  # a directory's attributes aren't those of what lies in it
            continue
        for word in words:
            name, equals, value = word.lstrip("-!").partition("=")
            if name in out:
                given = F.lit("unset") if word[0] == "-" else F.lit(None).cast("string") if word[0] == "!" else F.lit(value if equals else "set")
                out[name] = F.when(path.rlike(regex), given).otherwise(out[name])
    return out


def hidden_ref(name: Column, rules: list[str], stripped: Column | None = None) -> Column:
    """Whether ordered rules hide a reference: a rule fits a whole name or one that goes on behind a slash; the last that fits decides.

    ! shows again; ^ asks for the full name where `stripped` gives the one without a namespace, which other rules look at.
    """
    out = F.lit(False)
    for rule in rules:
        shown = rule.startswith("!")
        body = rule.removeprefix("!")
        column = name if body.startswith("^") or stripped is None else stripped
        body = body.removeprefix("^").rstrip("/")
        out = F.when((column == body) | column.startswith(f"{body}/"), not shown).otherwise(out)
    return out


#: What stands for itself in a basic expression and is special in an extended one; behind a backslash it is the other way round.
_BASIC_PLAIN = "+?|(){}"


def basic_regex(pattern: str) -> str:
    """A basic regular expression as an extended one."""
    out, i, bracket = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if bracket:
            out.append(c)
            bracket = c != "]"
        elif c == "[":
            out.append(c)
            bracket = True
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(pattern[i] if pattern[i] in _BASIC_PLAIN else "\\" + pattern[i])
        elif c in _BASIC_PLAIN:
            out.append("\\" + c)
        elif c == "*" and (not out or out[-1] in ("^", "(")):
            out.append("\\*")
        else:
            out.append(c)
        i += 1
    return "".join(out)


def word_regex(pattern: str) -> str:
    """A match that no word character touches on either side."""
    return rf"(?<!\w)(?:{pattern})(?!\w)"


def is_binary(data: Column, look: int = 8000) -> Column:
    """Whether a NUL stands in the first characters of a file."""
    return F.contains(F.substring(data, 1, look), F.lit("\0"))


# boolean search expressions ------------------------------------------------------------------


def grep_expression(line: Column, expression) -> Column:
    """A nested expression over regular expressions as a condition.

    A string is a pattern; ("and", x, y…), ("or", x, y…) and ("not", x) combine; ("fixed", s) and ("icase", s) are other kinds of pattern.
    """
    if isinstance(expression, str):
        return line.rlike(expression)
    word, *parts = expression
    if word == "fixed":
        return F.contains(line, F.lit(parts[0]))
    if word == "icase":
        return line.rlike("(?i)" + parts[0])
    if word == "not":
        return ~grep_expression(line, parts[0])
    conditions = [grep_expression(line, p) for p in parts]
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c if word == "and" else out | c
    return out


def parse_grep(tokens: list[str]):
    """Tokens `-e pattern`, `--and`, `--or`, `--not`, `(`, `)` as a nested expression; neighbours without a word are joined by or."""
    at = 0

    def either():
        nonlocal at
        parts = [both()]
        while at < len(tokens) and tokens[at] != ")":
            if tokens[at] == "--or":
                at += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both():
        nonlocal at
        parts = [atom()]
        while at < len(tokens) and tokens[at] == "--and":
            at += 1
            parts.append(atom())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def atom():
        nonlocal at
        if at >= len(tokens):
            raise ValueError("an expression is missing")
        token = tokens[at]
        at += 1
        if token == "--not":
            return ("not", atom())
        if token == "(":
            inner = either()
            if at >= len(tokens) or tokens[at] != ")":
                raise ValueError("unmatched (")
            at += 1
            return inner
        if token == "-e":
            at += 1
            return tokens[at - 1]
        raise ValueError(f"not an expression: {token}")

    out = either()
    if at != len(tokens):
        raise ValueError("unmatched )")
    return out
