"""Glob dialects. They differ in what stars cross, in case and in anchoring, so results depend on the dialect."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: dialect -> (what ``**/``, ``**``, ``*`` and ``?`` become, whether case counts, whether the whole path must fit)
DIALECTS = {
    "path": ("(?:.*/)?", ".*", "[^/]*", "[^/]", False, True),
    "strict": (".*/", ".*", "[^/]*", ".", True, True),
    "key": (".*", ".*", ".*", r"\?", False, True),
    "loose": (".*", ".*", ".*", r"\?", True, False),
}


def glob_regex(glob: str, dialect: str = "path") -> str:
    """The regular expression of a literal glob, the same for Java, RE2 and Python."""
    dirs, deep, star, one, case, whole = DIALECTS[dialect]
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + dirs, i + 3
        elif glob.startswith("**", i):
            out, i = out + deep, i + 2
        elif glob[i] in "*?":
            out, i = out + (star if glob[i] == "*" else one), i + 1
        else:
            out, i = out + re.sub(r"[^\w/ ]", lambda m: "\\" + m[0], glob[i]), i + 1
    return ("" if case else "(?i)") + (f"^{out}$" if whole else out)


def glob_column(glob: Column, dialect: str = "path") -> Column:
    """The same for a column of globs."""
    dirs, deep, star, one, case, whole = DIALECTS[dialect]
    out = F.regexp_replace(glob, r"([^\w/ *?])", r"\\$1")
    for a, b in (("**/", "\x01"), ("**", "\x02"), ("*", "\x03"), ("?", "\x04")):
        out = F.replace(out, F.lit(a), F.lit(b))
    for a, b in (("\x01", dirs), ("\x02", deep), ("\x03", star), ("\x04", one)):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit(("" if case else "(?i)") + ("^" if whole else "")), out, F.lit("$" if whole else ""))


def fits(path: Column, glob: str, dialect: str = "path") -> Column:
    """Whether a path fits a literal glob. Besides ``DIALECTS``: ``exact`` is strict, but a path always fits itself, and both may have backslashes; ``like`` knows ``*`` alone, and SQL's own signs."""
    if dialect == "like":
        return path.like(like_pattern(glob))
    if dialect == "exact":
        glob = glob.replace("\\", "/")
        return (normal(path) == glob) | F.rlike(normal(path), F.lit(glob_regex(glob, "strict")))
    return F.rlike(path, F.lit(glob_regex(glob, dialect)))


def like_pattern(key: str) -> str:
    """A key with stars as a LIKE pattern."""
    return key.replace("*", "%")


def normal(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def ignore_globs(text: str) -> list[str]:
    """Globs of an ignore file: blanks, comments and negations go; a bare name counts for files and folders of that name anywhere."""
    out = []
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] in "#!":
            continue
        if line.startswith("/"):
            out.append(line[1:])
        elif line.endswith("/"):
            out.append(f"**/{line}**")
        elif "/" in line or "*" in line:
            out.append(line)
        else:
            out += [f"**/{line}", f"**/{line}/**"]
    return out


def parts(path: Column) -> Column:
    """``folder, name, stem, extension`` of a path with either slash; the extension in lower case, without its point."""
    p = normal(path)
    name = F.substring_index(p, "/", -1)
    extension = F.lower(F.regexp_extract(name, r"[^.]\.([^.]+)$", 1))
    stem = F.when(extension == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(extension) - 1))
    folder = F.when(F.contains(p, F.lit("/")), F.substring(p, F.lit(1), F.length(p) - F.length(name) - 1)).otherwise("")
    return F.struct(folder.alias("folder"), name.alias("name"), stem.alias("stem"), extension.alias("extension"))


def relative(path: Column, root: Column) -> Column:
    """A path below a root as it is seen from there; any other path as it is."""
    p, r = normal(path), F.concat(F.rtrim(normal(root), F.lit("/")), F.lit("/"))
    return F.when(p.startswith(r), F.substring(p, F.length(r) + 1, F.length(p))).otherwise(p)
