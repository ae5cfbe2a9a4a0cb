"""Listing paths by globs: one matcher for all patterns, and the first so many paths without sorting all of them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Splitters of a round, and paths that may be ordered in one place.
SPLITTERS, SMALL = 64, 50_000
#: A name may not begin with a dot where a wildcard stands for its beginning.
SHOWN = r"(?!\.)"


def alternatives(pattern: str) -> list[str]:
    """``pattern`` with its braces spelled out: a{b,c{d,e}} gives ab, acd and ace. Braces without a comma stay."""
    depth, start, cuts = 0, -1, []
    for i, c in enumerate(pattern):
        if c == "{":
            depth += 1
            if depth == 1:
                start, cuts = i, [i]
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if not depth and len(cuts) > 1:
                inner = [pattern[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], i], strict=True)]
                return [x for part in inner for x in alternatives(pattern[:start] + part + pattern[i + 1 :])]
    return [pattern]


def _name(part: str) -> str:
    """A regular expression for one name of a path."""
    out, i = SHOWN if part[:1] in ("*", "?", "[") else "", 0
    while i < len(part):
        end = part.find("]", i + 2) if part[i] == "[" else -1
        if part[i] == "*":
            out += "[^/]*"
            i += len(part[i:]) - len(part[i:].lstrip("*"))
            continue
        if part[i] == "?":
            out += "[^/]"
        elif end > 0:
            inner = part[i + 1 : end]
            negated = inner[0] in "!^"
            body = re.sub(r"([\\\[\]^&])", r"\\\1", inner[negated:])
            out += f"[^/{body}]" if negated else f"[{body}]"
            i = end
        elif part[i] == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(part[i])
        i += 1
    # a name made of stars alone is not empty
    return out + "(?<!/)" if not part.strip("*") else out


def regex(pattern: str) -> str:
    """The regular expression of a glob: * and ? stay inside a name, ** stands for any folders, [a-z] and [!a-z] for characters, {a,b} for either."""
    found = []
    for one in alternatives(pattern):
        parts, out = one.split("/"), ""
        for k, part in enumerate(parts):
            last = k == len(parts) - 1
            if part == "**":
                out += rf"(?:{SHOWN}[^/]+/)*{SHOWN}[^/]+" if last else rf"(?:{SHOWN}[^/]+/)*"
            else:
                out += (rf"{SHOWN}[^/]+" if part == "*" else _name(part)) + ("" if last else "/")
        found.append(out)
    return "^(?:" + "|".join(found) + ")$"


def matching(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether one of ``include`` (or none is given) and none of ``exclude`` matches; each side is one expression. A null path never matches."""
    one = lambda patterns: path.rlike("|".join(map(regex, patterns)))
    found = one(include) if include else path.isNotNull()
    return F.coalesce(found & ~one(exclude) if exclude else found, F.lit(False))


def first(paths: DataFrame, n: int, column: str = "path", small: int = SMALL) -> DataFrame:
    """The ``n`` first rows of ``paths`` in the order of ``column``; of equal paths at the cut any.

    Sampled splitters part the paths into ranges, which are counted; the range in which the n-th lies is parted again until it is small. Ranges before it are taken whole, so only that range is ordered.
    """
    path = F.col(column)
    taken, rest, open_, left = [], paths.where(path.isNotNull()), None, n
    size = rest.count()
    while size > max(small, 1) and left < size:
        few = rest.sample(min(1.0, 40 * SPLITTERS / size), seed=7).select(column).distinct().limit(100 * SPLITTERS)
        sample = sorted(r[0] for r in few.collect())
        cuts = sorted(set(sample[:: max(1, len(sample) // SPLITTERS)]))
        at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < path))
        counts = dict(rest.groupBy(at.alias("k")).count().collect()) if cuts else {}
        before = k = 0
        while k in range(len(cuts) + 1) and before + counts.get(k, 0) < left:
            before, k = before + counts.get(k, 0), k + 1
        if counts.get(k, 0) == size:
            break  # one path makes up the range
        low = path > F.lit(cuts[k - 1]) if k else F.lit(True)
        high = path <= F.lit(cuts[k]) if k < len(cuts) else F.lit(True)
        if k:
            taken.append(rest.where(path <= F.lit(cuts[k - 1])))
        rest, size, left = rest.where(low & high), counts.get(k, 0), left - before
    open_ = rest.orderBy(column).limit(left) if left < size else rest
    for part in taken:
        open_ = open_.unionAll(part)
    return open_
