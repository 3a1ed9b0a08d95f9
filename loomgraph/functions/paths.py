"""Paths and globs as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCE_EXT = "\\.(js|ts|jsx|tsx|mjs|cjs|py|go|rs|rb|java|php)$"
#: a test file: by anchored folder, by any folder, and by folder or name
TEST_FILE = "(\\.test\\.|\\.spec\\.|__tests__/|(^|/)tests?/)"
TEST_PATH = "(\\.test\\.|\\.spec\\.|__tests__/|tests?/)"


def dirname(path: Column) -> Column:
    """Folder of a posix path, . for a bare name."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), "(\\.[^./]+)$", 1)


def strip_extension(path: Column) -> Column:
    return F.regexp_replace(path, SOURCE_EXT, "")


def normalize(path: Column) -> Column:
    """Posix path without empty, . and inner .. segments, by one fold."""
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    done = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when((s == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    joined = F.array_join(done, "/")
    return F.when(joined == "", F.lit(".")).otherwise(joined)


def join(folder: Column, spec: Column) -> Column:
    return normalize(F.concat(folder, F.lit("/"), spec))


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def suffixes(path: Column) -> Column:
    """All suffixes of a path that begin at a segment, longest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def is_test_file(path: Column) -> Column:
    """Anchored: contests/x.js is no test."""
    return path.rlike(TEST_FILE)


def has_test_path(path: Column) -> Column:
    """Unanchored: contests/x.js is a test."""
    return path.rlike(TEST_PATH)


def generated_name(path: Column) -> Column:
    """A segment of the file name says that a tool wrote it."""
    return F.arrays_overlap(F.split(basename(path), "[-._]"), F.array(*[F.lit(x) for x in ("bundle", "bundled", "min", "generated")]))


def glob_regex(glob: str) -> str:
    """Include and exclude globs: ** any folders, * one segment, ? one
    character, and dir/** also dir itself."""
    out, i = "", 0
    if glob.endswith("/**"):
        return "^" + glob_regex(glob[:-3])[1:-1] + "(?:/.*)?$"
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def annotation_regex(glob: str) -> str:
    """Annotation globs: ** any text, * one segment; ? is no wildcard but makes
    the character before it optional."""
    out = re.sub(r"([.+^${}()|\[\]\\])", r"\\\1", glob).replace("**", "\0").replace("*", "[^/]*").replace("\0", ".*")
    return f"^{out}$"


def static_prefix(glob: str) -> str:
    """The folders of a glob before its first wildcard."""
    steps = []
    for s in glob.split("/")[:-1]:
        if re.search(r"[*?{\[]", s):
            break
        steps.append(s)
    return "/".join(steps)


def name_key_source(path: Column) -> Column:
    """A source's name without folder, extension, case, dashes, underscores."""
    return F.regexp_replace(F.lower(basename(strip_extension(path))), "[-_]", "")
