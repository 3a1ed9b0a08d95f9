"""Readers of project trees, manifests, reports and logs.

A project is a relation (file, text, size, modified): a scan of files, or any
table with those columns.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension, glob_regex

#: fixed values: extensions by language, and of languages that are known but not read
LANGUAGES = {
    ".js": "js", ".jsx": "js", ".mjs": "js", ".cjs": "js", ".ts": "js", ".tsx": "js", ".mts": "js", ".cts": "js",
    ".py": "python", ".go": "go", ".rs": "rust", ".rb": "ruby", ".java": "java", ".php": "php",
}
UNSUPPORTED = (".c", ".h", ".cpp", ".hpp", ".cc", ".cs", ".kt", ".kts", ".swift", ".scala", ".ex", ".exs", ".dart", ".lua", ".pl", ".m")
IGNORED = ("node_modules", "dist", "build", "coverage", ".git", ".next", "out")
MAX_BYTES = 1_000_000
#: names that an analysis reads: sources, manifests, pages and the environment's example
READ = "{" + ",".join(f"*{e}" for e in (*LANGUAGES, *UNSUPPORTED, ".json", ".html", ".htm", ".example")) + "}"


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = IGNORED, names: str = READ) -> DataFrame:
    """(file, text, size, modified) of a tree, by the binary file source. Files
    whose names don't fit ``names`` are never opened.

    Hidden names go: Spark's listing skips them all, so .env.example is known
    only to relations that hold it (see :func:`filtered`). Exclude comes before
    ignore, and ignore before include.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    rows = raw.select(F.replace(path, F.lit(base), F.lit("")).alias("file"), F.col("content").cast("string").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return filtered(rows, include, exclude, ignore)


def filtered(rows: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), ignore: tuple[str, ...] = IGNORED) -> DataFrame:
    """The files that a scan keeps."""
    steps = F.split("file", "/")
    keep = ~F.exists(steps, lambda s: s.startswith(".") & (s != ".env.example")) & ~F.arrays_overlap(steps, F.array(*map(F.lit, ignore or ("",))))
    for glob in exclude:
        keep = keep & ~F.col("file").rlike(glob_regex(glob))
    if include:
        wanted = F.lit(False)
        for glob in include:
            wanted = wanted | F.col("file").rlike(glob_regex(glob))
        keep = keep & wanted
    return rows.where(keep)


def with_language(rows: DataFrame, max_bytes: int = MAX_BYTES, polyglot: bool = True) -> DataFrame:
    """All rows with lang and skipped_reason by extension and size; a file that
    is neither read nor skipped has neither."""
    ext = extension(F.col("file"))
    lang = F.coalesce(*[F.when(ext == e, name) for e, name in LANGUAGES.items() if polyglot or name == "js"])
    reason = F.when(ext.isin(*UNSUPPORTED), "unsupported-language").when(F.col("size") > max_bytes, "file-too-large")
    return rows.withColumns({"lang": lang, "skipped_reason": reason})


def routed(rows: DataFrame, max_bytes: int = MAX_BYTES, polyglot: bool = True) -> DataFrame:
    """lang and skipped_reason by extension and size; other files go."""
    return with_language(rows, max_bytes, polyglot).where("lang is not null or skipped_reason = 'unsupported-language'")


def split_cache(rows: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to parse, cached nodes that still hold) by content hash.

    cache: file, sha, and a node's columns; entries of files that are gone or
    changed fall away.
    """
    hashed = rows.withColumn("sha", F.sha1("text"))
    known = cache.select("file", "sha").distinct()
    return hashed.join(known, ["file", "sha"], "left_anti"), cache.join(hashed.select("file", "sha"), ["file", "sha"], "left_semi")


def cache_signature(config: dict) -> str:
    """The part of a configuration that changes what a parse yields."""
    import hashlib

    return hashlib.sha256(json.dumps({k: config.get(k) for k in ("include", "exclude", "maxFileSizeBytes", "polyglot")}, sort_keys=True).encode()).hexdigest()[:16]


def latest_change(rows: DataFrame) -> DataFrame:
    """The newest modification time of a scan."""
    return rows.agg(F.max("modified").alias("latest"))


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas as JSON; strings stay as they are."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = token.sub(lambda m: m[0] if m[0].startswith('"') else " ", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)


def read_jsonc(text: str | None) -> dict:
    """A JSONC object; {} where it doesn't parse."""
    try:
        got = json.loads(strip_jsonc(text or ""))
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def manifest(rows: DataFrame, name: str = "package.json") -> dict:
    """A project's manifest, {} without one: one row of one file."""
    return manifests(rows, name)[0]


def manifests(rows: DataFrame, *names: str) -> list[dict]:
    """The manifests of these names, {} where there is none: a row each."""
    got = {r.file: r.text for r in rows.where(F.col("file").isin(*names)).select("file", "text").collect()}
    return [read_jsonc(got.get(name)) for name in names]


def tag_attributes(rows: DataFrame, tag: str) -> DataFrame:
    """(file, text, hit, attributes) of every opening tag of a kind: the tag as
    written and its attributes by lower-case name, the first of a name."""
    opening = F.regexp_extract_all("text", F.lit(f"(?i)<{tag}(?:\\s+(?:\"[^\"]*\"|'[^']*'|[^\"'>])*)?>"), F.lit(0))
    hits = rows.select("file", "text", F.explode(opening).alias("hit"))
    one = "([^\\s=\"'<>/]+)\\s*=\\s*(\"[^\"]*\"|'[^']*'|[^\\s\"'>]+)"
    names = F.transform(F.regexp_extract_all("hit", F.lit(one), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all("hit", F.lit(one), F.lit(2)), lambda v: F.regexp_replace(v, "^[\"']|[\"']$", ""))
    pairs = F.arrays_zip(names.alias("name"), values.alias("value"))
    first = F.filter(pairs, lambda x, k: F.array_position(names, x["name"]) == k + 1)
    return hits.select("file", "text", "hit", F.map_from_entries(first).alias("attributes"))


def _is_external(src) -> F.Column:
    """An address with a scheme, or of another host."""
    scheme = F.split_part(src, F.lit(":"), F.lit(1))
    return src.startswith("//") | (F.contains(src, F.lit(":")) & scheme.rlike("^[A-Za-z][A-Za-z0-9+.-]*$"))


def module_scripts(rows: DataFrame) -> DataFrame:
    """(html, src) of module scripts in the root's pages, no external ones."""
    pages = rows.where(~F.contains("file", F.lit("/")) & F.col("file").endswith(".html"))
    src = F.col("attributes")["src"]
    found = tag_attributes(pages, "script").where(F.lower(F.col("attributes")["type"]) == "module")
    return found.select(F.col("file").alias("html"), src.alias("src")).where("src <> ''").where(~_is_external(F.col("src")))


def script_references(rows: DataFrame) -> DataFrame:
    """(html, src, line) of relative script sources in any page."""
    name = F.lower("file")
    pages = rows.where(name.endswith(".html") | name.endswith(".htm"))
    src = F.regexp_replace(F.col("attributes")["src"], "[?#].*$", "")
    line = F.size(F.split(F.expr("substring_index(text, hit, 1)"), "\n"))
    found = tag_attributes(pages, "script").select(F.col("file").alias("html"), src.alias("src"), line.alias("line"))
    return found.where("src <> ''").where(~F.col("src").startswith("/") & ~_is_external(F.col("src")))


def read_reports(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Findings of several JSON reports as one queue: source, then the rows."""
    from functools import reduce

    parts = [spark.read.option("multiLine", True).json(path).withColumn("source", F.lit(source)) for source, path in sorted(paths.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_log(spark: SparkSession, path: str, at: str = "timestamp") -> DataFrame:
    """An append-only log of JSON lines by time."""
    return spark.read.json(path).orderBy(at)
