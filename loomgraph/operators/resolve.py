"""References to files that exist: candidates in order, first hit.

A reference is resolved by expanding it into candidate paths, joining them with
the files, and taking the first that exists. Edges go only to existing files.
Package references of Go and Java meet files on exploded path suffixes, so no
join compares every pair.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import dirname, suffixes
from ..session import cut

#: fixed values: the order in which extensions, index files and sources are tried
JS_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".mjs", ".cjs")
JS_INDEX = ("/index.js", "/index.ts")
JS_SWAP = ((".js", (".ts", ".tsx")), (".mjs", (".mts",)), (".cjs", (".cts",)))
SOURCE_EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
#: fixed values: folders of built files, and conditions of exports in order
BUILD_FOLDERS = ("dist", "build", "lib", "out", "output", "es", "esm", "cjs", ".output")
CONDITIONS = ("import", "require", "node", "default")
#: fixed values: names that the runtimes define
GLOBAL_NAMES = (
    "console", "JSON", "Math", "Object", "Array", "Promise", "Number", "String", "Date", "process", "Buffer", "Set", "Map", "RegExp", "Error", "Symbol", "Boolean", "URL",
    "fetch", "setTimeout", "clearTimeout", "setInterval", "clearInterval", "parseInt", "parseFloat", "isNaN", "structuredClone", "queueMicrotask", "require", "import",
)


@dataclass
class Config:
    """What a project's manifest and compiler options say of its references."""

    name: str | None = None
    imports: dict = field(default_factory=dict)
    exports: dict | str | None = None
    #: (prefix, suffix or None, [(prefix, suffix)])
    aliases: list = field(default_factory=list)
    out_dir: str | None = None
    source_dir: str | None = None

    @classmethod
    def of(cls, manifest: dict, compiler: dict) -> Config:
        options = compiler.get("compilerOptions") or {}
        base, aliases = options.get("baseUrl") or ".", []
        for key, goals in (options.get("paths") or {}).items():
            head, star, tail = key.partition("*")
            places = []
            for goal in goals if isinstance(goals, list) else ():
                before, _, after = goal.partition("*")
                places.append((posixpath.normpath(posixpath.join(base, before)) + ("/" if before.endswith("/") else ""), after))
            if places:
                aliases.append((head, tail if star else None, places))
        tidy = lambda v: v.removeprefix("./").removesuffix("/") if isinstance(v, str) else None
        return cls(manifest.get("name"), manifest.get("imports") or {}, manifest.get("exports"), aliases, tidy(options.get("outDir")), tidy(options.get("rootDir")))


def condition(value) -> str | None:
    """The target of a conditional map."""
    if isinstance(value, dict):
        return next((t for c in CONDITIONS if (t := condition(value.get(c)))), None)
    return value if isinstance(value, str) else None


def mapped(table, spec: str) -> str | None:
    """The target of a subpath: exact, else the first pattern that fits."""
    if not isinstance(table, dict):
        return None
    if spec in table:
        return condition(table[spec])
    for key, value in table.items():
        head, star, tail = key.partition("*")
        if star and spec.startswith(head) and spec.endswith(tail) and len(spec) >= len(head) + len(tail):
            goal = condition(value)
            return goal.replace("*", spec[len(head) : len(spec) - len(tail)], 1) if goal else None
    return None


def try_file(base: str) -> list[str]:
    """Candidates of one module path, in order."""
    base = posixpath.normpath(base)
    swapped = [base[: -len(e)] + n for e, new in JS_SWAP if base.endswith(e) for n in new]
    return [base, *(base + e for e in JS_EXTENSIONS), *(base + e for e in JS_INDEX), *swapped]


def candidates(lang: str, file: str, spec: str, config: Config) -> tuple[list[str], str]:
    """(paths in order, what the reference is if none exists)."""
    here = posixpath.dirname(file) or "."
    near = lambda *p: posixpath.normpath(posixpath.join(here, *p))
    if lang == "js":
        if spec[:1] in (".", "/"):
            return try_file(posixpath.join(here, spec.lstrip("/") if spec.startswith("/") else spec)), "unresolved"
        if spec.startswith("#"):
            goal = mapped(config.imports, spec)
            return (try_file(goal.removeprefix("./")) if goal else []), "unresolved"
        for head, tail, places in config.aliases:
            if tail is None:
                if spec != head:
                    continue
                rest = ""
            elif spec.startswith(head) and spec.endswith(tail):
                rest = spec[len(head) : len(spec) - len(tail)]
            else:
                continue
            return [c for before, after in places for c in try_file(posixpath.join(before, rest + after))], "unresolved"
        if config.name and (spec == config.name or spec.startswith(config.name + "/")):
            path = "." + spec[len(config.name) :]
            goal = config.exports if isinstance(config.exports, str) and path == "." else mapped(config.exports, path)
            if goal:
                return try_file(goal.removeprefix("./")), "external"
        return [], "external"
    if lang == "python":
        dots = len(spec) - len(spec.lstrip("."))
        path = "/".join(x for x in spec[dots:].split(".") if x)
        bases = [near("../" * (dots - 1), path)] if dots else [posixpath.normpath(path), near(path)]
        out = []
        for b in bases:
            out += [f"{b}.py", f"{b}/__init__.py"] if b not in (".", "") else [near("__init__.py")] if dots else []
        return out, "unresolved" if dots else "external"
    if lang == "rust":
        if spec.startswith("mod:"):
            return [near(f"{spec[4:]}.rs"), near(spec[4:], "mod.rs")], "unresolved"
        steps = spec.split("::")[1:]
        roots = ("src", ".") if spec.startswith("crate") else (here,)
        longest = [posixpath.normpath(posixpath.join(r, *steps[:n])) for r in roots for n in range(len(steps), 0, -1)]
        return [c for b in longest for c in (f"{b}.rs", f"{b}/mod.rs")], "unresolved"
    if lang == "ruby":
        if spec.startswith(("./", "../")):
            return [near(spec if spec.endswith(".rb") else f"{spec}.rb")], "unresolved"
        return [f"lib/{spec}.rb", f"{spec}.rb"], "external"
    if lang == "php":
        return [posixpath.normpath(near(spec) if spec.startswith(("./", "../")) else spec), near(spec)], "unresolved"
    return [], "external" if lang in ("go", "java") else "unresolved"


def first_existing(refs: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """keys and target: the first of each row's ``candidates`` that is a file."""
    options = refs.select(*keys, F.posexplode("candidates").alias("_pos", "_path"))
    return options.join(files.select(F.col("file").alias("_path")).distinct().hint("merge"), "_path").groupBy(*keys).agg(F.min_by("_path", "_pos").alias("target"))


def resolve_imports(imports: DataFrame, files: DataFrame, config: Config | None = None) -> DataFrame:
    """Import edges: file, seq, to_file, external, unresolved. A Go import has
    an edge for each file of the package, all of one seq."""
    config = config or Config()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [candidates(lang, file, spec, config) for file, lang, spec in zip(*(b.column(k).to_pylist() for k in (0, 1, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.string())], names=["file", "lang", "seq", "source", "candidates", "otherwise"])

    refs = imports.select("file", "lang", "seq", "source").mapInArrow(run, "file string, lang string, seq int, source string, candidates array<string>, otherwise string")
    by_path = first_existing(refs, files, ["file", "seq"])
    go = imports.where("lang = 'go'").select("file", "seq", F.posexplode(suffixes(F.col("source"))).alias("pos", "folder"))
    packages = files.where(F.col("file").endswith(".go")).select(F.col("file").alias("target"), F.explode(suffixes(dirname(F.col("file")))).alias("folder")).where("folder <> '.'")
    longest = F.min("pos").over(Window.partitionBy("file", "seq"))
    by_package = go.join(packages.hint("merge"), "folder").withColumn("best", longest).where("pos = best").select("file", "seq", "target")
    java = imports.where("lang = 'java'").select("file", "seq", F.concat(F.replace("source", F.lit("."), F.lit("/")), F.lit(".java")).alias("tail"))
    classes = files.where(F.col("file").endswith(".java")).select(F.col("file").alias("target"), F.explode(suffixes(F.col("file"))).alias("tail"))
    by_class = java.join(classes.hint("merge"), "tail").groupBy("file", "seq").agg(F.min("target").alias("target"))
    hits = by_path.unionByName(by_package).unionByName(by_class)
    return refs.join(hits.hint("merge"), ["file", "seq"], "left").select(
        "file", "seq", F.col("target").alias("to_file"),
        F.when(F.col("target").isNull() & (F.col("otherwise") == "external"), F.col("source")).alias("external"),
        F.when(F.col("target").isNull() & (F.col("otherwise") == "unresolved"), F.col("source")).alias("unresolved"),
    )


def import_stats(edges: DataFrame) -> DataFrame:
    """resolved, internal and rate; a package import counts once."""
    once = edges.groupBy("file", "seq").agg(F.bool_or(F.col("to_file").isNotNull()).alias("hit"), F.bool_or(F.col("unresolved").isNotNull()).alias("miss"))
    n = F.count_if("hit") + F.count_if("miss")
    return once.agg(F.count_if("hit").alias("resolved"), n.alias("internal"), F.when(n > 0, F.count_if("hit") / n).otherwise(1.0).alias("rate"))


def source_candidates(declared: str, config: Config) -> list[str]:
    """Sources that a declared build path may come from, itself first."""
    bare = re.sub(r"\.[cm]?[jt]sx?$", "", declared)
    bases = []
    if config.out_dir and bare.startswith(config.out_dir + "/"):
        rest = bare[len(config.out_dir) + 1 :]
        bases += [posixpath.join(b, rest) for b in (config.source_dir, "src", "source", "") if b is not None]
    head, _, rest = bare.partition("/")
    if rest and head in BUILD_FOLDERS:
        bases += [posixpath.join(b, rest) for b in ("src", "source", "lib", "")]
    return [declared, *(c for b in bases for c in (*(b + e for e in SOURCE_EXTENSIONS), b))]


def unique_names(names: DataFrame) -> DataFrame:
    """(name, id) of the names that one id alone bears. names: name, id."""
    return names.groupBy("name").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other").select("name", "id")


def resolve_calls(functions: DataFrame, imports: DataFrame, edges: DataFrame) -> DataFrame:
    """Call edges: file, fn, call, to_id, resolution; the first rule that fits.

    functions: file, name, exported, receiver, calls; imports: file, seq, names.
    Names from references that don't resolve count as external.
    """
    calls = functions.select("file", F.col("name").alias("fn"), "receiver", F.explode("calls").alias("call"))
    #: dealt by their first names, with what follows those
    bare = F.substring_index("call", ".", 1)
    calls = calls.select("file", "fn", "receiver", bare.alias("bare"), F.substr("call", F.length(bare) + 1).alias("rest"))
    local = functions.select("file", "name").distinct()
    #: references and their edges meet by file, and so do the names that they bind
    referred = imports.select("file", "seq", "names", F.lit(None).cast("string").alias("to_file"), F.lit(False).alias("edge"))
    led = edges.select("file", "seq", F.lit(None).cast("array<string>").alias("names"), "to_file", F.lit(True).alias("edge"))
    refs = referred.unionByName(led).where("file is not null and seq is not null").repartition("file").groupBy("file", "seq").agg(
        F.flatten(F.collect_list("names")).alias("names"), F.max("to_file").alias("to_file"), F.bool_or("edge").alias("led"), F.bool_or(F.col("edge") & F.col("to_file").isNull()).alias("outside"))
    named = refs.where("led").select("file", "seq", "to_file", "outside", F.explode("names").alias("bare"))
    bound = named.groupBy("file", "bare").agg(F.max_by("to_file", F.when(F.col("to_file").isNotNull(), F.col("seq"))).alias("from_file"), F.bool_or("outside").alias("outside"))
    bound = cut(bound.sortWithinPartitions("file", "bare"), "bound")
    unique = unique_names(functions.where("exported").select("name", F.concat_ws("#", "file", "name").alias("id"))).select(F.col("name").alias("bare"), F.col("id").alias("unique_id"))
    has = lambda names, key, flag: names.select("file", F.col("name").alias(key), F.lit(True).alias(flag)).hint("merge")
    defined = local.select(F.col("file").alias("from_file"), F.col("name").alias("bare"))
    #: what an imported name means is looked up once for its file, not for each call; only what is found comes back
    asked = bound.where("from_file is not null").select("file", "bare", "from_file")
    by_file = asked.join(defined.hint("merge"), ["from_file", "bare"]).select("file", "bare", F.lit(True).alias("defines"), F.lit(None).cast("string").alias("unique_id"))
    by_name = asked.join(unique.hint("merge"), "bare").select("file", "bare", F.lit(None).cast("boolean").alias("defines"), "unique_id")
    found = by_file.unionByName(by_name).groupBy("file", "bare").agg(F.bool_or("defines").alias("defines"), F.max("unique_id").alias("unique_id"))
    meant = bound.join(found.hint("merge"), ["file", "bare"], "left")
    all_in = calls.join(has(local, "bare", "is_bare"), ["file", "bare"], "left").join(meant.hint("merge"), ["file", "bare"], "left").withColumn("call", F.concat("bare", "rest"))
    #: calls with dots, and methods of one's own, can only mean names with dots
    methods = cut(functions.select("file", "name").where(F.contains("name", F.lit("."))).distinct(), "methods")
    if methods.isEmpty():
        all_in = all_in.withColumns({"own": F.lit(None).cast("string"), "is_method": F.lit(False), "is_own": F.lit(False)})
    else:
        own = F.when((F.col("bare") == "this") & F.col("receiver").isNotNull(), F.concat("receiver", F.lit(".prototype."), F.substring("rest", 2, 1 << 30)))
        all_in = all_in.withColumn("own", own).join(has(methods, "call", "is_method"), ["file", "call"], "left").join(has(methods, "own", "is_own"), ["file", "own"], "left")
    inside, dotted = F.col("from_file").isNotNull(), F.contains("call", F.lit("."))
    rules = [
        (F.when(dotted, F.col("is_method")).otherwise(F.col("is_bare")), "local", F.concat_ws("#", "file", "call")),
        (F.col("is_own"), "local-receiver", F.concat_ws("#", "file", "own")),
        (inside & ~dotted & F.col("defines"), "cross-file", F.concat_ws("#", "from_file", "bare")),
        (inside & F.col("unique_id").isNotNull(), "cross-file", F.col("unique_id")),
        (inside & ~dotted, "unresolved", F.lit(None).cast("string")),
        (F.col("outside"), "external", F.lit(None).cast("string")),
        (F.col("bare").isin(*GLOBAL_NAMES), "global", F.lit(None).cast("string")),
        (F.col("is_bare"), "local-receiver", F.concat_ws("#", "file", "bare")),
        (dotted, "dynamic", F.lit(None).cast("string")),
    ]
    resolution, target = F.lit("unresolved"), F.lit(None).cast("string")
    for test, name, goal in reversed(rules):
        resolution, target = F.when(test, name).otherwise(resolution), F.when(test, goal).otherwise(target)
    return all_in.select("file", "fn", "call", F.col("bare").alias("receiver"), target.alias("to_id"), resolution.alias("resolution"))


def call_stats(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """resolved, total and rate; dynamic calls are no part of either."""
    total = F.count_if(F.col("resolution") != "dynamic")
    good = F.count_if(~F.col("resolution").isin("dynamic", "unresolved"))
    return calls.groupBy(*keys).agg(good.alias("resolved"), total.alias("total"), F.when(total > 0, good / total).otherwise(1.0).alias("rate"))


def lookup_path(files: DataFrame, arg: str) -> DataFrame:
    """A user's path: exact, else by suffix when one file alone fits."""
    exact = files.where(F.col("file") == arg).select("file")
    ends = files.where(F.col("file").endswith("/" + arg)).select("file")
    if not exact.isEmpty():
        return exact
    return ends.join(ends.agg(F.count("*").alias("n")).where("n = 1").select(F.lit(True).alias("one")))
