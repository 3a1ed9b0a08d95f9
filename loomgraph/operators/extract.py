"""Entities of source files: functions, imports, exports, calls, entry hints.

One Arrow pass turns (file, lang, text) into nested nodes; child relations are
exploded from it. JavaScript is read by regular expressions, other languages by
their declarations, so all nodes are heuristic and earn half credit.
Extraction never fails: a file that can't be read is a node that isn't parsed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .declarations import declarations

SCHEMA = (
    "file string, lang string, parser_kind string, parsed boolean, parse_errors int, loc int, module_type string, var_count int, "
    "functions array<struct<name:string,exported:boolean,is_async:boolean,line:int,end_line:int,params:int,receiver:string,shape_hash:string,calls:array<string>>>, "
    "imports array<struct<source:string,names:array<string>,type_only:boolean>>, exports array<string>, hints array<struct<kind:string,detail:string>>"
)

def _function(name: str, exported: bool, line: int, is_async: bool = False, **more) -> dict:
    return {"name": name, "exported": exported, "is_async": is_async, "line": line, "end_line": None, "params": 0, "receiver": None, "shape_hash": None, "calls": []} | more


def _declared(lang: str, file: str, text: str) -> dict:
    """Functions, imports, exports and hints of a source in a line-oriented language."""
    found = declarations(lang, file, text)
    return {
        "functions": [_function(name, shown, line, is_async) for name, shown, is_async, line in found.functions],
        "imports": [{"source": source, "names": names, "type_only": False} for source, names in found.imports],
        "exports": found.exports, "hints": [{"kind": kind, "detail": detail} for kind, detail in found.hints],
    }


_JS_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/", re.S)
_JS_IMPORT = re.compile(r"\bimport\s+(?P<type>type\s+)?(?P<what>[\w*{}\s,$]+?)\s+from\s*[\"'](?P<from>[^\"']+)[\"']|\bimport\s*[\"'](?P<bare>[^\"']+)[\"']|(?:\b(?:const|let|var)\s+(?P<bound>\{[^}]*\}|[\w$]+)\s*=\s*(?:await\s+)?)?\b(?:require|import)\s*\(\s*[\"'](?P<called>[^\"']+)[\"']\s*\)|\bexport\s+(?P<retype>type\s+)?(?P<again>\*(?:\s+as\s+[\w$]+)?|\{[^}]*\})\s*from\s*[\"'](?P<reexport>[^\"']+)[\"']")
_JS_FUNCTION = re.compile(r"(?P<export>\bexport\s+(?:default\s+)?)?(?:(?P<async>\basync\s+)?\bfunction\b\s*\*?\s*(?P<name>[\w$]+)\s*\((?P<args>[^)]*)\)|\b(?:const|let|var)\s+(?P<bound>[\w$]+)\s*=\s*(?P<basync>async\s+)?(?:function\b\s*[\w$]*\s*\((?P<fargs>[^)]*)\)|\((?P<aargs>[^)]*)\)\s*=>|(?P<one>[\w$]+)\s*=>)|(?P<recv>[\w$]+)\.prototype\.(?P<method>[\w$]+)\s*=\s*function\s*\((?P<margs>[^)]*)\))")
_JS_EXPORT = re.compile(r"\bexport\s+(?:default\s+)?(?:async\s+)?(?:function\s*\*?|class|const|let|var|interface|type|enum)\s+([\w$]+)|\bexport\s*\{([^}]*)\}|\bmodule\.exports\s*=\s*\{([^}]*)\}|\bmodule\.exports\s*=\s*([\w$]+)|\b(?:module\.)?exports\.([\w$]+)\s*=")
_JS_CALL = re.compile(r"(?<![\w$.])([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\(")
_JS_KEYWORDS = frozenset("if for while switch catch return function typeof await async new throw super in of do else void delete yield import require".split())


def _names(group: str) -> list[str]:
    """Local names of an import or export clause."""
    if "*" in group and "{" not in group:
        return [group.split()[-1]] if " as " in group else ["*"]
    out = []
    for part in re.sub(r"[{}]", ",", group).split(","):
        part = re.split(r"\s+as\s+|\s*:\s*", part.strip())[-1].removeprefix("type ").strip()
        if re.fullmatch(r"[\w$]+", part):
            out.append(part)
    return out


def shape_hash(source: str, own: str) -> str | None:
    """A hash of a function's structure: identifiers bound in it as VARn,
    literals by kind, callees and properties as they are; None under 4 lines."""
    if source.count("\n") < 3:
        return None
    bound: dict[str, str] = {own: "SELF"}
    for m in re.finditer(r"\b(?:const|let|var)\s+([\w$]+)|\(([\w$,\s]*)\)\s*(?:=>|\{)|\bfunction\s+([\w$]+)", source):
        for name in re.findall(r"[\w$]+", " ".join(x or "" for x in m.groups())):
            bound.setdefault(name, f"VAR{len(bound)}")
    out = []
    for m in re.finditer(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`|\d[\w.]*|(\.\s*)?([A-Za-z_$][\w$]*)|[^\s\w]+", source):
        if m[2]:
            out.append(m[0] if m[1] else bound.get(m[2], m[2]))
        else:
            out.append("STR" if m[0][0] in "\"'`" else "NUM" if m[0][0].isdigit() else m[0])
    return hashlib.sha1(" ".join(out).encode()).hexdigest()[:16]


def _javascript(text: str) -> dict:
    code = _JS_BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    imports, spans, seen = [], [], {}
    for m in _JS_IMPORT.finditer(code):
        g = m.groupdict()
        source = g["from"] or g["bare"] or g["called"] or g["reexport"]
        imports.append({"source": source, "names": _names(g["what"] or g["bound"] or g["again"] or ""), "type_only": bool(g["type"] or g["retype"])})
    exports: list[str] = []
    for m in _JS_EXPORT.finditer(code):
        if re.match(r"\s*from\b", code[m.end() :]):
            continue
        exports += [x for x in (m[1], m[4], m[5]) if x] + (_names(m[2] or m[3] or "") if m[2] or m[3] else [])
    for m in _JS_FUNCTION.finditer(code):
        g = m.groupdict()
        name = g["name"] or g["bound"] or f"{g['recv']}.prototype.{g['method']}"
        args = next((g[k] for k in ("args", "fargs", "aargs", "margs") if g[k] is not None), g["one"] or "")
        at = code.find("{", m.end())
        end = m.end()
        if at >= 0 and not code[m.end() : at].strip(" \n\t:=>"):
            depth = 0
            for k in range(at, len(code)):
                depth += (code[k] == "{") - (code[k] == "}")
                if not depth:
                    end = k + 1
                    break
        else:
            stop = code.find("\n", m.end())
            end = stop if stop >= 0 else len(code)
        line = code.count("\n", 0, m.start()) + 1
        spans.append((m.start(), end, name))
        own = _function(
            name, bool(g["export"]) or name in exports, line, bool(g["async"] or g["basync"]), end_line=line + code.count("\n", m.start(), end),
            params=len([a for a in args.split(",") if a.strip()]), receiver=g["recv"], shape_hash=shape_hash(code[m.start() : end], name),
        )
        if name in seen:  # declared twice: calls merge, the last shape counts
            seen[name] |= {"shape_hash": own["shape_hash"], "receiver": own["receiver"] or seen[name]["receiver"], "exported": own["exported"] or seen[name]["exported"]}
        else:
            seen[name] = own
    declared = {m.start("name") for m in _JS_FUNCTION.finditer(code) if m["name"]}
    for m in _JS_CALL.finditer(code):
        if m[1] in _JS_KEYWORDS or m.start() in declared:
            continue
        inside = [s for s in spans if s[0] <= m.start() < s[1]]
        if inside:
            calls = seen[max(inside)[2]]["calls"]
            if m[1] not in calls:
                calls.append(m[1])
    module = "module" if re.search(r"^\s*(?:import|export)\b", code, re.M) else "script"
    return {"functions": list(seen.values()), "imports": imports, "exports": exports, "hints": [], "module_type": module, "var_count": len(re.findall(r"\bvar\s+[\w${\[]", code))}


def extract_file(file: str, lang: str | None, text: str | None) -> dict:
    """One node; never raises."""
    node = {"file": file, "lang": lang, "parser_kind": "heuristic", "parsed": False, "parse_errors": 0, "loc": 0, "module_type": None, "var_count": 0, "functions": [], "imports": [], "exports": [], "hints": []}
    if text is None or lang is None:
        return node
    text = text.removeprefix("\ufeff")
    lines = re.split(r"\r?\n", text)
    node["loc"] = len(lines)
    try:
        node |= _javascript(text) if lang == "js" else _declared(lang, file, text)
        node["parsed"] = True
    except (KeyError, ValueError, IndexError, RecursionError):
        return node
    if lines[0].startswith("#!") and lang != "js":
        node["hints"].append({"kind": "shebang", "detail": lines[0][:60]})
    return node


def extract(files: DataFrame) -> DataFrame:
    """Nodes of (file, lang, text) rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [extract_file(*x) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("file", "lang", "text").mapInArrow(run, SCHEMA)


def functions_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("file", F.explode("functions").alias("f")).select("file", "f.*")


def imports_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("file", "lang", F.posexplode("imports").alias("seq", "i")).select("file", "lang", "seq", "i.*")


def exports_of(nodes: DataFrame) -> DataFrame:
    return nodes.select("file", F.explode("exports").alias("name"))


def _after_environment(text) -> F.Column:
    """What follows each mention of the environment object, and what precedes."""
    return F.split(text, "\\bprocess\\.env\\b")


def env_reads(files: DataFrame) -> DataFrame:
    """(key, n, files) of environment reads in JavaScript sources: by member, by
    literal subscript, and by taking the object apart."""
    name = "[A-Z_][A-Z0-9_]*"
    parts = files.where(F.contains("text", F.lit("process.env"))).select("file", _after_environment(F.col("text")).alias("parts"))
    member = F.transform(F.slice("parts", 2, 1 << 30), lambda x: F.coalesce(F.nullif(F.regexp_extract(x, f"^\\.({name})(?!\\w)", 1), F.lit("")), F.regexp_extract(x, f"^\\['({name})'\\]", 1)))
    double = F.transform(F.slice("parts", 2, 1 << 30), lambda x: F.regexp_extract(x, f"^\\[\"({name})\"\\]", 1))
    #: a part that ends in "{...} =" takes keys out by name
    apart = F.transform("parts", lambda x: F.regexp_extract(x, "\\{([^{}]*)\\}\\s*=\\s*$", 1))
    taken = F.transform(F.split(F.array_join(F.filter(F.slice(apart, 1, F.size("parts") - 1), lambda x: x != ""), ","), ","), lambda x: F.trim(F.regexp_replace(x, "[:=].*$", "")))
    keys = F.filter(F.concat(member, double, taken), lambda x: x.rlike(f"^{name}$"))
    hits = parts.select("file", F.explode(keys).alias("key"))
    return hits.groupBy("key").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("file")).alias("files"))


def dynamic_env_reads(files: DataFrame) -> DataFrame:
    """(file, n): reads of the environment by a subscript that is no literal."""
    parts = files.where(F.contains("text", F.lit("process.env"))).select("file", _after_environment(F.col("text")).alias("parts"))
    counted = parts.select("file", F.size(F.filter(F.slice("parts", 2, 1 << 30), lambda x: x.rlike("^\\[[^'\"\\]]"))).alias("n"))
    return counted.where("n > 0")


#: fixed values: method decorators that declare a route
ROUTE_DECORATORS = ("Get", "Post", "Put", "Delete", "Patch", "Options", "Head", "All")


def decorator_routes(files: DataFrame) -> DataFrame:
    """(file, decorator, method) of route decorators on methods: the decorator,
    further decorators and modifiers, then the method's name."""
    tag = F.regexp_extract_all("text", F.lit(f"@(?:{'|'.join(ROUTE_DECORATORS)})\\s*\\([^)]*\\)(?:\\s*@\\w+(?:\\([^)]*\\))?)*\\s*(?:(?:public|private|protected|static|async)\\s+)*\\w+\\s*\\("), F.lit(0))
    hits = files.where((F.col("lang") == "js") & F.contains("text", F.lit("@"))).select("file", F.explode(tag).alias("hit"))
    return hits.select("file", F.regexp_extract("hit", "^@(\\w+)", 1).alias("decorator"), F.regexp_extract("hit", "(\\w+)\\s*\\($", 1).alias("method"))
