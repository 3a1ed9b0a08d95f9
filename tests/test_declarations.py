"""Extraction of the line-oriented languages, outputs and routes."""

import pytest

from loomgraph.operators.extract import decorator_routes, dynamic_env_reads, env_reads, extract_file
from loomgraph.plans import project
from loomgraph.sources.project import module_scripts, scan, script_references

CASES = {
    "python": ("a.py", "import os, a.b as c\nfrom .x import (y as z,\n  w)\nfrom . import q\nfrom m import *\nasync def go(a):\n    def inner(): pass\nclass K:\n    def _p(self): pass\nclass _H: pass\n# def no(): pass\n'''\ndef doc(): pass\n'''\nif __name__ == \"__main__\":\n    go()\n",
               [("go", True, True, 6), ("inner", False, False, 7), ("_p", False, False, 9)], [("os", ["os"]), ("a.b", ["a"]), (".x", ["y", "w"]), (".", ["q"]), ("m", ["*"])], ["go", "K"], ["python-main-guard"]),
    "go": ("m.go", 'package main\nimport "fmt"\nimport (\n  x "a/b"\n  "c/d"\n)\nfunc main() {\n}\nfunc (r *T) Serve(a int) {}\nfunc low[T any]() {}\n',
           [("main", False, False, 7), ("Serve", True, False, 9), ("low", False, False, 10)], [("fmt", ["fmt"]), ("a/b", ["b"]), ("c/d", ["d"])], ["Serve"], ["go-main"]),
    "rust": ("src/main.rs", "pub mod x;\nmod y;\nuse crate::a::b;\npub(crate) use super::z;\nuse std::io;\npub async fn f() {}\nunsafe fn g() {}\nfn main() {}\n",
             [("f", True, True, 6), ("g", False, False, 7), ("main", False, False, 8)], [("mod:x", ["x"]), ("mod:y", ["y"]), ("crate::a::b", ["b"]), ("super::z", ["z"])], ["f"], ["rust-main"]),
    "ruby": ("a.rb", "require 'set'\nrequire_relative \"lib/x\"\nmodule M\n  class C\n    def self.make(x)\n    end\n    def ok?\n    end\n  end\nend\nif __FILE__ == $0\nend\n",
             [("make", True, False, 5), ("ok?", True, False, 7)], [("set", []), ("./lib/x", [])], ["M", "C", "make", "ok?"], ["ruby-main-guard"]),
    "java": ("A.java", "import java.util.List;\nimport static a.B.c;\npublic final class A {\n  public static void main(String[] a) { }\n  private Map<String, List<X>> go(int b) { if (x) return; }\n  public A() {}\n protected int[] q(\n) {}\n}\ninterface I {}\n",
             [("main", True, False, 4), ("go", False, False, 5), ("q", False, False, 7)], [("java.util.List", ["List"]), ("a.B.c", ["c"])], ["A", "main", "I"], ["java-main"]),
    "php": ("a.php", "<?php\nrequire_once __DIR__ . '/b.php';\n$x = include('c/d.php');\nabstract class K {\n  private static function p($a) {}\n  public function q() {}\n function r() {}\n}\nfunction top() {}\n// function no() {}\n",
            [("p", False, False, 5), ("q", True, False, 6), ("r", True, False, 7), ("top", True, False, 9)], [("./b.php", []), ("c/d.php", [])], ["K", "q", "r", "top"], []),
}


@pytest.mark.parametrize("lang", sorted(CASES))
def test_declarations(lang):
    file, text, functions, imports, exports, hints = CASES[lang]
    node = extract_file(file, lang, text)
    assert [(f["name"], f["exported"], f["is_async"], f["line"]) for f in node["functions"]] == functions
    assert [(i["source"], i["names"]) for i in node["imports"]] == imports
    assert node["exports"] == exports and [h["kind"] for h in node["hints"]] == hints and node["parsed"]


@pytest.mark.parametrize("lang", sorted(CASES))
@pytest.mark.parametrize("text", ["", "def", "func (", "import (", "\"", "pub(", "from", "public static", "require", "/*", "'''"])
def test_broken_sources_are_read(lang, text):
    assert extract_file("x", lang, text)["parsed"]


def test_environment_reads(spark):
    text = "a = process.env.PORT; b = process.env['KEY']; c = process.env[\"KEY\"]; const { HOME, lower, DEBUG: d = 1 } = process.env; process.env[name]; process.env.low; process.environment.X"
    df = spark.createDataFrame([("a.js", text), ("b.js", "process.env.PORT"), ("c.js", None)], "file string, text string")
    assert {(r.key, r.n, tuple(r.files)) for r in env_reads(df).collect()} == {("PORT", 2, ("a.js", "b.js")), ("KEY", 2, ("a.js",)), ("HOME", 1, ("a.js",)), ("DEBUG", 1, ("a.js",))}
    assert [tuple(r) for r in dynamic_env_reads(df).collect()] == [("a.js", 1)]


def test_routes_outputs_and_scripts(spark):
    rows = spark.createDataFrame([
        ("src/users.ts", "js", "@Controller('u')\nclass U {\n  @Get(':id')\n  @UseGuards(A)\n  async one(id) {}\n  @Post()\n  make() {}\n  @Input() name\n}"),
        ("webpack.config.js", "js", "module.exports = { output: { path: path.resolve(__dirname, 'electron'), filename: 'main.js' } }"),
        ("rollup.config.mjs", "js", "export default { output: [{ file: 'lib/a.cjs' }, { dir: \"out\" }] }"),
        ("webpack.config.ts", "js", "export default { output: { path: 'web', filename: '[name].js' } }"),
        ("index.html", None, "<script\n type=\"Module\" data-x='>' src='/src/a.js'></script><SCRIPT type=module src=https://x/y.js></SCRIPT><script src=\"b.js?v=1\"></script>"),
    ], "file string, lang string, text string")
    assert {tuple(r) for r in decorator_routes(rows).collect()} == {("src/users.ts", "Get", "one"), ("src/users.ts", "Post", "make")}
    assert {r.path for r in project.config_outputs(rows).collect()} == {"electron/main.js", "lib/a.cjs", "out", "web"}
    assert [tuple(r) for r in module_scripts(rows).collect()] == [("index.html", "/src/a.js")]
    assert [tuple(r) for r in script_references(rows).collect()] == [("index.html", "b.js", 2)]
    assert project.declared_outputs("npx esbuild a.ts --outfile=./web/x.js -o 'b c.js'") == ["web/x.js", "b c.js"] and project.declared_outputs("cp --file a b") == []
    assert project.started_script("NODE_ENV=x node --inspect src/a.mjs --y") == "src/a.mjs" and project.started_script("nodemon a.js") is None


def test_scan_opens_only_what_it_reads(spark, tmp_path):
    for name, text in {"src/a.js": "let a", "README.md": "x", "b.py": "b", ".env.example": "A=1", "node_modules/c.js": "c", ".hid/d.js": "d", "e.bin": "\0"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    assert {(r.file, r.text) for r in scan(spark, str(tmp_path)).collect()} == {("src/a.js", "let a"), ("b.py", "b")}
    assert {r.file for r in scan(spark, str(tmp_path), names="*.md").collect()} == {"README.md"}
