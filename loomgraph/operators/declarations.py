"""Declarations of line-oriented languages, read from a token stream.

A source becomes tokens (words, strings, punctuation) without comments. Each
language is a :class:`Grammar`: which words may precede a declaration, which word
opens a function, a type or an import, and who sees the name. One scanner walks
the statements of every language; what differs in kind (how an import is
written, how Java names a method) is a small reader of its own.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

_TEXT = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`"
_REST = r"|[^\W\d]\w*[?!]?(?![=\w])|[^\W\d]\w*|\d[\w.]*|::|\n|[^\s\w]"
_COMMENTS = {"hash": r"#[^\n]*", "slash": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "php": r"(?:#(?!\[)|//)[^\n]*|/\*.*?(?:\*/|\Z)", "python": r"#[^\n]*|(?:\"\"\".*?(?:\"\"\"|\Z))|(?:'''.*?(?:'''|\Z))"}


@dataclass
class Token:
    text: str
    line: int
    column: int

    @property
    def is_word(self) -> bool:
        return self.text[0].isalpha() or self.text[0] == "_"

    @property
    def literal(self) -> str | None:
        return self.text[1:-1] if self.text[0] in "\"'`" and len(self.text) > 1 else None


def tokens(source: str, comments: str) -> list[Token]:
    """Tokens with line ends; a string or comment of several lines is one."""
    out, line, begin = [], 1, 0
    for m in re.finditer(f"(?P<skip>{_COMMENTS[comments]})|{_TEXT}{_REST}", source, re.S):
        if m["skip"] is None:
            out.append(Token(m[0], line, m.start() - begin))
        ends = m[0].count("\n")
        if ends:
            line += ends
            begin = m.start() + m[0].rindex("\n") + 1
    return out


@dataclass
class Found:
    functions: list[tuple[str, bool, bool, int]] = field(default_factory=list)  # name, exported, async, line
    exports: list[str] = field(default_factory=list)
    imports: list[tuple[str, list[str]]] = field(default_factory=list)
    hints: list[tuple[str, str]] = field(default_factory=list)


class Cursor:
    """A place among the tokens of one source."""

    def __init__(self, rows: list[Token]):
        self.rows, self.at = rows, 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.rows[k].text if k < len(self.rows) else "\n"

    def literal(self) -> str | None:
        return self.rows[self.at].literal if self.at < len(self.rows) else None

    def word(self) -> bool:
        return self.at < len(self.rows) and self.rows[self.at].is_word

    def skip_group(self, opening: str = "(", closing: str = ")") -> None:
        """Past a balanced group that begins here."""
        depth = 0
        while self.at < len(self.rows):
            depth += (self.peek() == opening) - (self.peek() == closing)
            self.at += 1
            if not depth:
                return

    def path(self, joints: tuple[str, ...]) -> str:
        """Words and the joints between them, as one name."""
        out = ""
        while self.word() or self.peek() in joints:
            if self.word() and out and out[-1] not in "".join(joints):
                break
            out += self.peek()
            self.at += 1
        return out


Reader = Callable[[Cursor, Found], None]


def _python_import(c: Cursor, found: Found) -> None:
    while True:
        name = c.path((".",))
        if not name:
            return
        found.imports.append((name, [name.split(".")[0]]))
        if c.peek() == "as":
            c.at += 2
        if c.peek() != ",":
            return
        c.at += 1


def _python_from(c: Cursor, found: Found) -> None:
    source = ""
    while c.peek() == ".":
        source += "."
        c.at += 1
    if c.peek() != "import":
        source += c.path((".",))
    if c.peek() != "import":
        return
    c.at += 1
    grouped, names = c.peek() == "(", []
    c.at += grouped
    while c.peek() != ")" and (grouped or c.peek() != "\n") and c.at < len(c.rows):
        if c.word() or c.peek() == "*":
            names.append(c.peek())
            if c.peek(1) == "as":
                c.at += 2
        c.at += 1
    found.imports.append((source, names))


def _go_import(c: Cursor, found: Found) -> None:
    grouped = c.peek() == "("
    while c.at < len(c.rows) and c.peek() != ")":
        if (path := c.literal()) is not None:
            found.imports.append((path, [path.split("/")[-1]]))
            if not grouped:
                return
        c.at += 1


def _rust_mod(c: Cursor, found: Found) -> None:
    if c.word() and c.peek(1) == ";":
        found.imports.append((f"mod:{c.peek()}", [c.peek()]))


def _rust_use(c: Cursor, found: Found) -> None:
    if c.peek() in ("crate", "super", "self"):
        path = c.path(("::",)).removesuffix("::")
        if "::" in path:
            found.imports.append((path, [path.split("::")[-1]]))


def _literal_import(prefix: str) -> Reader:
    def read(c: Cursor, found: Found) -> None:
        c.at += c.peek() == "("
        if c.literal():
            found.imports.append((prefix + c.literal(), []))

    return read


def _java_import(c: Cursor, found: Found) -> None:
    c.at += c.peek() == "static"
    name = c.path((".",))
    if c.peek() == ";":
        found.imports.append((name, [name.split(".")[-1]]))


def _php_include(c: Cursor, found: Found) -> None:
    c.at += c.peek() == "("
    here = c.peek() == "__DIR__" and c.peek(1) == "."
    c.at += 2 * here
    path = c.literal()
    if path and path.endswith(".php"):
        found.imports.append((f"./{path.removeprefix('/')}" if here else path.removeprefix("/"), []))


def _java_method(c: Cursor, mods: list[str], line: int, found: Found) -> None:
    """``access type name(``: the last word before the parenthesis."""
    words: list[str] = []
    while c.at < len(c.rows) and (c.word() or c.peek() in ("<", ">", "[", "]", ",", ".", "?", "&", "\n")):
        if c.word():
            words.append(c.peek())
        c.at += 1
    if c.peek() == "(" and len(words) > 1:
        shown = "public" in mods
        found.functions.append((words[-1], shown, False, line))
        if shown:
            found.exports.append(words[-1])
        if words[-1] == "main" and shown and "static" in mods and "void" in words:
            found.hints.append(("java-main", f"main at line {line}"))


@dataclass(frozen=True)
class Grammar:
    comments: str
    function: str = ""
    modifiers: frozenset[str] = frozenset()
    types: frozenset[str] = frozenset()
    imports: dict[str, Reader] = field(default_factory=dict)
    #: who sees a function: (modifiers, name, whether it begins its line) -> bool
    shown: Callable[[list[str], str, bool], bool] = lambda mods, name, outer: True
    #: imports may stand inside an expression
    anywhere: bool = False
    #: (hint, the words of a guard of the main program)
    guard: tuple[str, tuple[str, ...]] = ("", ())


_ACCESS = frozenset({"public", "protected", "private"})
GRAMMARS = {
    "python": Grammar(
        "python", "def", frozenset({"async"}), frozenset({"class"}), {"import": _python_import, "from": _python_from},
        lambda mods, name, outer: outer and not name.startswith("_"), guard=("python-main-guard", ("if", "__name__", "=", "=", "__main__")),
    ),
    "go": Grammar("slash", "func", imports={"import": _go_import}, shown=lambda mods, name, outer: "A" <= name[:1] <= "Z"),
    "rust": Grammar(
        "slash", "fn", frozenset({"pub", "async", "unsafe", "const", "extern"}), imports={"mod": _rust_mod, "use": _rust_use},
        shown=lambda mods, name, outer: "pub" in mods,
    ),
    "ruby": Grammar(
        "hash", "def", types=frozenset({"class", "module"}), imports={"require": _literal_import(""), "require_relative": _literal_import("./")},
        guard=("ruby-main-guard", ("if", "__FILE__", "=", "=", "$")),
    ),
    "java": Grammar("slash", modifiers=_ACCESS | {"static", "final", "abstract", "synchronized", "sealed"}, types=frozenset({"class", "interface", "enum", "record"}), imports={"import": _java_import}),
    "php": Grammar(
        "php", "function", _ACCESS | {"static", "final", "abstract"}, frozenset({"class", "interface", "trait"}),
        {w + once: _php_include for w in ("require", "include") for once in ("", "_once")},
        lambda mods, name, outer: not {"private", "protected"} & set(mods), anywhere=True,
    ),
}


def _guarded(c: Cursor, words: tuple[str, ...]) -> bool:
    return bool(words) and all((c.rows[c.at + k].literal or c.peek(k)) == w for k, w in enumerate(words) if c.at + k < len(c.rows)) and c.at + len(words) <= len(c.rows)


def declarations(lang: str, file: str, source: str) -> Found:
    """What a source of the language declares and imports."""
    g, found = GRAMMARS[lang], Found()
    c = Cursor(tokens(source, g.comments))
    package_main = False
    while c.at < len(c.rows):
        start = not c.at or c.rows[c.at - 1].text in ("\n", ";", "{", "}")
        here = c.rows[c.at]
        if not (start or g.anywhere and here.text in g.imports) or not here.is_word:
            c.at += 1
            continue
        if _guarded(c, g.guard[1]):
            found.hints.append((g.guard[0], f"main guard at line {here.line}"))
        mods: list[str] = []
        while c.peek() in g.modifiers:
            mods.append(c.peek())
            c.at += 1
            if c.peek() == "(" and mods[-1] == "pub":
                c.skip_group()
            elif c.literal() and mods[-1] == "extern":
                c.at += 1
        word, outer = c.peek(), here.column == 0
        if word in g.imports:
            c.at += 1
            g.imports[word](c, found)
        elif word == g.function:
            c.at += 1
            if lang == "go" and c.peek() == "(":
                c.skip_group()
            if lang == "ruby" and c.peek() == "self":
                c.at += 2
            c.at += c.peek() == "&"
            if c.word():
                name = c.peek()
                if lang == "ruby" and c.peek(1) == "=" and c.at + 2 < len(c.rows) and c.rows[c.at + 1].column == c.rows[c.at].column + len(name) and c.peek(2) == "(":
                    name += "="
                shown = g.shown(mods, name, outer)
                found.functions.append((name, shown, "async" in mods, here.line))
                if shown:
                    found.exports.append(name)
                if lang == "rust" and name == "main" and (file == "main.rs" or file.endswith("/main.rs")):
                    found.hints.append(("rust-main", f"main at line {here.line}"))
        elif word in g.types:
            c.at += 1
            if c.word() and (lang != "python" or g.shown(mods, c.peek(), outer)):
                found.exports.append(c.peek())
        elif lang == "java" and _ACCESS & set(mods):
            _java_method(c, mods, here.line, found)
        elif lang == "go" and word == "package":
            package_main = c.peek(1) == "main"
        c.at += 1
    if package_main and any(f[0] == "main" for f in found.functions):
        found.hints.append(("go-main", "package main with func main()"))
    found.exports = list(dict.fromkeys(found.exports))
    return found
