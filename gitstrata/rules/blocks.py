"""How blocks of code open and close in each language."""

from __future__ import annotations

from typing import NamedTuple


class Block(NamedTuple):
    """``shape`` is the way a block closes.

    ``counter``: where opening and closing ``brackets`` balance, or at a line of ``ends``; ``indent``: before a line indented no
    deeper than the first; ``end``: with a line of ``ends``, for ``end_indent`` one indented no deeper than the first; ``statement``: with
    a semicolon or END; ``tag``: where all tags are closed; ``budget``: after ``lines`` further lines. Start words stand anywhere in a
    line, those in ``front`` (all with ``at_front``) at its beginning.
    """

    languages: list[str]
    shape: str
    starts: list[str]
    comments: list[str]
    brackets: str = "{}"
    ends: list[str] = []
    at_front: bool = False
    lines: int = 0
    front: list[str] = []


BLOCKS = [
    Block(["JavaScript", "TypeScript"], "counter", ["function ", "const ", "useState", "class "], ["//"]),
    Block(["Go"], "counter", ["func ", "type ", "struct {", "interface {"], ["//"]),
    Block(["Java", "C#", "C++", "C", "Kotlin", "Scala"], "counter",
          ["class ", "struct ", "public ", "private ", "protected ", "static ", "void ", "int ", "String ", "bool "], ["//", "/*", "*"]),
    Block(["Rust"], "counter", ["fn ", "struct ", "impl ", "trait ", "enum ", "mod "], ["//"]),
    Block(["Swift"], "counter", ["func ", "class ", "struct ", "protocol ", "enum ", "extension "], ["//"]),
    Block(["PHP"], "counter", ["function ", "class ", "interface ", "trait ", "public function", "private function", "protected function"], ["//", "#", "/*"]),
    Block(["Dart", "Flutter"], "counter", ["class ", "Widget ", "StatelessWidget", "StatefulWidget", "void ", "Future<", "Stream<"], ["//"]),
    Block(["Zig", "Nim"], "counter", ["fn ", "pub fn", "proc ", "func ", "type ", "const "], ["//", "#"]),
    Block(["R", "Julia"], "counter", [" function(", " <- function", "function ", "macro "], ["#"], ends=["end"]),
    Block(["CSS", "SCSS", "Sass", "Less"], "counter", ["{"], ["/*", "//"]),
    Block(["Clojure", "ClojureScript"], "counter", ["(defn ", "(defmacro ", "(defprotocol ", "(defrecord "], [";"], brackets="()"),
    Block(["Python"], "indent", ["def ", "class "], ["#"], at_front=True),
    Block(["Haskell", "PureScript"], "indent", ["::", "data ", "type ", "newtype ", "class ", "instance "], ["--"]),
    Block(["F#", "OCaml"], "indent", ["let ", "type ", "module ", "val ", "member "], ["//", "(*"]),
    Block(["YAML", "JSON", "TOML"], "indent", [":"], ["#"]),
    Block(["Ruby", "Crystal"], "end_indent", ["def ", "class ", "module "], ["#"], ends=["end"]),
    Block(["Elixir", "Erlang"], "end_indent", ["def ", "defp ", "defmodule ", "defstruct ", "defprotocol "], ["#"], ends=["end"]),
    Block(["Lua", "Moonscript"], "end", ["function ", " function("], ["--"], ends=["end"], front=["function "]),
    Block(["Shell", "Bash", "Zsh", "Fish"], "end", ["() {"], ["#"], ends=["}"]),
    Block(["PowerShell", "Batch"], "end", ["function ", "Function ", "::", ":", "sub ", "Sub "], ["#", "REM"], ends=["}", "End Sub", "End Function"]),
    Block(["SQL", "MySQL", "PostgreSQL"], "statement", ["CREATE PROCEDURE", "CREATE FUNCTION", "CREATE TRIGGER", "CREATE VIEW"], ["--", "/*"]),
    Block(["HTML", "XML", "SVG"], "tag", ["<component", "<div class=", "<section", "<article", "<main"], ["<!--"]),
]
# Every other language.
REST = Block([], "budget", ["function", "def ", "class ", "interface", "struct", "impl"], [], lines=15)

# A start word with a semicolon and no brace in its line is a declaration without body.
WITH_DECLARATIONS = ["Java", "C#", "C++", "C", "Kotlin", "Scala"]
# A brace opens a block in every line that does not begin with the mark.
STYLE_SHEETS, STYLE_RULE = ["CSS", "SCSS", "Sass", "Less"], "@"
# A line with a start word opens a block only at the left margin.
AT_MARGIN = ["YAML", "JSON", "TOML"]

# Blocks shorter than these are dropped: when closed, and at the end.
MIN_BLOCK = 50
MIN_CANDIDATE = 20
MARKUP_TAGS = ["component", "div", "section", "article", "main"]
