"""What is known of programming languages: how declarations begin, common words, comments and strings, files of prose."""

from __future__ import annotations

from typing import NamedTuple


class Declaration(NamedTuple):
    prefix: str
    #: The name declared stands right behind the prefix; elsewhere on the line is no declaration.
    binds: bool = False


def _declarations(kinds: str = "", binding: str = "", exact: tuple[str, ...] = (), before: tuple[str, ...] = ("",), mark: str = "") -> list[Declaration]:
    """Every kind of declaration behind every modifier; words of several parts are joined by a plus sign."""
    word = lambda m, k: f"{mark}{m}{k.replace('+', ' ')} "
    out = [Declaration(word(m, k)) for m in before for k in kinds.split()]
    out += [Declaration(word(m, k), True) for m in before for k in binding.split()]
    return out + [Declaration(x) for x in exact]


_SCRIPT = _declarations("function async+function class", "const let var", ("function(", "export default function", "export default async function", "export default class")) + _declarations(
    "function async+function class", "const let", before=("export ",)
)
_TYPED = _SCRIPT + _declarations("interface type enum", before=("", "export "))
_ACCESS = ("", "public ", "private ", "protected ")

#: How lines begin that declare something, by language.
DECLARATIONS: dict[str, list[Declaration]] = {
    "Go": _declarations("func type", "var const", ("func(", "var(", "const(")),
    "Python": _declarations("def class async+def"),
    "JavaScript": _SCRIPT,
    "TypeScript": _TYPED,
    "TSX": _TYPED,
    "Rust": _declarations("fn struct enum trait type", "const static", ("impl ", "pub(crate) fn "), ("", "pub ")),
    "Java": _declarations("class interface enum abstract+class", before=("", "public ")) + _declarations("class", before=("private ", "protected ")),
    "C": _declarations("#define typedef struct enum union"),
    "C++": _declarations("#define typedef struct enum union class namespace", exact=("template",)),
    "C#": _declarations("class interface enum struct", before=("", "public ")) + _declarations("class", before=("private ", "protected ", "internal ")),
    "Ruby": _declarations("def class module"),
    "PHP": _declarations("function", before=_ACCESS) + _declarations("class interface trait abstract+class"),
    "Kotlin": _declarations("fun class data+class sealed+class object interface enum+class typealias", "val var"),
    "Swift": _declarations("func class struct enum protocol typealias", "let var"),
    "Shell": _declarations("function", exact=("function(",)),
    "Lua": _declarations("function", before=("", "local ")),
    "Scala": _declarations("def class trait object case+class case+object sealed+trait sealed+class abstract+class type", "val var"),
    "Elixir": _declarations("def defp defmodule defmacro defmacrop defprotocol defimpl", exact=("defstruct",)),
    "Haskell": _declarations("data type newtype class instance module"),
    "Perl": _declarations("sub package use+constant"),
    "Zig": _declarations("fn", "const var", before=("", "pub ")),
    "Dart": _declarations("class abstract+class enum mixin extension typedef"),
    "Julia": _declarations("function struct mutable+struct abstract+type macro module"),
    "Clojure": _declarations("defn def defmacro defprotocol defrecord deftype ns", mark="("),
    "Erlang": [Declaration(f"-{k}{end}") for k in "module export define record type spec".split() for end in ("( " if k in ("type", "spec") else "(")],
    "Groovy": _declarations("def class interface enum trait"),
    "OCaml": _declarations("type module external", "let val"),
    "MATLAB": _declarations("function"),
    "Powershell": _declarations("function class enum"),
    "Nim": _declarations("proc func type template macro method"),
    "Crystal": _declarations("def class module struct enum lib macro"),
    "V": _declarations("fn struct", before=("", "pub ")) + _declarations("enum type", "const"),
}

_C = "auto break case char const continue default do double else enum extern for if int long return static struct switch typedef void"
#: Common words by language.
STOPWORDS: dict[str, frozenset[str]] = {
    language: frozenset(words.split())
    for language, words in {
        "Go": "break case chan const continue default defer else for func go if import interface map package range return struct switch type var",
        "Rust": "as break const continue else enum fn for if impl in let loop match mod mut pub return self struct type use",
        "Java": "abstract break case catch class continue default do else extends final for if implements import new package private public return static throw try void",
        "Python": "and as assert break class continue def del elif else except for from if import in is not or pass raise return try while with",
        "C": _C,
        "C++": "auto break case catch class const continue default delete do else for if namespace new private public return static struct template throw try virtual void",
        "C Header": _C,
        "C#": "abstract break case catch class const continue default do else for foreach if internal namespace new private public return static throw try using void",
        "JavaScript": "break case catch class const continue default do else export for function if import let new return switch throw try var while",
        "TypeScript": "break case catch class const continue default do else export for function if import interface let new return switch throw try type var while",
        "Ruby": "begin break case class def do else elsif end ensure for if include module next nil require rescue return self then unless while",
        "PHP": "abstract break case catch class const continue default do echo else extends for foreach function if namespace new private public return static throw try use",
        "Swift": "break case catch class continue default do else enum for func guard if import in let private public return self struct switch throw try var",
        "Kotlin": "abstract break class continue do else for fun if import in interface is object override package private public return val var when while",
        "Scala": "abstract case catch class def do else extends final for if implicit import match new object override package private return trait try type val var",
        "Perl": "chomp die do else elsif for foreach if last local my next our package print return sub unless use while",
        "Lua": "and break do else elseif end for function if in local nil not or repeat return then until while",
        "Dart": "abstract as break case catch class const continue default do else extends final for if import in new return static switch throw try var void",
        "Haskell": "case class data default deriving do else if import in instance let module newtype of then type where",
        "Shell": "case do done echo elif else esac exit fi for function if in local return then while",
    }.items()
}

#: Extensions of files that are prose.
PROSE = frozenset("md markdown txt text rst adoc asciidoc html htm xml svg csv tsv log org tex latex wiki rdoc textile pod man roff".split())


class Syntax(NamedTuple):
    """Comments and strings of a language, and words and signs at which the flow branches."""

    line: tuple[str, ...] = ()
    block: tuple[tuple[str, str], ...] = ()
    strings: tuple[tuple[str, str], ...] = (('"', '"'), ("'", "'"))
    branches: tuple[str, ...] = ("for ", "for(", "if ", "if(", "switch ", "while ", "else ", "|| ", "&& ", "!= ", "== ")


_SLASHES = Syntax(("//",), (("/*", "*/"),))
_TICKS = Syntax(("//",), (("/*", "*/"),), (('"', '"'), ("'", "'"), ("`", "`")))
_HASH = Syntax(("#",))
SYNTAX: dict[str, Syntax] = {
    **dict.fromkeys(("C", "C++", "C Header", "C++ Header", "C#", "Java", "Dart", "Groovy", "V", "PHP", "CSS"), _SLASHES),
    **dict.fromkeys(("Go", "JavaScript", "TypeScript", "TSX", "JSX"), _TICKS),
    **dict.fromkeys(("Rust", "Zig"), Syntax(("//",), (("/*", "*/"),), (('"', '"'),))),
    **dict.fromkeys(("Kotlin", "Scala", "Swift"), Syntax(("//",), (("/*", "*/"),), (('"""', '"""'), ('"', '"'), ("'", "'")))),
    "Python": Syntax(("#",), (), (('"""', '"""'), ("'''", "'''"), ('"', '"'), ("'", "'")), ("for ", "if ", "elif ", "while ", "else:", "or ", "and ", "!= ", "== ")),
    **dict.fromkeys(("Shell", "Perl", "YAML", "TOML", "Makefile", "Dockerfile", "Elixir", "Crystal"), _HASH),
    "Ruby": Syntax(("#",), (("\n=begin", "\n=end"),)),
    "Julia": Syntax(("#",), (("#=", "=#"),), (('"""', '"""'), ('"', '"'))),
    "Nim": Syntax(("#",), (("#[", "]#"),), (('"""', '"""'), ('"', '"'))),
    "Powershell": Syntax(("#",), (("<#", "#>"),)),
    "Lua": Syntax(("--",), (("--[[", "]]"),)),
    "Haskell": Syntax(("--",), (("{-", "-}"),), (('"', '"'),)),
    "OCaml": Syntax((), (("(*", "*)"),), (('"', '"'),)),
    "SQL": Syntax(("--",), (("/*", "*/"),)),
    "Clojure": Syntax((";",), (), (('"', '"'),)),
    "Erlang": Syntax(("%",), (), (('"', '"'),)),
    "MATLAB": Syntax(("%",), (("%{", "%}"),)),
    **dict.fromkeys(("HTML", "XML"), Syntax((), (("<!--", "-->"),), ())),
}


def has_declarations(language: str) -> bool:
    return language in DECLARATIONS


def is_declaration_line(line: str, language: str) -> bool:
    """Whether a line, without the white space before it, begins as a declaration."""
    return any(line.startswith(d.prefix) for d in DECLARATIONS.get(language, ()))


def declares(line: str, column: int, language: str) -> bool:
    """Whether what stands at a column of such a line is what it declares."""
    for d in DECLARATIONS.get(language, ()):
        if line.startswith(d.prefix):
            name = len(line) - len(line[len(d.prefix) :].lstrip(" \t"))
            return column == name if d.binds else True
    return False


def is_stopword(word: str, language: str) -> bool:
    return word.lower() in STOPWORDS.get(language, ())


def snippet_mode(extension: str, asked: str = "auto") -> str:
    """`snippet` for prose, `lines` for code, unless asked for one."""
    return asked if asked in ("snippet", "lines", "grep") else "snippet" if extension in PROSE else "lines"
