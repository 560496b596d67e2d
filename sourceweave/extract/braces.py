"""Languages with braces: patterns over the surface of a region tell functions, types and members."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.ids import make_id, normalize_id
from .base import Fragments, Syntax, Text

N = r"[A-Za-z_$][\w$]*"
#: Words before a parenthesis that are no calls.
NOT_CALLS = set("if for while switch catch return function func fn fun def match when sizeof typeof foreach elseif until do else new using lock unless and or not in is as synchronized assert throw await yield super this union enum struct".split())
CALL = re.compile(rf"(?P<before>(?:\b(?:new|func|function|fn|fun|def)\s+)?)(?P<name>{N})(?P<generic>(?:::)?<[\w\s,.:*&\[\]?]*>)?\s*\(")


@dataclass
class Language:
    syntax: Syntax
    items: str
    members: str = ""
    imports: tuple[str, ...] = ()
    call: re.Pattern = CALL
    calls_new: bool = False
    by_owner: bool = False


def _groups(m: re.Match) -> tuple[str, str]:
    return next((k, v) for k, v in m.groupdict().items() if v is not None and k[0] in "ftcmp")


class Reader:
    def __init__(self, lang: Language, rel: str, src: str, out: Fragments | None = None):
        self.lang, self.t = lang, Text(src, lang.syntax)
        self.out = out or Fragments(rel)
        self.out.file_node()

    def read(self) -> Fragments:
        self.imports()
        self.region(0, len(self.t.code))
        return self.out

    def imports(self) -> None:
        found = sorted((m.start(m.lastindex), m.group(m.lastindex)) for p in self.lang.imports for m in re.finditer(p, self.t.bare, re.M))
        for at, spec in found:
            self.out.imported(spec.strip(), self.t.line(at))

    def span(self, surface: str, a: int, at: int, expression: bool = True) -> tuple[int, int] | None:
        """The body that follows: braces, or after = or => the rest of the expression."""
        eq = re.compile(r"=>?").search(surface, at - a)
        brace = surface.find("{", at - a)
        if expression and eq and (brace < 0 or eq.start() < brace) and "\n\n" not in surface[at - a : eq.start()]:
            after = re.compile(r"\s*\{").match(surface, eq.end())
            if after:
                return a + after.end(), self.t.pair.get(a + after.end() - 1, a + len(surface))
            end = re.compile(r"\n(?!\s*[.?:|&+\-*])|;").search(surface, re.compile(r"\s*").match(surface, eq.end()).end())
            return a + eq.end(), a + (end.start() if end else len(surface))
        return self.t.body(surface, a, at)

    def calls(self, caller: str, body: tuple[int, int] | None) -> None:
        if not body:
            return
        for m in self.lang.call.finditer(self.t.code, *body):
            name, before = m.group("name"), m.group("before").strip()
            if name in NOT_CALLS or before and not (before == "new" and self.lang.calls_new):
                continue
            self.out.call(caller, name, self.t.line(m.start("name")))

    def region(self, a: int, b: int) -> None:
        surface = self.t.surface(a, b)
        for m in re.finditer(self.lang.items, surface, re.M):
            kind, name = _groups(m)
            at = a + m.start(kind)
            loc = self.t.line(at)
            if kind[0] == "p":
                body = self.t.body(surface, a, a + m.end())
                if body:
                    self.region(*body)
            elif kind[0] in "cm":
                self.special(kind, name, loc, surface, a, m)
            elif normalize_id(name) == "":
                continue
            elif kind[0] == "f":
                self.calls(self.out.function(name, loc), self.span(surface, a, a + m.end()))
            else:
                self.type(name, loc, self.t.body(surface, a, a + m.end()), m)

    def type(self, name: str, loc: str, body, m: re.Match) -> None:
        owner = self.out.type(name, loc)
        if body and self.lang.members:
            self.members(owner, name, body)

    def members(self, owner: str, owner_name: str, body: tuple[int, int]) -> None:
        surface = self.t.surface(*body)
        for m in re.finditer(self.lang.members, surface, re.M):
            name = _groups(m)[1]
            if name in NOT_CALLS or normalize_id(name) == "":
                continue
            at = body[0] + m.start(_groups(m)[0])
            id_ = self.out.member(owner, owner_name, name, self.t.line(at), self.lang.by_owner)
            self.calls(id_, self.span(surface, body[0], body[0] + m.end(), "=" not in m.group()))

    def special(self, kind: str, name: str, loc: str, surface: str, a: int, m: re.Match) -> None:
        raise NotImplementedError(kind)


C_SYNTAX = Syntax()
GO = Language(Syntax(quotes=('"', "'", "`")), rf"^func\s+(?P<f>{N})\s*[(\[]|^func\s*\((?P<recv>[^)]*)\)\s*(?P<method>{N})\s*\(|^type\s+(?P<t>{N})|^type\s*(?P<c>\()", imports=(r'^import\s+(?:[\w.]+\s+)?"([^"]+)"',))


class GoReader(Reader):
    def imports(self) -> None:
        super().imports()
        for m in re.finditer(r"^import\s*\(", self.t.code, re.M):
            end = self.t.pair.get(m.end() - 1, len(self.t.code))
            for x in re.compile(r'"([^"]+)"').finditer(self.t.bare, m.end(), end):
                self.out.imported(x.group(1), self.t.line(x.start()))

    def special(self, kind, name, loc, surface, a, m):
        if kind == "method":
            recv = re.sub(r"\[.*", "", m.group("recv")).split()
            owner = recv[-1].lstrip("*") if recv else ""
            id_ = self.out.define(make_id(self.out.stem, owner, name), name, f"{owner}.{name}()" if owner else name + "()", loc)
            self.calls(id_, self.t.body(surface, a, a + m.end()))
        else:
            at = a + m.start("c")
            end = self.t.pair.get(at, len(self.t.code))
            for x in re.finditer(rf"^\s*({N})\s+\S", self.t.surface(at + 1, end), re.M):
                self.out.type(x.group(1), self.t.line(at + 1 + x.start(1)))

    def span(self, surface, a, at, expression=True):
        return self.t.body(surface, a, at)


_ARGS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
JS = Language(
    Syntax(quotes=('"', "'", "`"), long=()),
    rf"\bfunction\s*\*?\s*(?P<f>{N})\s*[(<]|\bclass\s+(?P<t>{N})|\b(?:interface|enum)\s+(?P<t2>{N})|^\s*(?:export\s+)?(?:declare\s+)?type\s+(?P<t3>{N})\s*[=<]"
    rf"|\b(?:const|let|var)\s+(?P<f2>{N})\s*(?::[^=;\n]+)?=(?=\s*(?:async\s*)?(?:function\b|{_ARGS}\s*(?::[^=;{{]+)?=>|{N}\s*=>))",
    rf"(?:^|[;}}\s])\*?\s*#?(?P<m>{N})\s*(?:<[^>]*>)?{_ARGS}\s*(?::[^{{;=]+)?(?=\{{)",
    (r"^\s*import\s+(?:[^'\"();]*?\bfrom\s+)?['\"]([^'\"]+)['\"]",),
)


class JsReader(Reader):
    def type(self, name, loc, body, m):
        owner = self.out.type(name, loc)
        if body and m.lastgroup == "t":
            self.members(owner, name, body)

    def span(self, surface, a, at, expression=True):
        if not expression:
            return self.t.body(surface, a, at)
        arrow = re.compile(rf"\s*(?:async\s*)?(?:{_ARGS}\s*(?::[^=;{{]+)?=>|{N}\s*=>)").match(surface, at - a)
        if not arrow:
            return self.t.body(surface, a, at)
        brace = re.compile(r"\s*\{").match(surface, arrow.end())
        if brace:
            return a + brace.end(), self.t.pair.get(a + brace.end() - 1, a + len(surface))
        end = re.compile(r";|\n(?=\S)").search(surface, arrow.end() + 1)
        return a + arrow.end(), a + (end.start() if end else len(surface))


# fixed values: comments that explain
NOTES = ["NOTE:", "IMPORTANT:", "HACK:", "WHY:", "RATIONALE:", "TODO:", "FIXME:"]


def js_notes(out: Fragments, src: str) -> None:
    cited: set[str] = set()
    for i, line in enumerate(src.split("\n"), 1):
        s = line.strip()
        if any(s.startswith(f"{p} {n}") for p in ("//", "*") for n in NOTES):
            out.rationale(s.lstrip("/* "), i, out.file_id)
        if re.match(r"\s*(//|/\*|\*)", line):
            for kind, number in re.findall(r"(?i)\b(ADR|RFC)[- ]?(\d{1,5})\b", s):
                label = f"{kind.upper()}-{number.zfill(4) if kind.upper() == 'ADR' else number}"
                if label not in cited:
                    cited.add(label)
                    id_ = make_id("docref", label)
                    out.node(id_, label, f"L{i}", "doc_ref")
                    out.edge(out.file_id, id_, "cites", f"L{i}")


RUST = Language(
    Syntax(quotes=('"',)),
    rf"\bfn\s+(?P<f>{N})|\b(?:struct|enum|union|trait|type)\s+(?P<t>{N})|\bimpl\b(?:\s*<[^>{{]*>)?\s+(?:[^{{;]*?\bfor\s+)?&?(?:{N}::)*(?P<cimpl>{N})|\bmod\s+(?P<p>{N})\s*(?=\{{)",
    rf"\bfn\s+(?P<m>{N})",
    call=re.compile(rf"(?P<before>(?:\bfn\s+)?)(?P<name>{N})(?P<generic>::<[^>()]*>)?\s*(?:!\s*[(\[{{]|\()"),
)


class RustReader(Reader):
    def imports(self) -> None:
        for m in re.finditer(r"\buse\s+([^;]+);", self.t.bare):
            self.out.imported(re.sub(r"(::)?\{.*", "", m.group(1), flags=re.S).strip(), self.t.line(m.start()))

    def type(self, name, loc, body, m):
        self.out.type(name, loc)

    def special(self, kind, name, loc, surface, a, m):
        body = self.t.body(surface, a, a + m.end())
        if body:
            self.members(make_id(self.out.stem, name), name, body)

    def span(self, surface, a, at, expression=True):
        return self.t.body(surface, a, at)


C = Language(C_SYNTAX, rf"(?:^|[;}}])\s*(?!return\b|else\b|typedef\b)(?:[\w*]+[\s*]+)+(?P<f>{N})\s*\([^;{{}}]*\)\s*(?=\{{)|\b(?:struct|union|enum)\s+(?P<t>{N})\s*(?=\{{)", rf"\(\s*\*\s*(?P<m>{N})\s*\)\s*\(", (r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",))
CPP = Language(
    C_SYNTAX,
    rf"(?:^|[;}}>])\s*(?!return\b|else\b|typedef\b|using\b)(?:[\w:<>,*&~]+[\s*&]+)+(?P<f>{N})\s*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)|(?P<cowner>{N})::(?P<method>~?{N})\s*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)|\b(?:class|struct|union)\s+(?P<t>{N})(?=[^;(){{}}]*\{{)|\benum\s+(?:class\s+|struct\s+)?(?P<t2>{N})(?=[^;(){{}}]*\{{)|\bnamespace\s+(?P<p>[\w:]+)\s*(?=\{{)|\bnamespace\s*(?P<p2>(?=\{{))",
    rf"(?P<m>~?{N})\s*\([^;{{}}]*\)[^;{{}}=]*(?=\{{)",
    (r"^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]", r"^\s*using\s+(?:namespace\s+)?([\w:]+)\s*;"),
)


class CppReader(Reader):
    def special(self, kind, name, loc, surface, a, m):
        owner, name = m.group("cowner"), m.group("method")
        id_ = self.out.member(make_id(self.out.stem, owner), owner, name, loc)
        self.calls(id_, self.t.body(surface, a, a + m.end()))

    def span(self, surface, a, at, expression=True):
        return self.t.body(surface, a, at)


class CReader(CppReader):
    def members(self, owner, owner_name, body):
        for m in re.compile(self.lang.members).finditer(self.t.code, *body):
            self.out.member(owner, owner_name, m.group("m"), self.t.line(m.start("m")))


JAVA = Language(C_SYNTAX, rf"\b(?P<kind>class|interface|enum|record|@interface)\s+(?P<t>{N})", rf"(?<![.@\w])(?P<m>{N})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?=[{{;])", (r"^\s*import\s+(?:static\s+)?([\w.]+?)(?:\.\*)?\s*;",), by_owner=True)


class JavaReader(Reader):
    def type(self, name, loc, body, m):
        owner = self.out.type(name, loc)
        if not body:
            return
        head = m.groupdict().get("kind") or ""
        if "enum" in head:
            surface = self.t.surface(*body)
            stop = surface.find(";")
            part = surface if stop < 0 else surface[:stop]
            for c in re.finditer(rf"(?:^|,)\s*(?:@\w+\s+)*({N})\s*(?:\([^()]*\))?\s*(\{{)?", part):
                cid = make_id(owner, c.group(1))
                at = self.t.line(body[0] + c.start(1))
                self.out.node(cid, c.group(1), at)
                self.out.edge(owner, cid, "case_of", at)
                if c.group(2):
                    open_ = body[0] + c.start(2)
                    self.members(cid, c.group(1), (open_ + 1, self.t.pair.get(open_, body[1])))
            body = (body[0] + stop + 1, body[1]) if stop >= 0 else None
        if body:
            self.members(owner, name, body)

    def members(self, owner, owner_name, body):
        surface = self.t.surface(*body)
        for m in re.finditer(self.lang.members, surface, re.M):
            name = m.group("m")
            line = surface[surface.rfind("\n", 0, m.start()) + 1 : m.start()]
            if name in NOT_CALLS or "=" in line:
                continue
            id_ = self.out.member(owner, owner_name, name, self.t.line(body[0] + m.start("m")), self.lang.by_owner)
            self.calls(id_, self.t.body(surface, body[0], body[0] + m.end()))

    def span(self, surface, a, at, expression=True):
        return self.t.body(surface, a, at)


CSHARP = Language(
    C_SYNTAX,
    rf"\b(?P<kind>class|struct|interface|enum|record)\s+(?:struct\s+|class\s+)?(?P<t>{N})|\bnamespace\s+(?P<p>[\w.]+)\s*(?=\{{)|(?:^|[;}}])\s*(?!return\b|else\b|using\b|namespace\b)(?:[\w<>\[\],.?]+\s+)+(?P<f>{N})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?=\{{|=>)",
    rf"(?<![.@\w])(?:[\w<>\[\],.?]+\s+)(?P<m>{N})\s*(?:<[^>]*>)?\([^;{{}}]*\)\s*(?:where[^{{;]*)?(?=[{{;]|=>)",
    (r"^\s*using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;",),
)


class CSharpReader(Reader):
    def type(self, name, loc, body, m):
        owner = self.out.type(name, loc)
        if not body:
            return
        surface = self.t.surface(*body)
        for x in re.finditer(self.lang.members, surface, re.M):
            before = surface[surface.rfind("\n", 0, x.start("m")) + 1 : x.start("m")].split()
            if x.group("m") in NOT_CALLS or x.group("m") == name or not before or before[-1] in ("new", "return") or "=" in before:
                continue
            id_ = self.out.member(owner, name, x.group("m"), self.t.line(body[0] + x.start("m")))
            self.calls(id_, self.span(surface, body[0], body[0] + x.end()))


PHP = Language(
    Syntax(line=("//", "#"), quotes=('"', "'")),
    rf"\bfunction\s+&?(?P<f>{N})\s*\(|\b(?:class|interface|trait|enum)\s+(?P<t>{N})|\bnamespace\s+(?P<p>[\w\\]+)\s*(?=\{{)",
    rf"\bfunction\s+&?(?P<m>{N})\s*\(",
)


class PhpReader(Reader):
    def imports(self) -> None:
        for m in re.finditer(r"^\s*use\s+(?:function\s+|const\s+)?([^;({]+);", self.t.bare, re.M):
            for clause in m.group(1).split(","):
                self.out.imported(clause.split(" as ")[0].strip(), self.t.line(m.start(1)))

    def span(self, surface, a, at, expression=True):
        return self.t.body(surface, a, at)


SCALA = Language(
    Syntax(long=('"""',), quotes=('"',)),
    rf"\bdef\s+(?P<f>{N})|\b(?:case\s+)?(?:class|object|trait|enum)\s+(?P<t>{N})|^\s*package\s+(?P<p>[\w.]+)\s*(?=\{{)",
    rf"\bdef\s+(?P<m>{N})",
)


class ScalaReader(Reader):
    def imports(self) -> None:
        for m in re.finditer(r"^\s*import\s+([\w.]+)", self.t.bare, re.M):
            self.out.imported(m.group(1).rstrip("."), self.t.line(m.start(1)))

    def members(self, owner, owner_name, body):
        surface = self.t.surface(*body)
        for m in re.finditer(self.lang.members, surface, re.M):
            id_ = self.out.member(owner, owner_name, m.group("m"), self.t.line(body[0] + m.start("m")))
            self.calls(id_, self.span(surface, body[0], body[0] + m.end()))

    def type(self, name, loc, body, m):
        rest = self.t.code[m.end() :]
        owner = self.out.type(name, loc)
        if body and not re.match(r"[^{\n]*\n\s*(?:def|class|object|trait|enum|case|package|import|val)\b", rest):
            self.members(owner, name, body)


KOTLIN = Language(
    Syntax(long=('"""',), quotes=('"', "'")),
    rf"\bfun\s+(?:<[^>]*>\s*)?(?:{N}\.)?(?P<f>{N})\s*\(|\b(?P<kind>enum\s+class|class|interface|object)\s+(?P<t>{N})",
    rf"\bfun\s+(?:<[^>]*>\s*)?(?:{N}\.)?(?P<m>{N})\s*\(",
    (r"^\s*import\s+([\w.]+?)(?:\.\*)?\s*(?:as\s+\w+)?\s*;?$",),
    by_owner=True,
)


class KotlinReader(JavaReader):
    def members(self, owner, owner_name, body):
        surface = self.t.surface(*body)
        for m in re.finditer(self.lang.members, surface, re.M):
            id_ = self.out.member(owner, owner_name, m.group("m"), self.t.line(body[0] + m.start("m")), True)
            self.calls(id_, self.span(surface, body[0], body[0] + m.end()))

    def span(self, surface, a, at, expression=True):
        close = self.t.pair.get(at - 1)  # the parameters end before the body begins
        return Reader.span(self, surface, a, close + 1 if close and close < a + len(surface) else at)


ZIG = Language(
    Syntax(block=(), quotes=('"', "'")),
    rf"\bfn\s+(?P<f>{N})\s*\(|\bconst\s+(?P<t>{N})\s*=\s*(?:extern\s+|packed\s+)?(?:struct|enum|union|opaque)\b",
    rf"\bfn\s+(?P<m>{N})\s*\(",
    (r"@import\(\s*\"([^\"]+)\"",),
)


class ZigReader(Reader):
    def span(self, surface, a, at, expression=True):
        return self.t.body(surface, a, at)


def _read(reader, lang):
    def run(rel: str, src: str) -> Fragments:
        return reader(lang, rel, src).read()

    return run


def javascript(rel: str, src: str) -> Fragments:
    out = JsReader(JS, rel, src).read()
    js_notes(out, src)
    return out


def component(rel: str, src: str) -> Fragments:
    """Script parts of a single-file component; everything else is blanked, so lines keep their numbers."""
    keep = [m.span(1) for m in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script\s*>", src)]
    if rel.lower().endswith(".astro") and (m := re.match(r"(?s)\s*---[ \t]*\r?\n(.*?)\r?\n---", src)):
        keep.append(m.span(1))
    masked = "".join(c if c in "\r\n" or any(a <= i < b for a, b in keep) else " " for i, c in enumerate(src))
    out = javascript(rel, masked)
    for m in re.finditer(r"\bimport\s*\(\s*['\"]([^'\"]+)['\"]", src):
        out.imported(m.group(1), f"L{src.count(chr(10), 0, m.start()) + 1}")
    return out


go, rust, c, cpp = _read(GoReader, GO), _read(RustReader, RUST), _read(CReader, C), _read(CppReader, CPP)
java, csharp, php, scala, kotlin, zig = _read(JavaReader, JAVA), _read(CSharpReader, CSHARP), _read(PhpReader, PHP), _read(ScalaReader, SCALA), _read(KotlinReader, KOTLIN), _read(ZigReader, ZIG)
