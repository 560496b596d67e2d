"""Languages whose blocks end with a word: Ruby, Lua, Julia, SystemVerilog, and shell functions."""

from __future__ import annotations

import posixpath
import re

from ..functions.ids import make_id
from .base import Fragments, Syntax, Text

N = r"[A-Za-z_]\w*"


class Blocks:
    """Pairs of openers and "end" in a text whose strings and comments are blank."""

    def __init__(self, code: str, opener: re.Pattern):
        self.end: dict[int, int] = {}
        self.depth: dict[int, int] = {}
        stack: list[int] = []
        for m in opener.finditer(code):
            if m.group().strip().startswith("end"):
                if stack:
                    self.end[stack.pop()] = m.start()
            else:
                at = m.start(m.lastindex or 0)
                self.depth[at] = len(stack)
                stack.append(at)
        self.size = len(code)

    def close(self, at: int) -> int:
        return self.end.get(at, self.size)


def _calls(out: Fragments, t: Text, caller: str, a: int, b: int, call: re.Pattern, skip: set[str]) -> None:
    for m in call.finditer(t.code, a, b):
        if m.group(1) not in skip:
            out.call(caller, m.group(1), t.line(m.start(1)))


RUBY_OPEN = re.compile(r"(?:^[ \t]*|=[ \t]*)(if|unless|while|until|case|begin|for)\b|\b(def|class|module|do)\b|\bend\b", re.M)
RUBY_CALL = re.compile(rf"(?<![\w@$:])({N}[?!]?)\s*\(|(?:^|[=(,&|]|\breturn\b|\bthen\b|\bdo\b)[ \t]*({N})[ \t]*(?=$|[\n;)])", re.M)
RUBY_WORDS = set("if unless while until case when then else elsif begin rescue ensure end def class module do return yield self nil true false and or not in puts require require_relative load autoload private public protected break next redo retry super attr_reader attr_writer attr_accessor".split())


def ruby(rel: str, src: str) -> Fragments:
    out, t = Fragments(rel), Text(src, Syntax(line=("#",), block=(("=begin", "=end"),)))
    out.file_node()
    blocks = Blocks(t.code, RUBY_OPEN)
    for m in re.finditer(r"\b(?:require|require_relative|load|autoload)\b[^\n]*?['\"]([^'\"]+)['\"]", t.bare):
        out.imported(m.group(1), t.line(m.start()))

    def calls(caller: str, a: int, b: int) -> None:
        for m in RUBY_CALL.finditer(t.code, a, b):
            name = m.group(1) or m.group(2)
            if name not in RUBY_WORDS and (m.group(1) or not re.search(rf"\b{name}\s*=[^=]", t.code[a:b])):
                out.call(caller, name, t.line(m.start()))
        for m in re.compile(rf"\.({N}[?!]?)(?!\s*\(|\w)").finditer(t.code, a, b):
            out.call(caller, m.group(1), t.line(m.start(1)))

    for m in re.finditer(rf"\b(def|class|module)\s+(?:(self)\.)?([A-Za-z_][\w:]*[?!=]?)", t.code):
        at, depth = m.start(1), blocks.depth.get(m.start(1))
        if depth != 0:
            continue
        stop, loc = blocks.close(at), t.line(at)
        if m.group(1) == "def":
            if not m.group(2):
                calls(out.function(m.group(3), loc), m.end(), stop)
            continue
        name = m.group(3).split("::")[-1]
        owner = out.type(name, loc)
        for x in re.compile(rf"\bdef\s+(?!self\.)({N}[?!=]?)").finditer(t.code, m.end(), stop):
            if blocks.depth.get(x.start()) == 1:
                calls(out.member(owner, name, x.group(1), t.line(x.start())), x.end(), blocks.close(x.start()))
    return out


LUA_OPEN = re.compile(r"\b(function|if|do|repeat)\b|\b(?:end|until)\b")
LUA_CALL = re.compile(rf"({N})\s*[({{\"']")


def lua(rel: str, src: str) -> Fragments:
    out, t = Fragments(rel), Text(src, Syntax(line=("--",), block=(("--[[", "]]"),), quotes=('"', "'")))
    out.file_node()
    code = re.sub(r"\buntil\b", "end  ", t.code)
    blocks = Blocks(code, LUA_OPEN)
    skip = set("if while for function and or not return until elseif local require end then do else repeat".split())
    for m in re.finditer(r"\brequire\s*\(?\s*['\"]([^'\"]+)['\"]", t.bare):
        out.imported(m.group(1), t.line(m.start()))
    inside: list[tuple[int, int]] = []

    def owner_of(name: str, loc: str) -> str:
        id_ = make_id(out.stem, name)
        return id_ if id_ in out.seen else out.type(name, loc)

    for m in re.finditer(rf"^[ \t]*(?:local\s+)?({N})\s*=\s*\{{|\bfunction\s+({N})(?:([.:])({N}))?\s*\(", code, re.M):
        if m.group(1):
            if not any(a <= m.start() < b for a, b in inside):
                owner_of(m.group(1), t.line(m.start(1)))
            continue
        if blocks.depth.get(m.start()) != 0:
            continue
        stop, loc = blocks.close(m.start()), t.line(m.start())
        inside.append((m.start(), stop))
        if m.group(4):
            caller = out.member(owner_of(m.group(2), loc), m.group(2), m.group(4), loc)
        else:
            caller = out.function(m.group(2), loc)
        _calls(out, t, caller, m.end(), stop, LUA_CALL, skip)
    for m in LUA_CALL.finditer(t.code):
        if m.group(1) not in skip and not any(a <= m.start() < b for a, b in inside):
            out.call(out.file_id, m.group(1), t.line(m.start()))
    return out


JULIA_OPEN = re.compile(r"\b(function|macro|module|baremodule|struct|if|for|while|begin|let|try|do|quote|(?:abstract|primitive)\s+type)\b|\bend\b")
JULIA_CALL = re.compile(rf"(?<![@\w])({N}!?)\s*(?:\{{[^}}]*\}})?\(")


def julia(rel: str, src: str) -> Fragments:
    out, t = Fragments(rel), Text(src, Syntax(line=("#",), block=(("#=", "=#"),), long=('"""',), quotes=('"',)))
    out.file_node()
    code = re.sub(r"\[[^\[\]\n]*\]", lambda m: "[" + re.sub(r"[^\n]", " ", m.group()[1:-1]) + "]", t.code)
    blocks = Blocks(code, JULIA_OPEN)
    skip = set("if for while function macro return struct end begin let".split())
    for m in re.finditer(r"^[ \t]*(?:using|import)[ \t]+([^\n]+)", t.bare, re.M):
        text = m.group(1)
        for part in [text.split(":")[0]] if ":" in text else text.split(","):
            out.imported(part.split(" as ")[0].strip(), t.line(m.start()))

    def items(a: int, b: int, depth: int, owner: tuple[str, str] | None) -> None:
        pattern = rf"\b(function|macro)\s+((?:{N}\.)*{N}!?)|\b((?:mutable\s+)?struct|(?:abstract|primitive)\s+type)\s+({N})|\b(?:bare)?module\s+({N})|^[ \t]*({N}!?)\([^\n]*?\)(?:::\w+)?\s*=(?!=)([^\n]*)"
        for m in re.compile(pattern, re.M).finditer(code, a, b):
            if m.group(6):
                if not any(x <= m.start(6) < y for x, y in inner):
                    id_ = out.function(m.group(6), t.line(m.start(6)))
                    _calls(out, t, id_, m.start(7), m.end(7), JULIA_CALL, skip)
                continue
            at = m.start() if m.group(3) is None else m.start(3) + m.group(3).index("struct") if "struct" in m.group(3) else m.start(3)
            if blocks.depth.get(at) != depth:
                continue
            stop, loc = blocks.close(at), t.line(m.start())
            inner.append((at, stop))
            if m.group(2):
                name = m.group(2).split(".")[-1]
                id_ = out.member(owner[0], owner[1], name, loc) if owner else out.function(name, loc)
                _calls(out, t, id_, code.find("\n", m.end()) if "(" in code[m.end() : m.end() + 2] else m.end(), stop, JULIA_CALL, skip)
            elif m.group(4):
                out.type(m.group(4), loc)
            else:
                id_ = out.type(m.group(5), loc)
                inner.pop()
                items(m.end(), stop, depth + 1, (id_, m.group(5)))
                inner.append((at, stop))

    inner: list[tuple[int, int]] = []
    items(0, len(code), 0, None)
    return out


VERILOG_CALL = re.compile(rf"({N})\s*\(")
VERILOG_WORDS = set("if for while case casex casez repeat foreach function task module class begin always assign initial return new super void int input output inout logic wire reg parameter and or not posedge negedge assert property".split())


def verilog(rel: str, src: str) -> Fragments:
    out, t = Fragments(rel), Text(src, Syntax(quotes=('"',)))
    out.file_node()
    for m in re.finditer(r"`include\s+\"([^\"]+)\"", t.bare):
        out.imported(m.group(1), t.line(m.start()))

    def items(a: int, b: int) -> None:
        at = a
        pattern = re.compile(rf"\b(module|program|interface|package|class|function|task)\b\s+((?:automatic|static|virtual|void|\w+(?:\s*\[[^\]]*\])?)\s+)*?({N})\s*(?=[;#(]|extends\b|import\b)")
        while m := pattern.search(t.code, at, b):
            kind, name, loc = m.group(1), m.group(3), t.line(m.start())
            end = re.compile(rf"\bend{kind}\b").search(t.code, m.end(), b)
            stop = end.start() if end else b
            if kind in ("function", "task"):
                _calls(out, t, out.function(name, loc), m.end() if t.code[m.end() : m.end() + 1] != "(" else t.pair.get(m.end(), m.end()), stop, VERILOG_CALL, VERILOG_WORDS)
            elif kind == "package":
                out.type(name, loc)
                items(m.end(), stop)
            elif kind == "class":
                owner = out.type(name, loc)
                inner = re.compile(rf"\b(function|task)\b\s+(?:(?:automatic|static|virtual|void|\w+(?:\s*\[[^\]]*\])?)\s+)*?({N})\s*(?=[;(])")
                for x in inner.finditer(t.code, m.end(), stop):
                    close = re.compile(rf"\bend{x.group(1)}\b").search(t.code, x.end(), stop)
                    _calls(out, t, out.member(owner, name, x.group(2), t.line(x.start())), t.pair.get(x.end(), x.end()), close.start() if close else stop, VERILOG_CALL, VERILOG_WORDS)
            else:
                _calls(out, t, out.type(name, loc), t.pair.get(m.end(), m.end()), stop, VERILOG_CALL, VERILOG_WORDS)
            at = end.end() if end else b

    items(0, len(t.code))
    return out


# fixed values: programs that run a script given to them
RUNNERS = ["bash", "sh", "dash", "zsh", "ksh", "source"]
_SHELL_WORDS = set("if then else elif fi for while until do done case esac in function time { } [[ ]] ! select return local export readonly declare".split())


def shell(rel: str, src: str) -> Fragments:
    out, t = Fragments(rel), Text(src, Syntax(line=(" #", "\n#"), block=()))
    out.file_node()
    head = re.compile(rf"^[ \t]*(?:function\s+({N}[\w-]*)\s*(?:\(\s*\))?|({N}[\w-]*)\s*\(\s*\))\s*\{{", re.M)
    names = {m.group(1) or m.group(2) for m in head.finditer(t.code)}
    spans = []
    for m in head.finditer(t.code):
        name = m.group(1) or m.group(2)
        at = m.start(1) if m.group(1) else m.start(2)
        spans.append((m.end(), t.pair.get(m.end() - 1, len(t.code)), out.function(name, t.line(at))))

    def caller_at(i: int) -> str:
        own = [s for s in spans if s[0] <= i < s[1]]
        return max(own)[2] if own else ""

    for m in re.finditer(r"(?:^|[;&|({]|\b(?:then|do|else)\b|\$\()[ \t]*(?:[A-Za-z_]\w*=\S*[ \t]+)*([^\s;&|(){}#<>=$\"']+)([^\n;&|]*)", t.code, re.M):
        word, at = m.group(1), m.start(1)
        if word in _SHELL_WORDS or head.match(t.code, t.code.rfind("\n", 0, at) + 1):
            continue
        arg = re.match(r"[ \t]*(?:\"([^\"]*)\"|'([^']*)'|(\S+))", t.bare[m.end(1) : m.end()])
        first = next((g for g in arg.groups() if g is not None), "") if arg else ""
        loc = t.line(at)
        if word in ("source", "."):
            out.imported(first, loc)
            continue
        caller = caller_at(at)
        target = word if word.endswith(".sh") else first if word in RUNNERS else ""
        if target.endswith(".sh") and "$" not in target and "`" not in target and word not in names:
            out.edge(caller or out.file_id, make_id(posixpath.normpath(posixpath.join(posixpath.dirname(rel), target))), "calls", loc, 1.0)
        if caller:
            out.call(caller, word, loc)
    return out
