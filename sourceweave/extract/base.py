"""What extractors share: a collector of fragments, and a view of a source text with strings and comments blanked."""

from __future__ import annotations

import bisect
import posixpath
import re
from dataclasses import dataclass, field

from ..functions.ids import make_id


def file_stem(rel: str) -> str:
    """folder.name of a path, without its extension; the name alone at the top."""
    folder, name = posixpath.split(rel)
    bare = name.rsplit(".", 1)[0] if "." in name else name
    return f"{posixpath.basename(folder)}.{bare}" if folder else bare


@dataclass
class Fragments:
    """Everything that one file says, in the order it says it."""

    file: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    defs: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    aliases: list[dict] = field(default_factory=list)
    mod_refs: list[dict] = field(default_factory=list)
    md_refs: list[dict] = field(default_factory=list)
    labels: list[dict] = field(default_factory=list)
    invokes: list[dict] = field(default_factory=list)
    seen: set[str] = field(default_factory=set)

    def __post_init__(self):
        self.file_id, self.stem = make_id(self.file), file_stem(self.file)

    def node(self, id_: str, label: str, loc: str | None, file_type: str = "code", computed: str = "", source_file: str | None = None) -> bool:
        if not id_ or id_ in self.seen:
            return False
        self.seen.add(id_)
        self.nodes.append({"id": id_, "label": label, "file_type": file_type, "source_file": self.file if source_file is None else source_file, "loc": loc, "computed_name": computed})
        return True

    def file_node(self) -> None:
        self.node(self.file_id, posixpath.basename(self.file), "L1")

    def edge(self, source: str, target: str, relation: str, loc: str | None, weight: float | None = None) -> None:
        self.edges.append({"source": source, "target": target, "relation": relation, "confidence": "EXTRACTED", "source_file": self.file, "loc": loc, "weight": weight})

    def known(self, id_: str, name: str) -> None:
        self.defs.append({"id": id_, "name": name})

    def define(self, id_: str, name: str, label: str, loc: str) -> str:
        """A definition of the file itself."""
        self.node(id_, label, loc)
        self.edge(self.file_id, id_, "contains", loc)
        self.known(id_, name)
        return id_

    def function(self, name: str, loc: str) -> str:
        return self.define(make_id(self.stem, name), name, name + "()", loc)

    def type(self, name: str, loc: str) -> str:
        return self.define(make_id(self.stem, name), name, name, loc)

    def member(self, owner: str, owner_name: str, name: str, loc: str, by_owner: bool = False) -> str:
        """A definition inside a type: only the type contains it, and calls find it by its bare name."""
        id_ = make_id(owner, name) if by_owner else make_id(self.stem, owner_name, name)
        self.node(id_, f"{owner_name}.{name}()", loc)
        self.edge(owner, id_, "contains", loc)
        self.known(id_, name)
        return id_

    def call(self, caller: str, callee: str, loc: str, is_member: bool = False) -> None:
        if caller and callee:
            self.calls.append({"caller_id": caller, "callee": callee, "loc": loc, "is_member": is_member})

    def imported(self, spec: str, loc: str) -> None:
        if spec:
            self.imports.append({"file_id": self.file_id, "spec": spec, "loc": loc})

    def rationale(self, text: str, line: int, parent: str) -> None:
        label = re.sub("\r\n|\r|\n", " ", text[:80]).strip()
        id_ = make_id(self.stem, "rationale", str(line))
        self.node(id_, label, f"L{line}", "rationale")
        self.edge(id_, parent, "rationale_for", f"L{line}")


@dataclass
class Syntax:
    """How a language writes comments and strings."""

    line: tuple[str, ...] = ("//",)
    block: tuple[tuple[str, str], ...] = (("/*", "*/"),)
    quotes: tuple[str, ...] = ('"', "'")
    long: tuple[str, ...] = ()
    regex: bool = False


class Text:
    """A source text; ``code`` is as long, with comments and the insides of strings blank; in ``bare`` only comments are."""

    def __init__(self, text: str, syntax: Syntax):
        self.text = text
        self.breaks = [i for i, c in enumerate(text) if c == "\n"]
        openers = [(re.escape(a), "c", b) for a, b in syntax.block] + [(re.escape(a), "c", "\n") for a in syntax.line] + [(re.escape(q), "s", q) for q in (*syntax.long, *syntax.quotes)]
        opener = re.compile("|".join(f"(?P<o{i}>{o[0]})" for i, o in enumerate(openers)))
        code, bare, at = [], [], 0
        blank = lambda s: re.sub(r"[^\n]", " ", s)
        while m := opener.search(text, at):
            _, kind, close = openers[int(m.lastgroup[1:])]
            plain = text[at : m.start()]
            end = self._close(text, m.end(), close, kind == "s", close in syntax.long)
            inside = text[m.start() : end]
            code.append(plain)
            bare.append(plain)
            if kind == "s" and close == "'" and end - m.start() > 4 and "\n" in inside:  # a lifetime or an apostrophe, not a string
                code.append("'")
                bare.append("'")
                end = m.end()
            elif kind == "s":
                code.append(inside[: len(m.group())] + blank(inside[len(m.group()) : -len(close)]) + inside[-len(close) :] if len(inside) >= 2 * len(close) else inside)
                bare.append(inside)
            else:
                code.append(blank(inside))
                bare.append(blank(inside))
            at = end
        self.code, self.bare = "".join(code) + text[at:], "".join(bare) + text[at:]
        self.pair: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        for m in re.finditer(r"[{}()\[\]]", self.code):
            c = m.group()
            if c in "{([":
                stack.append((c, m.start()))
            elif stack and stack[-1][0] == {"}": "{", ")": "(", "]": "["}[c]:
                self.pair[stack.pop()[1]] = m.start()

    @staticmethod
    def _close(text: str, at: int, close: str, string: bool, many_lines: bool) -> int:
        if not string:
            end = text.find(close, at)
            return len(text) if end < 0 else end if close == "\n" else end + len(close)
        while True:
            end = text.find(close, at)
            if end < 0:
                return len(text)
            back = len(text[:end]) - len(text[:end].rstrip("\\"))
            if back % 2 == 0 or close == "`" and many_lines:
                return end + len(close)
            at = end + 1

    def line(self, at: int) -> str:
        return f"L{bisect.bisect_left(self.breaks, at) + 1}"

    def surface(self, a: int, b: int) -> str:
        """code from a to b, but the insides of braces blank."""
        out, at = [], a
        for m in re.compile(r"\{").finditer(self.code, a, b):
            if m.start() < at:
                continue
            end = min(self.pair.get(m.start(), b), b)
            out.append(self.code[at : m.start() + 1])
            out.append(re.sub(r"[^\n]", " ", self.code[m.start() + 1 : end]))
            at = end
        return "".join(out) + self.code[at:b]

    def body(self, surface: str, a: int, at: int) -> tuple[int, int] | None:
        """The braces that follow place at (of the text) in a surface that begins at a, with no semicolon in between."""
        i = at - a
        while i < len(surface):
            if surface[i] == "{":
                return at + (i - (at - a)) + 1, self.pair.get(a + i, a + len(surface))
            if surface[i] == ";":
                return None
            i += 1
        return None
