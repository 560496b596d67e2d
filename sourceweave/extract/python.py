"""Python, by its own parser; a file with syntax errors is read line by line for its definitions."""

from __future__ import annotations

import ast
import re

from ..functions.ids import make_id
from .base import Fragments
from .braces import NOTES


def python(rel: str, src: str) -> Fragments:
    out = Fragments(rel)
    out.file_node()
    try:
        tree = ast.parse(src)
    except (SyntaxError, ValueError):
        for i, line in enumerate(src.split("\n"), 1):
            if m := re.match(r"(?:async\s+)?def\s+(\w+)", line):
                out.function(m.group(1), f"L{i}")
            elif m := re.match(r"class\s+(\w+)", line):
                out.type(m.group(1), f"L{i}")
        return out
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)

    def calls(node, caller: str) -> None:
        found = [c for s in node.body for c in ast.walk(s) if isinstance(c, ast.Call)]
        for c in sorted(found, key=lambda c: (c.lineno, c.col_offset)):
            if isinstance(c.func, ast.Name):
                out.call(caller, c.func.id, f"L{c.lineno}")
            elif isinstance(c.func, ast.Attribute):
                out.call(caller, c.func.attr, f"L{c.lineno}", True)

    for s in tree.body:
        loc = f"L{s.lineno}"
        if isinstance(s, functions):
            calls(s, out.function(s.name, loc))
        elif isinstance(s, ast.ClassDef):
            owner = out.type(s.name, loc)
            for m in s.body:
                if isinstance(m, functions):
                    calls(m, out.member(owner, s.name, m.name, f"L{m.lineno}"))
        elif isinstance(s, ast.Import):
            for a in s.names:
                out.imported(a.name, loc)
        elif isinstance(s, ast.ImportFrom):
            module = "." * s.level + (s.module or "")
            out.imported(module, loc)
            stem = module.strip(".").split(".")[-1]
            for a in s.names:
                if stem and a.name != "*":
                    out.aliases.append({"local": a.asname or a.name, "imported": a.name, "module_stem": stem, "loc": loc})
    _rationale(out, tree, src)
    return out


def _docstring(node) -> tuple[str, int] | None:
    first = node.body[0] if node.body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        text = first.value.value.strip().strip("\"'").strip()
        return (text, first.lineno) if len(text) > 20 else None
    return None


def _generated(src: str) -> bool:
    """Written by a tool, or a migration: its first docstring explains nothing."""
    head = src[:2048]
    if any(s in head for s in ("DO NOT EDIT", "@generated", "Generated by the protocol buffer")):
        return True
    migration = re.search(r"(?m)^revision\s*[:=]", head) and "def upgrade(" in head and "down_revision" in head
    return bool(migration) or ("class Migration(migrations.Migration)" in head and "operations" in head)


def _rationale(out: Fragments, tree: ast.Module, src: str) -> None:
    if not _generated(src) and (found := _docstring(tree)):
        out.rationale(*found, out.file_id)

    def visit(node, parent: str) -> None:
        for s in ast.iter_child_nodes(node):
            if isinstance(s, ast.ClassDef):
                id_ = make_id(out.stem, s.name)
            elif isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
                id_ = make_id(out.stem, s.name) if parent == out.file_id else make_id(parent, s.name)
            else:
                visit(s, parent)
                continue
            if found := _docstring(s):
                out.rationale(*found, id_)
            if isinstance(s, ast.ClassDef):
                visit(s, id_)

    visit(tree, out.file_id)
    for i, line in enumerate(src.split("\n"), 1):
        if any(line.strip().startswith(f"# {n}") for n in NOTES):
            out.rationale(line.strip(), i, out.file_id)
