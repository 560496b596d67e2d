"""Markdown, configuration JSON and server configurations."""

from __future__ import annotations

import json
import posixpath
import re

from ..functions.ids import make_id, normalize_id, sanitize_label
from .base import Fragments

LINK = re.compile(r"\[[^\]]*\]\(([^)\s]+)")
WIKI = re.compile(r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]")
REFERENCE = re.compile(r"\s{0,3}\[[^\]]+\]:\s*<?([^\s>]+)>?")
HEADING = re.compile(r"(#{1,6})\s+(.+)")
SPAN = re.compile("`([^`\n]+)`")


def front_matter(text: str) -> tuple[dict[str, str], int]:
    """The flat keys between two lines of dashes at the top, and how many lines they take."""
    lines = [x.rstrip("\r") for x in text.split("\n")]
    if lines[0] != "---" or "---" not in lines[1:]:
        return {}, 0
    end = lines.index("---", 1)
    out = {}
    for line in lines[1:end]:
        key, colon, value = line.partition(":")
        value = value.strip()
        if colon:
            quoted = len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'"
            out[key.strip()] = value[1:-1] if quoted else value
    return out, end + 1


def markdown(rel: str, src: str) -> Fragments:
    out = Fragments(rel)
    root = make_id(posixpath.splitext(rel)[0])
    meta, skip = front_matter(src)
    computed = " ".join(x for x in (meta.get("description"), (meta.get("tags") or "").strip("[]")) if x)
    out.node(root, meta.get("title") or posixpath.basename(rel), "L1", meta.get("type") or "document", computed)
    above: list[tuple[int, str]] = []
    fenced = False
    for i, line in enumerate(src.split("\n")[skip:], skip + 1):
        loc = f"L{i}"
        if line.strip().startswith("```"):
            fenced = not fenced
            continue
        if fenced:
            continue
        found = [*LINK.findall(line), *WIKI.findall(line), *([m.group(1)] if (m := REFERENCE.match(line)) else []), *[s.strip() for s in SPAN.findall(line) if not re.search(r"[ \t]", s.strip())]]
        for target in found:
            if target.strip():
                out.md_refs.append({"from_id": root, "target": target.strip(), "loc": loc})
        if m := HEADING.match(line):
            level, title = len(m.group(1)), m.group(2).strip()
            id_ = make_id(root, title)
            if id_ in out.seen:
                id_ = make_id(root, title, str(i))
            out.node(id_, title, loc, "heading")
            while above and above[-1][0] >= level:
                above.pop()
            out.edge(above[-1][1] if above else root, id_, "contains", loc)
            above.append((level, id_))
    return out


# fixed values: names and keys of configuration files, and limits
JSON_BYTES, JSON_PAIRS, JSON_DEPTH = 1 << 20, 500, 6
CONFIG_NAMES = [
    "package.json", "tsconfig.json", "jsconfig.json", "composer.json", "deno.json", "deno.jsonc", "bower.json", "manifest.json", "app.json", "now.json", "vercel.json",
    "angular.json", "nest-cli.json", "biome.json", "biome.jsonc", "renovate.json", ".babelrc", ".babelrc.json", ".eslintrc.json", ".prettierrc.json", ".prettierrc", "babel.config.json",
]
CONFIG_ENDINGS = (".eslintrc.json", ".prettierrc.json", ".babelrc.json", "tsconfig.json", "jsconfig.json")
DEPENDENCY_KEYS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies", "bundleDependencies", "bundledDependencies"]
CONFIG_KEYS = [*DEPENDENCY_KEYS, "extends", "$ref", "$schema", "compilerOptions"]


class _Pairs(list):
    """An object as (key, value, line) in order."""


def parse_pairs(src: str):
    """JSON whose objects keep the lines of their keys. Comments and trailing commas are let pass."""
    token = re.compile(r'\s+|//[^\n]*|/\*.*?\*/|(?P<s>"(?:[^"\\]|\\.)*")|(?P<p>[{}\[\]:,])|(?P<w>[^\s{}\[\]:,"]+)', re.S)
    tokens, at, line = [], 0, 1
    while at < len(src):
        m = token.match(src, at)
        if not m:
            raise ValueError(at)
        if m.lastgroup:
            tokens.append((m.lastgroup, m.group(), line))
        line += m.group().count("\n")
        at = m.end()
    place = 0

    def value(depth: int = 0):
        nonlocal place
        if depth > 200:
            raise ValueError("too deep")
        kind, text, _ = tokens[place]
        place += 1
        if kind == "s":
            return json.loads(text)
        if kind == "w":
            return json.loads(text)
        if text == "[":
            out = []
            while tokens[place][1] != "]":
                out.append(value(depth + 1))
                if tokens[place][1] == ",":
                    place += 1
            place += 1
            return out
        if text != "{":
            raise ValueError(text)
        pairs = _Pairs()
        while tokens[place][1] != "}":
            kind, text, where = tokens[place]
            if kind != "s" or tokens[place + 1][1] != ":":
                raise ValueError(text)
            place += 2
            pairs.append((json.loads(text), value(depth + 1), where))
            if tokens[place][1] == ",":
                place += 1
        place += 1
        return pairs

    try:
        out = value()
    except (IndexError, RecursionError) as e:
        raise ValueError from e
    if place != len(tokens):
        raise ValueError(place)
    return out


def config_json(rel: str, src: str) -> Fragments:
    """Keys of configuration files, and what they extend, refer to and depend on. Other JSON gives nothing."""
    out, name = Fragments(rel), posixpath.basename(rel).lower()
    try:
        doc = parse_pairs(src) if len(src.encode()) <= JSON_BYTES else None
    except ValueError:
        return out
    if not isinstance(doc, _Pairs) or not (name in CONFIG_NAMES or name.endswith(CONFIG_ENDINGS) or any(k in CONFIG_KEYS for k, _, _ in doc)):
        return out
    out.file_node()
    linked: set[tuple] = set()
    budget = JSON_PAIRS

    def link(source: str, target: str, relation: str, loc: str) -> None:
        if source and target and source != target and (source, target, relation) not in linked:
            linked.add((source, target, relation))
            out.edge(source, target, relation, loc)

    def refer(source: str, text: str, relation: str, loc: str, known: bool = True) -> None:
        id_ = make_id("ref", text)
        if known:
            out.node(id_, sanitize_label(text), loc, "concept")
        link(source, id_, relation, loc)

    def visit(pairs: _Pairs, parent: str, parent_key: str, depth: int) -> None:
        nonlocal budget
        if depth > JSON_DEPTH:
            return
        for key, value, line in pairs:
            if budget <= 0:
                return
            budget -= 1
            if not normalize_id(key):
                continue
            loc, id_ = f"L{line}", make_id(out.stem, parent_key, key)
            out.node(id_, sanitize_label(key), loc)
            link(parent, id_, "contains", loc)
            if isinstance(value, _Pairs):
                visit(value, id_, key, depth + 1)
            elif isinstance(value, list):
                for x in value:
                    if isinstance(x, str) and x:
                        refer(id_, x, "extends", loc)
            elif isinstance(value, str) and value:
                if key == "extends":
                    refer(out.file_id, value, "extends", loc)
                elif key == "$ref":
                    refer(parent, value, "references", loc, False)
                elif parent_key in DEPENDENCY_KEYS:
                    dep = make_id(key)
                    out.node(dep, sanitize_label(key), loc, "concept")
                    link(id_, dep, "imports", loc)

    visit(doc, out.file_id, "", 0)
    return out


# fixed values: files that configure servers, and how package names look
SERVER_FILES = [".mcp.json", "claude_desktop_config.json", "mcp.json", "mcp_servers.json"]
SERVER_LIMIT = 200
NPM = re.compile(r"@[a-z0-9][a-z0-9._-]*/[a-z0-9][a-z0-9._-]*(?:@[\w.\-+]+)?")
PYPI = re.compile(r"[a-z0-9][a-z0-9._-]*-mcp(?:-[a-z0-9._-]+)?|mcp-[a-z0-9][a-z0-9._-]*")


def package_in(args: list[str]) -> str:
    for arg in (a.strip() for a in args):
        if arg and not re.match(r"-{1,2}\w", arg):
            if NPM.fullmatch(arg):
                return "@" + arg[1:].split("@")[0]
            if PYPI.fullmatch(arg):
                return arg
    return ""


def server_config(rel: str, src: str) -> Fragments:
    """Servers with their commands, packages and the names, never the values, of their variables."""
    out = Fragments(rel)
    try:
        doc = json.loads(src)
    except ValueError:
        return out
    servers = doc.get("mcpServers") if isinstance(doc, dict) else None
    if not isinstance(servers, dict) and isinstance(doc, dict) and isinstance(doc.get("mcp"), dict):
        servers = doc["mcp"].get("servers")
    if not isinstance(servers, dict):
        return out
    out.file_node()
    linked: set[tuple] = set()

    def add(source: str, id_: str, label: str, relation: str) -> None:
        out.node(id_, sanitize_label(label), "L1")
        if id_ and source != id_ and (source, id_, relation) not in linked:
            linked.add((source, id_, relation))
            out.edge(source, id_, relation, "L1")

    def fits(s) -> bool:
        return isinstance(s, dict) and isinstance(s.get("command") or "", str) and all(isinstance(a, str) for a in s.get("args") or []) and isinstance(s.get("env") or {}, dict) and all(isinstance(v, str) for v in (s.get("env") or {}).values())

    for name in [n for n in sorted(servers) if n and fits(servers[n])][:SERVER_LIMIT]:
        spec, server = servers[name], make_id(out.stem, "mcp_server", name)
        add(out.file_id, server, name, "contains")
        if command := (spec.get("command") or "").strip():
            add(server, make_id("mcp_command", command), command, "references")
        if package := package_in(spec.get("args") or []):
            add(server, make_id("mcp_package", package), package, "references")
        for variable in sorted(spec.get("env") or {}):
            if variable:
                add(server, make_id("env_var", variable), variable, "requires_env")
    return out
