"""Terraform blocks, their references, and the names that label modules compose.

A value is a string, a list of strings, EMPTY (null or "") or UNKNOWN (not a literal). References are read from the
text of an attribute, with strings blank but for their interpolations.
"""

from __future__ import annotations

import posixpath
import re

from ..functions.ids import make_id
from .base import Fragments, Syntax, Text

UNKNOWN, EMPTY = None, ""
# fixed values: fields of a label, their usual order, and what is no address
FIELDS = ["namespace", "tenant", "environment", "stage", "name"]
ORDER = ["namespace", "environment", "stage", "name", "attributes"]
META = {"each", "count", "self", "path", "terraform", "true", "false", "null", "for", "in", "if", "else", "endif", "endfor"}
IDENT = r"[A-Za-z_][\w-]*"


def scope_of(rel: str) -> str:
    return posixpath.dirname(rel) or "tf"


def _interpolated(text: str) -> str:
    """A value's text with strings blank, except inside ${...}."""

    def plain(m: re.Match) -> str:
        keep = [x.span(1) for x in re.finditer(r"(?<!\$)\$\{((?:[^{}]|\{[^{}]*\})*)\}", m.group())]
        return "".join(c if c == "\n" or any(a <= i < b for a, b in keep) else " " for i, c in enumerate(m.group()))

    return re.sub(r'"(?:[^"\\$]|\\.|\$\{(?:[^{}]|\{[^{}]*\})*\}|\$(?!\{))*"', plain, text)


def addresses(text: str) -> list[str]:
    out = []
    for m in re.finditer(rf"(?<![\w.\"-])({IDENT})((?:\s*\[[^\]]*\])?(?:\.{IDENT})+)", _interpolated(text)):
        head, parts = m.group(1), re.findall(rf"\.({IDENT})", m.group(2)) if "[" not in m.group(2).split(".")[0] else []
        if head in META or not parts:
            continue
        if head == "data":
            if len(parts) >= 2:
                out.append(f"data.{parts[0]}.{parts[1]}")
        else:
            out.append(f"{head}.{parts[0]}")
    return out


def literal(text: str):
    """A string's value; "" for null, None if it is no literal string."""
    text = text.strip()
    if text == "null":
        return EMPTY
    m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"', text)
    return UNKNOWN if not m or "${" in m.group(1) else m.group(1)


def literal_list(text: str):
    text = text.strip()
    if text == "null":
        return []
    if not re.fullmatch(r"\[.*\]", text, re.S):
        return UNKNOWN
    parts = [literal(x) for x in re.findall(r'"(?:[^"\\]|\\.)*"|[^\s,\[\]]+', text[1:-1])]
    return UNKNOWN if any(p is UNKNOWN for p in parts) else [p for p in parts if p]


def variable(text: str) -> str:
    m = re.fullmatch(rf"var\.({IDENT})", text.strip())
    return m.group(1) if m else ""


def is_label(source: str) -> bool:
    return "cloudposse/label/null" in source or "terraform-null-label" in source


def label_inputs(attrs: dict[str, str]) -> dict:
    """What a label module is given. fields: value, EMPTY or UNKNOWN of each; attributes: a list or UNKNOWN."""
    out = {"fields": {}, "vars": {}, "context": "", "has_context": "context" in attrs, "broken": False, "delimiter": "-", "order": list(ORDER), "case": "lower", "attributes": [], "attributes_set": False}
    for f in FIELDS:
        value = literal(attrs[f]) if f in attrs else EMPTY
        out["fields"][f] = value
        if value is UNKNOWN and variable(attrs[f]):
            out["vars"][f] = variable(attrs[f])
    if "attributes" in attrs:
        out["attributes"] = literal_list(attrs["attributes"])
        out["attributes_set"] = attrs["attributes"].strip() != "null"
        if out["attributes"] is UNKNOWN and variable(attrs["attributes"]):
            out["vars"]["attributes"] = variable(attrs["attributes"])
    if out["has_context"]:
        out["context"] = next(iter(addresses(attrs["context"])), "") if re.fullmatch(rf"{IDENT}(\.{IDENT})*", attrs["context"].strip()) else ""
    if "delimiter" in attrs:
        value = literal(attrs["delimiter"])
        out["broken"] |= value is UNKNOWN
        out["delimiter"] = "-" if attrs["delimiter"].strip() == "null" or value is UNKNOWN else value
    if "label_value_case" in attrs:
        value = literal(attrs["label_value_case"])
        out["broken"] |= value is UNKNOWN
        out["case"] = (value or "lower").lower()
    if "label_order" in attrs:
        value = literal_list(attrs["label_order"])
        out["broken"] |= value is UNKNOWN
        out["order"] = value or list(ORDER)
    return out


def segment(value: str, case: str) -> str:
    bare = re.sub(r"[^-a-zA-Z0-9]", "", value)
    return {"none": bare, "upper": bare.upper(), "title": bare[:1].upper() + bare[1:].lower()}.get(case, bare.lower())


def compose(x: dict) -> str:
    """The name: known parts, {part} for unknown ones and then " (partial)" at the end; nothing if nothing is known."""
    if x["broken"]:
        return ""
    parts, known, partial = [], 0, x["has_context"]
    for key in x["order"]:
        value = x["attributes"] if key == "attributes" else x["fields"].get(key, EMPTY)
        if value is UNKNOWN:
            parts.append("{" + key + "}")
            partial = True
            continue
        own = [segment(v, x["case"]) for v in (value if isinstance(value, list) else [value])]
        own = [v for v in dict.fromkeys(own) if v]
        if own:
            parts.append(x["delimiter"].join(own))
            known += 1
    return "" if not known else x["delimiter"].join(parts) + (" (partial)" if partial else "")


class Hcl:
    """Blocks and attributes of a text, by brackets."""

    def __init__(self, src: str):
        self.t = Text(src, Syntax(line=("//", "#"), quotes=()))
        masked = re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: '"' + re.sub(r"[^\n]", " ", m.group()[1:-1]) + '"', self.t.code)
        self.code, self.pair = masked, {}
        stack: list[int] = []
        for m in re.finditer(r"[{}\[\]()]", masked):
            if m.group() in "{[(":
                stack.append(m.start())
            elif stack:
                self.pair[stack.pop()] = m.start()

    def items(self, a: int, b: int):
        """(kind, name, labels, where, begin, end) of the attributes and blocks between a and b."""
        at = a
        pattern = re.compile(rf'\s*(?:({IDENT})\s*=(?!=)|({IDENT})((?:\s+(?:"[^"]*"|{IDENT}))*)\s*\{{)')
        while at < b:
            m = pattern.match(self.code, at, b)
            if not m:
                line = self.code.find("\n", at, b)
                at = b if line < 0 else line + 1
                continue
            if m.group(1):
                i = m.end()
                while i < b and self.code[i] != "\n":
                    i = self.pair.get(i, i) + 1 if self.code[i] in "{[(" else i + 1
                yield "attribute", m.group(1), [], m.start(1), m.end(), min(i, b)
                at = i
            else:
                end = self.pair.get(m.end() - 1, b)
                yield "block", m.group(2), re.findall(rf'"([^"]*)"|({IDENT})', self.t.text[m.start(3) : m.end(3)]), m.start(2), m.end(), end
                at = end + 1

    def attributes(self, a: int, b: int):
        """All attributes at any depth of blocks."""
        for kind, name, _, at, x, y in self.items(a, b):
            if kind == "attribute":
                yield name, at, self.t.bare[x:y]
            else:
                yield from self.attributes(x, y)


def terraform(rel: str, src: str) -> Fragments:
    out, hcl, scope = Fragments(rel), Hcl(src), scope_of(rel)
    out.file_node()

    def define(address: str, loc: str, label: str = "", computed: str = "") -> str:
        id_ = make_id(scope, address)
        if out.node(id_, label or address, loc, computed=computed):
            out.edge(out.file_id, id_, "contains", loc)
        return id_

    def refer(source: str, name: str, at: int, text: str) -> None:
        relation = {"depends_on": "depends_on", "context": "inherits_context"}.get(name, "references")
        for address in addresses(text):
            if (target := make_id(scope, address)) != source:
                out.edge(source, target, relation, hcl.t.line(at))

    for kind, name, raw, at, a, b in hcl.items(0, len(hcl.code)):
        labels, loc = [x or y for x, y in raw], hcl.t.line(at)
        if kind != "block":
            continue
        if name == "locals":
            for k, key, _, where, x, y in hcl.items(a, b):
                if k == "attribute":
                    refer(define(f"local.{key}", hcl.t.line(where)), key, where, hcl.t.bare[x:y])
            continue
        if name in ("resource", "data") and len(labels) >= 2:
            address = ".".join(labels[:2]) if name == "resource" else f"data.{labels[0]}.{labels[1]}"
        elif name in ("module", "variable", "output", "provider") and labels:
            address = {"variable": "var"}.get(name, name) + "." + labels[0]
        else:
            continue
        if name == "module":
            own = {k: hcl.t.bare[x:y].strip() for kk, k, _, _, x, y in hcl.items(a, b) if kk == "attribute"}
            source = literal(own.get("source", "null")) or ""
            inputs = label_inputs(own) if is_label(source) else None
            id_ = define(address, loc, address + " [null-label]" if inputs else "", compose(inputs) if inputs else "")
            if source:
                out.mod_refs.append({"from_id": id_, "source": source, "loc": loc})
            args, passed = {}, {}
            for key, text in own.items():
                if key in ("source", "version"):
                    continue
                if variable(text):
                    passed[key] = variable(text)
                elif (value := literal(text)) is not UNKNOWN or (value := literal_list(text)) is not UNKNOWN:
                    args[key] = value
            out.invokes.append({"id": id_, "dir": scope, "args": args, "passed": passed})
            if inputs:
                out.labels.append({"id": id_, "scope": scope, "address": address, "inputs": inputs})
        else:
            id_ = define(address, loc)
        if name not in ("variable", "provider"):
            for key, where, text in hcl.attributes(a, b):
                refer(id_, key, where, text)
    return out


DEPTH = 8


def _exact(name: str) -> bool:
    return bool(name) and "{" not in name and not name.endswith("(partial)")


def _count(name: str) -> int:
    return sum(1 for s in name.removesuffix(" (partial)").split("-") if s and not s.startswith("{"))


def complete_labels(labels: list[dict], invokes: list[dict], callers: dict[str, list[str]]) -> dict[str, str]:
    """Better names for label modules, by id. callers: ids of the module blocks that call each folder; only a folder with one caller takes values from it."""
    by_id = {i["id"]: i for i in invokes}
    by_address = {(x["scope"], x["address"]): x for x in labels}

    def caller(folder: str) -> dict | None:
        own = [by_id[i] for i in callers.get(folder, []) if i in by_id]
        return own[0] if len(own) == 1 else None

    def argument(call: dict, name: str, depth: int):
        if name in call["args"]:
            return call["args"][name]
        outer = caller(call["dir"]) if name in call["passed"] and depth < DEPTH else None
        return argument(outer, call["passed"][name], depth + 1) if outer else UNKNOWN

    def filled(x: dict, depth: int) -> dict:
        inp = x["inputs"]
        out = {**inp, "fields": dict(inp["fields"])}
        call = caller(x["scope"])
        for key, name in inp["vars"].items():
            value = argument(call, name, depth) if call else UNKNOWN
            if key == "attributes":
                if isinstance(value, list) or value == EMPTY and value is not UNKNOWN:
                    out["attributes"], out["attributes_set"] = list(value or []), True
            elif isinstance(value, str) and value:
                out["fields"][key] = value
        parent = by_address.get((x["scope"], inp["context"])) if inp["context"] and depth < DEPTH else None
        if parent:
            above = filled(parent, depth + 1)
            for key in FIELDS:
                if not out["fields"][key] and above["fields"][key] != EMPTY:
                    out["fields"][key] = above["fields"][key]
            if above["attributes_set"] and isinstance(above["attributes"], list):
                own = out["attributes"] if out["attributes_set"] and isinstance(out["attributes"], list) else []
                out["attributes"], out["attributes_set"] = above["attributes"] + own, True
            if _exact(compose(above)):
                out["has_context"], out["context"] = False, ""
        return out

    better = {}
    for x in labels:
        before = compose(x["inputs"])
        if _exact(before):
            continue
        after = compose(filled(x, 0))
        if after and after != before and (_exact(after) or _count(after) > _count(before)):
            better[x["id"]] = after
    return better
