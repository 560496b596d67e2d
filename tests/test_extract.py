"""One small source for each language: what it must say."""

import pytest

from sourceweave.extract import manifests
from sourceweave.extract.dispatch import extract
from sourceweave.extract.terraform import compose, label_inputs
from sourceweave.functions.families import family
from sourceweave.functions.ids import clean_join, make_id, norm_label, normalize_id, sanitize_label
from sourceweave.functions.terms import query_terms
from sourceweave.sources.listing import Ignore, is_sensitive, shebang_ext
from sourceweave.sources.nodelink import size_cap

SOURCES = {
    "m.go": ('package a\nimport (\n  "fmt"\n  x "os"\n)\ntype (\n  Calc struct{ n int }\n)\nfunc Add(a, b int) int { return a + b }\nfunc (c *Calc) Sum() int { return Add(1, c.n) }\n', {"Add()", "Calc", "Calc.Sum()"}, {("Sum", "Add")}, {"fmt", "os"}),
    "s.ts": ('import { Add } from "../m";\nexport class Server {\n  async start(a: string): Promise<void> { boot(); }\n}\nexport const boot = (a: number) => {\n  return Add(a, 2);\n};\ninterface P { a: string }\n', {"Server", "Server.start()", "boot()", "P"}, {("start", "boot"), ("boot", "Add")}, {"../m"}),
    "s.rs": ("use std::io::{self, Read};\nstruct Server { p: u16 }\nimpl Server { fn start(&self) { boot() } }\nfn boot() -> i32 { math::add(1, 2) }\n", {"Server", "Server.start()", "boot()"}, {("start", "boot"), ("boot", "add")}, {"std::io"}),
    "s.c": ('#include <stdio.h>\nstruct Server {\n  int (*start)(int a);\n};\nint boot(int n) { return add(n, 1); }\nint run(void) { return boot(1); }\n', {"Server", "Server.start()", "boot()", "run()"}, {("run", "boot"), ("boot", "add")}, {"stdio.h"}),
    "s.cpp": ("#include <string>\nnamespace w {\nclass Server {\npublic:\n  int start() { return boot(); }\n};\nint boot() { return add(1, 2); }\n}\nint Server::stop(int a) { return boot(); }\n", {"Server", "Server.start()", "Server.stop()", "boot()"}, {("start", "boot"), ("stop", "boot"), ("boot", "add")}, {"string"}),
    "S.java": ("import util.Math;\nclass Server {\n  void start() { boot(); }\n  int boot() { return Math.add(1, 2); }\n}\nenum Color { RED, GREEN { void greet() { boot(); } } }\n", {"Server", "Server.start()", "Server.boot()", "Color", "RED", "GREEN", "GREEN.greet()"}, {("start", "boot"), ("boot", "add")}, {"util.Math"}),
    "s.cs": ("using System.Text;\nint Boot()\n{\n  return Add(1, 2);\n}\nnamespace Web\n{\n  class Server\n  {\n    public int Start()\n    {\n      return Boot();\n    }\n  }\n}\n", {"Boot()", "Server", "Server.Start()"}, {("Start", "Boot"), ("Boot", "Add")}, {"System.Text"}),
    "s.rb": ("require 'json'\nclass Server\n  def start\n    boot\n  end\nend\ndef boot\n  add(1, 2) if x\nend\n", {"Server", "Server.start()", "boot()"}, {("start", "boot"), ("boot", "add")}, {"json"}),
    "s.php": ("<?php\nuse Psr\\Log\\LoggerInterface;\nclass Server {\n  public function start() { return boot(); }\n}\nfunction boot() { return add(1, 2); }\n", {"Server", "Server.start()", "boot()"}, {("start", "boot"), ("boot", "add")}, {"Psr\\Log\\LoggerInterface"}),
    "s.scala": ("import scala.collection.mutable.Map\ndef boot(): Int = add(1, 2)\nclass Server {\n  def start(): Int = boot()\n}\n", {"boot()", "Server", "Server.start()"}, {("start", "boot"), ("boot", "add")}, {"scala.collection.mutable.Map"}),
    "s.jl": ("using LinearAlgebra\nimport Printf\nstruct Circle\n  r::Float64\nend\nmodule Shapes\nfunction area(c)\n  return scale(c)\nend\nend\ncube(x) = mul(x, x)\n", {"Circle", "Shapes", "Shapes.area()", "cube()"}, {("area", "scale"), ("cube", "mul")}, {"LinearAlgebra", "Printf"}),
    "s.sv": ('`include "defs.svh"\nfunction int compute(int x);\n  return add(x, 1);\nendfunction\nclass Counter;\n  function void step();\n    total = compute(2);\n  endfunction\nendclass\nmodule alu;\nendmodule\n', {"compute()", "Counter", "Counter.step()", "alu"}, {("compute", "add"), ("step", "compute")}, {"defs.svh"}),
    "s.kt": ("import kotlin.math.sqrt\nclass Server {\n  fun start(): Int {\n    return boot()\n  }\n  fun boot(): Int = add(1, 2)\n}\n", {"Server", "Server.start()", "Server.boot()"}, {("start", "boot"), ("boot", "add")}, {"kotlin.math.sqrt"}),
    "s.lua": ('local socket = require("socket")\nlocal Server = {}\nfunction Server.start(self)\n  boot()\nend\nfunction boot()\n  if x then y() end\n  return add(1, 2)\nend\n', {"Server", "Server.start()", "boot()"}, {("start", "boot"), ("boot", "add")}, {"socket"}),
    "s.zig": ('const std = @import("std");\npub const Server = struct {\n  pub fn start(self: *Server) void { boot(); }\n};\npub fn boot() void { const t = add(1, 2); }\n', {"Server", "Server.start()", "boot()"}, {("start", "boot"), ("boot", "add")}, {"std"}),
    "s.py": ("import os\nfrom util.math import add\nclass Server:\n  def start(self):\n    return boot()\ndef boot():\n  return add(1, 2)\n", {"Server", "Server.start()", "boot()"}, {("start", "boot"), ("boot", "add")}, {"os", "util.math"}),
    "m.sh": ("source ./math.sh\n. /etc/profile\nboot() {\n  add 1 2\n}\n", {"boot()"}, {("boot", "add")}, {"./math.sh", "/etc/profile"}),
    "c.vue": ('<template><a/></template>\n<script lang="ts">\nimport x from "./x"\nfunction f() { g() }\n</script>\n', {"f()"}, {("f", "g")}, {"./x"}),
}


@pytest.mark.parametrize("name", SOURCES)
def test_language(name):
    src, labels, calls, imports = SOURCES[name]
    found = extract(name, src.encode())
    assert labels <= {n["label"] for n in found.nodes}
    assert calls <= {(c["caller_id"].rsplit("_", 1)[-1] if name != "s.cs" else {"boot": "Boot", "start": "Start"}[c["caller_id"].rsplit("_", 1)[-1]], c["callee"]) for c in found.calls} | {(c["caller_id"].rsplit("_", 1)[-1].capitalize(), c["callee"]) for c in found.calls}
    assert imports == {i["spec"] for i in found.imports}


@pytest.mark.parametrize("name", [*SOURCES, "x.json", "x.tf", "x.md", ".mcp.json"])
@pytest.mark.parametrize("src", ["", "{", "((((", "'\"`\n", "\0\n", "end end end }", "def", "é" * 50])
def test_odd_sources(name, src):
    extract(name, src.encode())


def test_config():
    found = extract("package.json", b'{\n "dependencies": {"react": "1"},\n "extends": "./base"}')
    edges = {(e["source"], e["relation"], e["target"], e["loc"]) for e in found.edges}
    assert ("package_dependencies_react", "imports", "react", "L2") in edges and ("package_json", "extends", "ref_base", "L3") in edges
    assert not extract("d.json", b"[1]").nodes and not extract("d.json", b'{"a": 1}').nodes


def test_server_config():
    found = extract(".mcp.json", b'{"mcpServers": {"fs": {"command": "npx", "args": ["-y", "@a/b@1.2"], "env": {"TOK": "hidden"}}}}')
    assert {"fs", "npx", "@a/b", "TOK"} <= {n["label"] for n in found.nodes} and "hidden" not in str(found)


def test_manifests(tmp_path):
    found = manifests.packages({"go.mod": "module a.b/c\nrequire (\n  x.y/z v1.0\n)\n", "p/pom.xml": "<project xmlns='u'><groupId>g</groupId><artifactId>a</artifactId><dependencies><dependency><artifactId>d</artifactId></dependency></dependencies></project>", "q/pom.xml": "<broken"})
    assert {(e["source"], e["target"]) for e in found.edges} == {("pkg_a_b_c", "pkg_x_y_z"), ("pkg_g_a", "pkg_d")}
    for path, text in {"Cargo.toml": '[workspace]\nmembers = ["c/*"]\n', "c/a/Cargo.toml": '[package]\nname = "a"\n[dependencies]\ndb = {path = "../b", package = "b"}\nserde = "1"\n', "c/b/Cargo.toml": '[package]\nname = "b"\n'}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    assert [(e["source"], e["target"]) for e in manifests.cargo(str(tmp_path)).edges] == [("crate:a", "crate:b")]


LABELS = [
    ({"name": '"asdf"', "attributes": '["1", "2"]', "delimiter": '"!"'}, "asdf!1!2"),
    ({"name": '"asdf"', "attributes": '["1", "2"]', "delimiter": '"!"', "label_order": '["attributes", "name"]'}, "1!2!asdf"),
    ({"namespace": '"eg"', "stage": '"prod"', "name": '"app"'}, "eg-prod-app"),
    ({"namespace": '"eg"', "stage": '""', "name": '"app"'}, "eg-app"),
    ({"namespace": '"EG"', "name": '"App"', "label_value_case": '"none"'}, "EG-App"),
    ({"namespace": '"eg_x"', "name": '"a.b"'}, "egx-ab"),
    ({"name": '"app"', "attributes": '["a", "a", "b"]'}, "app-a-b"),
    ({"namespace": "var.namespace", "name": '"app"', "context": "module.base"}, "{namespace}-app (partial)"),
    ({"name": '"app"', "label_order": "var.order"}, ""),
    ({"name": "var.name"}, ""),
]


@pytest.mark.parametrize("attrs,want", LABELS)
def test_labels(attrs, want):
    assert compose(label_inputs(attrs)) == want


def test_ids():
    table = [(("main.go",), "main_go"), (("server", "HandleRequest"), "server_handlerequest"), (("  foo  ", "Bar()"), "foo_bar"), (("a__b",), "a_b"), (("_._leading",), "leading"), (("café",), "café"), (("", "x"), "x")]
    for parts, want in table:
        assert make_id(*parts) == want and normalize_id(want) == want
    assert norm_label("Größe É") == "große e" and sanitize_label("a\x00b") == "ab" and len(sanitize_label("é" * 300).encode()) == 256
    assert clean_join("a/b", "../c") == "a/c" and clean_join("a", "/x") == "a/x" and clean_join(".", "./x") == "x"
    assert family("a/b.GO") == "go" and family("x.unknown") is None


def test_terms():
    assert query_terms("Is an auth-token ok?") == ["auth", "token"]
    assert query_terms("how does the cache work") == ["cache"]
    assert query_terms("wie funktioniert das") == ["wie", "funktioniert", "das"]
    assert query_terms("warum funktioniert die Größe nicht") == ["größe"]


def test_secrets_and_sizes():
    for kept in ("password_reset.go", "passwords_controller.rb", "credentials_controller.rb", "secret_store.py"):
        assert not is_sensitive(kept)
    for gone in ("credentials.json", "secrets.yaml", ".env", "id_rsa", "server.pem", "secret_notes.md", "credentials.md", "password.mdx", "secrets.markdown", ".ssh/config.py"):
        assert is_sensitive(gone)
    assert [size_cap(x) for x in (None, " ", "x", "0", "-5", "1GB", "640mb", "123456")] == [512 << 20] * 5 + [1 << 30, 640 << 20, 123456]
    assert shebang_ext(b"#!/usr/bin/env -S X=1 python3\n") == ".py" and shebang_ext(b"#!/bin/fish\n") == "" and shebang_ext(b"x") == ""


def test_ignore(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".gitignore").write_text("*.log\n/top.go\nbuild/\n!keep.log\n[ab].go\n")
    (tmp_path / "sub" / ".gitignore").write_text("inner.go\n")
    ig = Ignore(str(tmp_path))
    assert ig.ignored("a.log") and not ig.ignored("keep.log") and ig.ignored("top.go") and not ig.ignored("sub/top.go")
    assert ig.ignored("x/build/y.go") and ig.ignored("sub/inner.go") and not ig.ignored("inner.go") and not ig.ignored("a.go")
