"""A small tree of our own: extraction, resolution, assembly, clusters, files, update."""

import json

import pytest

from sourceweave.operators import lookup
from sourceweave.plans import build
from sourceweave.sinks import files
from sourceweave.sources import listing, nodelink
from sourceweave.streaming import incremental

TREE = {
    "util/math.py": '"""Sums and what follows from sums."""\ndef add(a, b):\n    return a + b\n',
    "web/server.py": "import os\nfrom util.math import add as plus\n\n\nclass Server:\n    def start(self):\n        return boot()\n\n\ndef boot():\n    return plus(1, 2)\n",
    "ui/a.ts": 'import { g } from "./b";\nexport function f() { return g(); }\n',
    "ui/b.ts": 'import { f } from "./a";\nexport function g() { return f(); }\n',
    "docs/index.md": "# Start\nsee [orders](tables/orders.md), `boot` and [out](http://x.y)\n",
    "docs/glossary.md": "# Words\n",
    "docs/tables/orders.md": "---\ntype: table\ntitle: Orders\n---\n# Columns\n",
    "tf/main.tf": 'variable "region" {}\nresource "aws_vpc" "main" {}\nresource "aws_instance" "web" {\n  region = var.region\n  depends_on = [aws_vpc.main]\n}\nmodule "net" {\n  source = "./net"\n  stage = "prod"\n}\n',
    "tf/net/label.tf": 'module "this" {\n  source    = "cloudposse/label/null"\n  namespace = "eg"\n  stage     = var.stage\n  name      = "app"\n}\n',
    "tf/out.tf": 'output "id" {\n  value = aws_instance.web.id\n}\n',
    "package.json": '{"dependencies": {"react": "1"}}',
    "data.json": '{"a": [1, 2]}',
    "pyproject.toml": '[project]\nname = "demo"\ndependencies = ["requests>=2"]\n',
    "run": "#!/usr/bin/env bash\nsource ./lib.sh\ngo() {\n  bash tool.sh\n}\n",
    "tool.sh": "echo hi\n",
    "secrets/x.py": "def hidden(): pass\n",
    "skipme/y.py": "def ignored(): pass\n",
    ".gitignore": "skipme/\n",
}


def plant(root, tree):
    for path, text in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    plant(root, TREE)
    return root


@pytest.fixture(scope="module")
def made(spark, tree):
    g = build.build(spark, str(tree))
    return build.Graph(g.nodes.persist(), g.edges.persist(), g.communities.persist())


def links(g):
    return {(r.source, r.relation, r.target, r.confidence) for r in g.edges.collect()}


def test_listing(tree):
    found = listing.collect(str(tree)).files
    assert "run" in found and "ui/a.ts" in found
    assert not any("secrets" in f or "skipme" in f for f in found)


def test_calls(made):
    e = links(made)
    assert ("server_boot", "calls", "math_add", "EXTRACTED") not in e  # ids carry the folder
    assert ("web_server_boot", "calls", "util_math_add", "EXTRACTED") in e
    assert ("web_server_server_start", "calls", "web_server_boot", "INFERRED") in e
    assert ("ui_a_f", "calls", "ui_b_g", "INFERRED") in e
    assert ("web_server_py", "imports", "os", "EXTRACTED") in e
    assert ("ui_a_ts", "imports_from", "ui_b_ts", "EXTRACTED") in e
    assert ("run_go", "calls", "tool_sh", "EXTRACTED") in e


def test_documents(made):
    e = links(made)
    assert ("docs_index", "references", "docs_tables_orders", "EXTRACTED") in e
    assert ("docs_index", "references", "web_server_boot", "EXTRACTED") in e
    assert ("docs_index", "contains", "docs_glossary", "EXTRACTED") in e


def test_terraform(made):
    e = links(made)
    assert ("tf_aws_instance_web", "references", "tf_var_region", "EXTRACTED") in e
    assert ("tf_aws_instance_web", "depends_on", "tf_aws_vpc_main", "EXTRACTED") in e
    assert ("tf_output_id", "references", "tf_aws_instance_web", "EXTRACTED") in e
    assert ("tf_module_net", "references", "tfmodule_tf_net", "EXTRACTED") in e
    named = {r.id: r.computed_name for r in made.nodes.collect()}
    assert named["tf_net_module_this"] == "eg-prod-app"


def test_packages(made):
    assert ("pkg_demo", "depends_on", "pkg_requests", "EXTRACTED") in links(made)


def test_graph_is_sound(made):
    assert lookup.validate(made.nodes, made.edges).count() == 0
    assert made.communities.count() == made.nodes.count() == made.communities.select("id").distinct().count()


def test_files_round_trip(spark, made, tmp_path):
    path = str(tmp_path / "graph.json")
    files.write_json(made.nodes, made.edges, path)
    nodes, edges = nodelink.read(spark, path)
    assert nodes.count() == made.nodes.count() and edges.count() == made.edges.count()
    assert lookup.diff_summary(lookup.diff_nodes(nodes, made.nodes), lookup.diff_edges(edges, made.edges)) == "no changes"
    files.write_graphml(made.nodes, made.edges, str(tmp_path / "g.graphml"))
    files.write_dot(made.nodes, made.edges, str(tmp_path / "g.dot"))
    files.write_csv(made.nodes, made.edges, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    files.write_bundle(made.nodes, made.edges, str(tmp_path / "b"))
    assert (tmp_path / "b" / "ui" / "a_ts" / "index.md").exists() and (tmp_path / "b" / "index.md").exists()
    text = files.report(made.nodes, made.edges, made.communities, "demo")
    assert "2-file cycle: `ui/b.ts -> ui/a.ts -> ui/b.ts`" in text
    merged = nodelink.merge_documents(path, path)
    assert len(merged["nodes"]) == nodes.count()
    ids = {n["id"] for n in json.load(open(path))["nodes"]}
    with pytest.raises(files.ShrinkError):
        files.check_shrink(path, ids - {"ui_a_f"}, set(), {"ui/a.ts"}, str(tmp_path))
    files.check_shrink(path, ids - {"ui_a_f"}, {"ui/a.ts"}, set(), str(tmp_path))
    files.check_shrink(path, set(), set(), set(), str(tmp_path), force=True)


def test_update(spark, tmp_path):
    root, state = tmp_path / "t", str(tmp_path / "state")
    plant(root, {k: TREE[k] for k in ("util/math.py", "web/server.py", "ui/a.ts", "ui/b.ts")})
    first, counts = incremental.update(spark, str(root), state)
    assert counts == {"parsed": 4}
    before = links(first)
    again, counts = incremental.update(spark, str(root), state)
    assert counts == {"reused": 4} and links(again) == before
    (root / "ui/b.ts").unlink()
    (root / "util/math.py").write_text("def sub(a, b):\n    return a - b\n")
    third, counts = incremental.update(spark, str(root), state)
    assert counts == {"parsed": 1, "reused": 2, "dropped": 1}
    full = build.build(spark, str(root))
    assert links(third) == links(full)
