"""The command line: python -m sourceweave.cli VERB ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from .operators import ask, lookup, traverse
from .plans import build
from .sinks import files
from .sources import listing, nodelink
from .streaming import incremental

OUT = "sourceweave-out"


def session() -> SparkSession:
    return SparkSession.builder.appName("sourceweave").config("spark.ui.enabled", "false").getOrCreate()


def _write(g: build.Graph, root: str, force: bool, with_clusters: bool) -> None:
    out = os.path.join(root, OUT)
    ids = {r.id: r.source_file for r in g.nodes.select("id", "source_file").toLocalIterator()}
    try:
        files.check_shrink(f"{out}/graph.json", set(ids), set(ids.values()), set(listing.collect(root).unreadable), root, force)
    except files.ShrinkError as e:
        print(f"warning: {e}", file=sys.stderr)
        return
    commit = build.git_head(root)
    files.write_json(g.nodes, g.edges, f"{out}/graph.json", commit)
    if with_clusters:
        files.write_text(f"{out}/GRAPH_REPORT.md", files.report(g.nodes, g.edges, g.communities, os.path.basename(os.path.abspath(root)), commit))
    print(f"{len(ids)} nodes written to {out}")


def _load(spark: SparkSession, path: str):
    return nodelink.read(spark, nodelink.inside(os.getcwd(), path))


def _id(nodes, name: str) -> str:
    row = lookup.resolve_symbol(nodes, name).first()
    if row is None:
        sys.exit(f"no node matches {name!r}")
    return row.id


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sourceweave")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: str, graph: bool = True, **flags):
        v = verbs.add_parser(name)
        for a in args:
            v.add_argument(a, **({"nargs": "?", "default": "."} if a == "path" else {}))
        if graph:
            v.add_argument("--graph", default=f"{OUT}/graph.json")
        for f, kind in flags.items():
            v.add_argument("--" + f.replace("_", "-"), **kind)

    on, many = {"action": "store_true"}, {"action": "append"}
    for name in ("build", "update"):
        verb(name, "path", graph=False, cargo=on, no_manifests=on, force=on, no_cluster=on)
    verb("watch", "path", graph=False)
    verb("query", "pattern")
    verb("ask", "question", depth={"type": int, "default": 2}, budget={"type": int, "default": 2000}, dfs=on)
    verb("explain", "name")
    verb("path", "source", "target")
    verb("extract", "file", graph=False)
    verb("export", "format", "out")
    verb("affected", graph=True, file=many, depth={"type": int, "default": 0}, relation=many)
    verb("diff", "old", "new", graph=False, json=on)
    verb("merge-driver", "base", "current", "other", graph=False)
    verb("validate")
    verb("serve")
    verb("hook", "action", graph=False)
    verb("version", graph=False)
    a = p.parse_args(argv)
    if a.verb == "version":
        print("1")
        return 0
    if a.verb == "merge-driver":
        files.write_text(a.current, json.dumps(nodelink.merge_documents(a.current, a.other), indent=2, ensure_ascii=False))
        return 0
    if a.verb == "hook":
        return hook(a.action)
    if a.verb == "extract":
        from .extract.dispatch import extract

        with open(a.file, "rb") as f:
            found = extract(a.file, f.read())
        print(json.dumps({"nodes": found.nodes, "edges": found.edges}, indent=2))
        return 0
    spark = session()
    if a.verb == "build":
        _write(build.build(spark, a.path, not a.no_manifests, a.cargo, not a.no_cluster), a.path, a.force, not a.no_cluster)
    elif a.verb == "update":
        g, counts = incremental.update(spark, a.path, os.path.join(a.path, OUT, "state"), not a.no_manifests, a.cargo)
        _write(g, a.path, a.force, True)
        print(", ".join(f"{n} {k}" for k, n in sorted(counts.items())))
    elif a.verb == "watch":
        incremental.watch(spark, a.path, os.path.join(a.path, OUT, "state"), lambda g, c: _write(g, a.path, False, True)).awaitTermination()
    elif a.verb == "diff":
        (on_, oe), (nn, ne) = nodelink.read(spark, a.old), nodelink.read(spark, a.new)
        nodes, edges = lookup.diff_nodes(on_, nn), lookup.diff_edges(oe, ne)
        if a.json:
            print(json.dumps({"nodes": [r.asDict() for r in nodes.orderBy("label", "id").collect()], "edges": [r.asDict() for r in edges.orderBy(*lookup.KEY).collect()]}))
        else:
            print(lookup.diff_summary(nodes, edges))
    else:
        return _read_verbs(spark, a)
    return 0


def _read_verbs(spark: SparkSession, a) -> int:
    nodes, edges = _load(spark, a.graph)
    if a.verb == "query":
        for r in lookup.search(nodes, a.pattern).collect():
            print(f"{r.label}  {r.source_file}:{(r.source_location or '').lstrip('L')}")
    elif a.verb == "ask":
        if a.budget <= 0:
            sys.exit("budget must be over 0")
        print(ask.ask(nodes, edges, a.question, "dfs" if a.dfs else "bfs", a.depth, a.budget))
    elif a.verb == "explain":
        for r in lookup.explain(nodes, edges, _id(nodes, a.name)).collect():
            print(f"{r.dir} {r.relation} {r.label} [{r.confidence}]")
    elif a.verb == "path":
        found = traverse.shortest_path(edges, _id(nodes, a.source), _id(nodes, a.target))
        names = {r.id: r.label or r.id for r in nodes.where(nodes.id.isin(found)).collect()} if found else {}
        print(" -> ".join(names[i] for i in found) or "no path")
    elif a.verb == "affected":
        for r in traverse.affected(nodes, edges, a.file or build.git_changed("."), a.relation, a.depth).collect():
            print(f"{r.change} {r.label} {r.source_file}")
    elif a.verb == "export":
        write = {"graphml": files.write_graphml, "dot": files.write_dot, "json": files.write_json, "okf": files.write_bundle, "parquet": files.write_tables, "csv": lambda n, e, o: files.write_csv(n, e, f"{o}.nodes.csv", f"{o}.edges.csv")}
        write[a.format](nodes.withColumn("computed_name", nodes.computed_name), edges, a.out)
    elif a.verb == "validate":
        issues = [r.issue for r in lookup.validate(nodes, edges).collect()]
        print("\n".join(issues) or "ok")
        return 1 if issues else 0
    elif a.verb == "serve":
        from .server import Server

        Server(nodes, edges).run(sys.stdin, sys.stdout)
    return 0


HOOKS = ["post-commit", "post-merge", "post-checkout"]
MARK = "# sourceweave update"


def hook(action: str, root: str = ".") -> int:
    """install, uninstall or status of the git hooks that run update."""
    folder = os.path.join(root, ".git", "hooks")
    for name in HOOKS:
        path = os.path.join(folder, name)
        text = open(path).read() if os.path.exists(path) else ""
        if action == "status":
            print(f"{name}: {'installed' if MARK in text else 'not installed'}")
        elif action == "install" and MARK not in text:
            files.write_text(path, (text or "#!/bin/sh\n") + f"{MARK}\npython -m sourceweave.cli update . || true\n")
            os.chmod(path, 0o755)
        elif action == "uninstall" and MARK in text:
            lines = text.split("\n")
            i = lines.index(MARK)
            del lines[i : i + 2]
            rest = "\n".join(lines)
            if rest.strip() in ("", "#!/bin/sh"):
                os.remove(path)
            else:
                files.write_text(path, rest)
    return 0


if __name__ == "__main__":
    try:
        sys.exit(main())
    except BrokenPipeError:
        sys.exit(0)
