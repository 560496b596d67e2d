"""From a file's name and bytes to its fragments, one file or a DataFrame of files."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..schema import FRAGMENT
from ..sources.listing import shebang_ext
from . import braces, documents, python, terraform, words
from .base import Fragments

EXTRACTORS = {
    **dict.fromkeys([".js", ".jsx", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx"], braces.javascript),
    **dict.fromkeys([".vue", ".svelte", ".astro"], braces.component),
    **dict.fromkeys([".tf", ".tfvars", ".hcl"], terraform.terraform),
    **dict.fromkeys([".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx"], braces.cpp),
    **dict.fromkeys([".c", ".h"], braces.c),
    **dict.fromkeys([".rb", ".rake"], words.ruby),
    **dict.fromkeys([".php", ".phtml"], braces.php),
    **dict.fromkeys([".sh", ".bash"], words.shell),
    **dict.fromkeys([".scala", ".sc"], braces.scala),
    **dict.fromkeys([".v", ".sv", ".svh", ".vh"], words.verilog),
    **dict.fromkeys([".kt", ".kts"], braces.kotlin),
    **dict.fromkeys([".md", ".mdx", ".markdown", ".skill"], documents.markdown),
    ".go": braces.go, ".py": python.python, ".rs": braces.rust, ".java": braces.java, ".cs": braces.csharp, ".jl": words.julia, ".lua": words.lua, ".zig": braces.zig, ".json": documents.config_json,
}


def extract(rel: str, content: bytes) -> Fragments:
    """A file's fragments; none for a file that no extractor reads."""
    src = content.decode("utf-8", "replace")
    if posixpath.basename(rel) in documents.SERVER_FILES:
        return documents.server_config(rel, src)
    ext = posixpath.splitext(rel)[1].lower() or shebang_ext(content)
    return EXTRACTORS[ext](rel, src) if ext in EXTRACTORS else Fragments(rel)


KINDS = {"node": "nodes", "edge": "edges", "def": "defs", "call": "calls", "import": "imports", "alias": "aliases", "mod_ref": "mod_refs", "md_ref": "md_refs", "label": "labels", "invoke": "invokes"}
COLUMNS = [c.split()[0] for c in FRAGMENT.split(", ")]


def rows(found: Fragments, file_idx: int) -> list[dict]:
    """Fragments as rows of one table; what only one kind has goes to extra, as JSON."""
    out = []
    for kind, name in KINDS.items():
        for pos, x in enumerate(getattr(found, name)):
            row = {k: v for k, v in x.items() if k in COLUMNS}
            if rest := {k: v for k, v in x.items() if k not in COLUMNS}:
                row["extra"] = json.dumps(rest)
            out.append({"file": found.file, "file_idx": file_idx, "kind": kind, "pos": pos, **row})
    return out


def fragment_frame(found: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=COLUMNS).astype(object).where(lambda d: d.notna(), None)


def extract_files(files: DataFrame) -> DataFrame:
    """files: path, idx, content. Rows of FRAGMENT; one file at a time, wherever its partition is."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, idx, content in zip(part["path"], part["idx"], part["content"], strict=True):
                yield fragment_frame(rows(extract(path, bytes(content)), int(idx)))

    return files.select("path", "idx", "content").mapInPandas(run, FRAGMENT)
