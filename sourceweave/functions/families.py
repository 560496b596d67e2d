"""Languages whose symbols can call one another."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: extensions of each family
FAMILIES = {
    "go": [".go"],
    "rust": [".rs"],
    "jsts": [".js", ".jsx", ".mjs", ".cjs", ".ts", ".mts", ".cts", ".tsx"],
    "py": [".py"],
    "jvm": [".java", ".kt", ".kts", ".scala", ".sc"],
    "native": [".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx"],
    "dotnet": [".cs"],
    "ruby": [".rb", ".rake"],
    "php": [".php", ".phtml"],
    "lua": [".lua"],
    "julia": [".jl"],
    "zig": [".zig"],
    "verilog": [".v", ".sv", ".svh", ".vh"],
    "shell": [".sh", ".bash"],
}
BY_EXT = {e: f for f, own in FAMILIES.items() for e in own}


def family(path: str | None) -> str | None:
    return BY_EXT.get(os.path.splitext("x" + os.path.basename(path or ""))[1].lower())


def family_of(path: Column) -> Column:
    """The family of a path's extension; null if unknown."""
    table = F.create_map(*[F.lit(x) for pair in BY_EXT.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))]


def crosses(a: Column, b: Column) -> Column:
    """Both families are known and they differ."""
    return F.coalesce(family_of(a) != family_of(b), F.lit(False))
