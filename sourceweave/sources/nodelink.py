"""Graphs as node-link JSON: the interchange form, one document."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EDGE, GRAPH_NODE

# fixed values: sizes that are read
READ_BYTES, MERGE_BYTES, MERGE_NODES = 512 << 20, 50 << 20, 100_000


def size_cap(text: str | None, default: int = READ_BYTES) -> int:
    """Bytes of "1GB", "640mb" or a plain number; the default for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*(mb|gb)?\s*", (text or "").lower())
    value = int(m.group(1)) * {"mb": 1 << 20, "gb": 1 << 30, None: 1}[m.group(2)] if m else 0
    return value if value > 0 else default


def check_size(path: str, most: int) -> None:
    if os.path.getsize(path) > most:
        raise ValueError(f"{path} is larger than {most} bytes")


def inside(base: str, path: str) -> str:
    """path, if it is an existing file below base."""
    full = os.path.abspath(path)
    if os.path.commonpath([os.path.abspath(base), full]) != os.path.abspath(base) or not os.path.exists(full):
        raise ValueError(f"{path} is not a file below {base}")
    return full


def read(spark: SparkSession, path: str, cap: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes and edges with seq, their places in the document; of links with one source and target the first leads."""
    check_size(path, cap or size_cap(os.environ.get("SOURCEWEAVE_MAX_BYTES")))
    schema = f"nodes array<struct<{_fields(GRAPH_NODE)}>>, links array<struct<{_fields(EDGE)}>>"
    doc = spark.read.option("multiLine", True).schema(schema).json(f"file://{os.path.abspath(path)}")
    nodes, edges = (doc.select(F.posexplode(c).alias("seq", "x")).select(F.col("seq").cast("long").alias("seq"), "x.*") for c in ("nodes", "links"))
    text = lambda df, names: df.select([F.coalesce(c, F.lit("")).alias(c) if c in names else F.col(c) for c in df.columns])
    return text(nodes, ["id", "label", "file_type", "source_file", "norm_label"]), text(edges, ["source", "target", "relation", "confidence"])


def _fields(ddl: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in ddl.split(", ")))


def merge_documents(current: str, other: str) -> dict:
    """Union of two documents with all attributes kept: nodes by id and links by (source, target, relation), the current side's first."""
    docs = []
    for path in (current, other):
        check_size(path, MERGE_BYTES)
        with open(path) as f:
            docs.append(json.load(f))
    out = {**docs[1], **docs[0]}
    for name, key in (("nodes", lambda n: n.get("id")), ("links", lambda e: (e.get("source"), e.get("target"), e.get("relation")))):
        seen: dict = {}
        for x in [*(docs[0].get(name) or []), *(docs[1].get(name) or [])]:
            seen.setdefault(key(x), x)
        out[name] = list(seen.values())
    if len(out["nodes"]) > MERGE_NODES:
        raise ValueError(f"merged graph has more than {MERGE_NODES} nodes")
    return out
