"""Benchmark decontamination with one full-text index for each shard of the corpus.

A task turns its documents into word numbers of the benchmark's vocabulary. Words outside it can't be part of a match:
each run of them becomes one break, and runs of known words shorter than the shortest window go too. Over what is left
of about a million words (a shard) an FM-index is built; all windows of the benchmark are searched backwards through its
wavelet matrix at once, occurrences are located by sampled suffix positions, and overlapping ones merge into spans.

Nulls: a null text has no words. Empty texts, items without words and repeated rows are kept and give zeros. A null
item_id is read as an empty string. Columns beyond doc_id, text, item_id are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_words, mapped, ranges, stash
from .suffix import FMIndex

WINDOW = 13
#: The same words in a text that is not lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of benchmark text that one broadcast may hold; larger benchmarks run in as many blocks as needed.
BLOCK_BYTES = 32_000_000
SHARD_WORDS = 1_000_000
SPANS = "doc_id long, row long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


class Patterns:
    """The windows of benchmark items, as word numbers from 2 on (1 is a break)."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        self.names = sorted({str(k) for k, _ in items})
        at = {k: i for i, k in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for key, text in items:
            words = [self.number.setdefault(w, len(self.number) + 2) for w in hash_words((text or "").encode())]
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).add(at[str(key)])
        self.groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for length in sorted({len(p) for p in found}):
            own = [(p, sorted(o)) for p, o in found.items() if len(p) == length]
            first = np.concatenate(([0], np.cumsum([len(o) for _, o in own])))
            self.groups.append((np.array([p for p, _ in own], np.int64), first, np.array([x for _, o in own for x in o], np.int64)))
        self.shortest = min((g[0].shape[1] for g in self.groups), default=0)


def known_runs(ids: np.ndarray, shortest: int) -> np.ndarray:
    """Which words are in a run of known words that a window fits into."""
    known = np.concatenate(([False], ids > 0, [False]))
    edge = np.flatnonzero(known[1:] != known[:-1])
    start, stop = edge[::2], edge[1::2]
    fits = stop - start >= shortest
    keep = np.zeros(len(ids), bool)
    keep[ranges(start[fits], (stop - start)[fits])] = True
    return keep


def find(pat: Patterns, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Of each window length: positions of occurrences, the length, and pairs of occurrence and item."""
    index = FMIndex(tokens)
    for patterns, first, owners in pat.groups:
        lo, hi = index.search(patterns)
        hit = np.flatnonzero(hi > lo)
        if len(hit):
            where = index.locate(ranges(lo[hit], (hi - lo)[hit]))
            which = np.repeat(hit, (hi - lo)[hit])
            many = first[which + 1] - first[which]
            yield where, patterns.shape[1], np.repeat(np.arange(len(where)), many), owners[ranges(first[which], many)]


def shard_rows(pat: Patterns, docs: list[tuple], parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """docs: (doc_id, row, n_words). parts: of each, kept word numbers and their places in the document."""
    sizes = np.array([len(p[0]) for p in parts], np.int64)
    spans: list[list] = [[] for _ in docs]
    items: list[list] = [[] for _ in docs]
    if sizes.sum():
        owner = np.repeat(np.arange(len(docs)), sizes)
        ids, place = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        gap = np.concatenate(([True], (np.diff(place) != 1) | (np.diff(owner) != 0)))
        at = np.arange(len(ids)) + np.cumsum(gap)  # a break before each run
        tokens = np.ones(at[-1] + 2, np.int64)
        tokens[at] = ids
        cover = np.zeros(len(tokens) + 1, np.int64)
        pairs = []
        back = np.zeros(len(tokens), np.int64)
        back[at] = np.arange(len(ids))
        for where, length, occurrence, item in find(pat, tokens):
            np.add.at(cover, where, 1)
            np.add.at(cover, where + length, -1)
            pairs.append(np.unique(owner[back[where[occurrence]]] * len(pat.names) + item))
        hit = np.cumsum(cover)[at] > 0
        h = np.flatnonzero(hit)
        if len(h):
            new = np.concatenate(([True], (np.diff(place[h]) != 1) | (np.diff(owner[h]) != 0)))
            begin = np.flatnonzero(new)
            end = np.concatenate((begin[1:], [len(h)])) - 1
            for d, a, b in zip(owner[h[begin]].tolist(), place[h[begin]].tolist(), place[h[end]].tolist(), strict=True):
                spans[d].append({"start": a, "stop": b + 1})
            for x in np.unique(np.concatenate(pairs)).tolist():
                items[x // len(pat.names)].append(pat.names[x % len(pat.names)])
    ids_, rows, n = zip(*docs, strict=True)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(ids_, pa.int64()), pa.array(rows, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], ["doc_id", "row", "n_words", "spans", "items"])


def search_shards(shared):
    """shared: the broadcast Patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pat = shared.value
        get = pat.number.get
        docs, parts, held = [], [], 0
        for batch in batches:
            for doc_id, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text").cast(pa.large_string()), strict=True):
                words = hash_words(text.as_buffer().to_pybytes()) if text.is_valid else []
                ids = np.fromiter(map(lambda w: get(w, 0), words), np.int64, len(words))
                keep = np.flatnonzero(known_runs(ids, pat.shortest)) if pat.shortest else np.zeros(0, np.int64)
                docs.append((doc_id, row, len(words)))
                parts.append((ids[keep], keep))
                held += len(keep)
                if held >= SHARD_WORDS or len(docs) >= 50_000:
                    yield shard_rows(pat, docs, parts)
                    docs, parts, held = [], [], 0
        if docs:
            yield shard_rows(pat, docs, parts)

    return run


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, row (a hash of it), n_words, spans (words hit, as maximal half-open ranges) and items (item_ids found)."""
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = []
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    for b in range(blocks):
        own = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        pat = Patterns([(r.item_id, r.text) for r in own.collect()], window)
        found.append(mapped(rows, search_shards(spark.sparkContext.broadcast(pat)), SPANS))
    if blocks == 1:
        return found[0]
    whole = found[0]
    for x in found[1:]:
        whole = whole.unionByName(x)
    merged = whole.groupBy("doc_id", "row").agg(F.max("n_words").alias("n_words"), F.count("*").alias("times"), F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    joined = F.expr(
        "aggregate(spans, cast(array() as array<struct<start:bigint,stop:bigint>>), (a, s) -> CASE WHEN size(a) > 0 AND element_at(a, -1).stop >= s.start"
        " THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, s.stop)))) ELSE concat(a, array(s)) END)"
    )
    # rows that are equal in doc_id and text come back as many as they were
    return merged.select("doc_id", "row", "n_words", joined.alias("spans"), "items", F.explode(F.sequence(F.lit(1), (F.col("times") / blocks).cast("int")))).drop("col")


def decide(spans: DataFrame) -> DataFrame:
    """Adds n_hit and contaminated: words are hit, and they are a twentieth of all or more."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return spans.withColumn("n_hit", n_hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Without contaminated documents; from the others the hit words, with what stands between them, are cut. Columns stay, whatever their names; docs is read twice."""
    hits = decide(contaminated_spans(docs, benchmark)).where("n_hit > 0").select("doc_id", "row", "spans", "contaminated").dropDuplicates(["doc_id", "row"])
    names = docs.columns
    keyed = docs.select(F.struct(*names).alias("doc"), F.col("doc_id"), F.xxhash64("doc_id", "text").alias("row")).alias("d")
    same = (F.col("d.row") == F.col("h.row")) & F.col("d.doc_id").eqNullSafe(F.col("h.doc_id"))
    both = keyed.join(stash(hits, "hits").alias("h"), same, "left").where("h.contaminated IS NULL OR NOT h.contaminated").select("d.doc", "h.spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc")
            texts = doc.field("text").to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    word = [m.span() for m in WORD.finditer(texts[i])]
                    at, out = 0, []
                    for s in spans:
                        out.append(texts[i][at : word[s["start"]][0]])
                        at = word[s["stop"] - 1][1]
                    texts[i] = "".join([*out, texts[i][at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else doc.field(n) for n in names], names)

    return mapped(both, cut, docs.schema)


def report(spans: DataFrame) -> DataFrame:
    """The digest columns of contaminated_spans."""
    return decide(spans).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        "contaminated",
    )
