"""Removal of repeated byte strings by blockwise suffix sorting.

All suffixes that begin with one 400-byte string have the same minimizer: the 64-byte gram with the least hash (leftmost) among
those of the string. Neighbouring suffixes with one minimizer form a run, so a document is cut into runs of about
170 suffixes, and runs with the same minimizer are the suffix bucket that must be sorted together. Bucket by bucket:

1. Runs with equal content (told by 128 bits of BLAKE2b over their bytes and places) are counted, not sorted, and one copy of
   each content stands for all in what follows; if there are more, all its suffixes are repeated.
2. Minimizers that one content alone has need no more. Of the other contents, one copy each goes to its bucket.
3. A task lays its buckets' contents out with all minimizers at multiples of V, so suffixes that may be equal stand at one
   residue. It ranks the suffixes at the places of a difference cover modulo V once, by doubling, to 256 bytes. Then each
   bucket's suffixes are sorted: the bytes up to the next cover place decide, then cover ranks settle long ties, then the
   bytes after the last ranked place. Equal neighbours in that order are repeated strings.
4. The contents of buckets that no one task should hold (over GROUP of them) are cut into runs again, by the minimizers of
   another hash, which parts those that differ; what falls together again goes on so, LEVELS times. What then is left in one
   bucket, contents that differ in a few bytes only, is counted suffix by suffix, by BLAKE2b of the 400 bytes.

Passages of WORDS words may be shorter than 400 bytes. Those that stand elsewhere are found too, whatever their bytes (``clean`` cuts them,
``remove_repeats`` tells where they are): the same cut into runs is made on the texts' words, by minimizers of grams of words, and the
passages of contents that share a bucket are counted by 128 bits of BLAKE2b; equal passages always have one minimizer, so a bucket is
counted by itself, and one of over GROUP contents by all tasks.

Repeated suffixes go back to their documents, which drop each byte they cover. Strings never cross documents.
Null texts are empty, texts under 400 bytes lose nothing; an empty table gives an empty table. Equal rows, too, are documents
of their own and so repeat each other. Long texts are cut into overlapping parts of LONG bytes, which lose no suffix.
Documents are told apart by doc_id (which may be null) and a hash of the text; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_parts, mapped, ranges, split_by, stash, utf8
from .minhash import _BYTE, _INVERSE, _ODD, _STEP, mix, powers

LENGTH, GRAM = 400, 64
#: Words of a passage, and those of the grams that are its minimizers. Words are what ASCII white space parts.
WORDS, WORD_GRAM = 50, 8
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Contents that are sorted together, and how often larger buckets are cut anew.
GROUP, LEVELS = 512, 3
#: Bytes of text that are cut into runs, or sorted, at a time; texts beyond LONG are cut in parts.
BATCH, LONG = 1_000_000, 4_000_000
ROOT = 8
V = ROOT * ROOT
#: Every distance modulo V is a difference of two of these, and the next of them is never ROOT or more away.
COVER = np.array(sorted({*range(ROOT), *(ROOT * k - 1 for k in range(2, ROOT + 1))}))
_NEXT = np.array([min((c - r) % V for c in COVER) for r in range(V)])
_LAST = np.array([min((r - c) % V for c in COVER) for r in range(V)])
POS = 28
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 20, 1 << (n - 1).bit_length()) if n else 1 << 20
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = (powers(size, _ODD), powers(size, _INVERSE))
    a, b = _POWERS[size]
    return a[:n], b[:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Of the polynomial hash: that of codes[i:j] is (out[j] - out[i]) * inverse**i."""
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * _power(len(codes))[0], dtype=np.uint64)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, 2**64 - 1, np.uint64)
    padded[:n] = x
    grid = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(codes: np.ndarray, first: np.ndarray, level: int = 0, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Runs of suffixes with one minimizer. codes: a number for each byte or word; first: offsets of the texts in them. s, e: the first and last suffix of a run; p: the minimizer's place; h: its hash."""
    n = len(codes)
    if n < length:
        return {k: np.zeros(0, np.int64) for k in ("doc", "s", "e", "p", "h")}
    total = prefix_sums(codes)
    inverse = _power(n)[1]
    g = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1] + _STEP * np.uint64(level))
    low = np.uint64(2**POS - 1)
    least = sliding_min((g & ~low) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
    place = (least & low).astype(np.int64)
    start, size = first[:-1], np.diff(first)
    good = size >= length
    start, many = start[good], size[good] - length + 1
    i = ranges(start, many)
    doc = np.repeat(np.flatnonzero(good), many)
    p = place[i]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 0) | (np.diff(doc) != 0)))) if len(i) else np.zeros(0, np.int64)
    s, p, doc = i[new], p[new], doc[new]
    e = i[np.concatenate((new[1:], [len(i)])) - 1] if len(new) else s
    return {"doc": doc, "s": s, "e": e, "p": p, "h": g[p]}


def digests(data: np.ndarray, a: np.ndarray, b: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """128 bits of BLAKE2b over each data[a:b] and salt, as two numbers."""
    view, hashed = memoryview(np.ascontiguousarray(data)), hashlib.blake2b
    whole = [hashed(view[i:j], digest_size=16, salt=k.to_bytes(8, "little")).digest() for i, j, k in zip(a.tolist(), b.tolist(), salt.tolist(), strict=True)]
    return np.frombuffer(b"".join(whole), np.int64).reshape(-1, 2)


def text_parts(off: np.ndarray, long: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts into parts that hold each suffix of 400 bytes (or so many words) once: the number of the text, start and stop of each part."""
    size = np.diff(off)
    many = np.maximum(1, -(-(size - length + 1) // long))
    doc = np.repeat(np.arange(len(size)), many)
    start = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * long
    return doc, start, np.minimum(start + long + length - 1, off[1:][doc])


def find_runs(key: list[str], level: int):
    """Of rows with a key, n (how many there are) and text: the runs of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_parts(whole, BATCH):
                data, off = utf8(batch.column("text"))
                doc, start, stop = text_parts(off, LONG)
                for a, b in _spread(stop - start, 2 * BATCH):
                    begin, size = start[a:b], (stop - start)[a:b]
                    own = data[ranges(begin, size)] if b - a > 1 else data[begin[0] : stop[a]]
                    first = np.concatenate(([0], np.cumsum(size)))
                    r = runs(_BYTE[own], first, level)
                    row = doc[a:b][r["doc"]]
                    more, to = r["e"] - r["s"], r["p"] - r["s"]
                    c = digests(own, r["s"], r["e"] + LENGTH, (to << 32) + more)
                    s = r["s"] - first[:-1][r["doc"]] + begin[r["doc"]] - off[:-1][row]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(pa.array(row)) for k in [*key, "n"]), pa.array(r["h"].view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(s.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(to.astype(np.int32))],
                        [*key, "n", "run_h", "run_c", "run_d", "s", "more", "off"],
                    )
        _POWERS.clear()

    return run


def word_places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that follow each other in data: start and stop of each word, and len+1 offsets of the texts among the words."""
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    there = np.diff(off) > 0
    a, b = off[:-1][there], off[1:][there] - 1
    begin[a], end[b] = solid[a], solid[b]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(start, off)


def word_codes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for each word, from its length and first 16 bytes. Words that share it may share a minimizer, and are not taken as equal."""
    spare = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray(len(data) + 9, "<u8", spare, strides=(1,))
    size = stop - start
    code = size.astype(np.uint64)
    for k in (0, 8):
        held = np.clip(size - k, 0, 8)
        own = eight[start + k] << ((8 - np.maximum(held, 1)) * 8).astype(np.uint64)
        code = mix(code * _STEP + np.where(held > 0, own, np.uint64(0)))
    return code


def find_passages(key: list[str]):
    """Of rows with a key and text: the runs of passages of each text. s and more count words; at and size are the bytes where a run's words stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_parts(whole, BATCH):
                data, off = utf8(batch.column("text"))
                data, off = data[off[0] : off[-1]], off - off[0]
                start, stop, words = word_places(data, off)
                codes = word_codes(data, start, stop)
                spaced = np.concatenate((data, np.zeros(1, np.uint8)))[ranges(start, stop - start + 1)]
                place = np.concatenate(([0], np.cumsum(stop - start + 1)))
                spaced[place[1:] - 1] = 32  # any white space is as good
                doc, a, b = text_parts(words, BATCH, WORDS)
                for i, j in _spread(b - a, 2 * BATCH):
                    begin, size = a[i:j], (b - a)[i:j]
                    own = ranges(begin, size)
                    r = runs(codes[own], np.concatenate(([0], np.cumsum(size))), 0, WORDS, WORD_GRAM)
                    row, s, more = doc[i:j][r["doc"]], own[r["s"]], r["e"] - r["s"]
                    e = s + more + WORDS
                    c = digests(spaced, place[s], place[e], ((r["p"] - r["s"]) << 32) + more)
                    ints = (s - words[row], more, start[s] - off[row], stop[e - 1] - start[s])
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(pa.array(row)) for k in key), pa.array(r["h"].view(np.int64)), pa.array(c[:, 0]), pa.array(c[:, 1]), *(pa.array(x.astype(np.int32)) for x in ints)],
                        [*key, "run_h", "run_c", "run_d", "s", "more", "at", "size"],
                    )
        _POWERS.clear()

    return run


def _spread(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours of about so many bytes."""
    upto, out, a = np.concatenate(([0], np.cumsum(size))), [], 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of asked-for runs: wants has (h, c, d, n, s, more, off)."""
    for whole in batches:
        for batch in byte_parts(whole, BATCH):
            data, off = utf8(batch.column("text"))
            wants = batch.column("wants")
            flat, at = wants.flatten(), np.diff(wants.offsets.to_numpy())
            doc = np.repeat(np.arange(batch.num_rows), at)
            col = {k: flat.field(k) for k in ("h", "c", "d", "n", "s", "more", "off")}
            size = col["more"].to_numpy().astype(np.int64) + LENGTH
            begin = off[:-1][doc] + col["s"].to_numpy()
            for a, b in _spread(size, 4 * BATCH):
                body = data[ranges(begin[a:b], size[a:b])]
                first = np.concatenate(([0], np.cumsum(size[a:b]))).astype(np.int64)
                seg = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(first), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays([*(col[k].slice(a, b - a) for k in ("h", "c", "d", "n", "off")), seg.cast(pa.binary())], ["h", "c", "d", "n", "off", "text"])


def sample_ranks(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the suffixes at cover places by their first 256 bytes; places has each text place's number, t has spare zeros at its end."""
    n = len(t) - 512
    at = np.flatnonzero(np.isin(np.arange(n + 256) % V, COVER))
    number = np.zeros(n + 512, np.int64)
    number[at] = np.arange(len(at))
    window = np.lib.stride_tricks.sliding_window_view(t, V)[at]
    rank = np.unique(np.ascontiguousarray(window).view(f"S{V}")[:, 0], return_inverse=True)[1].astype(np.int64)
    for depth in (V, 2 * V):
        later = at + depth
        there = later < n + 256
        after = np.zeros(len(at), np.int64)
        after[there] = rank[number[later[there]]] + 1
        rank = np.unique(rank * (len(at) + 2) + after, return_inverse=True)[1].astype(np.int64)
    return number, rank


def packed(t: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The next size (under 8) bytes of t as numbers in byte order."""
    out = np.zeros(len(at), np.uint64)
    for k in range(ROOT - 1):
        out = out * np.uint64(256) + np.where(k < size, t[at + k], 0).astype(np.uint64)
    return out


def sort_block(group: np.ndarray, segs: list[bytes], off: np.ndarray, times: np.ndarray) -> list[np.ndarray]:
    """Of each content (its bucket, bytes, the minimizer's place in them, how many runs have it): which of its suffixes are repeated."""
    size = np.array([len(s) for s in segs], np.int64)
    base = np.zeros(len(segs), np.int64)
    at = V
    for k in range(len(segs)):
        at += (-(at + off[k])) % V
        base[k] = at
        at += size[k] + 1
    t = np.zeros(at + 512, np.uint8)
    t[ranges(base, size)] = np.frombuffer(b"".join(segs), np.uint8) + 1  # UTF-8 has no byte 255
    number, rank = sample_ranks(t)
    many = size - LENGTH + 1
    i = ranges(base, many)
    seg = np.repeat(np.arange(len(segs)), many)
    bucket = group[seg] * 1024 + (base + off)[seg] - i
    head = _NEXT[i % V]
    q = i + head
    end = i + LENGTH
    last = end - 256 - _LAST[(end - 256) % V]
    order = np.lexsort((packed(t, last + 256, end - last - 256), rank[number[last]], rank[number[q]], packed(t, i, head), bucket))
    keys = [x[order] for x in (bucket, packed(t, i, head), rank[number[q]], rank[number[last]], packed(t, last + 256, end - last - 256))]
    new = np.ones(len(i), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    cls = np.cumsum(new) - 1
    held = np.bincount(cls, weights=times[seg[order]])
    repeated = np.zeros(len(i), bool)
    repeated[order] = held[cls] > 1
    return np.split(repeated, np.cumsum(many)[:-1])


def sort_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and content; whole buckets are sorted together, about BATCH bytes at a time."""

    def done(rows: list[tuple]) -> pa.RecordBatch:
        h = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.concatenate(([0], (h[1:] != h[:-1]).astype(np.int64))))
        flags = sort_block(group, [r[5] for r in rows], np.array([r[4] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64))
        edges = [(r[:3], np.flatnonzero(np.diff(np.concatenate(([0], f.astype(np.int8), [0])))).tolist()) for r, f in zip(rows, flags, strict=True) if r[3] == 1 and f.any()]
        spans = pa.array([[{"a": a, "b": b} for a, b in zip(e[::2], e[1::2], strict=True)] for _, e in edges], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k, _ in edges], pa.int64()) for i in range(3)), spans], ["h", "c", "d", "spans"])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "d", "n", "off", "text")), strict=True):
            if rows and row[:3] == rows[-1][:3]:
                continue  # from an equal row
            if rows and row[0] != rows[-1][0] and held >= BATCH:
                yield done(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[5])
    if rows:
        yield done(rows)


def hash_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each suffix of contents: BLAKE2b of its 400 bytes, and its place k."""
    for whole in batches:
        for batch in byte_parts(whole, 100_000):
            data, off = utf8(batch.column("text"))
            many = np.diff(off) - LENGTH + 1
            i = ranges(off[:-1], many)
            seg = np.repeat(np.arange(batch.num_rows), many)
            x = digests(data, i, i + LENGTH, np.zeros(len(i), np.int64))
            take = [batch.column(c).take(pa.array(seg)) for c in ("h", "c", "d", "n")]
            yield pa.RecordBatch.from_arrays([*take, pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array((i - off[:-1][seg]).astype(np.int32))], ["h", "c", "d", "n", "x", "y", "k"])


def passage_digests(text: bytes) -> list[bytes]:
    """128 bits of BLAKE2b of each WORDS words of a content."""
    words = text.split()
    line, at, hashed = b" ".join(words), [0], hashlib.blake2b
    for w in words:
        at.append(at[-1] + len(w) + 1)
    return [hashed(line[i : j - 1], digest_size=16).digest() for i, j in zip(at, at[WORDS:])]  # noqa: B905


def count_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and content: the passages of single contents that stand twice in their bucket."""

    def done(rows: list[tuple]) -> list[tuple]:
        found, times = [passage_digests(r[4]) for r in rows], Counter()
        for r, own in zip(rows, found, strict=True):
            for x in own:
                times[x] += r[3]
        out = []
        for r, own in zip(rows, found, strict=True):
            edges = np.flatnonzero(np.diff([0, *(times[x] > 1 for x in own), 0])).tolist() if r[3] == 1 else []
            if edges:
                out.append((*r[:3], [{"a": a, "b": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]))
        return out

    def sent(out: list[tuple]) -> pa.RecordBatch:
        spans = pa.array([r[3] for r in out], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in out], pa.int64()) for i in range(3)), spans], ["h", "c", "d", "spans"])

    rows, out = [], []
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "d", "n", "text")), strict=True):
            if rows and row[:3] == rows[-1][:3]:
                continue  # from an equal row
            if rows and row[0] != rows[-1][0]:
                out += done(rows) if len(rows) > 1 else []
                rows = []
                if len(out) > 10_000:
                    yield sent(out)
                    out = []
            rows.append(row)
    yield sent(out + (done(rows) if len(rows) > 1 else []))


def hash_passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each passage of contents: its digest, and its place k."""
    for whole in batches:
        for batch in byte_parts(whole, 100_000):
            found = [passage_digests(t) for t in batch.column("text").to_pylist()]
            many = np.array([len(x) for x in found])
            seg = pa.array(np.repeat(np.arange(len(many)), many))
            x = np.frombuffer(b"".join(y for own in found for y in own), np.int64).reshape(-1, 2)
            take = [batch.column(c).take(seg) for c in ("h", "c", "d", "n")]
            yield pa.RecordBatch.from_arrays([*take, pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(ranges(np.zeros(len(many), np.int64), many).astype(np.int32))], ["h", "c", "d", "n", "x", "y", "k"])


CONTENT = ["h", "c", "d"]
SEGMENT = "h long, c long, d long, n long, off int, text binary"
SPANS = "array<struct<a:int,b:int>>"
#: Of ranges (a, b), those that they join to.
MAXIMAL = f"""aggregate(array_sort(flatten(collect_list(spans))), cast(array() as {SPANS}), (m, x) -> CASE WHEN size(m) > 0 AND element_at(m, -1).b >= x.a
  THEN concat(slice(m, 1, size(m) - 1), array(named_struct('a', element_at(m, -1).a, 'b', greatest(element_at(m, -1).b, x.b)))) ELSE concat(m, array(x)) END)"""


def _same(key: list[str], left: str, right: str) -> Column:
    """Equal keys, of which the last is never null."""
    out = F.col(f"{left}.{key[-1]}") == F.col(f"{right}.{key[-1]}")
    for k in key[:-1]:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _segments(texts: DataFrame, key: list[str], contents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The bytes of contents whose minimizer others have too, one copy or more of each: those of small buckets, and those of large ones, if any, one copy of each."""
    shared = contents.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    wanted = contents.join(shared, "h").withColumn("big", F.col("m") > GROUP)
    ask = F.collect_list(F.struct(*CONTENT, F.least("n", F.lit(2).cast("long")).alias("n"), "s", "more", "off")).alias("wants")
    asked = stash(wanted.groupBy(*[F.col(f"own_{k}").alias(k) for k in key], "big").agg(ask), "asked")
    near, _ = split_by(texts, F.xxhash64(*key), asked.select(F.xxhash64(*key).alias("k")))
    with_text = asked.alias("a").join(near.alias("t"), _same(key, "a", "t")).select("t.text", "a.wants", "a.big")
    small = mapped(with_text.where("not big").select("text", "wants"), cut_out, SEGMENT)
    if asked.where("big").isEmpty():
        return small, None
    return small, stash(mapped(with_text.where("big").select("text", "wants"), cut_out, SEGMENT).dropDuplicates(CONTENT), "large")


def _places(found: DataFrame, flagged: DataFrame, key: list[str]) -> DataFrame:
    """key and spans: where in its text each run that was found has the ranges of starts that were flagged for its content."""
    flagged = flagged.groupBy(*CONTENT).agg(F.expr(MAXIMAL).alias("spans"))
    same = (F.col("r.run_h") == F.col("f.h")) & (F.col("r.run_c") == F.col("f.c")) & (F.col("r.run_d") == F.col("f.d"))
    hits = found.select(*key, *[f"run_{k}" for k in CONTENT], "s").alias("r").join(flagged.alias("f"), same)
    placed = F.transform("f.spans", lambda x: F.struct((F.col("r.s") + x["a"]).alias("a"), (F.col("r.s") + x["b"]).alias("b")))
    return hits.select(*[F.col(f"r.{k}").alias(k) for k in key], placed.alias("spans"))


def repeated_starts(texts: DataFrame, key: list[str], level: int = 0) -> DataFrame:
    """Of rows with a key of longs, n (how many equal texts it stands for) and text (string or binary): key and spans, ranges [a, b) of the starts of repeated strings, a row for each run that has any."""
    schema = ", ".join(f"{k} long" for k in [*key, "n", "run_h", "run_c", "run_d"]) + ", s int, more int, off int"
    found = stash(mapped(texts.where(F.octet_length("text") >= LENGTH), find_runs(key, level), schema), "runs")
    one = [F.first(k).alias(f"own_{k}") for k in key]
    # any run of a content may stand for it: all have the same bytes
    contents = found.groupBy(*[F.col(f"run_{k}").alias(k) for k in CONTENT]).agg(F.sum("n").alias("n"), *one, *[F.first(k).alias(k) for k in ("s", "more", "off")])
    contents = stash(contents, "contents")
    small, large = _segments(texts, key, contents)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = mapped(small.repartition(n, "h").sortWithinPartitions(*CONTENT), sort_buckets, f"h long, c long, d long, spans {SPANS}")
    flagged = flagged.unionByName(contents.where("n > 1").select(*CONTENT, F.array(F.struct(F.lit(0).alias("a"), (F.col("more") + 1).alias("b"))).alias("spans")))
    if large is not None:
        if level < LEVELS:
            deeper = repeated_starts(large, CONTENT, level + 1)
        else:
            each = stash(mapped(large, hash_suffixes, "h long, c long, d long, n long, x long, y long, k int"), "suffixes")
            twice = each.groupBy("x", "y").agg(F.sum("n").alias("t")).where("t > 1").drop("t")
            deeper = each.join(twice, ["x", "y"]).select(*CONTENT, F.array(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("spans"))
        flagged = flagged.unionByName(stash(deeper, "deeper"))  # else the plans of all levels are one
    return _places(found, flagged, key)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Of docs with doc_id, th (a hash of the text) and text: doc_id, th and spans, the byte ranges [a, b) that repeated strings cover, for rows that have any."""
    starts = repeated_starts(docs.select("doc_id", "th", F.lit(1).cast("long").alias("n"), "text"), ["doc_id", "th"])
    bytes_ = F.transform("spans", lambda x: F.struct(x["a"].alias("a"), (x["b"] - 1 + LENGTH).alias("b")))
    # rows that are equal in both give each range as often as there are rows, and keep one
    return stash(starts.groupBy("doc_id", "th").agg(F.flatten(F.collect_set(bytes_)).alias("spans")), "spans")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Of docs with doc_id, th and text: doc_id, th and words, the ranges [a, b) of words that repeated passages cover, for rows that have any."""
    key = ["doc_id", "th"]
    texts = docs.select(*key, "text")
    schema = ", ".join(f"{k} long" for k in [*key, "run_h", "run_c", "run_d"]) + ", s int, more int, at int, size int"
    found = stash(mapped(texts.where(F.octet_length("text") >= 2 * WORDS - 1), find_passages(key), schema), "passages")
    contents = found.groupBy(*[F.col(f"run_{k}").alias(k) for k in CONTENT]).agg(F.count("*").alias("n"), F.first("more").alias("last"), F.first(F.struct(*key, "at", "size")).alias("own"))
    # cut_out takes bytes
    bytes_ = [F.col("own.at").alias("s"), (F.col("own.size") - LENGTH).alias("more"), F.lit(0).alias("off")]
    contents = stash(contents.select(*CONTENT, "n", "last", *[F.col(f"own.{k}").alias(f"own_{k}") for k in key], *bytes_), "passage_contents")
    small, large = _segments(texts, key, contents)
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = mapped(small.select(*CONTENT, "n", "text").repartition(n, "h").sortWithinPartitions(*CONTENT), count_passages, f"h long, c long, d long, spans {SPANS}")
    flagged = flagged.unionByName(contents.where("n > 1").select(*CONTENT, F.array(F.struct(F.lit(0).alias("a"), (F.col("last") + 1).alias("b"))).alias("spans")))
    if large is not None:
        each = stash(mapped(large.select(*CONTENT, "n", "text"), hash_passages, "h long, c long, d long, n long, x long, y long, k int"), "each")
        twice = each.groupBy("x", "y").agg(F.sum("n").alias("t")).where("t > 1").drop("t")
        flagged = flagged.unionByName(each.join(twice, ["x", "y"]).select(*CONTENT, F.array(F.struct(F.col("k").alias("a"), (F.col("k") + 1).alias("b"))).alias("spans")))
    words = F.transform("spans", lambda x: F.struct(x["a"].alias("a"), (x["b"] - 1 + WORDS).alias("b")))
    return stash(_places(found, flagged, key).groupBy(*key).agg(F.flatten(F.collect_set(words)).alias("words")), "words")


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal ranges of what ranges [a, b) cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def without(raw: bytes, cuts: list[list[int]]) -> bytes:
    at, out = 0, []
    for a, b in cuts:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]) if cuts else raw


def marked(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[list[int]], list[list[int]]]]:
    """Of rows of text, spans (of bytes) and words (spans of words): the text's bytes, and the maximal ranges of bytes that repeated strings and that repeated passages cover."""
    for text, spans, words in zip(*(batch.column(k).to_pylist() for k in ("text", "spans", "words")), strict=True):
        raw = (text or "").encode()
        place = [m.span() for m in WORD.finditer(raw)] if words else []
        yield raw, merged([(x["a"], x["b"]) for x in spans or ()]), merged([(place[x["a"]][0], place[x["b"] - 1][1]) for x in words or ()])


CUTS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kept (bytes), cuts (maximal removed ranges) and passages (maximal ranges of repeated passages, which stay) of rows of doc_id, text, spans of bytes and words (spans of words)."""
    for whole in batches:
        for batch in byte_parts(whole, 4 * BATCH):
            kept, cuts, passages = [], [], []
            for raw, own, words in marked(batch):
                kept.append(without(raw, own))
                cuts.append([{"a": a, "b": b} for a, b in own])
                passages.append([{"a": a, "b": b} for a, b in words])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(cuts, CUTS), pa.array(passages, CUTS)], ["doc_id", "kept", "cuts", "passages"])


def _with_spans(docs: DataFrame) -> DataFrame:
    """All rows of docs, whose columns go into one struct ``row``, with their spans of bytes and of words (null if nothing repeats)."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), F.xxhash64("text").alias("th"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    names = ["spans", "words"]
    both = repeated_spans(texts).unionByName(repeated_passages(texts), allowMissingColumns=True)
    spans = stash(both.groupBy("doc_id", "th").agg(*[F.first(n, ignorenulls=True).alias(n) for n in names]), "both")
    near, rest = split_by(rows, F.xxhash64("doc_id", "th"), spans.select(F.xxhash64("doc_id", "th").alias("k")))
    both = near.alias("d").join(spans.alias("s"), _same(["doc_id", "th"], "d", "s"), "left").select("d.row", *[f"s.{n}" for n in names])
    return both.unionByName(rest.select("row", *[F.lit(None).cast(spans.schema[n].dataType).alias(n) for n in names]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that stay), cuts (ranges of repeated strings, removed) and passages (ranges of repeated passages of WORDS words, which stay unless a string covers them) of every row."""
    both = _with_spans(docs.select("doc_id", "text")).select("row.doc_id", "row.text", "spans", "words")
    spans = "array<struct<a:long,b:long>>"
    return mapped(both, remove, f"doc_id long, kept binary, cuts {spans}, passages {spans}")


def clean(docs: DataFrame) -> DataFrame:
    """docs with the strings of 400 bytes and the passages of WORDS words that repeat cut from text; a character that is cut in its middle goes whole. Columns stay, whatever their names; null texts stay null."""
    names = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            row = whole.column("row")
            own = pa.RecordBatch.from_arrays([row.field("text"), whole.column("spans"), whole.column("words")], ["text", "spans", "words"])
            kept = [without(raw, merged([*cuts, *words])) for part in byte_parts(own, 4 * BATCH) for raw, cuts, words in marked(part)]
            texts = [None if t is None else k.decode("utf-8", "ignore") for k, t in zip(kept, own.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else row.field(n) for n in names], names)

    return mapped(_with_spans(docs), cut, docs.schema)


def report(removed: DataFrame) -> DataFrame:
    size = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"])
    gone = size("cuts")
    figures = [(F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.alias("n_removed"), F.size("cuts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")]
    return removed.select("doc_id", *figures, F.size("passages").cast("long").alias("n_passages"), size("passages").alias("n_passage_bytes"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """The same figures for a small list of texts, by counting every string."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - LENGTH + 1):
            seen[r[i : i + LENGTH]] = seen.get(r[i : i + LENGTH], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - LENGTH + 1):
            if seen[r[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(1 for i in range(len(r)) if gone[i] and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out
