"""Near-duplicate documents by SetSketch registers.

A document's set are the hashes of its 5-word shingles, made of 64-bit BLAKE2b digests of the words. Documents with equal
sets (told by 128 bits: two independent sums over the set) are one class; what follows works on classes, which have numbers. Each class has M registers: the smallest of the set's values under each of M hash functions, taken as a sample
of an exponential distribution, on an exponential scale truncated to 16 bits (registers of unions are maxima, so sketches
merge). Runs of R registers are band keys.

1. Buckets of two give a pair; likelihood over the registers and the two set sizes estimates its similarity; what stays
   below near(), far under the threshold, goes. In larger buckets every row is compared with all of about its size that no row
   before has reached, and links to those whose registers agree in the share near(): as few pairs as join all that are near.
   Buckets of over SPLIT rows are compared in blocks. Buckets of the same rows are looked at once.
2. The rest is confirmed on full sets: intersection and union are counted.
3. Pairs under the threshold also join their documents to one family. In families of more than one component, all
   documents of different components are compared on full sets, in blocks of BLOCK by BLOCK documents: blocks of the
   largest component meet only blocks of the others. That finds links that no pair of step 1 had.
4. Components of links are joined by repeated contraction; nothing is collected.

Null and empty texts and texts of blanks have empty sets, link with nothing and are kept. Rows with a null doc_id take
part; a component's id is its smallest doc_id that is not null. Repeated rows are in one class: all rows of its smallest
doc_id are kept. Columns beyond doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, components, mapped, stash

WORDS, M, R = 5, 96, 4
#: Similarity as a ratio: intersection * DEN >= union * num; NUM is op7's, other callers give their own.
NUM, DEN = 85, 100
BLOCK, SPLIT = 256, 4096
BASE, RATE = 1.001, 20.0
_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RNG.integers(1, 2**63, M, np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, M, np.uint64)
_PLACE = _RNG.integers(1, 2**63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def near(num: int) -> float:
    """The estimate from which on a pair is looked at: one of num / DEN falls below it with a probability of 3e-6 (80) or 6e-7 (85)."""
    return num / DEN - 0.2


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(1, n), np.uint64)
    size = 1
    while size < n:
        more = min(size, n - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, 2**64))
        size += more
    return out[:n]


_ODD = 0xD1342543DE82EF95
_INVERSE = pow(_ODD, -1, 2**64)


def word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of each data[start:stop], neighbours with one byte between them at least, a BLAKE2b digest; each distinct word is hashed once."""
    if not len(start):
        return np.zeros(0, np.uint64)
    both = np.stack((start, stop), 1).ravel()
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(both) - 1, [None, pa.py_buffer(both.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cut.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
    hashed = hashlib.blake2b
    own = np.frombuffer(b"".join([hashed(w, digest_size=8).digest() for w in coded.dictionary.to_pylist()]), np.uint64)
    return own[coded.indices.to_numpy()]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and len+1 offsets of the texts."""
    data = np.frombuffer(b" ".join(t.translate(LOWER_TABLE) for t in texts) + b" ", np.uint8)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank))))
    start, stop = edge[::2], edge[1::2]
    word = word_hashes(data, start, stop)
    doc = np.searchsorted(first, start, "right") - 1
    n = np.bincount(doc, minlength=len(texts))
    begin = np.concatenate(([0], np.cumsum(n)))
    place = np.arange(len(word)) - begin[doc]
    own = n[doc]
    padded = np.concatenate((word, np.zeros(WORDS, np.uint64)))
    h = np.full(len(word), _STEP, np.uint64)
    for k in range(WORDS):
        h += np.where(place + k < own, mix(padded[k : k + len(word)] * _PLACE[k] + np.uint64(k + 1)), np.uint64(0))
    keep = place < np.maximum(1, own - WORDS + 1)
    h, doc = mix(h[keep]), doc[keep]
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.concatenate(([True], (np.diff(doc) != 0) | (h[1:] != h[:-1]))) if len(h) else np.zeros(0, bool)
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def registers(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """M registers of each set that is not empty."""
    at = offsets[:-1][np.diff(offsets) > 0]
    out = np.empty((len(at), M), np.uint16)
    for k in range(M):
        low = np.minimum.reduceat(mix(h * _A[k] + _B[k]), at) if len(at) else np.zeros(0, np.uint64)
        exp = -np.log1p(-(low.astype(np.float64) + 1) / 2.0**64.001) / RATE
        out[:, k] = np.clip(np.floor(1 - np.log(exp) / np.log(BASE)), 0, 65535)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely similarity of pairs, from their registers and set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = M - more - less
    u = na / (na + nb)
    v = 1 - u
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    for j in np.arange(0.0, 1.0001, 0.02):
        up, down = p(u - v * j), p(v - u * j)
        like = more * np.log(np.maximum(up, 1e-12)) + less * np.log(np.maximum(down, 1e-12)) + same * np.log(np.maximum(1 - up - down, 1e-12))
        better = (like > best) & (j <= np.minimum(u / v, v / u) + 0.02)
        best, at = np.where(better, like, best), np.where(better, j, at)
    return at


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [(t or "").encode() for t in batch.column(name).to_pylist()]


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _parts(batches, 200):
        h, off = shingles(_texts(batch))
        n = np.diff(off)
        full = np.flatnonzero(n > 0)
        one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        if len(full):
            at = off[:-1][full]
            one[full] = np.add.reduceat(mix(h ^ _STEP), at)
            two[full] = np.add.reduceat(mix(h * _PLACE[0] + _PLACE[1]), at)
        regs: list[bytes | None] = [None] * len(n)
        for i, r in zip(full.tolist(), registers(h, off), strict=True):
            regs[i] = r.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "th", "n_shingles", "one", "two", "regs"])


def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, M // R, R).astype(np.uint64)
        key = np.full(regs.shape[:2], _STEP) + np.arange(M // R, dtype=np.uint64)
        for k in range(R):
            key = mix(key + regs[:, :, k])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cls").to_numpy(), M // R)), pa.array(key.ravel().view(np.int64))], ["cls", "band"])


def screen(batches: Iterator[pa.RecordBatch], num: int = NUM) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose estimated similarity is near() or more."""
    for batch in _parts(batches, 20_000):
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, M) for c in ("ra", "rb"))
        na, nb = (batch.column(c).to_numpy().astype(float) for c in ("na", "nb"))
        good = pa.array(estimate(a, b, na, nb) >= near(num))
        yield batch.select(["a", "b"]).filter(good)


def spanning(n: np.ndarray, regs: np.ndarray, share: float) -> list[tuple[int, int]]:
    """Of rows in the order of their set sizes n: as few pairs (reached from, reached) as join all that are near."""
    left, rest, size, out = np.arange(len(n)), np.ascontiguousarray(regs.T), n, []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left, rest, size = left[1:], rest[:, 1:], size[1:]
        u = queue.pop(0)
        lo, hi = np.searchsorted(size, share * n[u]), np.searchsorted(size, n[u] / share, "right")
        same = np.add.reduce((rest[:, lo:hi] == regs[u][:, None]).view(np.uint8), axis=0, dtype=np.uint8)
        hit = np.flatnonzero(same >= share * M) + lo
        if len(hit):
            found = left[hit].tolist()
            out += [(u, v) for v in found]
            queue += found
            keep = np.ones(len(left), bool)
            keep[hit] = False
            left, rest, size = left[keep], rest[:, keep], size[keep]
    return out


def bucket_pairs(batches: Iterator[pa.RecordBatch], num: int = NUM) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket (band, i, j), n and cls: the pairs that span what is near in each bucket."""
    held: pa.RecordBatch | None = None

    def pairs(batch: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
        cls, n = (batch.column(c).to_numpy() for c in ("cls", "n"))
        regs = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint16).reshape(-1, M)
        out = [(a + v, a + u) for a, b in zip(cuts[:-1], cuts[1:], strict=True) for u, v in spanning(n[a:b], regs[a:b], near(num))]
        at = np.array(out, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(cls[at[:, 0]]), pa.array(cls[at[:, 1]])], ["a", "b"])

    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("band", "i", "j")])
        cuts = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1))
        if len(cuts) > 1:
            yield pairs(batch.slice(0, int(cuts[-1])), cuts)
        held = batch.slice(int(cuts[-1]))  # the last bucket may go on
    if held is not None:
        yield pairs(held, np.array([0, held.num_rows]))


def linked(common: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int = NUM) -> np.ndarray:
    return DEN * common >= num * (na + nb - common)


def confirm(batches: Iterator[pa.RecordBatch], num: int = NUM) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts: whether their full sets link."""
    last, held = None, None
    for batch in _parts(batches, 500):
        ta, b = _texts(batch, "ta"), batch.column("b").to_pylist()
        ha, off = shingles(ta)
        good = []
        tb = batch.column("tb")
        for i, node in enumerate(b):
            if node != last:
                last, held = node, shingles([(tb[i].as_py() or "").encode()])[0]
            own = ha[off[i] : off[i + 1]]
            at = np.searchsorted(held, own)
            common = int((held[np.minimum(at, len(held) - 1)] == own).sum()) if len(held) else 0
            good.append(bool(linked(common, len(own), len(held), num)))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])


def block_links(table: pa.Table, num: int = NUM) -> pa.Table:
    """Of a block's documents (cls, comp, side, text): links between different components, as few as join what links."""
    cls, comp, side = (table.column(c).to_numpy() for c in ("cls", "comp", "side"))
    texts = [(t or "").encode() for t in table.column("text").to_pylist()]
    h, off = shingles(texts)
    n = np.diff(off)
    doc = np.repeat(np.arange(len(texts)), n)
    _, number, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[number] > 1
    number, doc = np.unique(number[shared], return_inverse=True)[1], doc[shared]
    order = np.argsort(number, kind="stable")
    number, doc = number[order], doc[order]
    common = np.zeros((len(texts), len(texts)), np.float32)
    top = int(number[-1]) + 1 if len(number) else 0
    for a in range(0, top, 4096):
        lo, hi = np.searchsorted(number, (a, a + 4096))
        one = np.zeros((len(texts), 4096), np.float32)
        one[doc[lo:hi], number[lo:hi] - a] = 1
        common += one @ one.T
    good = linked(common.astype(np.int64), n[:, None], n[None, :], num) & (comp[:, None] != comp[None, :])
    root = np.arange(len(texts))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in np.argwhere(np.triu(good)):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((cls[i], cls[j]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def near_links(docs: DataFrame, num: int = NUM) -> tuple[DataFrame, DataFrame, DataFrame]:
    """base: doc_id, th, n_shingles, one, two of every row; heads: the number cls of each class (one, two); links between classes (a, b)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    base = stash(mapped(docs, sketch, "doc_id long, th long, n_shingles long, one long, two long, regs binary"), "sketch")
    full = base.where("n_shingles > 0")
    # one row of each class stands for it; equal sets have equal registers
    ids = full.groupBy("one", "two").agg(F.min(F.struct("doc_id", "th")).alias("row"), F.max("n_shingles").alias("n"))
    same = F.col("h.row.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("h.row.th") == F.col("o.th")) & (F.col("h.one") == F.col("o.one")) & (F.col("h.two") == F.col("o.two"))
    heads = ids.alias("h").join(full.alias("o"), same).select("h.one", "h.two", "h.n", "o.doc_id", "o.th", "o.regs").dropDuplicates(["one", "two"])
    heads = stash(heads.withColumn("cls", F.monotonically_increasing_id()), "heads")
    keys = mapped(heads.select("cls", "regs"), bands, "cls long, band long")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "cls")).alias(f"m{k}") for k in (0, 1)]
    buckets = keys.groupBy("band").agg(F.count("*").alias("k"), F.min("cls").alias("a"), F.max("cls").alias("b"), *marks).where("k > 1")
    buckets = stash(buckets.groupBy("k", "a", "b", "m0", "m1").agg(F.min("band").alias("band")), "buckets")
    side = heads.select("cls", "n", "regs")
    both = buckets.where("k = 2").select("a", "b").join(side.toDF("a", "na", "ra"), "a").join(side.toDF("b", "nb", "rb"), "b")
    close = stash(mapped(both, lambda x: screen(x, num), "a long, b long").unionByName(_bucket_search(keys, buckets, side, num)).distinct(), "pairs")
    nodes = close.select(F.col("a").alias("cls")).union(close.select("b")).distinct().join(heads.select("cls", "doc_id", "th"), "cls")
    texts = stash(nodes.alias("x").join(docs.alias("d"), (F.col("x.th") == F.col("d.th")) & F.col("x.doc_id").eqNullSafe(F.col("d.doc_id"))).select("x.cls", "d.text").dropDuplicates(["cls"]), "texts")
    ready = close.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
    judged = stash(mapped(ready, lambda x: confirm(x, num), "a long, b long, linked boolean"), "judged")
    links = judged.where("linked").select("a", "b")
    return base, heads.select("one", "two", "cls"), links.unionByName(_block_search(judged, links, texts, num))


def _bucket_search(keys: DataFrame, buckets: DataFrame, side: DataFrame, num: int) -> DataFrame:
    """The pairs (a, b) of buckets of more than two rows."""
    rows = keys.join(buckets.where("k > 2").select("band", "k"), "band")
    parts = F.when(F.col("k") <= SPLIT, 1).otherwise(F.ceil(2 * F.col("k") / SPLIT)).cast("long")
    rows = rows.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64(F.lit(2), "cls"), F.col("parts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: (j != F.col("mine")) | (F.col("parts") == 1))
    slots = F.transform(others, lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    rows = rows.select("band", "cls", F.explode(slots).alias("s")).select("band", "s.i", "s.j", "cls").join(side, "cls")
    dealt = rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "n", "cls")
    return mapped(dealt.select("band", "i", "j", "cls", "n", "regs"), lambda x: bucket_pairs(x, num), "a long, b long")


def _block_search(judged: DataFrame, links: DataFrame, texts: DataFrame, num: int) -> DataFrame:
    comps = components(links)
    families = components(judged.select("a", "b"))
    member = families.toDF("cls", "family").join(comps.toDF("cls", "comp"), "cls", "left").select("cls", "family", F.coalesce("comp", "cls").alias("comp"))
    member = stash(member, "member")
    sizes = member.groupBy("family", "comp").agg(F.count("*").alias("k"))
    core = sizes.groupBy("family").agg(F.count("*").alias("parts"), F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("all")).where("parts > 1")
    core = core.select("family", F.col("top.comp").alias("core"), F.ceil(F.col("top.k") / BLOCK).alias("n_core"), F.ceil((F.col("all") - F.col("top.k")) / BLOCK).alias("n_rest"))
    open_ = member.join(core, "family").withColumn("in_core", F.col("comp") == F.col("core"))
    rest = F.pmod(F.xxhash64("cls"), F.col("n_rest"))
    mine = F.when(F.col("in_core"), F.pmod(F.xxhash64("cls"), F.col("n_core"))).otherwise(rest)
    slots = F.when(F.col("in_core"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1), lambda j: F.struct(j.alias("i"), (-1 - mine).alias("j")))).otherwise(
        F.concat(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_rest") - 1), lambda j: F.struct(F.least(mine, j).alias("i"), F.greatest(mine, j).alias("j"))),
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_core") - 1), lambda j: F.struct(mine.alias("i"), (-1 - j).alias("j"))),
        )
    )
    rows = open_.select("cls", "family", "comp", F.col("in_core").alias("side"), F.explode(slots).alias("s")).select("cls", "family", "comp", "side", "s.i", "s.j")
    ready = rows.join(texts, "cls")
    return ready.groupBy("family", "i", "j").applyInArrow(lambda t: block_links(t, num), "a long, b long")


def near_duplicates(docs: DataFrame, num: int = NUM) -> DataFrame:
    """doc_id, row (a hash of the text), n_shingles, component_id and kept of every row. Pairs link from a similarity of num / DEN on."""
    base, heads, links = near_links(docs, num)
    comps = components(stash(links, "links"))
    low = base.where("n_shingles > 0").groupBy("one", "two").agg(F.min("doc_id").alias("low"))
    named = low.join(heads, ["one", "two"]).join(comps.toDF("cls", "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(least, "component").select("one", "two", "component_id")
    same = (F.col("b.one") == F.col("c.one")) & (F.col("b.two") == F.col("c.two")) & (F.col("b.n_shingles") > 0)
    out = base.drop("regs").alias("b").join(named.alias("c"), same, "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("th").alias("row"), "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id").eqNullSafe(own), F.lit(False)).alias("kept"))
