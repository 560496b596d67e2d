"""Language identification by prediction by partial matching.

For each language a tree of byte contexts (order 0 to 4, A-Z lower-cased) is counted on a bounded sample of labelled
documents, then frozen. A symbol costs -log2(count / (total + kinds)) bits in the longest context that has seen it, and
-log2(kinds / (total + kinds)) bits for each longer context that has not (method C); unknown symbols cost 8 bits below
order 0. A text's language is the one with the shortest code, the first in the alphabet of equal ones.

Texts that are null or have no letter, and all texts if nothing was learned, are ``und`` with score 0. Training rows need
text, lang and doc_id. The sample is bounded by SAMPLE_BYTES a language (``learn``). Every byte of every text is scored. Repeated rows stay; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE, mapped

ORDER = 4
SAMPLE_BYTES = 300_000
CHUNK = 1 << 19
LETTER = re.compile(r"[^\W\d_]")
UND = "und"


class Lookup:
    """Places of 64-bit keys, by open addressing."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = size - 1
        self.keys, self.values = np.full(size, 2**64 - 1, np.uint64), np.full(size, -1, np.int32)
        left, at = np.arange(len(keys)), self._hash(keys)
        while len(left):
            free = self.values[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = left[free][first]
            self.keys[slot], self.values[slot] = keys[won], won
            rest = self.keys[at] != keys[left]
            left, at = left[rest], (at[rest] + 1) & self.mask

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        out = self.values[at]
        rest = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        out[rest] = -1
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            value, same = self.values[at], self.keys[at] == keys[rest]
            out[rest[same]] = value[same]
            go = ~same & (value >= 0)
            rest, at = rest[go], at[go]
        return out


def grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place, as one number; the first places miss some."""
    out = np.zeros(len(data), np.uint64)
    for k in range(n):
        out[k:] |= data[: len(data) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each after ORDER line breaks, and the number of the text that a byte is of (-1: padding)."""
    pad = b"\n" * ORDER
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t.translate(LOWER_TABLE))), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.full(len(data), -1, np.int64)
    first = np.concatenate(([0], np.cumsum(sizes + ORDER)))[:-1] + ORDER
    inside = np.repeat(first - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    owner[inside] = np.repeat(np.arange(len(texts)), sizes)
    return data, owner


class Model:
    """Frozen counts of all languages: for each known n-gram its cost in each language, for each context its escape cost."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.langs = sorted(samples)
        data = {lang: padded(samples[lang]) for lang in self.langs}
        count = len(self.langs)
        self.lookup, self.cost, self.escape = [], [], []
        below_cost, below = np.full((1, count), 8.0), None
        below_keys = np.zeros(1, np.uint64)
        for n in range(1, ORDER + 2):
            own = {lang: np.unique(grams(d, n)[o >= 0], return_counts=True) for lang, (d, o) in data.items()}
            keys = np.unique(np.concatenate([k for k, _ in own.values()])) if own else np.zeros(0, np.uint64)
            seen = np.zeros((len(keys), count))
            for j, lang in enumerate(self.langs):
                seen[np.searchsorted(keys, own[lang][0]), j] = own[lang][1]
            context = keys >> np.uint64(8)
            ctx, back = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(ctx), count)), np.zeros((len(ctx), count))
            np.add.at(total, back, seen)
            np.add.at(kinds, back, seen > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                esc = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(seen / (total + kinds)[back])
            suffix = keys & np.uint64(2 ** (8 * (n - 1)) - 1)
            under = below_cost[np.searchsorted(below_keys, suffix)] if n > 1 else np.repeat(below_cost, len(keys), 0)
            cost = np.where(seen > 0, hit, esc[back] + under)
            self.lookup.append(Lookup(keys))
            self.cost.append(cost.astype(np.float32))
            self.escape.append((Lookup(ctx), esc.astype(np.float32)))
            below_cost, below_keys = cost, keys

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        data, owner = padded(texts)
        for a in range(0, len(data), CHUNK):
            begin = max(0, a - ORDER)
            part, own = data[begin : a + CHUNK], owner[a : a + CHUNK]
            skip = a - begin
            use = np.flatnonzero(own >= 0)
            total = np.zeros((len(use), len(self.langs)), np.float32)
            left = np.arange(len(use))
            whole = grams(part, ORDER + 1)[skip:][use]
            for n in range(ORDER + 1, 0, -1):
                key = whole[left] & np.uint64(2 ** (8 * n) - 1)
                at = self.lookup[n - 1].find(key)
                known = at >= 0
                total[left[known]] += self.cost[n - 1][at[known]]
                left, key = left[~known], key[~known]
                lookup, escape = self.escape[n - 1]
                c = lookup.find(key >> np.uint64(8))
                met = c >= 0
                total[left[met]] += escape[c[met]]
            total[left] += 8.0
            for j in range(len(self.langs)):
                out[:, j] += np.bincount(own[use], weights=total[:, j], minlength=len(texts))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """docs: doc_id, text, lang. Byte counts of all usable rows set the part of each language that is sampled; only that comes to the driver.

    The sample is whole documents in the order of a hash of their id, up to sample_bytes of each language; of a document that alone goes
    beyond, the first sample_bytes (to a whole character) are learned, so a language of long documents only is learned too.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    size = F.least(F.octet_length("text"), F.lit(sample_bytes)).cast("long")
    sums = usable.groupBy("lang").agg(F.sum(size).alias("n"), F.max(size).alias("top")).collect()
    if not sums:
        return Model({})
    part = 1_000_000
    order = F.pmod(F.xxhash64("doc_id"), F.lit(part))
    share = F.create_map(*[F.lit(x) for r in sums for x in (r.lang, min(part, int(part * 1.5 * (sample_bytes + r.top) / max(1, r.n)) + 1))])
    # a character has a byte at least, so this keeps all that is learned
    rows = usable.where(order < share[F.col("lang")]).select("lang", order.alias("o"), "doc_id", F.substring("text", 1, sample_bytes).alias("text")).collect()
    samples: dict[str, list[bytes]] = {}
    held: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.o, r.doc_id, r.text)):
        text = r.text.encode()[:sample_bytes].decode("utf-8", "ignore").encode()
        if held.get(r.lang, 0) + len(text) <= sample_bytes:
            samples.setdefault(r.lang, []).append(text)
            held[r.lang] = held.get(r.lang, 0) + len(text)
    return Model(samples)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, score (the best language's part of the probability) and bits (code bits a byte; null for ``und``) to all columns of docs, of which those with these names go."""
    spark = docs.sparkSession
    docs = docs.drop("lang_pred", "score", "bits")
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            use = [i for i, t in enumerate(texts) if LETTER.search(t)] if known.langs else []
            pred, score, rate = [UND] * len(texts), [0.0] * len(texts), [None] * len(texts)
            for a in range(0, len(use), 200):
                some = use[a : a + 200]
                raw = [texts[i].encode("utf-8", "replace") for i in some]
                bits = known.bits(raw)
                best = bits.argmin(1)
                prob = 1 / np.exp2(np.maximum(-1000, bits.min(1)[:, None] - bits)).sum(1)
                for i, t, k, p, b in zip(some, raw, best.tolist(), prob.tolist(), bits.min(1).tolist(), strict=True):
                    pred[i], score[i], rate[i] = known.langs[k], p, b / len(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], [*batch.schema.names, "lang_pred", "score", "bits"])

    return mapped(docs, run, schema)
