"""Token ids in ORC files, in the order of document ids.

A range exchange by doc_id (and a hash of the text, so that one id with very many rows is spread) deals documents to
shards; a task encodes its documents and writes one file: stripes of run-length encoded integers, with row indexes and a
Bloom filter on doc_id, so stripes are read in parallel and most are skipped when few documents are asked for. Shard
totals, one row for each shard, give the place of every document in the whole.

The tokenizers library encodes strings once: a batch's texts are cut at white space, where the library's own pre-tokenizer
always cuts too, and strings that a worker has met are taken from memory. Texts with a special token's string, or with
separators that are white space to some and not to others, go through the library whole.

Null texts are empty: the end id alone. Null doc_ids come first. Repeated rows stay. Other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_parts, claim, mapped, ranges, utf8
from .memory import Memory

#: White space beyond ASCII (a fixed list of the Unicode standard), and separators that only some take for white space.
ODD = re.compile("[\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Single words after a blank, of ASCII and Latin-1 letters, which the library can encode many at a time as one text.
SPACED = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
END_ID = 0
#: Text that is encoded at a time.
BATCH_BYTES = 8_000_000
SCHEMA = "doc_id long, shard int, at long, n_tokens long, ids array<int>"


_ASCII = np.arange(256)
_WHITE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))
_LETTER = ((_ASCII | 32) >= 97) & ((_ASCII | 32) <= 122) & (_ASCII < 128)
_SIGN = (_ASCII > 32) & (_ASCII < 127) & ~_LETTER & ~((_ASCII >= 48) & (_ASCII <= 57))
_LEAD = ((_ASCII >= 0x1C) & (_ASCII <= 0x1F)) | np.isin(_ASCII, [0xC2, 0xE1, 0xE2, 0xE3])  # the first bytes of what ODD finds
_LATIN = (_ASCII >= 0x80) & (_ASCII <= 0xBF) & (_ASCII != 0x97) & (_ASCII != 0xB7)


def string_cuts(data: np.ndarray) -> np.ndarray:
    """Where strings begin that the published word pattern keeps apart: at white space after another character, after a single white
    character that is no blank, at an ASCII sign after a letter. Runs of white space are not cut: what follows decides how the pattern cuts them."""
    white = _WHITE[data]
    before = np.concatenate(([False], white[:-1]))
    two = np.concatenate(([False], before[:-1]))
    lone = np.concatenate(([0], data[:-1])) != 32
    letter = _LETTER[data]
    letter[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    new = (white & ~before) | (~white & before & ~two & lone)
    new[1:] |= letter[:-1] & _SIGN[data[1:]]
    return new


class Encoder:
    """Ids of texts, from those of their strings."""

    def __init__(self, path: str, strings: int = 500_000, chain: int = 256):
        """strings: how many are remembered. chain: words that the library encodes as one text."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.chain = chain
        vocabulary = self.library.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a byte is one character of a byte-level piece
        self.size[list(vocabulary.values())] = [len(t) for t in vocabulary]
        self.memory = Memory(strings, self._learn)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words after a blank are encoded many at a time and told apart by the bytes of their ids."""
        spaced = [SPACED.match(s) is not None for s in new]
        chain = [s for s, yes in zip(new, spaced, strict=True) if yes]
        parts = [chain[a : a + self.chain] for a in range(0, len(chain), self.chain)]
        ids = np.concatenate([np.zeros(0, np.int32), *self._ids([b"".join(p).decode() for p in parts])])
        ends, upto = np.cumsum([len(w) for w in chain]), np.cumsum(self.size[ids])
        last = np.searchsorted(upto, ends)  # the id that ends each word
        if len(chain) and (last[-1] >= len(ids) or (upto[last] != ends).any()):
            raise ValueError("the library cuts words in another way")
        many = np.diff(np.concatenate(([-1], last)))
        rest = self._ids([s.decode() for s, yes in zip(new, spaced, strict=True) if not yes])
        order = np.argsort(np.concatenate((np.flatnonzero(spaced), np.flatnonzero(~np.array(spaced, bool)))))
        counts = np.concatenate((many, np.array([len(v) for v in rest], np.int64))).astype(np.int64)
        first = np.concatenate(([0], np.cumsum(counts)[:-1]))
        return np.concatenate([ids, *rest])[ranges(first[order], counts[order])], counts[order]

    def _whole(self, texts: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Which texts can't be cut."""
        out = np.zeros(len(texts), bool)
        lead = np.flatnonzero(_LEAD[data[off[0] : off[-1]]]) + off[0]
        for i in np.unique(np.searchsorted(off, lead, "right") - 1).tolist():
            out[i] = ODD.search(texts[i].as_py()) is not None
        raw = data[off[0] : off[-1]].tobytes()
        for special in self.special:
            if special.encode() in raw:
                out |= [special in (t or "") for t in texts.to_pylist()]
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids, counts = self.flat(pa.array(texts, pa.string()))
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has. end follows each text's ids."""
        data, off = utf8(texts)
        whole = self._whole(texts, data, off)
        begin, size = off[:-1][~whole], np.diff(off)[~whole]
        own = np.ascontiguousarray(data[off[0] : off[-1]]) if not whole.any() else data[ranges(begin, size)]
        first = np.concatenate(([0], np.cumsum(size)))
        new = string_cuts(own) if len(own) else np.zeros(0, bool)
        new[first[:-1][size > 0]] = True
        cuts = np.flatnonzero(new)
        ids, many = self.memory.values(own, np.concatenate((cuts, [len(own)])))
        upto = np.concatenate(([0], np.cumsum(many)))[np.searchsorted(cuts, first)]
        counts = np.zeros(len(texts), np.int64)
        counts[~whole] = np.diff(upto)
        at = np.flatnonzero(whole)
        for i, more in zip(at.tolist(), self._ids([texts[i].as_py() for i in at.tolist()]), strict=True):
            before = counts[:i].sum()
            ids = np.concatenate((ids[:before], more, ids[before:]))
            counts[i] = len(more)
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), end)
            counts += 1
        return ids, counts


def encoder(path: str) -> Encoder:
    return claim(f"tokens {path}", lambda: Encoder(path))


def encode_shards(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(path)
        shard, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in byte_parts(whole, BATCH_BYTES):
                flat, n = encode.flat(batch.column("text"), end_id)
                places = at + np.concatenate(([0], np.cumsum(n)[:-1]))
                at += int(n.sum())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), shard, np.int32)), pa.array(places), pa.array(n), lists], ["doc_id", "shard", "at", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, tokenizer: str, out: str, end_id: int = END_ID, shards: int | None = None) -> None:
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    (
        mapped(dealt.select("doc_id", "text"), encode_shards(tokenizer, end_id), SCHEMA, f"tokens {tokenizer}").write.mode("overwrite")
        .option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", "1000").option("orc.stripe.size", str(16 << 20)).option("orc.create.index", "true").orc(out)
    )


def read_tokens(spark, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, shard, at, n_tokens, ids, and start: the ids of all documents before it. doc_ids reach the files as a pushed filter, which row indexes and Bloom filters answer."""
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row for each shard
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(first), "shard").withColumn("start", F.col("first") + F.col("at")).drop("first")


def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, off = ids.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def report(tokens: DataFrame) -> DataFrame:
    return mapped(tokens.select("doc_id", "start", "n_tokens", "ids"), crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
