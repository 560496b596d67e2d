"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are normalized (blanks become U+2581, one is put in front) and cut between characters that no piece of the
vocabulary holds next to each other; parts that are new to the worker are joined into one text, whose suffixes are sorted.
Binary search finds the range of suffixes that begin with each piece; the ranges' places are edges (start, end, piece),
sorted by where in their part they end. Relaxation goes through the edges once, in all parts at the same time: for each
place it keeps the piece that ends there in the encoding of everything before it. An edge takes a place if it can follow
the piece kept where it starts, that is, if merging would not have joined characters of the two across their border
(``Vocabulary.follows``). Exactly one edge does, so the result is that of merging, without merging.

Characters that no piece holds are edges of their bytes' pieces. Ids decode by joining pieces, bytes as UTF-8.
Null texts are empty and have no pieces. Repeated rows stay. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_parts, claim, mapped, ranges
from .memory import Memory

BLANK = "▁"
#: Parts that a worker remembers; characters joined into one indexed text; text that is encoded at a time.
MEMORY, INDEX_CHARS, BATCH_BYTES = 300_000, 150_000, 2_000_000
#: Parts of more characters are relaxed one at a time.
LONG = 64


class Numbers:
    """Places of 64-bit keys in a list of distinct ones, by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.at = np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int32)
        for k, slot in enumerate(self._slot(keys).tolist()):
            while self.at[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.at[slot] = keys[k], k

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.at[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & self.mask
            out[rest] = self.at[slot]
            go = (out[rest] >= 0) & (self.keys[slot] != keys[rest])
            rest, slot = rest[go], slot[go]
        return out


class Vocabulary:
    """Pieces by falling score, so that a piece's number is its rank in merging."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normalize = sp.normalize
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        plain.sort(key=lambda i: -sp.get_score(i))
        self.ids = np.array(plain, np.int64)
        self.names = [self.pieces[i] for i in plain]
        self.rank = {p: k for k, p in enumerate(self.names)}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.longest = max(map(len, self.names), default=1)
        self._split()
        self._characters()
        back = {i: b for b, i in self.byte.items()}
        raw = [bytes([back[i]]) if i in back else p.encode() if p in self.rank else b"" for i, p in enumerate(self.pieces)]
        self.raw, self.raw_first = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        self.memory = Memory(MEMORY, self.learn_all)

    def _split(self) -> None:
        """When merging makes each piece (0: characters), the two pieces that it joins last, and when any two pieces that are neighbours join."""
        n = len(self.names)
        self.made = np.array([k + 1 if len(p) > 1 else 0 for k, p in enumerate(self.names)], np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        pairs, when, usable = [], [], []
        rank = self.rank.get
        for k, p in enumerate(self.names):
            for i in range(1, len(p)):
                if (a := rank(p[:i])) is not None and (b := rank(p[i:])) is not None:
                    pairs.append(a * n + b)
                    when.append(k + 1)
            parts = [*p]
            while len(parts) > 2:
                best = min((r, i) for i in range(len(parts) - 1) if (r := rank(parts[i] + parts[i + 1])) is not None) if any(a + b in self.rank for a, b in zip(parts, parts[1:])) else None
                if best is None:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            if len(parts) == 2 and all(x in self.rank for x in parts):
                self.left[k], self.right[k] = rank(parts[0]), rank(parts[1])
            if len(parts) <= 2 and (len(p) == 1 or self.left[k] != k):
                usable.append(k)  # merging gets there
        self.joins, self.when = Numbers(np.array(pairs, np.int64)), np.array([*when, 0], np.int64)
        self.usable = np.array(usable, np.int64)
        self.size = np.array([len(p) for p in self.names], np.int64)

    def _characters(self) -> None:
        """Numbers of characters (0: those that no piece of two or more holds), which of them can be neighbours, and the pieces as rows of them."""
        known = sorted({c for p in self.names if len(p) > 1 for c in p})
        self.char = np.zeros(0x110000, np.uint16)
        self.char[[ord(c) for c in known]] = np.arange(1, len(known) + 1)
        self.near = np.zeros((len(known) + 1, len(known) + 1), bool)
        self.rows = np.zeros((len(self.names), self.longest), np.uint16)
        for k, p in enumerate(self.names):
            row = self.char[[ord(c) for c in p]]
            self.rows[k, : len(p)] = row
            self.near[row[:-1], row[1:]] = True

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces a and b stay as they are side by side. Their merges are undone, the last one first (of equals the right one): what then
        meets at the border must not join before the merge that was undone."""
        a, b = a.copy(), b.copy()
        out, limit, left = np.ones(len(a), bool), np.full(len(a), len(self.names) + 2), np.arange(len(a))
        while len(left):
            x, y = a[left], b[left]
            at = self.joins.find(x * len(self.names) + y)
            bad = (at >= 0) & (self.when[at] < limit[left])
            out[left[bad]] = False
            tx, ty = self.made[x], self.made[y]
            first = tx > ty
            limit[left] = np.where(first, tx, ty + 1)
            a[left], b[left] = np.where(first, self.right[x], x), np.where(first, y, self.left[y])
            left = left[~bad & ((tx > 0) | (ty > 0))]
        return out

    def edges(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and piece of all occurrences of all pieces in a text of character numbers (0: none)."""
        present = np.unique(c)
        bits = 8 if len(present) < 255 else 16
        number = np.zeros(int(self.char.max()) + 1, np.uint64)
        number[present[present > 0]] = np.arange(1, (present > 0).sum() + 1)
        own = self.usable[(number[self.rows[self.usable]] > 0).sum(1) == self.size[self.usable]]
        per = 64 // bits
        columns = -(-self.longest // per)

        def packed(x: np.ndarray) -> np.ndarray:
            out = np.zeros(x.shape[:-1] + (x.shape[-1] // per,), np.uint64)
            for k in range(per):
                out |= x[..., k::per] << np.uint64(bits * (per - 1 - k))
            return out

        rows = np.zeros((len(own), columns * per), np.uint64)
        rows[:, : self.longest] = number[self.rows[own]]
        size = self.size[own]
        low, high = packed(rows), packed(np.where(np.arange(rows.shape[1]) < size[:, None], rows, np.uint64(2**bits - 1)))
        t = np.concatenate((number[c], np.zeros(columns * per, np.uint64)))
        word = np.zeros(len(c) + (columns - 1) * per, np.uint64)
        for k in range(per):
            word |= t[k : k + len(word)] << np.uint64(bits * (per - 1 - k))
        keys = [word[k * per : k * per + len(c)] for k in range(columns)]
        order = np.lexsort(keys[::-1])
        head = keys[0][order]
        lo, hi = np.searchsorted(head, low[:, 0], "left"), np.searchsorted(head, high[:, 0], "right")
        for k in range(1, columns):
            deep = np.flatnonzero((size > k * per) & (hi > lo))
            lo[deep], hi[deep] = (self._bound(keys[k], order, want[deep, k], lo[deep], hi[deep], after) for want, after in ((low, False), (high, True)))
        many = hi - lo
        return order[ranges(lo, many)], np.repeat(own, many)

    @staticmethod
    def _bound(key: np.ndarray, order: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of each wanted value in its own range of order."""
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            x = key[order[mid]]
            right = x <= want[open_] if after else x < want[open_]
            lo[open_], hi[open_] = np.where(right, mid + 1, lo[open_]), np.where(right, hi[open_], mid)
        return lo

    def learn_all(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, counts, a, held = [], [], 0, 0
        for k, part in enumerate(new):
            held += len(part) // 4 + 1
            if held >= INDEX_CHARS or k == len(new) - 1:
                ids, many = self.learn(new[a : k + 1])
                flat.append(ids)
                counts.append(many)
                a, held = k + 1, 0
        return np.concatenate(flat), np.concatenate(counts)

    def learn(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes parts (UTF-32), all over one index of their joined text."""
        size = np.array([len(p) // 4 for p in parts], np.int64)
        single = np.flatnonzero(size == 1)
        ids: list[list[int]] = [self._character(parts[i].decode("utf-32-le")) for i in single.tolist()]
        longer = np.flatnonzero(size > 1)
        owner, pieces = self.relax([parts[i] for i in longer.tolist()], size[longer]) if len(longer) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        counts = np.zeros(len(parts), np.int64)
        counts[single] = [len(x) for x in ids]
        counts[longer] = np.bincount(owner, minlength=len(longer))
        both = np.concatenate((np.repeat(single, counts[single]), longer[owner]))
        flat = np.concatenate((np.array([i for x in ids for i in x], np.int64), self.ids[pieces]))
        return flat[np.argsort(both, kind="stable")].astype(np.int32), counts

    def _character(self, c: str) -> list[int]:
        if c in self.rank:
            return [int(self.ids[self.rank[c]])]
        return [self.byte.get(b, self.unknown) for b in c.encode()] if self.byte else [self.unknown]

    def relax(self, parts: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all parts, the number of the part and the pieces of its encoding, in order."""
        first = np.cumsum(size + 1) - size - 1
        c = np.zeros(int(first[-1] + size[-1]) + 1, np.uint16)
        c[ranges(first, size)] = self.char[np.frombuffer(b"".join(parts), np.uint32)]
        begin = np.repeat(first, size + 1)
        start, piece = self.edges(c)
        end = start + self.size[piece]
        kept, back = np.full(len(c) + 1, -1, np.int64), np.zeros(len(c) + 1, np.int64)
        depth = end - begin[start]
        short = size[np.searchsorted(first, start, "right") - 1] <= LONG
        by = np.flatnonzero(short)
        by = by[np.argsort(depth[by].astype(np.uint16), kind="stable")]
        steps = np.searchsorted(depth[by], np.arange(LONG + 2))
        for a, b in zip(steps[:-1], steps[1:]):
            e = by[a:b]
            s, p = start[e], piece[e]
            before = kept[s]
            good = s == begin[s]
            ask = np.flatnonzero(~good & (before >= 0))
            good[ask] = self.follows(before[ask], p[ask])
            kept[end[e[good]]], back[end[e[good]]] = p[good], s[good]
        if not short.all():
            self._relax_long(start, piece, end, begin, np.flatnonzero(~short), kept, back)
        at, left = first + size, np.arange(len(parts))
        owners, found = [], []
        while len(left):
            x = at[left]
            if (kept[x] < 0).any():
                raise ValueError("no piece ends where one has to")
            owners.append(left)
            found.append(kept[x])
            at[left] = back[x]
            left = left[at[left] > first[left]]
        owner, pieces = np.concatenate(owners[::-1]), np.concatenate(found[::-1])
        order = np.argsort(owner, kind="stable")
        return owner[order], pieces[order]

    def _relax_long(self, start, piece, end, begin, edges, kept, back) -> None:
        """The same for parts of many characters, one edge after the other; pairs of pieces that were asked for are remembered."""
        fits: dict[tuple[int, int], bool] = {}
        edges = edges[np.argsort(end[edges], kind="stable")]
        held: dict[int, int] = {}
        for s, p, e, first in zip(start[edges].tolist(), piece[edges].tolist(), end[edges].tolist(), begin[start[edges]].tolist(), strict=True):
            if s != first:
                if (before := held.get(s)) is None:
                    continue
                if (good := fits.get((before, p))) is None:
                    if len(fits) > 300_000:
                        fits.clear()
                    good = fits[before, p] = bool(self.follows(np.array([before]), np.array([p]))[0])
                if not good:
                    continue
            held[e] = p
            kept[e], back[e] = p, s

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        ids, counts = self.flat(texts)
        return [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(counts)[:-1])] if len(texts) else []

    def flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        normal = [self.normalize(t) if t else "" for t in texts]
        first = np.concatenate(([0], np.cumsum([len(t) for t in normal]))).astype(np.int64)
        data = np.frombuffer("".join(normal).encode("utf-32-le"), np.uint8)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        c = self.char[data.view(np.uint32)]
        new = np.ones(len(c), bool)
        new[1:] = ~self.near[c[:-1], c[1:]]
        new[first[:-1][np.diff(first) > 0]] = True
        cuts = np.flatnonzero(new)
        ids, many = self.memory.values(data, 4 * np.concatenate((cuts, [len(c)])))
        return ids, np.diff(np.concatenate(([0], np.cumsum(many)))[np.searchsorted(cuts, first)])

    def decode(self, ids: list[int]) -> str:
        return self.texts(np.array(ids, np.int64), np.array([len(ids)]))[0]

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids, of which each text has so many."""
        size = self.raw_first[ids + 1] - self.raw_first[ids]
        data = self.raw[ranges(self.raw_first[ids], size)].tobytes()
        upto = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        texts = [data[a:b].decode("utf-8", "replace").replace(BLANK, " ") for a, b in zip(upto[:-1], upto[1:], strict=True)]
        return [t[1:] if t[:1] == " " else t for t in texts]


def vocabulary(path: str) -> Vocabulary:
    return claim(f"pieces {path}", lambda: Vocabulary(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text and ids of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in byte_parts(whole, BATCH_BYTES):
                ids, counts = vocab.flat(batch.column("text").to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), lists], ["doc_id", "text", "ids"])

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, text string, ids array<int>", f"pieces {path}")


def report(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each row's ids and of the text decoded from them, and whether that is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in byte_parts(whole, BATCH_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, counts = vocab.flat(texts)
                back = vocab.texts(ids, counts)
                raw, at = ids.astype("<u4").tobytes(), (4 * np.concatenate(([0], np.cumsum(counts)))).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        pa.array(counts, pa.int64()),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                        pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "same"],
                )

    return mapped(docs.select("doc_id", "text"), run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string, same boolean", f"pieces {path}")
