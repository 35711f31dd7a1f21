"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A sequence of tokens is the encoding of its bytes exactly when every neighbouring pair is the
encoding of the pair's bytes (this holds for vocabularies whose tokens encode to themselves).  So
two encodings are joined by encoding a window around the boundary anew, and the window grows until
the pair on either side of it is stable; then all pairs of the result are stable, and it equals the
encoding of the whole.  A piece of text is halved recursively, its halves are encoded and joined,
so the cost of a huge piece is that of its leaves and boundaries.

The join is associative, hence the tree over a document's pieces is free: pieces are encoded
separately by definition, their join is concatenation.  Decoding concatenates bytes up a tree.

Defined results: null text counts as empty; an empty text has no ids; invalid UTF-8 is replaced as
Python's "replace" does; null ids pass through; repeated rows are encoded each; other columns are
not read by `encode`; special tokens are ordinary text."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 32
NEVER = 1 << 40
#: pieces after which a task's memory of them begins anew
MEMORY = 1 << 16
#: bytes of text encoded together
GROUP = 1 << 21


class Vocabulary:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self._stable = lru_cache(1 << 14)(self._pair)
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        halves = ((ranks.get(t[:k]), ranks.get(t[k:]), i) for t, i in ranks.items() for k in range(1, len(t)))
        split = np.fromiter((x for a, b, i in halves if a is not None and b is not None for x in (a << 20 | b, i)), np.int64).reshape(-1, 2)
        split = split[np.argsort(split[:, 0], kind="stable")]
        self.pairs, self.merged = split[:, 0].copy(), split[:, 1].copy()
        tokens = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def leaf(self, data: bytes) -> list[int]:
        """Plain BPE: merge the neighbours with the lowest rank, the leftmost first."""
        ranks = self.ranks
        if (own := ranks.get(data)) is not None:
            return [own]
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _pair(self, a: int, b: int) -> bool:
        return self.leaf(self.bytes[a] + self.bytes[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of both from the encodings of each."""
        if not left or not right:
            return left + right
        if self._stable(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.leaf(b"".join(map(self.bytes.__getitem__, left[len(left) - a:] + right[:b])))
            fits_left = a == len(left) or self._stable(left[-a - 1], window[0])
            fits_right = b == len(right) or self._stable(window[-1], right[b])
            if fits_left and fits_right:
                return left[:len(left) - a] + window + right[b:]
            a, b = (a if fits_left else 2 * a), (b if fits_right else 2 * b)

    def encode_piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.leaf(data)
        half = len(data) // 2
        return self.join(self.encode_piece(data[:half]), self.encode_piece(data[half:]))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the merges of neighbours, NEVER where there is none."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (b >= 0), self.merged[at], NEVER)

    def _leaves(self, pieces: list[bytes]) -> list[bytes]:
        """`leaf` of many short pieces at once, one row each, as packed ids."""
        size = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), size.max() + 1), -1, np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ids[np.arange(ids.shape[1]) < size[:, None]] = flat
        rank = self._rank(np.maximum(ids[:, :-1], 0), ids[:, 1:])
        live = np.arange(len(pieces))
        while len(live):
            r = rank[live]
            at = r.argmin(axis=1)
            go = r[np.arange(len(live)), at] < NEVER
            live, at, r = live[go], at[go], r[go]
            if not len(live):
                break
            row = ids[live]
            cols = np.arange(row.shape[1])
            after = np.concatenate([row[:, 1:], np.full((len(row), 1), -1)], axis=1)
            row = np.where(cols > at[:, None], after, row)
            k = np.arange(len(live))
            row[k, at] = r[k, at]
            r = np.where(cols[:-1] > at[:, None], np.concatenate([r[:, 1:], np.full((len(r), 1), NEVER)], axis=1), r)
            r[k, at] = self._rank(row[k, at], row[k, at + 1])
            left = np.flatnonzero(at > 0)
            r[left, at[left] - 1] = self._rank(row[left, at[left] - 1], row[left, at[left]])
            ids[live], rank[live] = row, r
        full = ids >= 0
        packed = ids[full].astype("<u4").tobytes()
        ends = np.cumsum(full.sum(axis=1)) * 4
        return [packed[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist())]

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; those longer than a leaf go through the tree."""
        out: list[bytes | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) <= LEAF:
                by_width.setdefault((len(p) + 3) // 4, []).append(i)
            else:
                out[i] = np.array(self.encode_piece(p), "<u4").tobytes()
        for own in by_width.values():
            for at in range(0, len(own), 1 << 15):
                part = own[at:at + (1 << 15)]
                for i, ids in zip(part, self._leaves([pieces[i] for i in part])):
                    out[i] = ids
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > 1 << 16:
            half = len(ids) // 2
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return _gather(self.blob, self.start, self.size, ids)[0].tobytes()


def _gather(blob: np.ndarray, start: np.ndarray, size: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries `codes` of a blob one after the other, and where each ends."""
    own = size[codes]
    ends = np.cumsum(own)
    if not len(own) or not ends[-1]:
        return blob[:0], ends
    return blob[np.repeat(start[codes] - ends + own, own) + np.arange(ends[-1])], ends


class Codec:
    """Encodes texts to packed little-endian 32-bit ids and back.

    A text is cut before each space that a non-blank follows: no piece of the pattern crosses such a
    place.  Within a group of texts each distinct unit is split once; pieces are remembered until
    there are more than MEMORY.  A text with other blank runs is one unit."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.vocabulary = Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.split = regex.compile(pattern).findall
        self.runs = re.compile(r" \s|\s \Z").search
        self._forget()

    def _forget(self) -> None:
        """Begin an empty memory of pieces: the place, number and list of their ids."""
        self.known: dict[str, int] = {}
        self.size = np.empty(0, np.int64)
        self.blob = np.empty(0, "<u4")

    def _pieces(self, words: list[str], alone: list[str]) -> tuple[list[str], np.ndarray]:
        """Pieces of all units and the number in each: `words` follow a space, `alone` do not."""
        found = self.split(" " + " ".join(words)) if words else []
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        unit_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        counts = [np.diff(np.searchsorted(ends, unit_ends, "right"), prepend=0)]
        for text in alone:
            own = self.split(text)
            found.extend(own)
            counts.append([len(own)])
        return found, np.concatenate(counts).astype(np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [not self.runs(t) for t in texts]
        parts = pc.split_pattern(pa.array([t if f else "" for t, f in zip(texts, plain)], pa.large_string()), " ")
        bounds = parts.offsets.to_numpy()
        # the first unit of a text has no space before it; an empty one is the space that ends a text
        first = np.zeros(len(parts.values), bool)
        first[bounds[:-1]] = True
        units = parts.values.filter(pa.array(~first)).dictionary_encode()
        words = units.dictionary.to_pylist()
        n = len(words)
        codes = np.empty(len(first), np.int64)
        codes[~first] = units.indices.to_numpy()
        codes[first] = n + np.arange(len(texts))
        alone = [t.split(" ", 1)[0] if f else t for t, f in zip(texts, plain)] + [" "]
        if "" in words:
            empty = words.index("")
            words[empty] = "x"
            codes[codes == empty] = n + len(texts)
        found, counts = self._pieces(words, alone)
        if len(self.known) > MEMORY:
            self._forget()
        new = [p for p in dict.fromkeys(found) if p not in self.known]
        packed = self.vocabulary.encode_pieces([p.encode() for p in new])
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.size = np.concatenate([self.size, np.fromiter(map(len, packed), np.int64, len(packed)) // 4])
        self.blob = np.concatenate([self.blob, np.frombuffer(b"".join(packed), "<u4")])
        piece = np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))
        ids, ends = _gather(self.blob, np.cumsum(self.size) - self.size, self.size, piece)
        unit_ends = np.concatenate([[0], ends])[np.cumsum(counts)]
        unit_size = np.diff(unit_ends, prepend=0)
        out, ends = _gather(ids, unit_ends - unit_size, unit_size, codes)
        ends = np.concatenate([[0], ends])[bounds]
        return [out[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, ids: bytes) -> bytes:
        return self.vocabulary.decode(np.frombuffer(ids, "<u4"))


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _local(path: str, name: str | None) -> str:
    """The vocabulary file where this task can open it."""
    return SparkFiles.get(name) if name else path


def _grouped(texts):
    """Consecutive texts of about GROUP bytes together."""
    group, size = [], 0
    for text in texts:
        raw = text.as_py() or b""
        if group and size + len(raw) > GROUP:
            yield group
            group, size = [], 0
        group.append(raw.decode("utf-8", "replace"))
        size += len(raw)
    if group:
        yield group


def _run(path: str, pattern: str, name: str | None, with_ids: bool):
    def run(batches):
        # a reused worker may still hold what earlier stages freed
        pa.default_memory_pool().release_unused()
        c = codec(_local(path, name), pattern)
        for batch in batches:
            done = 0
            for group in _grouped(batch.column(1)):
                packed = c.encode(group)
                arrays = [batch.column(0).slice(done, len(group)), pa.array([len(p) // 4 for p in packed], pa.int64()),
                          pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                          pa.array([hashlib.sha256(c.decode(p)).hexdigest() for p in packed], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    arrays, names = [*arrays, pa.array(packed, pa.binary())], [*names, "ids"]
                done += len(group)
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           with_ids: bool = False, ship: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every text.

    `path` is a rank file each executor can open; with `ship` the driver's copy is sent to them."""
    name = None
    if ship:
        docs.sparkSession.sparkContext.addFile(path)
        name = path.rsplit("/", 1)[-1]
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")) \
        .mapInArrow(_run(path, pattern, name, with_ids), schema)


def _back(path: str, pattern: str, name: str | None):
    def run(batches):
        c = codec(_local(path, name), pattern)
        for batch in batches:
            texts = [c.decode(ids.as_py() or b"").decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])
    return run


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", ship: bool = False) -> DataFrame:
    """(doc_id, text) of packed ids; null ids give an empty text."""
    name = None
    if ship:
        tokens.sparkSession.sparkContext.addFile(path)
        name = path.rsplit("/", 1)[-1]
    return tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")) \
        .mapInArrow(_back(path, pattern, name), "doc_id bigint, text string")
