"""Prefix trie of conversations from sorted order and longest common prefixes.

A turn is a 128-bit digest of its role and text.  Conversations are sorted by their sequences of
digests (a prefix stands before what continues it), equal ones by id, so the members of every prefix
are one interval of the order.  The longest common prefix (LCP) with the row before is kept beside
each row.  A candidate prefix of depth d at a row reaches left and right as far as the LCPs are at
least d; both ends are found by binary search over a sparse table of range minima, each on its own
and without a stack or any other row's result.

The order is range-partitioned; a partition becomes one block row of flat arrays.  A block answers
what lies inside it from its own table.  What leaves it goes on in a second table over the minima of
blocks, and ends in one block at one of its records: the places where, counted from a block's edge,
the LCP falls below everything before.  There are at most `BLOCKS` blocks, larger where there is more
data, and a block has at most one record per turn of its edge conversation, so what the driver gathers and
sends out has a bound.  Sums over subtrees are differences of running sums, as the nodes below one are
owned by the rows of its interval.  Nothing is shuffled after the sort but the ids of copies that
cross blocks: a digest over ids has to run over them in order, so their joined blocks of text go
through one task in order, block by block.

Defined results: null role and text count as empty; turns stand by number, null first, equal numbers
by digest; rows without a conversation id belong to none; a conversation without turns is a member of
the root; equal conversations are members of the same nodes; ids are ordered as numbers; no conversations
give no nodes; other columns are not read.  Texts of any length are only hashed and counted.  A
conversation is one row of 24 bytes a turn, which bounds its turns (10**7 are 240 MB).  Two different
turns have one digest with odds of about 10**-15 among 10**12 turns."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wirepost.llm import scratch

#: conversations whose head is borrowed by the next ninety-nine, and turns borrowed at most
STRIDE, HEAD = 100, 6
#: bytes of a turn's digest
WIDTH = 16
#: turns of a block at least, and blocks at most
BLOCK, BLOCKS = 1 << 15, 1 << 14
#: nodes sent on together
SENT = 1 << 14
FAR = np.iinfo(np.int64).max
_BLOCK = ("lcps", "lengths", "ids", "points")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (digest, code points)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    body = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(F.col("turn"), F.unhex(F.substring(F.sha2(body, 256), 1, 2 * WIDTH)).alias("digest"), F.length(text).cast("long").alias("points"))
    told = conversations.filter("conv_id is not null").select("conv_id", turn.alias("t"))
    return told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")) \
        .select("conv_id", F.expr("transform(t, x -> struct(x.digest AS digest, x.points AS points))").alias("turns"))


def rebuilt(conversations: DataFrame, stride: int = STRIDE, head: int = HEAD) -> DataFrame:
    """(conv_id, turns): the first h turns of a conversation come from the one its hundred begins
    with, where h is its id's crc32 modulo `head`; the rest are its own."""
    own = scratch.keep(turns_of(conversations), "turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % head).cast("int")
    heads = own.filter(F.col("conv_id") % stride == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, head - 1).alias("heads"))
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % stride).join(heads, "base", "left").withColumn("h", h)
    lent = F.expr("CASE WHEN heads IS NULL OR h = 0 THEN filter(turns, x -> false) ELSE slice(heads, 1, h) END")
    return joined.select("conv_id", F.concat(lent, F.expr("slice(turns, h + 1, size(turns) + 1)")).alias("turns"))


def _keys(batches):
    """(conv_id, key, points): the digests of a conversation's turns joined, and their code points."""
    for batch in batches:
        turns = batch.column(1)
        offsets, flat = turns.offsets.to_numpy(), turns.values
        digests, points = flat.field("digest").to_pylist(), flat.field("points")
        keys = [b"".join(digests[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(turns.offsets, points)],
                                         ["conv_id", "key", "points"])


def _block(batches):
    """One row of arrays for a sorted partition; the first row's LCP is not known here (0)."""
    ids, lengths, lcps, points, first, last = [], [], [], [], None, None
    for batch in batches:
        for conv, key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            lcps.append(0 if last is None else common(last, key))
            first, last = key if first is None else first, key
            ids.append(conv)
            lengths.append(len(key) // WIDTH)
            points.append(own.values.to_numpy())
    if ids:
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first], pa.binary()), pa.array([last], pa.binary()),
             one(lcps, pa.int32()), one(lengths, pa.int32()), one(ids, pa.int64()), one(np.concatenate(points), pa.int64())],
            ["block", "first", "last", *_BLOCK])


def common(a: bytes, b: bytes) -> int:
    """Digests that two keys begin with in common."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class Minima:
    """Sparse table of range minima."""

    def __init__(self, values: np.ndarray):
        self.n, self.levels = len(values), [values]
        while 2 << (len(self.levels) - 1) <= self.n:
            below, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(below[:-half], below[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a:b] (a largest number where it is empty)."""
        out = np.full(len(a), FAR)
        span = np.maximum(b - a, 1)
        for j, table in enumerate(self.levels):
            at = np.flatnonzero((b > a) & (span >> j == 1))
            out[at] = np.minimum(table[a[at]], table[b[at] - (1 << j)])
        return out

    def right(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """First place from `start` on whose value is below `depth`, else the length."""
        at = start.copy()
        for j in reversed(range(len(self.levels))):
            table, span = self.levels[j], 1 << j
            fits = at + span <= self.n
            ok = fits & (table[np.where(fits, at, 0)] >= depth)
            at[ok] += span
        return at

    def left(self, stop: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Last place before `stop` whose value is below `depth`, else -1."""
        at = stop.copy()
        for j in reversed(range(len(self.levels))):
            table, span = self.levels[j], 1 << j
            fits = at >= span
            ok = fits & (table[np.where(fits, at - span, 0)] >= depth)
            at[ok] -= span
        return at - 1


def records(values: np.ndarray) -> np.ndarray:
    """Places where the value falls below all before."""
    low = np.minimum.accumulate(values)
    return np.flatnonzero(np.concatenate([[True], low[1:] < low[:-1]]))


class Block:
    """One block: its rows' LCPs (the first one settled), lengths, ids and code points, and the nodes
    its rows own, in the order of a walk from the root: a subtree's nodes follow one another."""

    def __init__(self, lcps, lengths, ids, points, entering: int):
        self.lcp, self.length, self.ids, self.points = lcps.astype(np.int64), lengths.astype(np.int64), ids, points
        self.lcp[0] = entering
        self.n = len(self.ids)
        self.minima, self.least_id = Minima(self.lcp), Minima(self.ids)
        owned = self.length - self.lcp
        self.first = np.concatenate([[0], np.cumsum(owned)])
        self.row = np.repeat(np.arange(self.n), owned)
        self.depth = np.arange(len(self.row)) - self.first[self.row] + self.lcp[self.row] + 1
        turns = np.concatenate([[0], np.cumsum(self.length)])
        self.last_points = np.zeros(len(self.row), np.int64)
        deep = self.depth > 0
        self.last_points[deep] = points[turns[self.row[deep]] + self.depth[deep] - 1]
        #: rows equal to the row before
        self.copy = self.lcp == self.length

    def opening(self, depth: int, a: int, b: int) -> int:
        """Rows of a..b-1 whose LCP is `depth` and that go on below it."""
        return int(np.count_nonzero((self.lcp[a:b] == depth) & (self.length[a:b] > depth)))

    def summary(self) -> dict:
        """What other blocks need: totals, and (LCP, place, least id up to there) at the records."""
        up, down = records(self.lcp), self.n - 1 - records(self.lcp[::-1])
        least = int(self.lcp.min())
        return {"n": self.n, "least": least, "least_id": int(self.ids.min()), "openers": self.opening(least, 0, self.n), "copies": bool(self.copy[0]),
                "up": self.lcp[up], "up_at": up, "up_id": np.minimum.accumulate(self.ids)[up - 1],
                "up_openers": [self.opening(self.lcp[a], a, b) for a, b in zip(up.tolist(), [*up[1:].tolist(), self.n])],
                "down": self.lcp[down], "down_at": down, "down_id": np.minimum.accumulate(self.ids[::-1])[self.n - 1 - down]}

    def running(self, top: "Top", index: int) -> tuple[np.ndarray, np.ndarray]:
        """What the nodes before each node save, and the leaves among them."""
        first, last = top.extents(self, index, self.row, self.depth)
        saved = (last - first) * self.last_points
        leaf = top.children(self, index, self.row, self.depth) == 0
        return np.concatenate([[0], np.cumsum(saved)]), np.concatenate([[0], np.cumsum(leaf)])

    def sums(self, top: "Top", index: int) -> dict:
        """Both, in all and before each record."""
        saved, leaves = self.running(top, index)
        at = self.first[top.blocks[index]["up_at"]]
        return {"saved": int(saved[-1]), "leaves": int(leaves[-1]), "up_saved": saved[at], "up_leaves": leaves[at]}

    def nodes(self, top: "Top", index: int) -> tuple[dict, list[tuple]]:
        """The columns of this block's nodes, and (place, order, joined ids) of the copies that other
        blocks hold, too."""
        row, depth = self.row, self.depth
        first, last = top.extents(self, index, row, depth)
        saved, leaves = top.below(self, index, self.running(top, index))
        begin = int(top.starts[index])
        digests, pieces = [EMPTY] * len(row), []
        ends = np.append(np.flatnonzero(~self.copy), self.n)  # where another sequence begins
        goes_on = index + 1 < len(top.blocks) and top.blocks[index + 1]["copies"]
        if self.copy[0]:
            place = top.before(index, self.lcp[:1])[0][2]
            pieces.append((place, begin, joined(self.ids[:ends[0]])))
        whole = np.flatnonzero(self.length[row] == depth)
        for j, r, stop in zip(whole.tolist(), row[whole].tolist(), ends[np.searchsorted(ends, row[whole], "right")].tolist()):
            if stop == self.n and goes_on:
                digests[j] = None
                pieces.append((begin + r, begin + r, joined(self.ids[r:])))
            else:
                digests[j] = hashlib.sha256(joined(self.ids[r:stop])).hexdigest()
        parent = top.least_ids(self, index, row, np.maximum(depth - 1, 0))
        return {"place": first, "conv_id": top.least_ids(self, index, row, depth), "depth": depth,
                "parent_conv_id": pa.array(parent, pa.int64(), mask=depth == 0), "n_convs": last - first + 1,
                "n_children": top.children(self, index, row, depth), "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(digests, pa.string())}, pieces


EMPTY = hashlib.sha256(b"").hexdigest()


def joined(ids: np.ndarray) -> bytes:
    return b",".join(b"%d" % i for i in ids.tolist())


class Top:
    """The blocks' summaries, with a sparse table over the blocks' least LCPs."""

    def __init__(self, blocks: list[dict], sums: list[dict] | None = None):
        self.blocks = blocks
        self.starts = np.concatenate([[0], np.cumsum([b["n"] for b in blocks])])
        self.least = np.array([b["least"] for b in blocks])
        self.minima, self.ids = Minima(self.least), Minima(np.array([b["least_id"] for b in blocks]))
        order = np.lexsort((np.arange(len(blocks)), self.least))
        self.by_least = self.least[order] * len(blocks) + order
        self.open_sums = np.concatenate([[0], np.cumsum(np.array([b["openers"] for b in blocks])[order])])
        self.sums = sums
        if sums is not None:
            self.saved = np.concatenate([[0], np.cumsum([s["saved"] for s in sums])])
            self.leaves = np.concatenate([[0], np.cumsum([s["leaves"] for s in sums])])

    def beyond(self, block: int, depths: np.ndarray):
        """(block, record, place) behind the right end of prefixes that leave `block`: the first place
        of the order whose LCP is below the depth; block -1 where there is none."""
        other = self.minima.right(np.full(len(depths), block + 1), depths)
        found = []
        for b, d in zip(other.tolist(), depths.tolist()):
            if b == len(self.blocks):
                found.append((-1, 0, int(self.starts[-1])))
            else:
                k = int(np.argmax(self.blocks[b]["up"] < d))
                found.append((b, k, int(self.starts[b] + self.blocks[b]["up_at"][k])))
        return found

    def before(self, block: int, depths: np.ndarray):
        """(block, record, place) of the left end of prefixes that came into `block`."""
        other = self.minima.left(np.full(len(depths), block), depths)
        found = []
        for b, d in zip(other.tolist(), depths.tolist()):
            k = int(np.argmax(self.blocks[b]["down"] < d))
            found.append((b, k, int(self.starts[b] + self.blocks[b]["down_at"][k])))
        return found

    def extents(self, own: Block, block: int, rows: np.ndarray, depths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Global first and last row of the members of each candidate prefix (row, depth)."""
        right, left = own.minima.right(rows + 1, depths), own.minima.left(rows + 1, depths)
        first, last = left + self.starts[block], right + self.starts[block] - 1
        for ends, out, ask, shift in ((right == own.n, last, self.beyond, -1), (left < 0, first, self.before, 0)):
            values, back = np.unique(depths[ends], return_inverse=True)
            if len(values):
                out[ends] = np.array([place for _, _, place in ask(block, values)])[back] + shift
        return first, last

    def least_ids(self, own: Block, block: int, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Smallest id of the members of each candidate prefix."""
        right, left = own.minima.right(rows + 1, depths), own.minima.left(rows + 1, depths)
        out = own.least_id.least(np.maximum(left, 0), right)
        for ends, ask, sign in ((right == own.n, self.beyond, 1), (left < 0, self.before, -1)):
            values, back = np.unique(depths[ends], return_inverse=True)
            if not len(values):
                continue
            found = ask(block, values)
            other = np.array([b if b >= 0 else len(self.blocks) for b, _, _ in found])
            span = (np.full(len(values), block + 1), other) if sign > 0 else (other + 1, np.full(len(values), block))
            best = self.ids.least(*span)  # of the blocks in between
            for i, (b, k, _) in enumerate(found):
                if sign > 0 and b >= 0 and self.blocks[b]["up_at"][k] > 0:
                    best[i] = min(best[i], self.blocks[b]["up_id"][k])
                elif sign < 0:
                    best[i] = min(best[i], self.blocks[b]["down_id"][k])
            out[ends] = np.minimum(out[ends], best[back])
        return out

    def children(self, own: Block, block: int, rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """Children of the nodes that `rows` own at `depths`: a row opens a child where it shares
        exactly the node with the row before and goes on; the owner itself opens one if it goes on."""
        right = own.minima.right(rows + 1, depths)
        going = np.flatnonzero(own.length > own.lcp)
        keys = np.sort(own.lcp[going] * (own.n + 1) + going)
        count = np.searchsorted(keys, depths * (own.n + 1) + right) - np.searchsorted(keys, depths * (own.n + 1) + rows + 1)
        count = count + (own.length[rows] > depths)
        ends = right == own.n
        values, back = np.unique(depths[ends], return_inverse=True)
        if len(values):
            more, m = [], len(self.blocks)
            for d, (b, k, _) in zip(values.tolist(), self.beyond(block, values)):
                a, z = np.searchsorted(self.by_least, [d * m + block + 1, d * m + (b if b >= 0 else m)])
                part = self.blocks[b]["up_openers"][k - 1] if b >= 0 and k > 0 and self.blocks[b]["up"][k - 1] == d else 0
                more.append(int(self.open_sums[z] - self.open_sums[a]) + part)
            count[ends] += np.array(more)[back]
        return count

    def below(self, own: Block, block: int, running: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(what the subtree saves, its leaves) of every node that the block's rows own."""
        right = own.minima.right(own.row + 1, own.depth)
        out = [r[own.first[right]] - r[:-1] for r in running]
        ends = right == own.n
        values, back = np.unique(own.depth[ends], return_inverse=True)
        if len(values):
            more = []
            for b, k, _ in self.beyond(block, values):
                stop = b if b >= 0 else len(self.blocks)
                part = (self.sums[b]["up_saved"][k], self.sums[b]["up_leaves"][k]) if b >= 0 else (0, 0)
                more.append((self.saved[stop] - self.saved[block + 1] + part[0], self.leaves[stop] - self.leaves[block + 1] + part[1]))
            for o, m in zip(out, np.array(more, np.int64).T):
                o[ends] += m[back]
        return out[0], out[1]


def _blocks(batches, settled):
    """(index, Block) of block rows (block, lcps, lengths, ids, points)."""
    for batch in batches:
        for r in range(batch.num_rows):
            index, entering = settled[batch.column(0)[r].as_py()]
            yield index, Block(*(batch.column(c)[r].values.to_numpy(zero_copy_only=False) for c in range(1, 5)), entering)


def _told(settled, top):
    def run(batches):
        for index, own in _blocks(batches, settled.value):
            fact = own.summary() if top is None else own.sums(top.value, index)
            yield pa.RecordBatch.from_arrays([pa.array([index], pa.int32()), pa.array([pickle.dumps(fact)], pa.binary())], ["at", "fact"])
    return run


def _gathered(blocks: DataFrame, settled, top=None) -> list[dict]:
    """One small record of each block, in order: at most `BLOCKS` of them."""
    rows = blocks.mapInArrow(_told(settled, top), "at int, fact binary").collect()
    return [pickle.loads(r.fact) for r in sorted(rows, key=lambda r: r["at"])]


def _edges(batches):
    for batch in batches:
        lcps = [-1 if last is None else common(last, first) for first, last in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lcps, pa.int32())], ["block", "lcp"])


_COLUMNS = ["place", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
_SCHEMA = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in _COLUMNS) + ", sequence bigint, piece binary"


def _nodes(settled, top):
    """The nodes of each block (piece null), then its pieces: place, sequence and piece alone."""
    def run(batches):
        for index, own in _blocks(batches, settled.value):
            columns, pieces = own.nodes(top.value, index)
            n = len(own.row)
            whole = pa.RecordBatch.from_arrays([*(pa.array(columns[c]) for c in _COLUMNS), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                                               [*_COLUMNS, "sequence", "piece"])
            for at in range(0, n, SENT):
                yield whole.slice(at, SENT)
            for place, sequence, piece in pieces:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place], pa.int64()), *(pa.nulls(1, pa.int64()) for _ in _COLUMNS[1:-1]), pa.nulls(1, pa.string()),
                     pa.array([sequence], pa.int64()), pa.array([piece], pa.binary())], [*_COLUMNS, "sequence", "piece"])
    return run


def _digested(batches):
    """(place, digest) of pieces in order, one at a time."""
    place, state = None, None
    for batch in batches:
        for at, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            if at != place:
                if state is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([state.hexdigest()])], ["at", "digest"])
                place, state = at, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_buffer())
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([state.hexdigest()])], ["at", "digest"])


def nodes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, place)
    of every node of the trie of (conv_id, turns); place is its first member's row in the order."""
    spark = conversations.sparkSession
    keyed = scratch.keep(conversations.select("conv_id", "turns").mapInArrow(_keys, "conv_id bigint, key binary, points array<bigint>"), "keyed")
    turns = keyed.agg(F.sum(F.greatest(F.size("points"), F.lit(1)))).first()[0] or 0
    parts = max(1, min(BLOCKS, -(-turns // block)))
    blocks = scratch.keep(keyed.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(
        _block, "block int, first binary, last binary, lcps array<int>, lengths array<int>, ids array<bigint>, points array<bigint>"), "blocks")
    edges = blocks.select("block", "first", F.lag("last").over(Window.orderBy("block")).alias("last")).mapInArrow(_edges, "block int, lcp int").collect()
    settled = spark.sparkContext.broadcast({b: (i, lcp) for i, (b, lcp) in enumerate(sorted(map(tuple, edges)))})
    rows = blocks.select("block", *_BLOCK)
    summaries = _gathered(rows, settled)
    if not summaries:
        return spark.createDataFrame([], _SCHEMA).select(*_COLUMNS[1:], "place")
    top = Top(summaries)
    top = spark.sparkContext.broadcast(Top(summaries, _gathered(rows, settled, spark.sparkContext.broadcast(top))))
    found = scratch.keep(rows.mapInArrow(_nodes(settled, top), _SCHEMA), "nodes")
    pieces = found.filter("piece is not null").select("place", "sequence", "piece").repartition("place").sortWithinPartitions("place", "sequence")
    digests = pieces.select("place", "piece").mapInArrow(_digested, "at bigint, digest string")
    own = found.filter("piece is null")
    open_ = own.filter("ends_sha256 is null").join(digests, F.col("place") == F.col("at")).withColumn("ends_sha256", F.col("digest"))
    return own.filter("ends_sha256 is not null").select(*_COLUMNS[1:], "place").unionByName(open_.select(*_COLUMNS[1:], "place"))
