"""Spelling variants: words one edit apart, found through a dictionary of trie-node pairs.

The vocabulary stands in two tries, of the words and of the reversed words, whose nodes are numbered.
A node stands for one prefix (or suffix), so a pair of numbers (prefix node, suffix node) stands for a
word with a place between the two:

* with one position skipped, words of one pair differ in that position alone;
* a word cut between two positions, and a longer one with one position skipped, are of one pair when
  the longer one has that code point more.  Skipping any of several equal neighbours gives the same
  word, so only the first of such a run counts: each pair of words meets exactly once.

Pairs of words are never formed: each word takes from a group of one key how many partners it has
and the best of them.  A group holds at most one word per code point of the alphabet (90) and one cut
word, whatever the data.

Numbering is one range-partitioned sort per trie: a word owns the nodes that it does not share with
the word before, and they count on in sorted order.  A partition is one row of at most about `BLOCK`
words; where one goes on with the prefix of another, the driver settles the shared nodes from the
last word of each.  There are at most `BLOCKS` partitions.

Defined results: a null or empty text has no words; a null id deletes no code point; rows that repeat an
id or text count each; ties between forms go to the smallest word in code-point order; texts of any
length are read in pieces; a word of L code points takes 2 L + 1 short rows, so very long words cost
in proportion; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirepost.llm import scratch

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: a form is at least this many times as frequent as the word
RATIO = 5
DELETED = 199
#: bytes of a text read at once, and of distinct words a task counts before it sends them on
PIECE, HELD = 1 << 20, 1 << 25
#: words of a block of a trie, and blocks at most
BLOCK, BLOCKS = 1 << 14, 1 << 16
#: numbers of entries sent on together
SENT = 1 << 17
#: chains of forms grow in frequency by `RATIO`, so doubling settles them sooner
ROUNDS = 8

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: U+00C0 to U+00FF are the two-byte sequences C3 80 to C3 BF
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
_GAP = re.compile(rb"[\x00-\x60\x7b-\x7f]")


def runs(text: bytes):
    """Lower-cased runs of a UTF-8 text with their counts, piece by piece."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield Counter(_RUN.findall(text[at:end].translate(_LOWER)))
        at = end


def damaged(run: bytes, h: int) -> bytes:
    """`run` without its code point h % length, if 199 divides h."""
    if h % DELETED:
        return run
    points = run.decode()
    cut = h % len(points)
    return (points[:cut] + points[cut + 1:]).encode()


def _counted(batches):
    held, size = Counter(), 0

    def sent():
        words = [w.decode() for w in held]
        found = [(w, n) for w, n in zip(words, held.values()) if len(w) >= LEAST_LENGTH]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            start = None if i is None else zlib.crc32(b"%s:" % str(i).encode())
            for counted in runs(text.as_py()):
                for run, n in counted.items():
                    if len(run) >= LEAST_LENGTH:
                        word = run if start is None else damaged(run, zlib.crc32(run, start))
                        if word not in held:
                            size += len(word) + 100
                        held[word] += n
                if size > HELD:
                    yield sent()
                    held, size = Counter(), 0
    if held:
        yield sent()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur `least` times or more, counted in their tasks first."""
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    counted = texts.mapInArrow(_counted, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def common(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def walk(keys):
    """(key, node numbers of its prefixes by length, nodes so far) of sorted keys, as if they were the whole trie."""
    nodes, total, last = [], 0, None
    for key in keys:
        kept = 0 if last is None else common(last, key) + 1
        nodes = nodes[:kept] + list(range(total, total + len(key) + 1 - kept))
        total += len(key) + 1 - kept
        last = key
        yield key, nodes, total


def _block(batches):
    keys = [k for batch in batches for k in batch.column(0).to_pylist()]
    if not keys:
        return
    for _, tail, owned in walk(keys):
        pass
    yield pa.RecordBatch.from_arrays(
        [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([keys[0]]), pa.array([keys[-1]]), pa.array([owned], pa.int64()),
         pa.array([tail], pa.list_(pa.int64())), pa.array([keys], pa.list_(pa.string()))], ["block", "first", "last", "owned", "tail", "keys"])


def settle(edges) -> dict:
    """(number of the block's first own node, numbers of the nodes that go on from the block before)
    by block, from (block, first, last, owned, tail) in order."""
    found, start, last, numbers = {}, 0, None, []
    for block, first, final, owned, tail in edges:
        entering = numbers[:common(last, first) + 1] if last is not None else []
        found[block] = (start, entering)
        numbers = [entering[x] if x < len(entering) else start + x - len(entering) for x in tail]
        start, last = start + owned - len(entering), final
    return found


def _numbered(settled):
    def run(batches):
        for batch in batches:
            for block, keys in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start, entering = settled.value[block]
                enter = np.array(entering or [0], np.int64)
                held, size = [], 0
                for key, nodes, _ in walk(keys):
                    local = np.array(nodes, np.int64)
                    held.append((key, np.where(local < len(entering), enter[np.minimum(local, len(enter) - 1)], start + local - len(entering))))
                    size += len(nodes)
                    if size > SENT:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)
    return run


def _rows(held) -> pa.RecordBatch:
    keys, nodes = zip(*held)
    bounds = np.cumsum([0, *map(len, nodes)]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(nodes)))], ["key", "nodes"])


def numbered(keys: DataFrame, count: int, block: int = BLOCK) -> DataFrame:
    """(key, nodes): numbers of the trie nodes of every prefix, the empty one first, of `count`
    distinct keys.  Numbers of whole keys ascend with the keys."""
    parts = max(1, min(BLOCKS, -(-count // block)))
    name = keys.columns[0]
    blocks = scratch.keep(keys.select(F.col(name).alias("key")).repartitionByRange(parts, "key").sortWithinPartitions("key")
                          .mapInArrow(_block, "block int, first string, last string, owned bigint, tail array<bigint>, keys array<string>"), "trie")
    edges = [tuple(r) for r in blocks.select("block", "first", "last", "owned", "tail").orderBy("block").collect()]
    settled = keys.sparkSession.sparkContext.broadcast(settle(edges))
    return blocks.select("block", "keys").mapInArrow(_numbered(settled), "key string, nodes array<bigint>")


def _entries(batches):
    """(p, s, kind, id, n): kind 0 a skipped position, 1 the same where it is the first of equal
    neighbours, 2 a cut; id is the word's own node."""
    for batch in batches:
        held, size = [], 0
        for word, n, up, down in zip(*(batch.column(c) for c in range(4))):
            word, up, down = word.as_py(), up.values.to_numpy(), down.values.to_numpy()
            m = len(word)
            first = np.array([1] + [a != b for a, b in zip(word[1:], word)], np.int8)
            held.append((np.concatenate([up[:m], up]), np.concatenate([down[:m][::-1], down[::-1]]),
                         np.concatenate([first, np.full(m + 1, 2, np.int8)]), np.full(2 * m + 1, up[m]), np.full(2 * m + 1, n.as_py(), np.int64)))
            size += 2 * m + 1
            if size > SENT:
                yield _packed(held)
                held, size = [], 0
        if held:
            yield _packed(held)


def _packed(held) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], ["p", "s", "kind", "id", "n"])


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (word, n) of distinct words."""
    words = scratch.keep(words.select("word", "n"), "words")
    count = words.count()
    up = numbered(words.select("word"), count, block).select(F.col("key").alias("word"), F.col("nodes").alias("up"))
    down = numbered(words.select(F.reverse("word").alias("word")), count, block).select(F.reverse("key").alias("word"), F.col("nodes").alias("down"))
    tries = scratch.keep(words.join(up, "word").join(down, "word").select("word", "n", "up", "down"), "tries")
    named = tries.select(F.element_at("up", -1).alias("id"), "word", "n")

    entries = tries.mapInArrow(_entries, "p bigint, s bigint, kind byte, id bigint, n bigint")
    groups = entries.groupBy("p", "s").agg(F.collect_list(F.struct("n", "id", "kind")).alias("m")).filter("size(m) > 1")
    met = groups.select(F.expr("""inline(transform(transform(m, x -> struct(x.id AS id, filter(m, y -> y.id <> x.id
        AND ((x.kind < 2 AND y.kind < 2) OR (x.kind = 1 AND y.kind = 2) OR (x.kind = 2 AND y.kind = 1))) AS near)),
        x -> struct(x.id AS id, cast(size(x.near) AS bigint) AS n_near, array_max(transform(x.near, y -> struct(y.n AS n, -y.id AS id))) AS best)))"""))
    near = met.filter("n_near > 0").groupBy("id").agg(F.sum("n_near").alias("n_near"), F.max("best").alias("best"))
    judged = scratch.keep(named.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("best.n") >= F.col("n") * ratio, -F.col("best.id")).alias("to")), "judged")

    links = judged.filter("to is not null").select("id", "to")
    last = scratch.keep(links, "forms")
    for _ in range(ROUNDS):
        onward = last.select(F.col("id").alias("to"), F.col("to").alias("next"))
        step = scratch.keep(last.join(onward, "to", "left").select("id", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "forms")
        last = step.select("id", "to")
        if step.filter("moved").isEmpty():
            break
    else:
        raise RuntimeError("forms did not settle")
    ends = links.withColumnRenamed("to", "form_id").join(last.withColumnRenamed("to", "root_id"), "id")
    forms = ends.join(judged.select(F.col("id").alias("form_id"), F.col("word").alias("form"), F.col("n").alias("form_n")), "form_id") \
        .join(judged.select(F.col("id").alias("root_id"), F.col("word").alias("root")), "root_id").select("id", "form", "form_n", "root")
    return judged.join(forms, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
