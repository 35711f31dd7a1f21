import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from llm import cases
from wirepost.llm import conversation_trie as trie
from wirepost.llm import scratch

SCHEMA = "conv_id long, turn long, role string, text string, place long, extra string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    scratch.ship(spark)


def rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def plain(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(int)
    for x in members:
        if x:
            children[x[:-1]] += 1
    out = []
    for x, ms in members.items():
        under = [y for y in members if y[:len(x)] == x]
        saved = sum((len(members[y]) - 1) * len(y[-1][1]) for y in under if y)
        ends = ",".join(map(str, sorted(c for c in ms if len(convs[c]) == len(x))))
        out.append((min(ms), len(x), min(members[x[:-1]]) if x else None, len(ms), children[x], sum(not children[y] for y in under), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return out


def awkward(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        conv = c if c % 7 else 100 * c
        for turn in range(r.choice([1, 1, 2, 3, 3, 5, 8])):
            rows.append((conv, turn, r.choice(["user", "bot", None]) if turn > 2 else "user", r.choice(["a", "b", "äö" * 3, "", None])))
    rows += [(1, None, "sys", "first"), (5000, 3, None, None), (None, 1, "user", "lost"), (7000, 0, "user", "x" * 100000), (-250, 1, "user", "a"), (-201, 1, "user", "b")]
    for c in range(300, 340):  # copies, some of them longer
        rows += [(c, t, "user", "same") for t in range(9 if c % 10 == 0 else 6)]
    r.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("block", [1 << 15, 40, 7])
def test_nodes_match_plain_python(spark, block):
    rows = awkward(1, 90)
    got = trie.nodes(trie.rebuilt(frame(spark, rows)), block).select(COLUMNS).collect()
    assert cases.ordered(got) == cases.ordered(plain(rebuilt(rows)))


def test_blocks_inside_one_group_of_copies(spark):
    """Half of all conversations are equal, so whole blocks lie inside one node's interval."""
    rows = [(c, t, "user", "same") for c in range(1000, 1100) for t in range(6)]
    rows += [(c, t, "user", f"{c % 5}{t}") for c in range(100) for t in range(1 + c % 8)]
    got = trie.nodes(trie.rebuilt(frame(spark, rows)), 30).select(COLUMNS).collect()
    assert cases.ordered(got) == cases.ordered(plain(rebuilt(rows)))


def test_repeated_turn_numbers_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, 1, "user", t) for t in "abcdef"] + [(2, 1, "user", t) for t in "fedcba"]
    got = [trie.nodes(trie.turns_of(frame(spark, x))).select(COLUMNS).collect() for x in (rows, rows[::-1])]
    assert cases.ordered(got[0]) == cases.ordered(got[1]) and {r.n_convs for r in got[0]} == {2}


def test_empty_table(spark):
    got = trie.nodes(trie.rebuilt(frame(spark, [])))
    assert got.columns[:8] == COLUMNS and got.count() == 0


def test_minima():
    r = np.random.default_rng(4)
    for n in (1, 2, 3, 17, 64):
        values = r.integers(0, 5, n)
        table = trie.Minima(values)
        for a in range(n):
            for d in range(6):
                right = next((q for q in range(a, n) if values[q] < d), n)
                left = next((q for q in range(a, -1, -1) if values[q] < d), -1)
                assert table.right(np.array([a]), np.array([d]))[0] == right
                assert table.left(np.array([a + 1]), np.array([d]))[0] == left
            for b in range(a + 1, n + 1):
                assert table.least(np.array([a]), np.array([b]))[0] == values[a:b].min()
