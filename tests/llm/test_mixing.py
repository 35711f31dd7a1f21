from collections import defaultdict

import pytest

from llm import cases
from wirepost.llm import mixing


def plain_targets(sizes: dict, weights=(3, 1, 2), share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        w = sum(weight[s] for s in open_)
        target = {s: most * sizes[s] for s in full} | {s: rest * weight[s] / w for s in open_}
        over = {s for s in open_ if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def rows_of(seed=0):
    return [(i, cases.prose(i, 20 + (i * 37) % 400), "en", f"s{(i * i) % 7}" if i % 11 else None, 1, 1, "r", "x") for i in range(seed, seed + 600)]


@pytest.mark.parametrize("rows", [rows_of(), cases.documents()])
def test_plan(spark, rows):
    got = mixing.plan(cases.frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append((len(cases.words(r[1])), r[3]))
    assert all((g["size"], g.source) in want[g.doc_id] for g in got)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for g in got:
        sizes[g.source] += g["size"]
        taken[g.source] += g.taken
        target[g.source] = g.target
        assert g.copies in (0, 1, 2) and g.taken == g.copies * g["size"] and 0 <= g.rate <= 2
    plain = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(plain[s], rel=1e-9)
        longest = max(g["size"] for g in got if g.source == s)
        assert abs(taken[s] - target[s]) <= longest
    assert all(g.source_size == sizes[g.source] for g in got)
    assert cases.ordered(mixing.plan(cases.frame(spark, rows).repartition(7)).collect()) == cases.ordered(got)


def test_rates_are_one_tilt_per_source(spark):
    """The odds of a document against the base odds are exp(tilt * size): log odds are linear in size."""
    import math
    got = mixing.plan(cases.frame(spark, rows_of())).collect()
    for s in {g.source for g in got}:
        pts = sorted({(g["size"], g.rate) for g in got if g.source == s and 0.01 < g.rate < 1.99})
        slopes = [(math.log(r / 2 / (1 - r / 2)) - math.log(3)) / z for z, r in pts]
        assert not slopes or max(slopes) - min(slopes) < 1e-3 * max(1e-3, max(map(abs, slopes))) + 1e-6
        expected = sum(g.rate * g["size"] for g in got if g.source == s)
        assert expected == pytest.approx(next(g.target for g in got if g.source == s), rel=1e-4)


@pytest.mark.parametrize("share", [1.4, 1.6])
def test_one_long_text_leaves_no_gap(spark, share):
    """The rounding takes the long text once or twice, not 1.3 or 1.7 times; short texts make up for it."""
    rows = [(i, "w " * (5 + i % 3), "en", "s", 1, 1, "r", "x") for i in range(1000)] + [(5000, "w " * 6000, "en", "s", 1, 1, "r", "x")]
    got = mixing.plan(cases.frame(spark, rows), share=share).collect()
    assert len(got) == 1001 and all(g.copies in (0, 1, 2) for g in got)
    assert abs(sum(g.taken for g in got) - got[0].target) <= 7


def test_hot_sizes_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBERED", 10)
    rows = [(i, "a b c d", "en", "s" if i % 3 else "t", 1, 1, "r", "x") for i in range(300)]
    got = mixing.plan(cases.frame(spark, rows)).collect()
    for s in "st":
        own = [g for g in got if g.source == s]
        assert abs(sum(g.taken for g in own) - own[0].target) <= 4


def test_mix_repeats_whole_rows(spark):
    rows = cases.documents()
    docs = cases.frame(spark, rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    count = defaultdict(int)
    for g in mixing.plan(docs).collect():
        count[g.doc_id] += g.copies
    found = defaultdict(int)
    for r in mixed.collect():
        found[r.doc_id] += 1
    assert {k: v for k, v in count.items() if v} == dict(found)


def test_empty(spark):
    assert mixing.plan(cases.frame(spark, [])).count() == 0
    assert mixing.mix(cases.frame(spark, [])).count() == 0
    assert mixing.plan(cases.frame(spark, [(1, None, None, None, None, 1, "r", "x")])).collect()[0].taken == 0
