import random

import numpy as np
import pytest

from llm import cases
from wirepost.llm import minhash, scratch, words


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    scratch.ship(spark)


def plain(rows, k=2):
    """All pairs of sets; an id is one node whatever its texts."""
    sets = []
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in cases.words(r[1])]
        sets.append({tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    own = {}
    for i, r in enumerate(rows):
        if r[0] is not None and sets[i]:
            own[r[0]] = min(own.get(r[0], r[0]), least[find(i)])
    return [(r[0], len(s), None if r[0] is None else own.get(r[0], r[0]), r[0] is None or own.get(r[0], r[0]) == r[0]) for r, s in zip(rows, sets)]


def edited(base, n, r):
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.random()}"
    return " ".join(w)


def test_near_classes_match_plain_python(spark):
    rows = cases.documents()
    assert cases.ordered(minhash.near_classes(cases.frame(spark, rows)).collect()) == cases.ordered(plain(rows))


@pytest.mark.parametrize("seed", [3, 4])
def test_groups_that_hubs_alone_do_not_join(spark, seed):
    """Copies edited on both sides of the threshold, chains, and texts that share long passages."""
    r = random.Random(seed)
    base, passage = cases.prose(50 + seed, 150).split(), cases.prose(51 + seed, 100)
    rows = [(1000 - i, edited(base, r.randint(0, 30), r)) for i in range(120)]
    rows += [(2000 + i, passage + " " + cases.prose(100 + i, r.randint(5, 40))) for i in range(60)]
    chain = cases.prose(60 + seed, 150).split()
    for i in range(40):
        chain[r.randrange(150)] = f"c{i}"
        rows.append((4000 + i, " ".join(chain)))
    few = [f"w{i}" for i in range(40)]
    rows += [(5000 + i, " ".join(r.sample(few, 38) if r.random() < 0.3 else few[: r.randint(3, 40)])) for i in range(80)]
    rows += [(6000 + i, "same text here") for i in range(50)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cases.ordered(minhash.near_classes(docs).collect()) == cases.ordered(plain(rows))


def test_different_texts_of_one_id_stay_different_sets(spark):
    a, b, c = cases.prose(1, 60), cases.prose(2, 60), cases.prose(3, 60)
    rows = [(1, a), (1, b), (2, b + " end"), (3, c), (4, a + " end"), (1, a), (5, c + " end"), (0, c), (0, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert cases.ordered(minhash.near_classes(docs).collect()) == cases.ordered(plain(rows))


def test_half_of_all_rows_in_one_group(spark):
    r = random.Random(9)
    base = cases.prose(70, 100).split()
    rows = [(i, edited(base, r.randint(0, 2), r)) for i in range(300)] + [(1000 + i, cases.prose(500 + i, 30)) for i in range(300)]
    got = {g.doc_id: g for g in minhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].component_id == 0 for i in range(300)) and all(got[i].kept for i in range(1000, 1300))


def test_coordinates_are_shifts_of_one_table():
    tokens = words.mix(np.arange(50, dtype=np.uint64))
    table = np.random.Generator(np.random.PCG64(minhash.SEED)).permutation(minhash.SPACE)
    assert sorted(set(table.tolist())) == list(range(minhash.SPACE))
    places = (words.mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(minhash.SPACE)).astype(np.int64)
    want = [min(table[(p + k) % minhash.SPACE] for p in places) for k in range(minhash.BANDS * minhash.ROWS)]
    assert minhash.signature(tokens).tolist() == want


def test_shared_coordinates_estimate_the_similarity():
    r = np.random.default_rng(1)
    got = []
    for _ in range(200):
        tokens = r.integers(0, 1 << 63, 120).astype(np.uint64)
        a, b = tokens[:110], tokens[10:]  # 100 of 120 shared
        got.append(np.mean(minhash.signature(a) == minhash.signature(b)))
    assert abs(np.mean(got) - 100 / 120) < 0.01


def test_empty_table(spark):
    assert minhash.near_classes(cases.frame(spark, [])).count() == 0
