import random

import pytest

from llm import cases
from wirepost.llm import components, exact_dedup, ngram_join, scratch, substring_dedup, words
from wirepost.llm.exact_dedup import CHUNK, combine, fingerprint, normal


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    scratch.ship(spark)


def test_exact_groups_match_plain_python(spark):
    got = exact_dedup.exact_groups(cases.frame(spark)).collect()
    assert cases.ordered(got) == cases.ordered(cases.exact_groups(cases.documents()))


def test_huge_texts_take_the_parallel_way_with_the_same_result(spark):
    got = exact_dedup.exact_groups(cases.frame(spark), huge=40).collect()
    assert cases.ordered(got) == cases.ordered(cases.exact_groups(cases.documents()))


def test_unequal_texts_with_one_fingerprint_are_split(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "prints_of", lambda docs, *a, real=exact_dedup.prints_of: real(docs, *a).selectExpr(
        "id", "0L fp1", "0L fp2", "0L length", "text_sha256"))
    monkeypatch.setattr(exact_dedup, "collisions", lambda docs, prints, *a: prints.select("fp1", "fp2", "length").distinct())
    got = exact_dedup.exact_groups(cases.frame(spark)).collect()
    assert cases.ordered(got) == cases.ordered(cases.exact_groups(cases.documents()))


def test_collisions_compare_contents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a  b"), (3, "a c")], "doc_id long, text string")
    prints = exact_dedup.prints_of(docs, "doc_id", "text", 1 << 20)
    assert exact_dedup.collisions(docs, prints, "doc_id", "text").count() == 0


def test_fingerprints_compose():
    r = random.Random(3)
    for n in (0, 1, 5, CHUNK - 1, CHUNK, CHUNK + 1, 3 * CHUNK + 7):
        text = r.randbytes(n)
        for cut in {0, n // 3, n}:
            a, b = fingerprint(text[:cut]), fingerprint(text[cut:])
            assert (*combine(a[:2], b[:2], b[2]), n) == fingerprint(text)
    assert normal(b" a \n b") == b" a b" and normal(b"a\t") == b"a " and normal(b"\n ") == b" " and normal(b"") == b""


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    docs = cases.frame(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    want = {(k, s) for _, k, _, _, s in cases.exact_groups(cases.documents())}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k, _ in want)


def test_near_groups_match_plain_python(spark):
    rows = cases.documents()
    got = ngram_join.near_groups(cases.frame(spark, rows)).collect()
    assert cases.ordered(got) == cases.ordered(cases.near_groups(rows))


def edits(base, i, n, r):
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{i}x{r.random()}"
    return " ".join(w)


def test_near_groups_on_copies_that_only_meet_in_their_origin(spark, monkeypatch):
    """Copies of one text, each edited elsewhere, chains, and texts that share a frequent passage."""
    r = random.Random(5)
    base, passage = cases.prose(50, 150).split(), cases.prose(51, 60)
    rows = [(1000 - i, edits(base, i, 2, r)) for i in range(40)] + [(3, " ".join(base))]
    rows += [(2000 + i, passage + " " + cases.prose(100 + i, 40)) for i in range(30)]
    rows += [(3000 + i, passage + " " + cases.prose(200, 8 + i)) for i in range(12)]
    chain = cases.prose(60, 200).split()
    for i in range(15):
        chain[i * 13] = f"c{i}"
        rows.append((4000 + i, " ".join(chain)))
    r.shuffle(rows)
    want = cases.ordered(cases.near_groups(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cases.ordered(ngram_join.near_groups(docs).collect()) == want
    monkeypatch.setattr(ngram_join, "FREQUENT", 10 ** 9)  # plain hash order
    assert cases.ordered(ngram_join.near_groups(docs).collect()) == want


def word_sets(rows):
    """Components of texts as sets of words (k = 1), by comparing all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    sets = {i: set(t.split()) for i, t in rows}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [(i, len(sets[i]), find(i)) for i in sets]


def in_order(names, frequent=False):
    """`names` in the global order of one-word shingles: by hash, frequent ones of one count by signed hash."""
    import pyarrow as pa
    hashed = {n: int(next(ngram_join._sets(pa.array([n.encode()], pa.binary()), 1))[0]) for n in names}
    return sorted(names, key=lambda n: (hashed[n] + (1 << 63)) % (1 << 64) if frequent else hashed[n])


def test_links_past_a_popular_hub_that_is_not_complete(spark, monkeypatch):
    """a and b share 90 of 100 words; the hub h holds ten more of a's rare words, beyond its prefix."""
    monkeypatch.setattr(ngram_join, "POPULAR", 1)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rare = in_order([f"r{i}" for i in range(61)])
    x, others, ys = rare[0], rare[1:51], rare[51:]
    often = in_order([f"f{i}" for i in range(99)], frequent=True)
    own = lambda name: [f"{name}{i}" for i in range(100)]
    # p .. s give every word of `often` one count, c is the hub of the frequent ones in both prefixes
    a, b, h, c = [x, *ys, *often[:89]], [x, *often], [x, *ys, *others, *often[:39]], often[:60]
    rows = [(1, h), (2, a), (3, b), (4, c), (5, own("p") + often[39:]), (6, own("q") + often[60:]), (7, own("s") + often[89:])]
    rows = [(i, " ".join(w)) for i, w in rows]
    want = word_sets(rows)
    assert (3, 100, 2) in want
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert cases.ordered(ngram_join.near_groups(docs, k=1, fragments=1).collect()) == cases.ordered(want)


def test_popular_hubs_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "POPULAR", 1)
    r = random.Random(11)
    rows = []
    for g in range(12):
        base, odd = [f"g{g}w{i}" for i in range(60)], [f"g{g}o{i}" for i in range(40)]
        for i in range(12):
            out = r.randint(2, 16)
            rows.append((100 * g + i, " ".join(r.sample(base, 60 - out) + r.sample(odd, r.randint(0, out)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for fragments in (1, 4):
        assert cases.ordered(ngram_join.near_groups(docs, k=1, fragments=fragments).collect()) == cases.ordered(word_sets(rows))


def test_shared_prefix_shingles_bound_the_overlap(spark):
    """Every pair at the threshold passes the bound by counts; pairs that share one passage do not."""
    r = random.Random(5)
    rows, links = [], 0
    for _ in range(3000):
        n, shared = r.randint(1, 60), r.randint(1, 60)
        pool = r.sample(range(10_000), 200)
        both = pool[:shared]
        a, b = sorted(both + pool[60:60 + max(n - shared, 0)]), sorted(both + pool[120:120 + r.randint(0, 30)])
        m_a, m_b = (ngram_join.prefix_size(len(x), 80) for x in (a, b))
        met = sorted(set(a[:m_a]) & set(b[:m_b]))
        if met:
            linked = 100 * shared >= 80 * len(set(a) | set(b))
            links += linked
            rows.append((len(a), len(b), len(met), a.index(met[-1]), b.index(met[-1]), linked))
    pairs = spark.createDataFrame(rows, "n_a long, n_b long, lists long, last long, last_b long, linked boolean")
    passed = pairs.filter(ngram_join._may_reach_by_count(80))
    assert links > 100 and passed.filter("linked").count() == links
    assert passed.filter("not linked").count() < pairs.filter("not linked").count() / 2


def test_texts_that_share_a_passage_beside_links(spark):
    r = random.Random(8)
    passage, rows = [f"p{i}" for i in range(30)], []
    for g in range(15):
        base = [f"g{g}w{i}" for i in range(r.choice([10, 40, 90]))]
        for i in range(5):
            rows.append((10 * g + i, " ".join(passage + r.sample(base, len(base) - r.randint(0, len(base) // 8)) + [f"g{g}o{i}"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert cases.ordered(ngram_join.near_groups(docs, k=1).collect()) == cases.ordered(word_sets(rows))


def test_keep_first(spark):
    rows = cases.documents()
    got = [r.doc_id for r in ngram_join.keep_first(cases.frame(spark, rows)).collect()]
    want = {i for i, _, c in cases.near_groups(rows) if i is None or i == c}
    assert len(got) == len(set(got)) and set(got) == want


def test_prefix_is_long_enough():
    for n in range(1, 200):
        assert ngram_join.prefix_size(n, 80) == n - min(i for i in range(n + 1) if 100 * i >= 80 * n) + 1


def test_components(spark):
    r = random.Random(1)
    links = [(i, i + 1) for i in range(0, 60)] + [(r.randrange(100, 160), r.randrange(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    got = {x.id: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {i: i for p in links for i in p}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(i, i) == root[i] for i in root)


@pytest.mark.parametrize("window", [35, 5, 9])
def test_strip_repeats_matches_plain_python(spark, window):
    rows = cases.documents()
    got = substring_dedup.strip_repeats(cases.frame(spark, rows), window=window).collect()
    assert cases.ordered(got) == cases.ordered(cases.stripped(rows, window))


def test_strip_repeats_on_random_texts_with_unique_ids(spark):
    r = random.Random(9)
    pieces = [cases.prose(i, n) for i, n in enumerate([36, 40, 70, 34, 35, 110])]
    rows = [(i, " ".join(r.choice(pieces) if r.random() < 0.4 else cases.prose(1000 + 7 * i + j, r.randint(1, 60)) for j in range(4))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert cases.ordered(substring_dedup.strip_repeats(docs).collect()) == cases.ordered(cases.stripped(rows))


def test_long_texts_hash_like_short_ones(monkeypatch):
    import pyarrow as pa
    text = cases.prose(1, 4000).encode()
    whole = [h.tolist() for _, h, _ in words.hashed(pa.array([text], pa.binary()))]
    monkeypatch.setattr(words, "PIECE", 100)
    assert [h.tolist() for _, h, _ in words.hashed(pa.array([text], pa.binary()))] == whole
    assert len(whole[0]) == len(text.split())


def test_empty_tables(spark):
    docs = cases.frame(spark, [])
    assert exact_dedup.exact_groups(docs).count() == 0
    assert ngram_join.near_groups(docs).count() == 0
    assert substring_dedup.strip_repeats(docs).count() == 0
    assert exact_dedup.drop_copies(docs).columns == docs.columns
