"""Small tables with every awkward row, and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, rep string, id string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6))) for _ in range(n))


def documents() -> list[tuple]:
    base, other, passage = prose(1, 120), prose(2, 90), prose(3, 60)
    edited = base.split()
    edited[60] = "changed"
    texts = [
        base, base, base.replace(" ", "\n\t", 3), base.upper(), " ".join(edited), other, None, "", " \t\n", "one two", "one  two",
        prose(4, 80) + " " + passage + " " + prose(5, 40), passage + " " + prose(6, 50), prose(7, 30) + "\n" + passage,
        "be " * 200, "x" * 5000, prose(8, 3000), prose(8, 3000) + " end", "Äöü ß – 漢字 " * 20, "a b c " * 15,
        "line of five good words\n" * 12, "### *** $$$ " * 30, "12345 67890 -- !!", " lead and trail ",
        other + " " + other,
    ]
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], None if t is None else len(t), i, "r", "x") for i, t in enumerate(texts)]
    rows.append(rows[5])                                  # a repeated row
    rows.append((None, other, "en", "a", 1, 1, None, None))  # a null id
    return rows


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def exact_groups(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    group = defaultdict(list)
    for r, n in zip(rows, norm):
        group[n].append(r[0])
    out = []
    for r, n in zip(rows, norm):
        ids = [i for i in group[n] if i is not None]
        keep = min(ids) if ids else None
        out.append((r[0], keep, len(group[n]), r[0] == keep, sha(n)))
    return out


def near_groups(rows):
    sets = []
    for r in rows:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(r[1])]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][0] is None or rows[b][0] is None or not x or not y:
                continue
            if 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(rows[a][0]), find(rows[b][0])
                root[max(p, q)] = min(p, q)
    return [(r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets)]


def stripped(rows, window=35):
    seen = Counter()
    every = [words(r[1]) for r in rows]
    for w in every:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, every):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def base_counts(rows):
    out = []
    for r in rows:
        text = r[1] or ""
        w = words(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        n = len(w)
        out.append((r[0], n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
                    n < 50 or 100 * len(covered) > 50 * n))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)
