import base64
import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from llm import cases
from wirepost.llm import bpe, scratch

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    scratch.ship(spark)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_random_texts(codec, reference):
    r = random.Random(2)
    alphabets = ["ab", "abcdefghij klm", "=-#", "éà ü\n", " \n\t a", "0123 x", "  b ", "漢字ab 🙂"]
    texts = ["".join(r.choice(r.choice(alphabets)) for _ in range(r.choice([0, 1, 3, 40, 300]))) for _ in range(1500)]
    texts += ["".join(r.choice(a) for _ in range(200)) for a in alphabets for _ in range(40)]
    texts += ["", " ", "  ", "a ", " a", "a  b", "a \n b", "x\n \ny", "<|endoftext|>", "a" * 3000, "=" * 2000, " " * 999]
    for text, packed in zip(texts, codec.encode(texts)):
        assert ids_of(packed) == reference.encode_ordinary(text), text
        assert codec.decode(packed) == text.encode()


def test_tree_and_boundary_windows(codec, reference):
    r = random.Random(4)
    v = codec.vocabulary
    for alphabet in ("ab", "=-", "the in", "aeiou", "0123456789"):
        for n in (33, 64, 200, 1000):
            data = "".join(r.choice(alphabet) for _ in range(n)).encode()
            whole = reference.encode_single_token(data) if data in v.ranks else reference._core_bpe.encode_single_piece(data)
            assert v.encode_piece(data) == whole == v.leaf(data)
            cut = r.randrange(n)
            assert v.join(v.leaf(data[:cut]) if cut else [], v.leaf(data[cut:])) == whole


def test_memory_may_begin_anew(codec, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 3)
    for text in ("one two three four", "five six one two", "three"):
        assert ids_of(codec.encode([text])[0]) == reference.encode_ordinary(text)


def test_table_round_trip(spark, reference):
    docs = cases.frame(spark)
    got = bpe.encode(docs, PATH, public_tokenizers.PATTERN, with_ids=True)
    want = []
    for i, text, *_ in cases.documents():
        ids = reference.encode_ordinary(text or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), cases.sha(text or ""), bytes(packed)))
    rows = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got.collect()]
    assert cases.ordered(rows) == cases.ordered(want)
    back = bpe.decode(got, PATH, public_tokenizers.PATTERN, ship=True)
    assert cases.ordered(back.collect()) == cases.ordered((i, t or "") for i, t, *_ in cases.documents())
    assert bpe.encode(cases.frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
