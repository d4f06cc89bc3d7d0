import hashlib
import random

import numpy as np
import pytest

from rollstore.llm import bytebpe, token_counts
from rollstore.llm.common import Scratch

PIECES = [
    "a", "b", "the", "'s", "'", " ", "  ", "\n", "\t", "1", "23", "!", "%%%", "é", "ß", "日", "本", " ", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>", "İ", "Σ", "ŉ", "😀", "é", "\x00", "\x1c", "²", "ª", "aaaa", "     ", "''''", "\r\n", "'ll", "'LL",
]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES if k % 2 else PIECES[:15]) for _ in range(rng.randrange(40))) for k in range(n)]


@pytest.fixture(scope="module")
def coder():
    return bytebpe.coder(bytebpe.vocabulary("byte_bpe_50k.json"))


def packed(coder, text):
    return np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def tree(coder, text, leaf):
    leaves = coder.cut(text, leaf)
    assert "".join(x for x, _ in leaves) == text
    return coder.tree([(coder.encode_leaf(x, j or (i + 1 < len(leaves) and leaves[i + 1][1])), j) for i, (x, j) in enumerate(leaves)])


def test_library_agrees(coder, monkeypatch):
    for k, t in enumerate(mixed(1500, 5)):
        ids = packed(coder, t)
        assert coder.encode(t) == ids
        monkeypatch.setattr(bytebpe, "WINDOW", (1, 2, 8)[k % 3])
        assert tree(coder, t, (1, 2, 3, 5, 8)[k % 5]) == ids
        assert coder.decode(ids) == coder.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def test_unsplit_text(coder):
    rng = random.Random(8)
    for alphabet in ("ab", "abcdefgh", "é日x", " ", "1234567890", "!?"):
        t = "".join(rng.choice(alphabet) for _ in range(3000))
        assert tree(coder, t, 100) == packed(coder, t)


def test_documents(docs, texts, empty, coder):
    extra = docs.sparkSession.createDataFrame([(1000, "<|endoftext|>" + "ab" * 500 + "\n" * 300), (1001, "ab" * 500), (1001, "ab" * 500)], "doc_id long, text string")
    src = docs.select("doc_id", "text").unionByName(extra)
    expected = []
    for r in src.collect():
        ids = packed(coder, r.text or "")
        expected.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    for leaf in (bytebpe.LEAF, 64):
        assert sorted(map(tuple, bytebpe.encode(src, bytebpe.vocabulary("byte_bpe_50k.json"), leaf=leaf).collect())) == sorted(expected)
    assert bytebpe.encode(empty, bytebpe.vocabulary("byte_bpe_50k.json")).count() == 0
    kept = bytebpe.encode(docs, bytebpe.vocabulary("byte_bpe_50k.json"), keep_ids=True, keep_text=True, leaf=64)
    assert {r.doc_id: r.decoded for r in kept.collect()} == {i: t or "" for i, t in texts}


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts(name):
    c = token_counts.Counter(bytebpe.vocabulary(name))
    some = mixed(1500, 6)
    assert c.count(some) == c.whole(some)


def test_cache(docs, texts, empty, spark):
    path = bytebpe.vocabulary("word_bpe_49k.json")
    cache = Scratch(spark, "cache").path("tokens")
    whole = token_counts.Counter(path).whole
    expected = sorted((i, len((t or "").encode()), n, n > 10) for (i, t), n in zip(texts, whole([t or "" for _, t in texts]), strict=True))
    half = docs.where("doc_id < 20")
    assert token_counts.count_tokens(half, path, cache, limit=10).count() == 20
    first = spark.read.parquet(cache).count()
    assert first == len({t or "" for i, t in texts if i < 20})
    for _ in range(2):
        assert sorted(map(tuple, token_counts.count_tokens(docs, path, cache, limit=10).collect())) == expected
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in texts})
    assert token_counts.count_tokens(empty, path, cache).count() == 0
