import brute
import pytest

from rollstore.llm import blocks, exact_dedup, near_dedup, substring_dedup, suffix_dedup


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_exact(docs, texts, empty):
    names = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert rows(exact_dedup.exact_dedup(docs, digest_all=True), *names) == brute.exact(texts)
    assert rows(exact_dedup.exact_dedup(docs), *names[:4]) == [r[:4] for r in brute.exact(texts)]
    assert rows(exact_dedup.exact_dedup(empty), *names) == []


def test_exact_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect()), key=str)
    assert found == sorted([(1, 1, 3, True), (1, 1, 3, True), (None, 1, 3, False), (None, None, 1, True), (2, 2, 1, True)], key=str)


def test_exact_without_broadcast(docs, texts, monkeypatch):
    monkeypatch.setattr(exact_dedup, "small_side", lambda df, *a: df)
    assert rows(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept") == [r[:4] for r in brute.exact(texts)]


def test_exact_is_native(docs):
    plan = exact_dedup.exact_dedup(docs, digest_all=True)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_near(docs, texts, empty):
    names = ("doc_id", "n_shingles", "component_id", "kept")
    expected = brute.near(texts)
    assert sum(not r[3] for r in expected) > 10
    assert rows(near_dedup.near_dedup(docs), *names) == expected
    assert rows(near_dedup.near_dedup(empty), *names) == []


def test_near_repeated_rows_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(3, text), (3, text), (5, text), (None, text), (7, "z")], "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(df).collect()), key=str)
    assert found == sorted([(3, 3, True), (3, 3, True), (5, 3, False), (None, None, True), (7, 7, True)], key=str)


def test_near_chain_beyond_the_bucket_minimum(spark):
    """A link between two documents neither of which is near the smallest one of their bucket."""
    base = [f"w{i}" for i in range(300)]
    data = [(k, " ".join(base[k * 12 : k * 12 + 180])) for k in range(10)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(near_dedup.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept") == brute.near(data)


def test_near_group_without_links(spark):
    """Hundreds of texts made from one, most of them linked to few others: no link is lost, few pairs are made."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    data = [(0, " ".join(base))]
    for k in range(1, 300):
        gone = set(rng.sample(range(70), 2))
        data.append((k, " ".join(f"x{k}" if i in gone and k % 3 else w for i, w in enumerate(base) if not (i in gone and k % 3 == 0))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    expected = brute.near(data)
    assert 20 < sum(r[3] for r in expected) < 290
    assert rows(near_dedup.near_dedup(df), "doc_id", "n_shingles", "component_id", "kept") == expected


def test_parity_never_exceeds_the_difference():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 7, 60, 400, 3000):
        common = rng.integers(0, 2**64, n, dtype=np.uint64)
        for d in (0, 1, 5, 40, 300):
            other = rng.integers(0, 2**64, d, dtype=np.uint64)
            x, y = np.unique(common), np.unique(np.concatenate([common[d // 2 :], other]))
            differ = int(np.bitwise_count((near_dedup.parity(x) ^ near_dedup.parity(y)).view(np.uint64)).sum())
            assert differ <= len(np.setxor1d(x, y)) and (differ > 0 or len(np.setxor1d(x, y)) % 2 == 0)


def test_bands_and_estimate_keep_pairs_at_the_threshold():
    """Of pairs exactly at the threshold none lacks a shared band, and the estimate rejects none."""
    import numpy as np

    rng = np.random.default_rng(6)
    for union in (7, 20, 60, 150, 400):
        common = -(-85 * union // 100)
        for _ in range(200):
            u = rng.integers(0, 2**64, union, dtype=np.uint64)
            cut = common + (union - common) // 2
            x, y = np.sort(u[:cut]), np.sort(np.concatenate([u[:common], u[cut:]]))
            a, b = near_dedup.signature(x), near_dedup.signature(y)
            assert any((a[i:j] == b[i:j]).all() for i, j in near_dedup.bands())
            own = near_dedup.REGISTERS * -np.expm1(-min(len(x), len(y)) / near_dedup.REGISTERS)
            assert (a == b).sum() >= near_dedup.least_agreement(0.85, np.array([own]))[0]


def test_signature_estimates():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.5, 0.85, 0.95):
        same = []
        for _ in range(30):
            common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) for n in (int(1000 * share), int(1000 * (1 - share) / 2), int(1000 * (1 - share) / 2)))
            x, y = (near_dedup.signature(np.unique(np.concatenate([common, z]))) for z in (a, b))
            same.append((x == y).mean())
        c = near_dedup.chance_collision()
        assert abs((np.mean(same) - c) / (1 - c) - share) < 0.03


def test_words_windows(docs, texts, empty):
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    expected = brute.windows(texts)
    assert sum(r[2] for r in expected) > 500
    assert rows(substring_dedup.substring_dedup(docs), *names) == expected
    assert rows(substring_dedup.substring_dedup(docs, block_bytes=2000), *names) == expected
    assert rows(substring_dedup.substring_dedup(empty), *names) == []
    assert substring_dedup.levels(50) == [13, 25, 50]


def test_byte_strings(docs, texts, empty):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = brute.strings(texts)
    assert sum(r[2] for r in expected) > 2000
    assert rows(suffix_dedup.suffix_dedup(docs), *names) == expected
    assert rows(suffix_dedup.suffix_dedup(docs, block_bytes=2000), *names) == expected
    assert rows(suffix_dedup.suffix_dedup(empty), *names) == []


@pytest.mark.parametrize("f", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup])
def test_repeated_and_null_ids(spark, f):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in f(df).collect()) == [("1", True), ("1", True), ("None", False)]


def test_window_hashes():
    import numpy as np

    units = np.arange(1, 200, dtype=np.uint64) ** np.uint64(3)
    for k in (1, 2, 3, 13, 50):
        h = blocks.window_hashes(units, k)
        assert len(h) == len(units) - k + 1 and len(np.unique(h)) == len(h)
        assert blocks.window_hashes(units[5:], k)[0] == h[5]
    for w in (1, 2, 7, 38):
        m = blocks.window_min(units[::-1].copy(), w)
        assert m.tolist() == [int(units[::-1][i : i + w].min()) for i in range(len(units) - w + 1)]


def test_suffix_arrays_and_factors_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(5)
    for alphabet, lengths in ((2, [30, 1, 70, 5]), (1, [40, 40]), (3, [100]), (256, [60, 50, 60]), (2, [1, 1, 1])):
        texts = [rng.integers(0, alphabet, n).astype(np.uint8) for n in lengths]
        texts[-1][: len(texts[0])] = texts[0][: len(texts[-1])]
        text, sizes = np.concatenate(texts), np.array(lengths)
        owner = rng.permutation(len(lengths))[blocks.group_rows(sizes)]
        suffixes = [t[k:].tobytes() for t in texts for k in range(len(t))]
        order, ranks = suffix_dedup.suffix_array(text, sizes)
        assert [suffixes[i] for i in order] == sorted(suffixes)
        common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905, E731
        lcp = suffix_dedup.common_prefixes(text, sizes, order, ranks)
        assert lcp.tolist() == [0] + [common(suffixes[a], suffixes[b]) for a, b in zip(order, order[1:])]  # noqa: B905
        lpf = np.zeros(len(text), int)
        lpf[order] = suffix_dedup.longest_previous_factors(owner[order], lcp)
        assert lpf.tolist() == [max([common(x, y) for y, p in zip(suffixes, owner, strict=True) if p < o] or [0]) for x, o in zip(suffixes, owner, strict=True)]
    assert len(suffix_dedup.longest_previous_factors(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_bytes_of_a_line_in_many_contexts(spark):
    """One line of 20, and one of 60 bytes, each in thousands of contexts: only the long one goes, and is sent once a block."""
    short, long = "a line that is short", "this line is long enough to be removed wherever it is again!"
    data = [(k, f"{k * 7919:08d}{k * 31:05d} {short if k % 2 else long} {k * 104729:010d}") for k in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute.strings(data)


def test_a_long_text(spark):
    """A text of 300,000 words beside copies of its middle: whole texts, never a prefix."""
    import random

    rng = random.Random(9)
    words = [f"w{rng.randrange(200000)}" for _ in range(300_000)]
    data = [(0, " ".join(words)), (1, " ".join(words[250_000:250_090])), (2, "x " + " ".join(words[-60:])), (3, None)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert rows(substring_dedup.substring_dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute.windows(data)
    by_id = {r.doc_id: r for r in suffix_dedup.suffix_dedup(df).collect()}
    assert by_id[0].n_removed == 0 and by_id[1].n_removed == by_id[1].n_bytes and by_id[2].n_removed == by_id[2].n_bytes - 1
    near = {r.doc_id: r.n_shingles for r in near_dedup.near_dedup(df).collect()}
    assert near[0] > 299_000 and near[3] == 0


def test_texts_are_not_moved(docs):
    """Answers are brought to the blocks: the bucketed table is read without an exchange."""
    from rollstore.llm.common import Scratch

    packed = blocks.Packed(docs, Scratch(docs.sparkSession, "test"), "doc_id", "text", 2000)
    assert packed.df.count() > 3
    for r in packed.df.select("uid").collect():
        assert r.uid >= 0
    out = blocks.beside(packed.df, packed.df.groupBy("uid").count())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "blob" not in "".join(x for x in plan.splitlines() if "Exchange" in x)
    assert out.where("count = 1").count() == packed.df.count()
    packed.close(docs.sparkSession.range(1))


def test_spark_hash(spark):
    import numpy as np
    from pyspark.sql import functions as F

    values = [0, 1, 42, 2**40 + 7, 2**63 - 1]
    expected = [r.h for r in spark.createDataFrame([(v,) for v in values], "v long").select(F.hash("v").alias("h")).collect()]
    assert blocks.spark_hash(np.array(values)).tolist() == expected
    assert all(blocks.spark_hash(np.array([blocks.number_in(b, 7)]))[0] % 7 == b for b in range(7))
