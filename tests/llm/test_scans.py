import random
import re

import numpy as np

from rollstore.llm import ann, license_scan, mixing, quality

from brute import targets

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def test_licences(docs, texts, empty):
    out = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    assert len(out) == len(texts)
    for i, t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = [(k, label) for k in range(len(w)) for p, label in license_scan.BASE.items() if w[k : k + len(p.split())] == p.split()]
        r = out[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.license_scan(empty).count() == 0


def placed(words, template):
    """The rule itself, for every shift: the best share of the template in place with all phrases, or 0."""
    best, n = 0.0, len(template.words)
    for s in range(-n - template.drift, len(words) + 1):
        at = lambda i, d, s=s: words[i + s + d] if 0 <= i + s + d < len(words) else None
        covered = sum(any(at(i, d) == w for d in range(template.drift + 1)) for i, w in enumerate(template.words))
        whole = all(any(all(at(i, d) == template.words[i] for i in range(a, b)) for d in range(template.drift + 1)) for a, b in template.phrases)
        if covered >= template.need and whole:
            best = max(best, covered / n)
    return best


def test_licence_labels_against_brute_force():
    """Templates whole, cut at either end, with words put in, left out or changed, and files of licence words alone."""
    rng = random.Random(3)
    index = license_scan.Index()
    texts = [t for _, t, _ in license_scan.TEMPLATES]
    files = []
    for t in texts:
        w = t.split()
        for _ in range(4):
            v = list(w)
            for _ in range(rng.randrange(1 + len(w) // 6)):
                k = rng.randrange(len(v) + 1)
                v[k : k + rng.randrange(2)] = [rng.choice(["other", "natural", "the"])] * rng.randrange(2)
            files.append(" ".join(["before"] * rng.randrange(3) + v[rng.randrange(2) * rng.randrange(1 + len(v) // 3) :] + ["after"] * rng.randrange(3)))
    files += [" ".join(rng.choice(" ".join(texts).split()) for _ in range(40)) for _ in range(60)] + ["", "mit", "license mit"]
    data = [f.encode() for f in files]
    raw, offsets = np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])])
    number = {w: i for i, w in enumerate(index.vocabulary)}
    found = 0
    for text, row in zip(files, index.scan(raw, offsets), strict=True):
        words = [number.get(w, -1) for w in text.split()]
        shares = [(t, placed(words, t)) for t in index.templates]
        assert row["labels"] == {t.label for t, x in shares if x and not t.is_base}, text
        assert row["score"] == max([x for t, x in shares if not t.is_base] + [0.5 * any(x for t, x in shares if t.is_base)])
        found += bool(row["labels"])
    assert found > 60


def test_licences_in_the_forms_that_files_have(spark):
    cases = {
        "MIT License\n\nCopyright (c) 2020": "mit",
        "the Apache License, Version 2.0 applies to the file": "apache-2.0",
        "subject to the Mozilla Public License v2": "mpl-2.0",
        "Permission is hereby granted, free of charge, to any natural person obtaining a copy of this software and associated documentation files": "mit-grant",
        "// SPDX-License-Identifier: MIT": "mit",
        "obtaining a copy of this software, hereby granted": "",
        "Nothing of that kind.": "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    found = {r.doc_id: r.labels for r in license_scan.license_scan(df).collect()}
    assert list(cases.values()) == [found[i] for i in range(len(cases))]
    for label, template, _ in license_scan.TEMPLATES:
        r = license_scan.license_scan(spark.createDataFrame([(1, f"intro words, {template.upper()}; and more")], "doc_id long, text string")).first()
        assert label in r.labels.split(",") and r.score == 1
        if label == "isc":
            break


def test_nearest(spark):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((40, 16)), 30, axis=0) + 0.3 * rng.standard_normal((1200, 16))
    x[5] = x[7] = x[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000, None, 1), (5100, [0.0] * 16, 1), (5200, [float("nan")] * 16, 1), (5300, [None] * 16, 1), (100, x[100].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = ann.nearest(df, df.where("vec_id % 100 = 0"), block_rows=300, group_bytes=800).collect()
    hit = 0
    for q in range(0, 1200, 100):
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[q] = np.inf
        best = np.lexsort((np.arange(len(x)), dist))[:10]
        assert [r.rank for r in mine] == list(range(1, 11))
        assert all(r.score == dist[r.vec_id] for r in mine)
        hit += len({r.vec_id for r in mine} & set(best.tolist()))
        if q == 100:
            assert [r.vec_id for r in mine[:2]] == [5, 7]
    assert hit >= 0.9 * 120 and len(found) == 120
    few = df.where("vec_id < 4")
    assert ann.nearest(few, few.where("vec_id = 0")).count() == 3
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_nearest_verifies_few(spark):
    """Over all queries of a table: recall, and the share of vectors whose distance is computed at all."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toArrow()
    ids, x = rows.column("vec_id").to_numpy(), np.array(rows.column("embedding").to_pylist(), float)
    index, hit, asked = ann.Index(ids, x), 0, np.flatnonzero(ids % 10 == 0)
    for q in asked:
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        dist[ids == ids[q]] = np.inf
        hit += len(set(ids[np.lexsort((ids, dist))[:10]].tolist()) & set(index.search(int(ids[q]), x[q], 10)[0].tolist()))
    assert hit >= 0.9 * 10 * len(asked)
    assert index.verified < 0.05 * len(x) * len(asked)


def test_nearest_dimensions_and_repeated_ids(spark):
    """Vectors of different dimensions don't meet; many vectors of one id are all searched."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(4 if i % 3 else 7).tolist()) for i in range(90)] + [(200, rng.standard_normal(4).tolist()) for _ in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.where("vec_id = 0 or vec_id = 1"), k=200, block_rows=20).collect()
    assert {r.vec_id for r in found if r.query_id == 0} == {i for i, v in rows if len(v) == 7 and i}
    assert sum(r.vec_id == 200 for r in found if r.query_id == 1) == 50


def tree_by_tree(x, y, rounds):
    """The boosted model without tables: each row's score is the sum of the trees' answers, kept row by row."""
    bins = [[int(np.searchsorted(np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality.BINS + 1)[1:-1])), v, side="right")) for v in x[:, j]] for j in range(x.shape[1])]
    share = (y.sum() + 1) / (len(y) + 2)
    total = [float(np.log(share / (1 - share)))] * len(y)
    for _ in range(rounds):
        for b in bins:
            n = max(b) + 1
            g, h, c = np.zeros(n), np.zeros(n), np.zeros(n, int)
            for i, k in enumerate(b):
                p = 1 / (1 + np.exp(-total[i]))
                g[k], h[k], c[k] = g[k] + y[i] - p, h[k] + p * (1 - p), c[k] + 1
            answer = quality.RATE * quality._tree(g, h, c)
            total = [t + answer[k] for t, k in zip(total, b, strict=True)]
    return 1 / (1 + np.exp(-np.array(total)))


def test_tables_are_the_sum_of_their_trees(monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 3)).round(1)
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * rng.standard_normal(300) > 0.5).astype(float)
    monkeypatch.setattr(quality, "ROUNDS", 4)
    monkeypatch.setattr(quality, "PAIRS", 0)
    assert np.allclose(quality.fit(x, y).score(x), tree_by_tree(x, y, 4))
    monkeypatch.setattr(quality, "PAIRS", 2)
    monkeypatch.setattr(quality, "ROUNDS", 10)
    m = quality.fit(x, y)
    slow = []
    for row in x:
        z = m.base + sum(m.tables[j][np.searchsorted(m.cuts[j], row[j], side="right")] for j in range(3))
        z += sum(t[np.searchsorted(m.pair_cuts[i], row[i], side="right"), np.searchsorted(m.pair_cuts[j], row[j], side="right")] for (i, j), t in zip(m.pairs, m.pair_tables, strict=True))
        slow.append(1 / (1 + np.exp(-z)))
    assert m.pairs and np.allclose(m.score(x), slow)


def test_mixture(docs, texts, empty):
    out = mixing.mix(docs).collect()
    source = {i: f"s{i % 4}" if i % 9 else None for i, _ in texts}
    size = {i: len((t or "").encode().split()) for i, t in texts}
    sizes: dict = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    goal = targets(sizes)
    taken: dict = {}
    assert len(out) == len(texts)
    for r in out:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (size[r.doc_id], sizes[s]) and abs(r.target - goal[s]) < 1e-6 * (1 + goal[s])
        assert r.taken == r.copies * r.size and r.copies <= 2
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 2 * max(n for i, n in size.items() if source[i] == s)
    assert sorted(out) == sorted(mixing.mix(docs.repartition(5)).collect())
    assert mixing.mix(empty).count() == 0


def test_water_filling(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5}, {"a": 1, "b": 1, "c": 1, "d": 900, None: 7}, {"a": 0, "b": 0}, {"x": 5}):
        df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df, [3, 1, 2], 1.5, 2.0).collect()}
        assert all(abs(got[s] - t) < 1e-9 * (1 + t) for s, t in targets(sizes).items())


def test_model_learns_main_effects_and_interactions():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((4000, 4))
    y = (((x[:, 0] > 0) ^ (x[:, 1] > 0)) | (x[:, 2] > 1.5)).astype(float)
    m = quality.fit(x[:3000], y[:3000])
    assert (0, 1) in m.pairs or (1, 0) in m.pairs
    assert ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x[:3]), 0.5)
    assert (quality.fit(x[:50], np.ones(50)).score(x[:3]) > 0.9).all()


def test_classifier_on_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = quality.query(spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_classifier_on_odd_rows(docs, empty, texts, spark):
    labels = spark.createDataFrame([(i, i % 2) for i, _ in texts] + [(1, None), (None, 1)], "doc_id long, quality int")
    m = quality.train(docs, labels)
    assert quality.classify(docs, m).where("score between 0 and 1").count() == len(texts)
    assert quality.accepted(docs, m).columns == docs.columns
    assert quality.classify(empty, quality.train(empty, labels)).count() == 0
