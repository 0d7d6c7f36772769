"""Near-duplicates, lines, embeddings and components against brute force."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from hearthline.llm import embedding_dedup, line_dedup, near_dedup
from hearthline.llm.graph import connected_components


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (None, 1)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and a != b]
    assert found == roots({n for p in real for n in p}, real)
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def copies(rng, n_bases, n_copies):
    texts = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(3, 260))]
        for _ in range(n_copies):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(words))
    return texts


def test_near_duplicates(docs_of, nasty, no_docs):
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = copies(rng, 25, 6) + [passage + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(rng.randrange(10, 90))) for _ in range(60)]
    rows = list(enumerate(texts))
    found = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    expected = roots(sets, links)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(r.n_shingles == len(sets[i]) and r.kept == (expected[i] == i) for i, r in found.items())
    odd = near_dedup.near_duplicates(nasty).collect()
    assert len(odd) == 10
    assert {(r.doc_id, r.component_id) for r in odd} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 7), (None, None), (8, 8)}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_one_bit_minima_let_links_through(spark):
    """Far from the limit at every size, for pairs of one size and for sets that hold one another."""
    rng = np.random.default_rng(6)
    sizes = (128, 200, 300, 700, 2000)
    limits = spark.range(1).select(*[near_dedup.most_differing(F.lit(n)) for n in sizes]).first()
    for n, limit in zip(sizes, limits):
        differing = []
        for i in range(600):
            u = rng.integers(0, 2 ** 63, 2 * n).astype(np.uint64) * np.uint64(2)
            shared, larger = int(np.ceil(1.7 * n / 1.85)), int(n / 0.85)
            a, b = (u[:n], np.concatenate([u[:shared], u[n:2 * n - shared]])) if i % 2 else (u[:n], u[:larger])
            x, y = near_dedup.minimum_bits(np.unique(a)), near_dedup.minimum_bits(np.unique(b))
            differing.append(sum(((p ^ q) & (2 ** 64 - 1)).bit_count() for p, q in zip(x, y)))
        assert np.mean(differing) + 7 * np.std(differing) <= limit and max(differing) <= limit - 2 * np.std(differing)


def test_lines(docs_of, nasty, no_docs):
    rng = random.Random(9)
    bases = ["".join(rng.choice("abcdefghij     ") for _ in range(rng.randrange(60, 200))).strip() for _ in range(30)]
    rows = []
    for i in range(40):
        lines = []
        for base in rng.sample(bases, 4):
            at = rng.randrange(len(base))
            lines.append(base[:at] + rng.choice(["", "z", "Z"]) + base[at:])
        rows.append((i, "\n".join(lines + [""])))
    found = {(r.doc_id, r.line_no): r for r in line_dedup.line_classes(docs_of(rows)).collect()}
    keys = {(i, n): line.strip(" ").lower() for i, t in rows for n, line in enumerate(t.split("\n"))}
    sets = {k: frozenset(v[i:i + 5] for i in range(max(1, len(v) - 4))) for k, v in keys.items() if v}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    expected = roots(sets, links)
    wrong = [k for k in sets if found[k].kept != (expected[k] == k)]
    assert len(wrong) <= 2  # banding is probabilistic; every link found is exact
    assert all(found[k].kept for k in keys if not keys[k])
    cleaned = line_dedup.without_repeated_lines(docs_of(rows))
    assert cleaned.columns == docs_of(rows).columns
    assert sum(len([x for x in r.text.split("\n") if x]) for r in cleaned.collect()) == sum(r.kept for k, r in found.items() if keys[k])
    assert {r.doc_id for r in line_dedup.without_repeated_lines(nasty).collect()} == {1, 2, 3, 4, 5, None, 8}
    assert line_dedup.line_classes(no_docs).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[i % 20] + rng.normal(size=16) * rng.choice([0.02, 0.25, 0.6]) for i in range(300)]).reshape(300, 16)
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    rows += [(300, rows[0][1]), (301, None), (302, [0.0] * 16), (303, [float("nan")] * 16), (304, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<float>, label int, node int")
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect() if r.vec_id is not None}
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i is not None and i <= 300}
    links = [(a, b) for a, b in combinations(units, 2) if units[a] @ units[b] >= 0.95]
    expected = roots(found, links)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert {i: r.n_links for i, r in found.items()} == {i: sum(i in p for p in links) for i in found}
    assert next(iter(found.values())).audited_recall >= 0.9
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0
