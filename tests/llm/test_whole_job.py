"""Inputs of which an operator once did only a part."""

import random

import numpy as np

from hearthline.llm import embedding_dedup, line_dedup, near_dedup, secret_scan


def runs_of(line):
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def test_typos_in_lines_of_words(spark, docs_of):
    rng = random.Random(2)
    pairs = []
    while len(pairs) < 150:
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(5, 9))) for _ in range(rng.choice([7, 8, 12, 16]))]
        line = " ".join(words)
        if len(pairs) % 3:
            at = rng.randrange(len(line))
            other = line[:at] + "z" + line[at + 1:]
        else:  # a space more moves no words
            other = line.replace(" ", "  ", 1)
        x, y = runs_of(line), runs_of(other)
        if 100 * len(x & y) >= 80 * len(x | y):
            pairs.append((line, other))
    docs = docs_of([(i, line) for i, line in enumerate(x for p in pairs for x in p)])
    kept = {r.doc_id for r in line_dedup.line_classes(docs).filter("kept").collect()}
    missed = sum(2 * i + 1 in kept for i in range(len(pairs)))
    assert all(2 * i in kept for i in range(len(pairs)))
    assert missed <= 4


def test_different_lines_are_signed_once_and_in_one_row(docs_of):
    """Repeats are made one before they are signed; linked lines pass the test on four bits of their minima."""
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefgh \u00e9\U0001f600") for _ in range(n)).strip() or "x" for n in (1, 4, 5, 6, 60, 200, 2000)]
    docs = docs_of([(-3 - i, "\n".join([line, line.upper(), "  " + line, ""])) for i in range(3) for line in lines])
    signed = line_dedup.classes_of(docs).collect()
    assert len(signed) == len(set(lines)) == len({(r.h1, r.h2) for r in signed})
    assert all(len(r.bands) == line_dedup.BANDS for r in signed)
    assert {int(r.first // line_dedup.LINE_PLACES) for r in signed} == {-5}
    near = []
    for i in range(200):
        line = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(40, 120))]
        other = line[:]
        while True:
            before, at = other[:], rng.randrange(len(line))
            other[at] = "z"
            x, y = runs_of("".join(line)), runs_of("".join(other))
            if 100 * len(x & y) < 80 * len(x | y):
                break
        near.append(("".join(line), "".join(before)))
    sketches = {r.h1: r.sketch for r in line_dedup.classes_of(docs_of([(i, "\n".join(p)) for i, p in enumerate(near)])).collect()}
    keys = line_dedup.lines_of(docs_of([(i, "\n".join(p)) for i, p in enumerate(near)])).select("doc_id", "line_no", "h1").collect()
    h1 = {(r.doc_id, r.line_no): r.h1 for r in keys}
    for i in range(len(near)):
        a, b = sketches[h1[i, 0]], sketches[h1[i, 1]]
        differing = sum((x >> 4 * k & 15) != (y >> 4 * k & 15) for x, y in zip(a, b) for k in range(line_dedup.MINIMA_A_WORD))
        assert differing <= line_dedup.most_differing(80)


def test_runs_are_hashed_once_a_text_and_sketches_join_shared_bands_only(spark, docs_of, monkeypatch):
    texts = ["", "ab", "abcde", "abcdefabcdef", "\u00e9\U0001f600" * 9, "x" * 300]
    hashed = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", line_dedup.runs("t").alias("r"))
    found = {r.i: r.r for r in hashed.collect()}
    assert all(len(found[i]) == len(set(found[i])) == len(runs_of(t)) for i, t in enumerate(texts))
    assert set(found[2]) < set(found[3])
    classes = line_dedup.classes_of(docs_of([(1, "a line of some words\nanother"), (2, "a line of some words!\nquite different")]))
    plans = []
    monkeypatch.setattr(line_dedup, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    lists = line_dedup.band_lists(classes).collect()
    assert len({r.node for r in lists}) == 2 and all(r.about is not None for r in lists)
    window = plans[0][plans[0].index("Window"):]
    assert "sketch" not in window[:window.index("Relation")]


def test_plain_tokens_are_all_counted(docs_of):
    texts = ["ordinary tokens number1234 appear", None, "ordinary ordinary"]
    plain = secret_scan.learn(docs_of(list(enumerate(texts)))).plain
    words = [w for t in texts if t for w in secret_scan.PLAIN.findall(t)]
    assert sum(n for pair, n in plain.pairs.items() if pair[0] == "^") == len(words) == 6
    assert plain.pairs["^l"] == 5 and plain.pairs["^h"] == 1 and plain.firsts["d"] == 4


def test_pairs_without_the_leader_are_compared(docs_of, monkeypatch):
    """The first of the list fails the cheap test with both others, which are linked."""
    asked = []
    real = near_dedup.apart_pairs
    monkeypatch.setattr(near_dedup, "apart_pairs", lambda *a: asked.append(1) or real(*a))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words[:12])), (2, " ".join(words)), (3, " ".join([*words, "x"]))]
    far = [(1, " ".join(words[:12])), (2, "some other text of a few words")]
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(rows)).collect()} == {1: 1, 2: 2, 3: 2}
    asked.clear()
    assert {r.component_id for r in near_dedup.near_duplicates(docs_of(far)).collect()} == {1, 2} and asked


def test_links_between_clusters_that_fill_their_lists(spark):
    rng = np.random.default_rng(5)
    dim, rows = 16, []
    for pair in range(3):
        a, side = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        for turn in (0.0, 16.0):  # cosine 0.961 between the centres
            centre = np.cos(np.radians(turn)) * a + np.sin(np.radians(turn)) * side
            rows += [centre + rng.normal(size=dim) * 0.002 for _ in range((30, 80, 100)[pair])]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    x = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    found = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    assert [found[i].n_links for i in range(len(x))] == near.sum(1).tolist()
    assert len({r.component_id for r in found.values()}) == 3
