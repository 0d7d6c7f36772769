"""Periodic runs against a search of every period."""

import random
import re
import zlib
from hashlib import sha256

import numpy as np

from hearthline.llm import periodic_runs as pr


def brute_runs(words):
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            part = words[start:start + length]
            if length >= max(6, 4 * q) and all(part[:-p] != part[p:] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planted):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs, keep = brute_runs(words), [True] * n
    for s, length, q in runs:
        keep[s + q:s + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            sha256(" ".join(w for w, k in zip(words, keep) if k).encode()).hexdigest())


def repetitive(rng):
    """Words with runs inside runs, broken runs and runs next to one another."""
    words = []
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(4)
        if kind == 0:
            words += [rng.choice("abc") for _ in range(rng.randrange(30))]
        elif kind == 1:
            root = [rng.choice("ab") for _ in range(rng.randrange(1, 24))]
            words += (root * 9)[:rng.randrange(len(root), 9 * len(root))]
        elif kind == 2:
            inner = ([rng.choice("abcd") for _ in range(rng.randrange(1, 4))] * 8)[:rng.randrange(4, 20)]
            words += (inner + ["x", "y"]) * rng.randrange(1, 7)
        else:
            words += [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60))]
    return words


def test_runs_are_those_of_a_full_search():
    rng = random.Random(5)
    for _ in range(60):
        documents = [repetitive(rng) for _ in range(rng.randrange(1, 8))]
        found = pr.runs_of([[w.encode() for w in d] for d in documents], [None] * len(documents))
        assert found == [brute_runs(d) for d in documents]


def test_every_period_of_a_scale_is_proposed():
    rng = random.Random(6)
    for q in range(1, 140):
        words = [f"w{rng.randrange(10 ** 6)}" for _ in range(q)]
        document = ["a", "b"] + words * 4 + words[:rng.randrange(q)] + ["c"]
        if q == 1:
            document = ["a", "b"] + words * 6
        [found] = pr.runs_of([[w.encode() for w in document]], [None])
        assert found == brute_runs(document) and any(r[2] == q for r in found)


def test_the_set_is_sparse_and_locally_consistent():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 50, 4000)
    words[2000:3000] = words[500:1500]
    names, scale = pr.mix(words.astype(np.uint64)), 1
    while scale < 16:
        names, scale = pr.doubled(names, scale), scale * 2
    members = set(pr.synchronising_set(names, scale, []).tolist())
    assert {m - 1500 for m in members if 2000 <= m <= 3000 - 32} == {m for m in members if 500 <= m <= 1500 - 32}
    gaps = np.diff(sorted(members))
    assert gaps.max() <= scale and len(members) < 4 * 4000 / scale


def test_query_rows(spark, docs_of, nasty, no_docs):
    rng = random.Random(8)
    rows = [(i, " ".join(repetitive(rng))) for i in range(200)]
    rows += [(i, None if i % 3 else " \n") for i in range(200, 230)] + [(231, "a\x1cb c " * 9), (232, "x " * 5), (233, "x " * 6)]
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for planted in (False, True):
        found = pr.periodic_runs(docs_of(rows), pr.seeded_repeats if planted else None).select(columns).collect()
        assert sorted(map(tuple, found)) == sorted(brute_row(i, t, planted) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    again = pr.periodic_runs(nasty, pr.seeded_repeats, texts=True).collect()
    expected = {(r.doc_id, r.text): brute_row(r.doc_id, r.text, True) for r in nasty.collect()}
    assert len(again) == 10 and {tuple(r)[:8] for r in again} == set(expected.values())
    assert {r.doc_id: r.collapsed for r in again}[7] == "one one"
    assert pr.periodic_runs(no_docs).count() == 0


def test_a_long_document(spark, docs_of):
    rng = random.Random(9)
    root = [f"w{rng.randrange(3000)}" for _ in range(11_000)]
    words = root[:700] + root * 5 + ["end"] * 7
    [row] = pr.periodic_runs(docs_of([(1, " ".join(words))]), texts=True).collect()
    assert [tuple(r) for r in row.runs] == [(0, 700, 11_000)][:0] + [(700, 55_000, 11_000), (55_700, 7, 1)]
    assert len(row.collapsed.split()) == 700 + 11_000 + 1
