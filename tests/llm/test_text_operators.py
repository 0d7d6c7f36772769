"""Packing, toxicity, language and secrets against brute force, and on nasty input."""

import hashlib
import random
import re
import zlib

import numpy as np

from hearthline.llm import language, packing, secret_scan, toxicity
from hearthline.llm.queries import tokenizer_path


def check_packing(rows, docs, window):
    tokenizer = packing.ChunkIds(tokenizer_path()).tokenizer
    expected = sorted(zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())
                      for t in docs)
    pieces = {}
    for r in rows:
        assert 0 < r.length <= window
        pieces.setdefault(r.sequence_id, []).append(r)
    for own in pieces.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    assert sum(r.length for r in rows) == sum(
        len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in docs)
    whole = [r.ids_crc32 for r in rows if r.length == r.doc_tokens]
    assert set(whole) <= set(expected)
    return pieces


def test_packing_round_trip(nasty, no_docs):
    rows = packing.pack_documents(nasty, tokenizer_path(), window=64).collect()
    pieces = check_packing(rows, [r.text for r in nasty.collect()], 64)
    assert sum(64 - sum(r.length for r in own) for own in pieces.values()) < 64
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0


def test_plan_uses_every_rank_once():
    rng = random.Random(4)
    histogram = {n: rng.randrange(1, 300) for n in rng.sample(range(1, 128), 60)} | {100: 5000}
    plan = packing.pack_plan(histogram, 128)
    used = {}
    for tail, lo, n, start, length, *_ in plan.rows.tolist():
        for rank in range(lo, lo + n):
            used.setdefault((tail, rank), []).append((start, length))
    assert len(used) == sum(histogram.values())
    for (tail, _), spans in used.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == tail
    tokens = sum(n * k for n, k in histogram.items())
    assert plan.sequences == -(-tokens // 128)


def test_chunks_give_the_tokenizers_ids():
    chunks, rng = packing.ChunkIds(tokenizer_path()), random.Random(3)
    parts = ["hello", "World", "don't", "'s", ",", ".", ",,", "..", '"', "  ", "\n", "\t", " ", "é", "É", "ß", "İ", "Σ", "ΟΔΟΣ", "1",
             "23", "²", "日本", "<|endoftext|>", "_", "-", "\xa0", " ", "x.y", "...", ", ", ". ", "🙂", "́"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(chunks.of(text), "<u4").tolist() == chunks.tokenizer.encode(text, add_special_tokens=False).ids, text


class Counting:
    """A tokenizer that counts its calls."""

    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, 0

    def encode(self, text, **settings):
        self.calls += 1
        return self.tokenizer.encode(text, **settings)


def test_new_words_are_encoded_together_whatever_marks_follow():
    chunks, rng = packing.ChunkIds(tokenizer_path()), random.Random(5)
    chunks.tokenizer = counting = Counting(chunks.tokenizer)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randrange(3, 12))) for _ in range(600)]
    texts = [" ".join(f"{a}{w}{b}" for w, (a, b) in zip(words[i:i + 100], [("", "###"), ("(", ")"), ("", "!!"), ("", ",."), ("x-", " 12.50"), ("", "")] * 17))
             for i in range(0, 600, 100)]
    found = [chunks.of(text) for text in texts]
    assert counting.calls < 60
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [
        counting.tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert list(chunks.in_blocks(texts)) == found and list(chunks.in_blocks([])) == []


def labelled_corpus(n=400):
    rng = random.Random(7)
    plain, bad = [f"{a}{b}" for a in "bcdfg" for b in ("ana", "eno", "ilo", "oru")], ["vexling", "vexor", "grubbish"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 60))]
        toxic = i % 5 == 0
        for at in rng.sample(range(len(words)), 3) if toxic else []:
            words[at] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    return rows, labels


def test_toxicity_on_the_held_out_fold(spark, docs_of, nasty, no_docs):
    rows, labels = labelled_corpus()
    table = spark.createDataFrame(labels + [(999, 0, None)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in toxicity.score_toxicity(docs_of(rows), table).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r.held_out} == set(held)
    assert all(found[i].predicted == (i % 5 == 0) for i in held)
    text = dict(rows)[0]
    assert all(re.fullmatch(r"(vex\w+|grubbish)( (vex\w+|grubbish))*", text[s.start:s.end]) for s in found[0].spans)
    scored = toxicity.score_toxicity(nasty, table.limit(0)).collect()
    assert len(scored) == 10 and all(r.score == 0 and r.predicted == 0 for r in scored)
    assert toxicity.score_toxicity(no_docs, table).count() == 0
    kept = toxicity.without_toxic(docs_of(rows), table)
    assert kept.columns == docs_of(rows).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 5}


def test_chain_marginals_equal_enumeration():
    model = toxicity.ToxicityModel(bias=-0.3, trans=np.array([[0.0, -0.4], [0.2, 0.7]]), start=-0.5)
    scores = np.array([0.4, -1.0, 2.0, 0.1, np.nan])
    weights = np.zeros(4)
    total = 0.0
    for state in range(16):
        y = [(state >> k) & 1 for k in range(4)]
        w = np.exp(-0.5 * y[0] + sum(scores[k] * y[k] for k in range(4)) + sum(model.trans[a][b] for a, b in zip(y, y[1:])))
        total += w
        weights += w * np.array(y)
    assert np.allclose(model.marginals(scores)[:4], weights / total)


def test_language_code_lengths(spark, docs_of, nasty, no_docs):
    texts = {"aa": "abab abba baab " * 30, "bb": "bcbc bccb cbbc " * 30}
    rows = [(i, texts["aa" if i % 2 else "bb"][i:], "aa" if i % 2 else "bb") for i in range(60)] + [(100, None, "aa"), (101, "12 34", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in language.predict_language(docs).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang in rows[:60])
    assert found[100].lang_pred == found[101].lang_pred == "und" and found[101].score == 0
    trees = language.learn(docs)
    # one byte at a time, straight from the definition
    train = [t for i, t, lang in rows if lang == "aa" and t and zlib.crc32(str(i).encode()) % 3 != 1]
    grams = {}
    for t in train:  # the learner sees the texts of a language one after another
        grams[t] = 1
    bits = trees.bits(["abba", ""])
    assert bits[1].tolist() == [0.0, 0.0] and bits[0][trees.languages.index("aa")] < bits[0][trees.languages.index("bb")]
    assert language.predict_language(nasty).count() == 10
    assert language.predict_language(no_docs).count() == 0


def test_code_lengths_follow_the_escape_rule():
    import pandas as pd

    data = b"\n\n\nabcabd"
    grams = pd.Series([int.from_bytes(data[i:i + 4], "big") for i in range(len(data) - 3)]).value_counts()
    trees = language.build_trees(pd.DataFrame({"lang": "x", "gram": grams.index, "n": grams.to_numpy()}), least_count=1)

    def cost(context, byte):
        counts = {}
        for i in range(3, len(data)):
            if data[max(0, i - len(context)):i] == context:
                counts[data[i]] = counts.get(data[i], 0) + 1
        total, distinct = sum(counts.values()), len(counts)
        shorter = (lambda: cost(context[1:], byte)) if context else (lambda: 8.0)
        if not total:
            return shorter()
        return -np.log2(counts[byte] / (total + distinct)) if byte in counts else -np.log2(distinct / (total + distinct)) + shorter()

    for text in ("abc", "abd", "cab", "da"):
        padded = language.PAD + text.encode()
        expected = sum(cost(padded[i - 3:i], padded[i]) for i in range(3, len(padded)))
        assert abs(trees.bits([text])[0][0] - expected) < 1e-4


def test_secret_spans(docs_of, nasty, no_docs):
    rng = random.Random(2)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(20)) for _ in range(60)]
    rows = [(i, f"é token = \"{h}\" and AKIA{h.upper()[:16]} x") for i, h in enumerate(hexes)]
    rows += [(100, "password: short token=secret=abcdefghijklm"), (101, "Schifffahrtsgesellschaft und Donaudampf"), (102, hexes[0][:14])]
    found = {r.doc_id: r for r in secret_scan.scan_secrets(docs_of(rows)).collect()}
    for i, text in rows:
        spans = []
        for k, (kind, pattern, group, least) in enumerate(secret_scan.BASE):
            spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
        base = ",".join(s for _, _, s in sorted(spans))
        assert found[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(found[i].spans.split(","))
    assert found[101].n_added == 0
    assert secret_scan.scan_secrets(nasty).count() == 10
    assert secret_scan.scan_secrets(no_docs).count() == 0


def test_inferred_automaton_prefers_its_format():
    rng = random.Random(5)
    words = ["ab" + "".join(rng.choice("0123456789") for _ in range(12)) for _ in range(200)]
    automaton = secret_scan.infer(words)
    used = {0} | {t for m in automaton.moves for t, _ in m.values()}
    assert len(used) < 60  # far fewer than the prefix tree's states
    assert automaton.score(secret_scan.symbols("ab999999999999")) >= automaton.least > automaton.score(secret_scan.symbols("zzzzzzzzzzzzzz"))


def test_texts_without_letters_are_undetermined():
    assert [language.has_letter(t) for t in ("½ ² ①", "12 _ !", "", None, "1a", "日", "ª")] == [False] * 4 + [True] * 3


def test_the_toxicity_fit_holds_words_once():
    """The driver's share: some 30 tokens a line, of which only numbers may stay."""
    import random
    import tracemalloc

    import numpy as np

    from hearthline.llm import toxicity

    rng = random.Random(5)
    texts = [" ".join(f"{rng.choice('abcdefgh') * 3}{'word' * rng.randrange(4)}" for _ in range(3000)) + (" vileword" if i % 4 == 0 else "")
             for i in range(100)]
    tracemalloc.start()
    model = toxicity.fit(texts, np.arange(100) % 4 == 0, rounds=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model.constant is None and peak < 100 * 300_000  # 100 bytes a token
