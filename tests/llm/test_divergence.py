"""The source divergence audit against plain counting and against its SQL."""

import random
import re
from collections import Counter, defaultdict

from oracle_compare import compare, connect

from __spark_entry__ import oracle_sql, queries
from hearthline.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value string, rank int"


def brute(rows, least=3, most=200):
    groups, spread = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in
                 re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang or "", source or ""].update(terms)
        spread[lang or ""].update(set(terms))
    out = set()

    def p(count, kept):
        return {t: 1 + 10 ** 9 * (count[t] + 1) // (sum(count[k] for k in kept) + len(kept)) for t in kept}

    def listed(lang, source, part, values, limit=None):
        ordered = sorted(values.items(), key=lambda kv: (-kv[1], kv[0].encode()))[:limit]
        out.update((lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ordered))

    for lang in {g[0] for g in groups}:
        kept = [t for t, k in spread[lang].items() if k >= least]
        sources = [s for g, s in groups if g == lang]
        own = {s: p(groups[lang, s], kept) for s in sources}
        whole = p(sum((groups[lang, s] for s in sources), Counter()), kept)
        for s in sources:
            listed(lang, s, "pair", {o: sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept) for o in sources if o != s})
            listed(lang, s, "term", {t: (own[s][t] - whole[t]) ** 2 // whole[t] for t in kept
                                     if groups[lang, s][t] and own[s][t] > whole[t]}, most)
    return out


def sample(n, seed=3):
    rng = random.Random(seed)
    words = ["The", "the", "THE", "Éa", "éa", "İx", "straße", "日本", "a1b", "it's", "x_y", "¼"] + [f"w{chr(97 + k)}" for k in range(26)]
    rows = []
    for i in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None])
        text = rng.choice([" ", "\n", "\x1c", "-"]).join(rng.choice(words[:8 + 6 * len(source or "")]) for _ in range(rng.randrange(25)))
        rows.append((i, text if rng.random() < 0.95 else None, rng.choice(["en", "en", "de", None, ""]), source))
    return rows + [(n, "only once", "xx", "s1"), (n, None, "xx", "s2"), (None, "", "yy", "s9")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "v", 2) for r in rows], SCHEMA)


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_plain_counting(spark):
    rows = sample(120)
    assert rows_of(dv.source_divergence(frame(spark, rows))) == brute(rows)
    # ties beyond the limit, and many small blocks
    assert rows_of(dv.source_divergence(frame(spark, rows + rows), 2, 3, block_cells=40)) == brute(rows + rows, 2, 3)


def test_partial_sums_do_not_change_the_result(spark, monkeypatch):
    rows = sample(80, 4)
    monkeypatch.setattr(dv, "HELD_TERMS", 5)
    assert rows_of(dv.source_divergence(frame(spark, rows))) == brute(rows)


def test_counts_beyond_64_bits_stay_exact(spark):
    [row] = spark.range(1).select(dv.per_billion(
        dv.F.lit(10 ** 13), dv.F.lit(3 * 10 ** 13), dv.F.lit(7)).alias("p")).collect()
    assert row.p == 1 + 10 ** 9 * (10 ** 13 + 1) // (3 * 10 ** 13 + 7)


def test_odd_inputs(spark, nasty, no_docs):
    assert dv.source_divergence(no_docs).count() == 0
    plain = [(r.doc_id, r.text, r.lang, r.source) for r in nasty.collect()]
    assert rows_of(dv.source_divergence(nasty)) == brute(plain)


def test_query_matches_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    name = "op13_source_divergence"
    result = compare(spark, connect(sf), sf, name, queries()[name], oracle_sql()[name])
    assert result.startswith("ok"), result
