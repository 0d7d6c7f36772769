"""Decontamination, stand-ins, archives and the pipeline."""

import heapq
import random
import re

import duckdb
import pytest
from oracle_compare import compare, connect

from __spark_entry__ import oracle_sql, queries
from hearthline.llm import decontamination, surrogates, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op6_warc_index", "op10_decontamination"])
def test_query_matches_its_sql(spark, name):
    result = compare(spark, connect(SF), SF, name, queries()[name], oracle_sql()[name])
    assert result.startswith("ok"), result


def test_every_operator_is_registered():
    numbers = {int(n[2:].split("_")[0]) for n in queries() if re.match(r"op\d+_", n)}
    assert numbers == set(range(1, 14)) and "pipeline" in queries()


def test_contamination(spark, docs_of, nasty, no_docs):
    rng = random.Random(6)
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(n))) for i, n in enumerate([13, 14, 40, 5, 1, 0, 60])] + [(7, None), (2, "b1 B2")]
    texts = []
    for _ in range(60):
        words = [f"W{rng.randrange(900)}," for _ in range(rng.randrange(0, 80))]
        source = (rng.choice(items)[1] or "").split()
        at, length = rng.randrange(max(1, len(source))), rng.randrange(10, 30)
        texts.append(" ".join(words[:20] + [w.upper() for w in source[at:at + length]] + words[20:]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {r.doc_id: r for r in decontamination.contamination(docs_of(list(enumerate(texts))), benchmark).collect()}
    windows = {}
    for i, t in items:
        w = re.findall(r"[0-9a-z]+", (t or "").lower())
        for s in range(len(w) - min(13, len(w)) + 1) if w else []:
            windows.setdefault(tuple(w[s:s + 13]), set()).add(str(i))
    for i, t in enumerate(texts):
        w, hit, seen = re.findall(r"[0-9a-z]+", t.lower()), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    seen |= windows[tuple(w[s:s + n])]
        assert (found[i].n_words, found[i].n_hit, found[i].n_items) == (len(w), len(hit), len(seen)), t
        assert found[i].contaminated == (bool(hit) and 20 * len(hit) >= len(w))
    assert decontamination.contamination(nasty, benchmark).count() == 10
    assert decontamination.contamination(nasty, benchmark.limit(0)).filter("contaminated or n_hit > 0").count() == 0
    assert decontamination.contamination(no_docs, benchmark).count() == 0


def test_capital_sigma_does_not_hide_a_hit(spark, docs_of):
    """Lower-casing a whole text would write the last sigma of a word by what follows it."""
    words = [f"{a}{b}ΟΣ" for a in "ΑΒΓΔ" for b in "ΛΜΝΞ"][:13]
    benchmark = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    docs = docs_of([(1, "'".join(words)), (2, "'".join(words[:12])), (3, " ".join(words).lower())])
    found = {r.doc_id: (r.n_hit, r.contaminated) for r in decontamination.contamination(docs, benchmark).collect()}
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        con.register(name, df.toPandas())
    expected = {i: (n, c) for i, n, c in con.sql(f"SELECT doc_id, n_hit, contaminated FROM ({decontamination.SQL})").fetchall()}
    assert found == expected == {1: (13, True), 2: (0, False), 3: (0, False)}


def test_stand_ins(spark, docs_of, nasty, no_docs):
    rows = [(1, "Mrs. Ann Smith, +1 (988) 555-2485 or 988-555-2485, Mr Smith, Ann.B.12@Mail8.Example.com 42.144.35.254"),
            (2, "ann.b.12@mail8.example.com; 4111 1111 1111 1111 = 4111111111111111; 123-45-6789; Frau SMITH"),
            (3, "nobody"), (4, "госпожа Анна Петрова")]
    rows += [(10 + i, f"mail a{i}@x.org") for i in range(120)]
    out = {r.doc_id: r for r in surrogates.replace_entities(docs_of(rows), "key").collect()}
    for secret in ("Ann", "Smith", "555-2485", "42.144.35.254", "ann.b", "4111", "123-45-6789", "SMITH", "Петрова"):
        assert not any(secret in r.text for r in out.values()), secret
    one = re.fullmatch(r"Mrs\. (\w+) (\w+), \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4}), Mr (\w+), (\S+@\S+\.com) (\d+\.\d+\.\d+\.\d+)", out[1].text)
    assert one and one[2] == one[7] and (one[3], one[4]) == (one[5], one[6]) and one[1].endswith("na")
    two = re.fullmatch(r"(\S+); (\d{4} \d{4} \d{4} \d{4}) = (\d{16}); \d{3}-\d{2}-\d{4}; Frau (\w+)", out[2].text)
    assert two and two[1] == one[8].lower() and two[2].replace(" ", "") == two[3] and two[4] == one[2].upper()
    digits = [int(d) for d in reversed(two[3])]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"госпожа [А-Я][а-я]+на [А-Я][а-я]+", out[4].text)
    assert out[3].text == "nobody" and out[3].n_entities == 0
    mails = [out[10 + i].text for i in range(120)]
    assert len(set(mails)) == 120 and not set(mails) & {t for _, t in rows}
    assert surrogates.replace_entities(docs_of(rows), "other").filter("doc_id = 1").first().text != out[1].text
    same = {(r.doc_id, r.text) for r in surrogates.replace_entities(nasty, "key").collect()}
    assert same == {(r.doc_id, r.text) for r in nasty.collect()}
    assert surrogates.replace_entities(no_docs, "key").count() == 0


def test_archives_round_trip(spark):
    body = "x\r\n\r\ny" * 300
    rows = [(1, "http://A.example.com/b", body), (2, "http://example.com", body), (3, None, None), (4, "http://a.example.com/\nb", "short"),
            (5, "http://a.example.com:80/", "short"), (None, "http://z.org", body), (7, "http://example.com", body + "é"), (2, "http://example.com", body)]
    pages = spark.createDataFrame([(a, b, c, "v") for a, b, c in rows], "page_id long, url string, html string, value string")
    out = warc.capture_index(pages).collect()
    assert len(out) == len(rows)
    by_id = {r.page_id: r for r in out}
    assert (by_id[1].record_type, by_id[1].refers_to, by_id[1].payload_bytes) == ("revisit", 2, len(body))
    assert by_id[2].record_type == by_id[4].record_type == by_id[5].record_type == by_id[7].record_type == "response"
    assert by_id[3].payload_bytes == 0 and by_id[3].url_key == "" and by_id[7].payload_bytes == len(body) + 2
    ordered = sorted(out, key=lambda r: (r.range_no, r.nth))
    keys = [(r.url_key, r.captured) for r in ordered]
    assert keys == sorted(keys)
    assert warc.capture_index(pages.limit(0)).count() == 0


def test_loser_tree_merges_like_a_heap():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == list(heapq.merge(*runs))


def test_pipeline_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        after = {r.doc_id for r in out.collect()}
        assert after <= before and after, name
        docs, before = out, after
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()} == before
