"""Source divergence audit: how far the term frequencies of each source are from the others'.

Tokenizing is one `bytes.translate`, whose table lowers A-Z and turns everything else in ASCII
that is no letter into blanks, and one `bytes.split`; letters beyond ASCII stay as they are. A
Counter per document gives term frequencies, its keys document frequencies. Each task sums both
per (language, source) and hands out partial sums, which Spark adds up, so a frequent term or a
source with a third of all rows reaches the shuffle as a few rows a task. All probabilities are
integers in parts of a billion, worked out in decimals that hold them exactly.

Every pair of sources of a language is compared over all its kept terms. Terms are dealt by hash
into blocks of bounded size; a block lays its terms out as a matrix (source, term), in which a
term that a source lacks has that source's probability of count 0, and adds the pairs' values.

Edge cases: null text, language and source count as ''; a source without terms takes part with
count 0 everywhere; a language without kept terms has pairs of value 0 and no terms; repeated rows
count each time; an empty table gives an empty result; other columns are ignored. Text that is
not valid UTF-8 is split at the same bytes.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.lists import broadcast_if_small
from hearthline.session import cut_lineage

#: A term is kept in a language where so many of its documents have it.
LEAST_DOCUMENTS = 3
#: Terms listed per source.
MOST_TERMS = 200
BILLION = 1_000_000_000
#: Distinct terms that a task sums up before it hands them out.
HELD_TERMS = 200_000
#: Cells of the matrix (source, term) of one block; more where a language has so many sources that
#: a block's pairs would outnumber its cells.
BLOCK_CELLS = 200_000

UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
TRANSLATE = bytes(LOWER[UPPER.index(b)] if b in UPPER else b if b in LOWER or b >= 0x80 else 0x20 for b in range(256))

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()),
                    ("documents", pa.int64())])


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TRANSLATE).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences, documents with it; a null term for every (lang, source)."""
    def emitted(held):
        for (lang, source), (n, documents) in held.items():
            terms = [None, *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *map(documents.__getitem__, n)], pa.int64())], schema=COUNTS)

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                terms = terms_of(text)
                document = Counter(terms)
                n, documents = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(terms)
                documents.update(document.keys())
                size += len(n)
                if size >= HELD_TERMS:
                    yield from emitted(held)
                    held, size = {}, 0
        yield from emitted(held)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                       F.col("text").cast("binary").alias("text"))
    return (rows.mapInArrow(run, "lang string, source string, term binary, n long, documents long")
            .groupBy("lang", "source", F.col("term").cast("string").alias("term"))
            .agg(F.sum("n").alias("n"), F.sum("documents").alias("documents")))


def per_billion(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + kept)), exact for counts beyond 64-bit products."""
    above = (n + 1).cast("decimal(20,0)") * F.lit(BILLION).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", above, (total + kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); below 2^63 because p and q are at most 10^9 + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def pair_sums(terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Values of all ordered pairs of `sources` over the terms of one block."""
    names = sources["source"].to_numpy()
    column, distinct = pd.factorize(terms["term"])
    p = np.repeat(sources["p_absent"].to_numpy(np.int64)[:, None], len(distinct), 1)
    row = pd.Index(names).get_indexer(terms["source"])
    p[row, column] = terms["p"].to_numpy(np.int64)
    values = []
    for own in p:
        apart = own - p
        values.append((apart * apart // p).sum(1))
    keep = ~np.eye(len(names), dtype=bool)
    source, item = np.nonzero(keep)
    return pd.DataFrame({"lang": sources["lang"].iloc[0], "source": names[source], "item": names[item],
                         "value": np.array(values, np.int64).reshape(len(names), len(names))[keep]})


def source_divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS,
                      block_cells: int = BLOCK_CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows against every other source of the
    language, `term` rows for the terms that most exceed their language's frequency."""
    counts = cut_lineage(term_counts(docs))
    kept = cut_lineage(counts.filter("term is not null").groupBy("lang", "term")
                       .agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents"))
                       .filter(F.col("documents") >= least_documents).select("lang", "term", "lang_n"))
    used = cut_lineage(counts.filter("term is not null").join(kept, ["lang", "term"])
                       .select("lang", "source", "term", "n", "lang_n"))
    languages = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = cut_lineage(
        counts.filter("term is null").select("lang", "source")
        .join(used.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(languages, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
        .withColumn("sources", F.count("*").over(Window.partitionBy("lang"))))
    small_groups = broadcast_if_small(groups)
    scored = used.join(small_groups, ["lang", "source"]).select(
        "lang", "source", "term", "sources", per_billion(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
        per_billion(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = (scored.filter("p > q")
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                   divergence(F.col("p"), F.col("q")).alias("value"))
           .withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= most_terms))

    cells = F.col("kept").cast("double") * F.col("sources")
    most = F.greatest(F.lit(float(block_cells)), 4.0 * F.col("sources") * F.col("sources"))
    blocks = int(groups.agg(F.max(F.floor(cells / most))).first()[0] or 0) + 1
    absent = groups.filter("sources > 1").select(
        "lang", "source", F.when(F.col("kept") > 0, per_billion(F.lit(0).cast("long"), F.col("total"), F.col("kept")))
        .otherwise(F.lit(1)).cast("long").alias("p_absent"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    dealt = scored.filter("sources > 1").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    pairs = (dealt.groupBy("lang", "block").cogroup(absent.groupBy("lang", "block"))
             .applyInPandas(pair_sums, "lang string, source string, item string, value long")
             .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(ranked)))
    return pairs.unionByName(top).select("lang", "source", "part", "item", "value", "rank")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
t AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
n AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
languages AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(n.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN n USING (lang, source) GROUP BY g.lang, g.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 1)) // (g.total + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.lang_n + 1)) // (l.total::HUGEINT + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN languages l USING (lang) LEFT JOIN n USING (lang, source, term)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value
  FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
