"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every KEEP consecutive hashes of GRAM words the smallest is kept as a fingerprint, on both
sides alike: any shared span of GRAM + KEEP - 1 words, which is a window's length, shares a
fingerprint. Fingerprints of documents meet those of the benchmark, documents that met any are
candidates, and in these alone hits are extended word by word: the windows at all positions are
looked up (by 128 bits of hash) among the benchmark's, and the words they cover are hits.

The benchmark side has one row per distinct fingerprint or window, is written out first, and is
broadcast only while Spark's threshold for its measured size allows; otherwise the joins
shuffle, with rows that are unique per document and fingerprint. Items shorter than a window are
windows of their own length; each such length there is costs one more pass over the documents.

Edge cases: null text has no words; documents without words have n_words 0 and no hit; items
without words (or text) match nothing; an item_id with several texts counts once; a document
shorter than a window can only meet short items; equal rows get equal results; empty tables give
no rows, and an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

WINDOW = 13
#: Words in a fingerprint's gram, and grams of which one fingerprint is kept: 6 + 8 - 1 = 13.
GRAM, KEEP = 6, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def exact_words(text: str) -> Column:
    """Words with A-Z in lower case."""
    return words_in(F.translate(F.col(text), UPPER, LOWER))


def grams(words: str, size: int, seed: int | None = None) -> Column:
    """Hashes of all runs of `size` words, by position; empty if there are fewer words."""
    hashed = (lambda i: F.xxhash64(F.slice(words, i, size))) if seed is None else (
        lambda i: F.xxhash64(F.lit(seed), F.slice(words, i, size)))
    return F.when(F.size(words) >= size, F.transform(F.sequence(F.lit(1), F.size(words) - (size - 1)), hashed)).otherwise(
        F.array().cast("array<bigint>"))


def fingerprints(hashes: str, keep: int) -> Column:
    """The distinct minima of all windows of `keep` hashes."""
    return F.when(F.size(hashes) >= keep, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.size(hashes) - (keep - 1)), lambda i: F.array_min(F.slice(hashes, i, keep))))).otherwise(
        F.array().cast("array<bigint>"))


def winnowed(texts: DataFrame, gram: int, keep: int) -> DataFrame:
    """Fingerprints of `text`. Words are compared in full lower case here, character by character,
    which may only bring in more candidates than A-Z alone. (The one rule that looks at a
    letter's neighbours, that of the capital sigma, is taken out first.)"""
    return (texts.withColumn("words", words_in(F.lower(F.replace("text", F.lit("Σ"), F.lit("σ")))))
            .withColumn("hashes", grams("words", gram))
            .withColumn("prints", fingerprints("hashes", keep)).drop("hashes"))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, length and hashes of every window of every item."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
             .filter("item is not null").withColumn("words", exact_words("text")).filter("size(words) > 0")
             .withColumn("length", F.least(F.size("words"), F.lit(window))))
    start = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1))
    return (items.select("item", "length", "words", start.alias("start"))
            .select("item", "length", F.slice("words", F.col("start"), F.col("length")).alias("own"))
            .select("item", "length", F.xxhash64("own").alias("h1"), F.xxhash64(F.lit(1), F.col("own")).alias("h2")).distinct())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row."""
    keep = window - gram + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("text_key", F.xxhash64("text"))
    windows = cut_lineage(benchmark_windows(benchmark, window))
    lengths = sorted(r["length"] for r in windows.select("length").distinct().collect())  # at most `window` rows
    test_prints = cut_lineage(
        winnowed(benchmark.select(F.col("text").cast("string").alias("text")), gram, keep)
        .select(F.explode("prints").alias("print")).distinct())

    printed = cut_lineage(winnowed(texts, gram, keep).select(
        "doc_id", "text_key", F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_words"), "prints"))
    met = [printed.select("doc_id", "text_key", F.explode("prints").alias("print")).join(test_prints, "print", "left_semi")]
    for length in lengths:
        if length < window:  # nothing that short is sure to leave a fingerprint
            short = windows.filter(F.col("length") == length).select(F.col("h1").alias("print")).distinct()
            met.append(texts.withColumn("words", exact_words("text"))
                       .select("doc_id", "text_key", F.explode(F.array_distinct(grams("words", length))).alias("print"))
                       .join(short, "print", "left_semi"))
    candidates = cut_lineage(reduce(DataFrame.union, met).select("doc_id", "text_key").distinct())

    ids = candidates.select(F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"))
    close = (texts.join(ids, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key")), "left_semi")
             .dropDuplicates(["doc_id", "text_key"]).withColumn("words", exact_words("text")))

    def positions(length: int) -> DataFrame:
        both = F.arrays_zip(grams("words", length).alias("h1"), grams("words", length, 1).alias("h2"))
        return close.select("doc_id", "text_key", F.lit(length).alias("length"), F.posexplode(both).alias("start", "h")).select(
            "doc_id", "text_key", "length", "start", F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))

    window_ids = windows.select("length", "h1", "h2").distinct()
    no_hit = texts.sparkSession.createDataFrame([], "doc_id long, text_key long, length int, start int, h1 long, h2 long")
    hits = reduce(DataFrame.union, [positions(n) for n in lengths], no_hit).join(window_ids, ["length", "h1", "h2"])
    hits = cut_lineage(hits)
    ends = F.aggregate(  # words covered by intervals in order of start, then end
        F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["upto"], x["start"]))).alias("n"),
                                F.greatest(acc["upto"], x["end"]).alias("upto")), lambda acc: acc["n"])
    covered = hits.groupBy("doc_id", "text_key").agg(ends.alias("n_hit"))
    items = (hits.select("doc_id", "text_key", "length", "h1", "h2").distinct().join(windows, ["length", "h1", "h2"])
             .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("item")).alias("items")))
    found = covered.join(items, (covered.doc_id.eqNullSafe(items.doc_id)) & (covered.text_key == items.text_key)).select(
        covered.doc_id.alias("f_id"), covered.text_key.alias("f_key"), "n_hit", "items")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return (printed.drop("prints")
            .join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & F.col("text_key").eqNullSafe(F.col("f_key")), "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                    F.sha2(F.array_join(listed, ",").cast("binary"), 256).alias("items_sha256"),
                    ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated")))


SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, m, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT item, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s
        FROM (SELECT item, w, least(len(w), {WINDOW}) AS m FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, m, s, array_to_string(list_slice(w, s, s + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s
        FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
h AS (SELECT dw.doc_id, dw.s, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS p FROM (SELECT DISTINCT doc_id, s, m FROM h))
      GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
