"""MinHash near-dedup: bottom-k sketches from one hash function, verified exactly.

A document's set is its distinct 5-word shingles; their 64-bit hashes are that set, and the 128
smallest are its bottom-k sketch. Equal sets are one class. Retained values make inverted
lists, and classes that meet in a list are candidates if 256 one-bit minima of the same hash,
compared within the join, allow the similarity. Which values need a list follows from
the threshold: sketches of a linked pair share at least SHARED of SKETCH values, so any order
that all sketches agree on gives both a common value among the first SKETCH - SHARED + 1 (sets
that the sketch holds whole: among the first n - ceil(t n) + 1, without any chance). The order
is rarest first by a counting table of fixed size, so values of widely shared passages need no
list. Candidates pass a similarity estimate on the smallest values of both sketches' union and
an exact comparison of the full sets.

Components need fewer pairs than links: in every list one class leads and is compared with
the others (star), components are found, and again among classes that are not yet together;
what then still lies apart in a list is compared directly. A pair is left uncompared only
where both are in one component already, so no component is lost.

Edge cases: null and blank texts have empty sets, link with nothing and are kept; texts under
five words are one shingle; repeated rows link with each other (component_id is the smallest
doc_id); rows without doc_id are never linked; an empty table gives no rows; columns besides
`doc_id` and `text` are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.graph import connected_components
from hearthline.llm.lists import apart_pairs, broadcast_if_small, labelled, others, sizes_allow, star_pairs
from hearthline.llm.shipping import shipped
from hearthline.session import cut_lineage

WORDS_PER_SHINGLE = 5
#: Similarity in percent.
THRESHOLD = 85
SKETCH, SHARED = 128, 86
#: Standard errors below the threshold at which an estimate still goes to the exact check.
SLACK = 5.0
FREQUENCY_BITS = 17
STAR_ROUNDS = 2
#: One-bit minima of a set. At similarity 0.85 some MEAN_DIFFERING of them differ at most on average;
#: the variance depends on the size of the smaller set (VARIANCE and VARIANCE_BY_SIZE, from simulated
#: pairs of 128 to 3,000 shingles). A pair is let through up to so many deviations above the mean.
BITS, MEAN_DIFFERING, VARIANCE, VARIANCE_BY_SIZE, DEVIATIONS = 256, 20.0, 17.0, 4400.0, 8.0
#: Sets smaller than this are not tested by bits.
LEAST_FOR_BITS = 128
REMEMBERED_WORDS = 250_000

SETS = "doc_id long, row_id long, n_shingles long, hi long, lo long, bits array<long>, sketch binary"

#: Lower ends of BITS equal ranges of hashes.
RANGES = np.arange(BITS, dtype=np.uint64) << np.uint64(56)


class WordHashes(dict):
    """64-bit hashes of words; a worker remembers the recent ones."""

    def __init__(self):
        super().__init__()
        self.older: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        value = self.older.get(word)
        if value is None:
            value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= REMEMBERED_WORDS:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                        0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_set(text: str | None, hashes: WordHashes, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(width, len(a))
    h = np.full(len(a) - width + 1, (width * int(MULTIPLIERS[5])) % (1 << 64), np.uint64)
    for k in range(width):
        h += a[k:len(a) - width + 1 + k] * MULTIPLIERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def minimum_bits(h: np.ndarray) -> list[int]:
    """One bit of the smallest hash in each of BITS equal ranges, packed into longs. The ranges are
    those of a mixed hash; an empty range takes the bit of the next one that is not."""
    mixed = np.sort(h * MULTIPLIERS[0] ^ (h >> np.uint64(31)))
    at = np.searchsorted(mixed, RANGES)
    empty = at == np.append(at[1:], len(mixed))
    following = np.where(empty, 2 * BITS, np.arange(BITS))
    following = np.minimum.accumulate(np.append(following, following + BITS)[::-1])[::-1][:BITS] % BITS
    bits = ((mixed[at[following]] * MULTIPLIERS[1]) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def nullable(ids: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in ids]


def sketched(docs: DataFrame, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """Per document the size and digest of its set, and its sketch."""
    def run(batches):
        hashes, row = WordHashes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            out = []
            for doc_id, text in zip(nullable(batch["doc_id"]), batch["text"]):
                h = shingle_set(text, hashes, width)
                hi, lo = np.frombuffer(hashlib.md5(h.tobytes()).digest(), np.int64).tolist() if len(h) else (None, None)
                out.append((doc_id, row, len(h), hi, lo, minimum_bits(h) if len(h) else [], h[:SKETCH].tobytes()))
                row += 1
            yield pd.DataFrame(out, columns=["doc_id", "row_id", "n_shingles", "hi", "lo", "bits", "sketch"]).astype(
                {"doc_id": "Int64", "hi": "Int64", "lo": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SETS)


def frequency_table(classes: DataFrame, bits: int = FREQUENCY_BITS) -> np.ndarray:
    """How many sketch values fall on each of 2^bits counters, over all classes."""
    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            values = np.frombuffer(b"".join(batch["sketch"]), np.uint64)
            counts += np.bincount((values & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": at, "n": counts[at]})

    rows = (classes.select("sketch").mapInPandas(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
            .toPandas())  # at most 2^bits rows
    table = np.zeros(1 << bits, np.int64)
    table[rows["slot"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return table


def listed_values(sketch: np.ndarray, n: int, frequency: np.ndarray, threshold: int) -> np.ndarray:
    """The retained values of a sketch that need an inverted list: its rarest ones."""
    if n * 100 <= threshold * SKETCH:  # a linked set is no longer than SKETCH: both are whole
        need = n - (threshold * n + 99) // 100 + 1
    else:
        need = SKETCH - SHARED + 1
    order = np.lexsort((sketch, frequency[(sketch & np.uint64(len(frequency) - 1)).astype(np.int64)]))
    return sketch[order[:need]]


def inverted_lists(classes: DataFrame, frequency: np.ndarray, threshold: int) -> DataFrame:
    """value, node and set size of every entry of a list that two classes share."""
    table = shipped(classes.sparkSession, frequency)

    def run(batches):
        counts = table()
        for batch in batches:
            values = [listed_values(np.frombuffer(s, np.uint64), n, counts, threshold)
                      for s, n in zip(batch["sketch"], batch["n_shingles"])]
            sizes = [len(v) for v in values]
            if sum(sizes):
                yield pd.DataFrame({"value": np.concatenate(values).view(np.int64),
                                    "node": np.repeat(batch["node"].to_numpy(np.int64), sizes),
                                    "n": np.repeat(batch["n_shingles"].to_numpy(np.int64), sizes),
                                    "bits": np.repeat(batch["bits"].to_numpy(), sizes)})

    entries = cut_lineage(classes.mapInPandas(run, "value long, node long, n long, bits array<long>"))
    shared = entries.groupBy("value").agg(F.count("*").alias("entries")).filter("entries > 1").select("value")
    return entries.join(shared, "value").select("value", "node", F.struct("n", "bits").alias("about"))


def most_differing(n):
    """How many one-bit minima of a linked pair may differ, by the size of the smaller set."""
    return MEAN_DIFFERING + DEVIATIONS * F.sqrt(VARIANCE + VARIANCE_BY_SIZE / n)


def could_link(threshold: int):
    """Sizes allow the similarity, and so do the one-bit minima."""
    def near(x, y):
        differing = reduce(add, [F.bit_count(x["bits"][k].bitwiseXOR(y["bits"][k])) for k in range(BITS // 64)])
        smaller = F.least(x["n"], y["n"])
        return sizes_allow(x["n"], y["n"], threshold) & ((smaller < LEAST_FOR_BITS) | (differing <= most_differing(smaller)))
    return near


def estimated(pairs: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """Pairs whose union sketch does not speak against the threshold."""
    def side(name):
        return classes.select(F.col("node").alias(name), F.col("sketch").alias(f"{name}_sketch"))

    least = threshold / 100 - SLACK * (threshold / 100 * (1 - threshold / 100) / SKETCH) ** 0.5

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch["a_sketch"], batch["b_sketch"]):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                union = np.union1d(a, b)[:SKETCH]
                both = np.intersect1d(a, b, assume_unique=True)
                both = np.searchsorted(both, union[-1], "right")
                keep.append(both >= least * len(union) if len(union) == SKETCH else 100 * both >= threshold * len(union))
            yield batch.loc[keep, ["a", "b"]]

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_sketch", "b_sketch").mapInPandas(
        run, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """The pairs whose full sets, built from whole texts again, reach the threshold."""
    wanted = broadcast_if_small(cut_lineage(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()))
    texts = (docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
             .join(wanted, "node"))

    def full(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"],
                                "full_set": [shingle_set(t, hashes, width).tobytes() for t in batch["text"]]})

    sets = cut_lineage(texts.mapInPandas(full, "node long, full_set binary"))

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch["a_set"], batch["b_set"]):
                both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
                keep.append(100 * both >= threshold * ((len(a) + len(b)) // 8 - both))
            yield batch.loc[keep, ["a", "b"]]

    def side(name):
        return sets.select(F.col("node").alias(name), F.col("full_set").alias(f"{name}_set"))

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_set", "b_set").mapInPandas(
        run, "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = WORDS_PER_SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row."""
    spark = docs.sparkSession
    every = cut_lineage(sketched(docs, width))
    usable = every.filter("n_shingles > 0 and doc_id is not null")
    first = usable.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "row_id")).alias("first"))
    first = first.select("hi", "lo", F.col("first.doc_id").alias("node"), F.col("first.row_id").alias("row_id"))
    # a class is named by its smallest doc_id; an id with several texts is one node
    classes = cut_lineage(usable.join(first.select("row_id", "node"), "row_id")
                          .select("node", "n_shingles", "bits", "sketch"))
    lists = cut_lineage(inverted_lists(classes, frequency_table(classes), threshold))
    components = spark.createDataFrame([], "node long, component long")
    near = could_link(threshold)
    links = compared = None
    for step in range(STAR_ROUNDS + 1):
        parted = labelled(lists, components)
        if step == 0:
            pairs = star_pairs(parted, parted, near)
        elif step < STAR_ROUNDS:
            pairs = star_pairs(parted, others(parted), near)
        else:
            pairs = apart_pairs(parted, near)
        if links is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        tried = cut_lineage(pairs)
        if tried.isEmpty():  # the leaders have nobody left to try, other members may
            continue
        likely = cut_lineage(estimated(tried, classes, threshold))
        found = cut_lineage(verified(likely, docs, threshold, width))
        compared = tried if links is None else cut_lineage(compared.union(tried))
        links = found if links is None else links.union(found)
        components = cut_lineage(connected_components(links, "a", "b"))
    named = first.select("hi", "lo", "node").join(components.withColumnRenamed("component", "root"), "node", "left").select(
        F.col("hi").alias("class_hi"), F.col("lo").alias("class_lo"), F.coalesce("root", "node").alias("root"))
    result = every.join(named, (F.col("hi") == F.col("class_hi")) & (F.col("lo") == F.col("class_lo"))
                        & F.col("doc_id").isNotNull(), "left")
    return result.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"),
                         F.coalesce(F.col("doc_id") == F.coalesce("root", "doc_id"), F.lit(True)).alias("kept"))
