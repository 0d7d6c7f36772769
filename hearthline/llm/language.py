"""Language identification by prediction by partial matching (PPM).

Every language has a tree of byte contexts of order 0 to 3 with symbol counts from its sample.
A byte costs -log2(c / (T + D)) bits in the longest known context where it occurs (c its count,
T all counts, D distinct symbols there); every longer known context on the way costs an escape,
-log2(D / (T + D)) (method C); below order 0 a byte costs 8 bits. The statistics are frozen, so
the cost of every (context, byte) is worked out once, and a text's code length per language is a
sum of table entries. The shortest code names the language; the score is its share when code
lengths are turned back into probabilities.

The trees are fitted on whole texts of at most `labelled_bound` labelled documents a language.
n-grams are counted in tasks and summed by Spark; only the counts reach the driver. Scoring runs
over all documents in tasks without a shuffle.

Edge cases: null texts and texts without a letter are `und` with score 0, as is everything when
no labelled text exists; ties go to the first language by name; repeated rows and null ids are
scored like others; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.sampling import bounded_per_class, texts_of
from hearthline.llm.shipping import shipped
from hearthline.llm.toxicity import fold

LABELLED_BOUND = 1500
HELD_OUT_FOLDS, HELD_OUT_FOLD = 3, 1
#: Contexts of order 3 need so many occurrences to be kept.
LEAST_COUNT = 6
UNDETERMINED = "und"
PAD = b"\n\n\n"
PREDICTIONS = "doc_id long, lang_pred string, score double, bits array<double>"


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter; fractions, superscripts and circled digits are none."""
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, 4-byte gram (big-endian number) and its count."""
    def run(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                data = np.frombuffer(b"".join(PAD + t.encode() for t in texts), np.uint8).astype(np.uint32)
                if len(data) < 4:
                    continue
                grams = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
                found, n = np.unique(grams, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": found.astype(np.int64), "n": n})

    return (sample.select("lang", "text").mapInPandas(run, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class ContextTrees:
    """Costs in bits of every (context node, symbol), per language."""

    languages: list[str]
    symbols: np.ndarray  # byte -> symbol, 0 for bytes no language has
    node_of: np.ndarray  # three symbols -> context node
    costs: np.ndarray  # (node * symbols + symbol, language)
    size: int

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code lengths of `texts`: a row a text, a column a language."""
        out = np.zeros((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            s = self.symbols[np.frombuffer(PAD + text.encode("utf-8", "replace"), np.uint8)]
            for at in range(0, len(s) - 3, 1 << 20):
                part = s[at:at + (1 << 20) + 3].astype(np.int32)
                node = self.node_of[(part[:-3] * self.size + part[1:-2]) * self.size + part[2:-1]]
                out[i] += self.costs[node * self.size + part[3:]].sum(0, dtype=np.float64)
        return out


def order_costs(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Costs in contexts with `counts` (context, symbol) above the costs one order below."""
    total, distinct = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = -np.log2(counts / (total + distinct))
        escaped = -np.log2(distinct / (total + distinct)) + shorter
    return np.where(total == 0, shorter, np.where(counts > 0, seen, escaped))


def build_trees(counts: pd.DataFrame, least_count: int = LEAST_COUNT) -> ContextTrees:
    """Frozen cost tables from (lang, gram, n)."""
    counts = counts.sort_values(["lang", "gram"])
    languages = sorted(counts["lang"].unique())
    gram = counts["gram"].to_numpy(np.int64)
    used = np.unique(np.concatenate([(gram >> shift) & 255 for shift in (0, 8, 16, 24)] + [np.array([10])]))
    symbols = np.zeros(256, np.uint8 if len(used) < 255 else np.int16)
    symbols[used] = np.arange(1, len(used) + 1)
    size = len(used) + 1
    s = [symbols[(gram >> shift) & 255].astype(np.int64) for shift in (24, 16, 8, 0)]
    n = counts["n"].to_numpy(float)
    context3 = (s[0] * size + s[1]) * size + s[2]
    context2 = s[1] * size + s[2]
    totals = pd.Series(n).groupby(context3).sum()
    nodes3 = totals.index[totals >= least_count].to_numpy(np.int64)
    nodes2 = np.unique(context2)
    # nodes: order 0, order 1 by symbol, order 2, order 3
    node_of = np.zeros((size, size, size), np.int32)
    node_of[:, :, :] = 1 + np.arange(size)
    node_of[:, nodes2 // size, nodes2 % size] = 1 + size + np.arange(len(nodes2))
    node_of.reshape(-1)[nodes3] = 1 + size + len(nodes2) + np.arange(len(nodes3))
    costs = np.empty((1 + size + len(nodes2) + len(nodes3), size, len(languages)), np.float32)
    lang = counts["lang"].to_numpy()
    for k, name in enumerate(languages):
        own = lang == name

        def table(rows: int, index: np.ndarray, ok: np.ndarray) -> np.ndarray:
            flat = np.bincount(index[ok] * size + s[3][own][ok], n[own][ok], minlength=rows * size)
            return flat.reshape(rows, size)

        everything = np.ones(int(own.sum()), bool)
        zero = order_costs(table(1, np.zeros(int(own.sum()), np.int64), everything), np.full((1, size), 8.0))
        one = order_costs(table(size, s[2][own], everything), np.repeat(zero, size, 0))
        two = order_costs(table(len(nodes2), np.searchsorted(nodes2, context2[own]), everything), one[nodes2 % size])
        at = np.minimum(np.searchsorted(nodes3, context3[own]), max(len(nodes3) - 1, 0))
        ok = nodes3[at] == context3[own] if len(nodes3) else np.zeros(int(own.sum()), bool)
        three = order_costs(table(len(nodes3), at, ok), two[np.searchsorted(nodes2, nodes3 % (size * size))])
        costs[:, :, k] = np.concatenate([zero, one, two, three])
    return ContextTrees(languages, symbols, node_of.reshape(-1), costs.reshape(-1, len(languages)), size)


def learn(docs: DataFrame, labelled_bound: int = LABELLED_BOUND) -> ContextTrees | None:
    """Trees from labelled texts outside the held-out fold; None where there are none."""
    labelled = (docs.filter("text is not null and lang is not null and doc_id is not null")
                .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
                .filter(fold("doc_id", HELD_OUT_FOLDS) != HELD_OUT_FOLD))
    sample = bounded_per_class(labelled, "lang", labelled_bound)
    counts = gram_counts(texts_of(docs, sample, "lang").filter("text is not null")).toPandas()
    return build_trees(counts) if len(counts) else None


def predict_language(docs: DataFrame, labelled_bound: int = LABELLED_BOUND) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the code length of every language in bits."""
    shared = shipped(docs.sparkSession, learn(docs, labelled_bound))

    def run(batches):
        trees = shared()
        for batch in batches:
            texts = list(batch["text"])
            known = np.array([bool(trees and has_letter(t)) for t in texts], bool)
            names, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            lengths: list = [None] * len(texts)
            if known.any():
                bits = trees.bits([t for t, k in zip(texts, known) if k])
                best = bits.argmin(1)
                names[known] = np.array(trees.languages, object)[best]
                scores[known] = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                for i, row in zip(np.flatnonzero(known), bits):
                    lengths[i] = row.tolist()
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "lang_pred": names, "score": scores, "bits": lengths})

    predicted = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, PREDICTIONS)
    return predicted.select("doc_id", (fold("doc_id", HELD_OUT_FOLDS) == HELD_OUT_FOLD).alias("held_out"),
                            "lang_pred", "score", "bits")
