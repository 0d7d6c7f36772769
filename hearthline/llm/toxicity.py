"""Toxicity: a two-state linear-chain conditional random field over the words of each line.

Labels are per document, so token labels are derived first: in documents labelled toxic, a word
is labelled T where it, or a leading part of it, is strongly associated with the label
(likelihood ratio over document frequencies); every other word is O. The CRF has weights for
words, their first and last letters, and transitions, fitted by gradient on the exact
forward-backward marginals. Marginals of a whole text are aggregated to a document score by a
logistic fit on the same sample, and words with a marginal of at least one half, joined where
they follow one another, are the offending spans.

The fit uses at most `labelled_bound` labelled documents per class (whole texts, on the driver);
scoring runs over all documents in tasks and needs no shuffle.

Edge cases: null or empty text has no words and gets the score of an empty sum; where either
class has no labelled text, every score is the share of toxic labels (0 without labels); null
labels are left out, repeated labels of a document count as toxic if any of them is; repeated
and null ids are scored like others; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.sampling import bounded_per_class, texts_of
from hearthline.llm.shipping import shipped

#: Labelled documents per class from which the model is fitted.
LABELLED_BOUND = 1200
HELD_OUT_FOLDS, HELD_OUT_FOLD = 5, 0
REMEMBERED_WORDS = 300_000
#: 2 x log likelihood ratio above which a word's link to the label is no accident.
ASSOCIATION = 14.0
#: How many times more of the toxic than of the clean documents must have the word.
LEAST_RATIO = 10.0
#: Marginals below this are noise and do not count towards a document.
NOISE = 0.05
TOKEN = re.compile(r"[^\W\d_]+|\n")
LINE_END = np.nan

SCORES = "doc_id long, score double, n_toxic_words long, spans array<struct<start:int,end:int,score:double>>"


def features(word: str) -> list[str]:
    w = word.lower()
    return ([f"w={w}"] + [f"p{k}={w[:k]}" for k in (3, 4, 5, 6, 7) if len(w) > k]
            + [f"s{k}={w[-k:]}" for k in (3, 4) if len(w) > k])


class Chains:
    """Lines of words as chains, laid out so that all chains advance one word at a time."""

    def __init__(self, ends: np.ndarray, total: int):
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
        lengths = ends - starts
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        self.starts, self.lengths, self.total = starts[order], lengths[order], total
        longest = int(self.lengths[0]) if len(order) else 0
        # how many chains have a word at step t (they come first, as the longest do)
        self.active = np.searchsorted(-self.lengths, -np.arange(longest), "left")

    def odds(self, gain: np.ndarray, trans: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
        """Forward ratios and backward ratios of every word.

        `gain` is exp of a word's score for T against O; `trans` the 2 x 2 exponentiated
        transition scores [from][to] with O first. Ratios are T against O.
        """
        (oo, ot), (to, tt) = trans
        ahead, back = np.zeros(self.total), np.ones(self.total)
        ratio = np.full(len(self.starts), start)
        for t, n in enumerate(self.active):
            at = self.starts[:n] + t
            if t:
                ratio[:n] = (ot + tt * ratio[:n]) / (oo + to * ratio[:n])
            ratio[:n] *= gain[at]
            ahead[at] = ratio[:n]
        later = np.ones(len(self.starts))
        for t in range(len(self.active) - 1, -1, -1):
            n = self.active[t]
            at = self.starts[:n] + t
            back[at] = later[:n]
            x = gain[at] * later[:n]
            later[:n] = (to + tt * x) / (oo + ot * x)
        return ahead, back


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    #: logistic weights of `document_features`
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))
    #: the one score there is where no model could be fitted
    constant: float | None = None

    def word_score(self, word: str) -> float:
        if word == "\n":
            return LINE_END
        return min(25.0, max(-25.0, self.bias + sum(self.weights.get(f, 0.0) for f in features(word))))

    def marginals(self, scores: np.ndarray) -> np.ndarray:
        """P(word is T) for words with `scores`; every chain ends in LINE_END, which gets 0."""
        ends = np.flatnonzero(np.isnan(scores))
        gain = np.exp(np.nan_to_num(scores))
        ahead, back = Chains(ends, len(scores)).odds(gain, np.exp(self.trans), np.exp(self.start))
        odds = ahead * back
        return odds / (1 + odds)

    def document_scores(self, p: np.ndarray, sizes: list[int]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(document_features(p, sizes) @ self.document, -30, 30)))


def document_features(p: np.ndarray, sizes) -> np.ndarray:
    """Summed marginals, largest marginal, toxic words and their density, per document."""
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    summed = np.add.reduceat(np.where(p < NOISE, 0.0, p), at)
    largest = np.clip(np.maximum.reduceat(p, at), 1e-6, 1 - 1e-6)
    sure = np.add.reduceat((p >= 0.5).astype(float), at)
    return np.stack([np.ones(len(at)), np.log1p(summed), np.log(largest / (1 - largest)) / 10, np.log1p(sure),
                     np.log(summed + 0.05) - np.log(np.asarray(sizes) + 20.0)], 1)


class WordScores(dict):
    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        self[word] = score = self.model.word_score(word)
        return score


def token_labels(texts: Iterable[list[str]], toxic: np.ndarray) -> set[str]:
    """Features (words and their first letters) strongly tied to the toxic label."""
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    seen: dict[str, list[int]] = {}
    for words, is_toxic in zip(texts, toxic):
        for f in {f for w in set(words) for f in features(w) if f[0] != "s"}:
            seen.setdefault(f, [0, 0])[0 if is_toxic else 1] += 1
    found = set()
    for f, (a, b) in seen.items():
        if a < 3 or a / n_toxic < LEAST_RATIO * (b + 0.2) / n_clean:
            continue
        p = (a + b) / (n_toxic + n_clean)
        ratio = 2 * (a * np.log(a / n_toxic / p) + (b * np.log(b / n_clean / p) if b else 0))
        if ratio >= ASSOCIATION:
            found.add(f)
    return found


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None, rounds: int = 60,
        ridge: float = 1e-2) -> ToxicityModel:
    """The CRF by Adam on the exact log likelihood, then the document logistic.

    `share` is the share of toxic among all labels; the sample may hold another. The driver holds
    the sample as numbers, a word once.
    """
    if not toxic.any() or toxic.all():
        return ToxicityModel(constant=float(toxic.mean()) if len(toxic) else 0.0)
    tied = token_labels(([w for w in TOKEN.findall(t) if w != "\n"] for t in texts), toxic)

    vocabulary: dict[str, int] = {}
    numbers, sizes = array("q"), []
    for text in texts:
        found = TOKEN.findall(text)
        found.append("\n")
        numbers.extend([vocabulary.setdefault(w.lower(), len(vocabulary)) for w in found])
        sizes.append(len(found))
    ids, sizes = np.frombuffer(numbers, np.int64), np.array(sizes)
    line_end = vocabulary["\n"]
    tied_word = np.zeros(len(vocabulary), bool)
    known: dict[str, int] = {}
    rows, columns = array("q"), array("q")
    for w, i in vocabulary.items():
        if w == "\n":
            continue
        own = features(w)
        tied_word[i] = any(f in tied for f in own)
        for f in own:
            rows.append(i)
            columns.append(known.setdefault(f, len(known)))
    rows, columns = np.array(rows), np.array(columns)
    # a feature of one word only says no more than the word itself
    often = np.bincount(columns) >= 2
    is_word = np.zeros(len(known), bool)
    is_word[[k for f, k in known.items() if f[0] == "w"]] = True
    keep = often | is_word
    rows, columns = rows[keep[columns]], columns[keep[columns]]

    words = ids != line_end
    gold = tied_word[ids] & np.repeat(toxic, sizes)
    chains = Chains(np.flatnonzero(~words), len(ids))
    n = int(words.sum())
    theta = np.zeros(len(known) + 5)  # weights, bias, OT, TO, TT, start
    theta[-5], theta[-1] = -4.0, -2.0
    first = np.zeros(len(ids), bool)
    first[chains.starts] = True
    follows = words & ~first
    before = np.flatnonzero(follows) - 1
    pair_gold = np.array([(~gold[before] & gold[follows]).sum(), (gold[before] & ~gold[follows]).sum(),
                          (gold[before] & gold[follows]).sum()], float)
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        word_score = np.bincount(rows, theta[columns], minlength=len(vocabulary)) + theta[-5]
        gain = np.exp(np.clip(word_score, -25, 25))[ids]
        trans = np.array([[1.0, np.exp(theta[-4])], [np.exp(theta[-3]), np.exp(theta[-2])]])
        ahead, back = chains.odds(gain, trans, np.exp(theta[-1]))
        p = ahead * back
        p /= 1 + p
        p[~words] = 0.0
        # expected transitions from the forward ratio of a word and the backward of the next
        a, x = ahead[before], gain[follows]
        x *= back[follows]
        joint = [trans[0, 1] * x, a * trans[1, 0], np.multiply(a, trans[1, 1], out=a)]
        joint[2] *= x
        total = np.add(joint[0], joint[1], out=x)
        total += joint[2]
        total += trans[0, 0]
        expected = np.array([np.divide(j, total, out=j).sum() for j in joint])
        del ahead, back, gain, a, x, joint, total
        error = np.bincount(ids, p - gold, minlength=len(vocabulary))
        gradient = np.zeros_like(theta)
        gradient[:-5] = np.bincount(columns, error[rows], minlength=len(known)) + ridge * theta[:-5]
        gradient[-5] = error.sum()
        gradient[-4:-1] = expected - pair_gold
        gradient[-1] = (p[first] - gold[first]).sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
        theta = theta - 0.3 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)

    strong = {f: float(theta[k]) for f, k in known.items() if keep[k] and abs(theta[k]) > 1e-4}
    model = ToxicityModel(strong, float(theta[-5]), np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]]), float(theta[-1]))
    del known, rows, columns, p, gold, words, first, follows, before, chains
    p = model.marginals(np.array([model.word_score(w) for w in vocabulary])[ids])
    x = document_features(p, sizes)
    y, beta = toxic.astype(float), np.zeros(x.shape[1])
    share = toxic.mean() if share is None else share
    weight = np.where(toxic, share / toxic.mean(), (1 - share) / (1 - toxic.mean()))
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x + 0.05 * np.eye(len(beta))
        beta = beta + np.linalg.solve(h, x.T @ (weight * (y - q)) - 0.05 * beta)
    model.document = beta
    return model


def fold(column: str, folds: int):
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, labelled_bound: int = LABELLED_BOUND) -> ToxicityModel:
    """A model from the labelled documents outside the held-out fold."""
    labelled = (labels.filter("toxic is not null and doc_id is not null")
                .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
                .filter(fold("doc_id", HELD_OUT_FOLDS) != HELD_OUT_FOLD))
    sample = texts_of(docs, bounded_per_class(labelled, "toxic", labelled_bound), "toxic").filter("text is not null")
    rows = sample.orderBy("doc_id", "text").collect()  # at most 2 x labelled_bound labelled documents
    share = labelled.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return fit([r["text"] for r in rows], np.array([r["toxic"] == 1 for r in rows], bool), share)


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Offending spans (code points, end exclusive) from the marginals of the text's tokens."""
    spans = []
    last = -2
    for i, m in enumerate(TOKEN.finditer(text)):
        if p[i] >= 0.5:
            if last == i - 1:
                spans[-1]["end"], spans[-1]["score"] = m.end(), max(spans[-1]["score"], float(p[i]))
            else:
                spans.append({"start": m.start(), "end": m.end(), "score": float(p[i])})
            last = i
    return spans


def chunks(texts: list, chunk_chars: int):
    """Consecutive texts of together about `chunk_chars` characters, with the first's index."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        part.append(text or "")
        size += len(part[-1])
        if size >= chunk_chars:
            yield first, part
            first, part, size = i + 1, [], 0
    if part:
        yield first, part


def scores_of(texts: list[str], crf: ToxicityModel, cache: WordScores):
    """Scores, toxic words and spans of `texts`."""
    if crf.constant is not None:
        return np.full(len(texts), crf.constant), np.zeros(len(texts), np.int64), [[] for _ in texts]
    parts, sizes = [], []
    for text in texts:
        found = TOKEN.findall(text)
        found.append("\n")
        parts.append(np.fromiter(map(cache.__getitem__, found), float, len(found)))
        sizes.append(len(found))
    p = crf.marginals(np.concatenate(parts))
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    n_words = np.add.reduceat((p >= 0.5).astype(np.int64), at)
    spans = [spans_of(t, p[a:a + n]) if k else [] for t, a, n, k in zip(texts, at, sizes, n_words)]
    return crf.document_scores(p, sizes), n_words, spans


def score_texts(docs: DataFrame, model: ToxicityModel, chunk_chars: int = 2_000_000) -> DataFrame:
    """doc_id, score, n_toxic_words and the offending spans of every row."""
    shared = shipped(docs.sparkSession, model)

    def run(batches):
        crf = shared()
        cache = WordScores(crf)
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            for at, texts in chunks(list(batch["text"]), chunk_chars):
                scores, n_words, spans = scores_of(texts, crf, cache)
                yield pd.DataFrame({"doc_id": ids.iloc[at:at + len(texts)].to_numpy(), "score": scores, "n_toxic_words": n_words,
                                    "spans": spans}).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, SCORES)


def without_toxic(docs: DataFrame, labels: DataFrame, labelled_bound: int = LABELLED_BOUND,
                  chunk_chars: int = 2_000_000) -> DataFrame:
    """`docs`, all columns as they are, without the documents that are predicted toxic."""
    shared = shipped(docs.sparkSession, learn(docs, labels, labelled_bound))

    def run(batches):
        crf = shared()
        cache = WordScores(crf)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keep = np.concatenate([scores_of(part, crf, cache)[0] < 0.5 for _, part in chunks(texts, chunk_chars)] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled_bound: int = LABELLED_BOUND) -> DataFrame:
    """doc_id, held_out, score, predicted, then the number of toxic words and their spans."""
    scored = score_texts(docs, learn(docs, labels, labelled_bound))
    return scored.select("doc_id", (fold("doc_id", HELD_OUT_FOLDS) == HELD_OUT_FOLD).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic_words", "spans")
