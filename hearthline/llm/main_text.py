"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is the sequence of its leaf blocks (`dom`). Each block is MAIN or OTHER; the field has
weights for features of the block (tags, class names and roles of the elements above it, whether
the page has an article that this block is not in, length, share of links, punctuation, the words
of short blocks) and for the transitions between neighbours. It is fitted by gradient on exact
forward-backward marginals over labelled pages (`labelled_pages`), and whole pages are decoded
by Viterbi. The blocks found to be MAIN, in page order, are the text.

The fit uses at most `labelled_bound` pages of the table, drawn by the hash of page_id, as sources
of labelled pages; it happens on the driver. Extraction runs over all pages in tasks, without a
shuffle, each page whole.

Edge cases: null or empty html and pages without text give an empty text; null and repeated ids
and urls are handled row by row; where no sampled page labels itself the layouts are filled with
stated example sentences; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.dom import Block, blocks
from hearthline.llm.labelled_pages import INSIDE, MAIN, labelled_pages, tags_of
from hearthline.llm.shipping import shipped
from hearthline.llm.toxicity import Chains

#: Pages of the table from which labelled pages are made, layouts for each, and layouts at least.
LABELLED_BOUND, LAYOUTS_PER_PAGE, LEAST_LAYOUTS = 200, 6, 1200
#: Gradient steps, penalty of a weight (words, which are many and say little, a stronger one), and
#: how often a feature must occur in the labelled pages.
ROUNDS, RIDGE, WORD_RIDGE, LEAST_SEEN = 150, 0.01, 3.0, 3
REMEMBERED_PATHS = 50_000
SECTIONS = INSIDE | {"nav", "header", "footer", "aside", "form", "section", "dialog", "figure", "table"}
WORD = re.compile(r"[^\W\d_]+")
NAME = re.compile(r"[a-z]+")
SENTENCE_END = re.compile(r"[.!?…。！？](?:\s|$)")
RESULT = "page_id long, url string, text string, n_chars long, n_blocks long, n_main long"


def in_article(path: str) -> bool:
    return bool(INSIDE & set(tags_of(path)))


def path_features(path: str, page_has_article: bool) -> list[str]:
    elements = [e.partition(">")[::2] for e in path.split("/")[1:]]
    tags = [t for t, _ in elements]
    leaf, above = (tags or [""])[-1], (["", "", *tags])[-2]
    section = next((t for t in reversed(tags) if t in SECTIONS), "")
    found = {f"leaf={leaf}", f"pair={above}/{leaf}", f"section={section}", f"section={section}/{leaf}"}
    found |= {f"above={t}" for t in tags[:-1]}
    if page_has_article:
        inner = [i for i, t in enumerate(tags) if t in INSIDE]
        found.add("outside" if not inner else "inside")
        if inner:
            found |= {f"within={t}" for t in tags[inner[0] + 1:]} | {f"over={t}" for t in tags[:inner[0]]}
    for i, (_, attributes) in enumerate(elements):
        lowered = attributes.lower()
        for name in NAME.findall(lowered):
            found |= {f"name={name}", f"stem={name[:5]}"}
            found.add(f"{'own' if i == len(elements) - 1 else 'parent' if i == len(elements) - 2 else 'far'}={name}")
            if page_has_article and inner and i > inner[0]:
                found.add(f"within-name={name}")
        if "~hidden" in lowered:
            found.add("hidden")
    return sorted(found)


def text_features(leaf: str, text: str, link_chars: int) -> tuple[str, ...]:
    n = len(text)
    size, links = min(n.bit_length(), 10), min(4, 5 * link_chars // n)
    ends = len(SENTENCE_END.findall(text, 0, 4000))
    return (f"size={size}", f"size={size}/{leaf}", f"links={links}", f"links={links}/{leaf}", f"ends={min(ends, 3)}",
            f"last={'letter' if text[-1].isalnum() else text[-1]}", "©" if "©" in text else "no ©",
            f"sentences={min(ends, 3)}/{size}")


def word_features(text: str) -> list[str]:
    """Words of short blocks."""
    if len(text) > 60:
        return []
    return sorted({f"word={w}" for w in WORD.findall(text.lower())})


def block_features(page: list[Block]) -> list[list[str]]:
    has_article = any(in_article(b.path) for b in page)
    return [path_features(b.path, has_article) + list(text_features(b.path.rsplit("/", 1)[-1].split(">", 1)[0], b.text, b.link_chars))
            + word_features(b.text) for b in page]


@dataclass
class PageField:
    """Weights for MAIN against OTHER; transitions [from][to] with OTHER first."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0


class Scorer:
    """Scores of blocks; sums over paths and over text shapes are remembered."""

    def __init__(self, model: PageField):
        self.model, self.paths, self.shapes = model, {}, {}

    def total(self, features: Iterable[str]) -> float:
        weights = self.model.weights
        return sum(weights.get(f, 0.0) for f in features)

    def scores(self, page: list[Block]) -> list[float]:
        if len(self.paths) > REMEMBERED_PATHS:
            self.paths.clear()
        has_article, out = any(in_article(p) for p in {b.path for b in page}), []
        for block in page:
            key = (block.path, has_article)
            known = self.paths.get(key)
            if known is None:
                leaf = block.path.rsplit("/", 1)[-1].split(">", 1)[0]
                known = self.paths[key] = (leaf, self.total(path_features(*key)) + self.model.bias)
            leaf, score = known
            shape = text_features(leaf, block.text, block.link_chars)
            of_shape = self.shapes.get(shape)
            if of_shape is None:
                of_shape = self.shapes[shape] = self.total(shape)
            out.append(score + of_shape + self.total(word_features(block.text)))
        return out

    def decode(self, page: list[Block]) -> list[int]:
        return viterbi(self.scores(page), self.model.transitions, self.model.start)


def viterbi(scores: list[float], transitions: np.ndarray, start: float) -> list[int]:
    """The most likely labels of a chain; ties go to OTHER."""
    if not scores:
        return []
    (oo, om), (mo, mm) = transitions.tolist()
    other, main, back = 0.0, start + scores[0], []
    for score in scores[1:]:
        from_other, from_main = main + mo <= other + oo, main + mm > other + om
        back.append((0 if from_other else 1, 1 if from_main else 0))
        other, main = (other + oo if from_other else main + mo), (main + mm if from_main else other + om) + score
    labels = [int(main > other)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS) -> PageField:
    """The field by Adam on the exact log likelihood of the labelled pages."""
    known: dict[str, int] = {}
    rows, columns, gold, ends = [], [], [], []
    for page, labels in pages:
        for own, label in zip(block_features(page), labels):
            rows += [len(gold)] * len(own)
            columns += [known.setdefault(f, len(known)) for f in own]
            gold.append(label == MAIN)
        ends.append(len(gold))
        gold.append(False)  # the slot that ends a chain
    rows, columns = np.array(rows, np.int32), np.array(columns, np.int32)
    keep = np.bincount(columns, minlength=len(known))[columns] >= LEAST_SEEN
    rows, columns, gold = rows[keep], columns[keep], np.array(gold)
    total = len(gold)
    chains = Chains(np.array(ends), total)
    real, first = np.ones(total, bool), np.zeros(total, bool)
    real[ends] = False
    first[chains.starts] = True
    later = np.flatnonzero(real & ~first)
    before = later - 1
    pair_gold = np.array([(~gold[before] & gold[later]).sum(), (gold[before] & ~gold[later]).sum(), (gold[before] & gold[later]).sum()], float)
    ridge = np.array([WORD_RIDGE if f.startswith("word=") else RIDGE for f in known])
    theta = np.zeros(len(known) + 5)  # weights, bias, transitions OM, MO, MM, start
    m = v = np.zeros_like(theta)
    for step in range(1, rounds + 1):
        score = np.clip(np.bincount(rows, theta[columns], minlength=total) + theta[-5], -30, 30)
        gain = np.exp(score)
        trans = np.exp(np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]]))
        ahead, back = chains.odds(gain, trans, np.exp(theta[-1]))
        p = np.where(real, ahead * back / (1 + ahead * back), 0.0)
        a, x = ahead[before], gain[later] * back[later]
        joint = np.stack([trans[0, 1] * x, a * trans[1, 0], a * trans[1, 1] * x])
        error = p - gold
        gradient = np.zeros_like(theta)
        gradient[:-5] = np.bincount(columns, error[rows], minlength=len(known)) + ridge * theta[:-5]
        gradient[-5] = error.sum()
        gradient[-4:-1] = (joint / (trans[0, 0] + joint.sum(0))).sum(1) - pair_gold + RIDGE * theta[-4:-1]
        gradient[-1] = (p[first] - gold[first]).sum()
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient ** 2
        theta = theta - 0.2 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    weights = {f: float(theta[k]) for f, k in known.items() if abs(theta[k]) > 1e-4}
    return PageField(weights, float(theta[-5]), np.array([[0.0, theta[-4]], [theta[-3], theta[-2]]]), float(theta[-1]))


def learn(pages: DataFrame, labelled_bound: int = LABELLED_BOUND, layouts_per_page: int = LAYOUTS_PER_PAGE,
          least_layouts: int = LEAST_LAYOUTS) -> PageField:
    """The field from labelled pages made of at most `labelled_bound` pages of the table."""
    drawn = F.xxhash64(F.col("page_id").cast("long"))
    rows = pages.filter("html is not null").select(drawn.alias("draw"), F.col("html").cast("string").alias("html"))
    chosen = [r.draw for r in rows.groupBy("draw").agg(F.count("*")).orderBy("draw").limit(labelled_bound).collect()]
    sample = rows.filter(F.col("draw").isin(chosen)).groupBy("draw").agg(F.min("html").alias("html")).orderBy("draw")
    return fit(labelled_pages([r.html for r in sample.toLocalIterator()] if chosen else [], layouts_per_page, least_layouts))


def main_blocks(html: str | None, scorer: Scorer) -> tuple[list[str], int]:
    """Texts of the MAIN blocks, and the number of all blocks."""
    found = blocks(html or "")
    return [b.text for b, label in zip(found, scorer.decode(found)) if label == MAIN], len(found)


def extract_main_text(pages: DataFrame, model: PageField | None = None, labelled_bound: int = LABELLED_BOUND) -> DataFrame:
    """page_id, url, the main text and its code points, then the page's blocks and those kept."""
    shared = shipped(pages.sparkSession, model or learn(pages, labelled_bound))

    def run(batches):
        scorer = Scorer(shared())
        for batch in batches:
            texts, n_blocks, n_main = [], [], []
            for html in batch.column(2):
                kept, n = main_blocks(html.as_py(), scorer)
                texts.append("\n\n".join(kept))
                n_blocks.append(n)
                n_main.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()),
                 pa.array(n_blocks, pa.int64()), pa.array(n_main, pa.int64())], names=names)

    names = [c.split()[0] for c in RESULT.split(", ")]
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, RESULT)
