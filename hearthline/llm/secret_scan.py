"""Secret scan: fixed patterns, and formats learned by grammar inference.

Three fixed patterns give the base spans: assignments of a value to a secret's name, access key
ids and hexadecimal strings. The values they find are labelled credentials; per kind a
probabilistic automaton is inferred from them (ALERGIA): the tree of their prefixes over classes
of characters, whose states are merged where the frequencies of their endings and next symbols
are statistically compatible, all the way down. Every other token with a digit is then scored by
its likelihood per character under each automaton and under a model of plain tokens; where a
format explains it better, and no worse than the credentials it was learned from, its span is
added. Base spans are never taken back.

The automata are fitted on at most `credential_bound` different values a kind, drawn by hash from
all documents; the model of plain tokens counts all of them, as often as they occur. Scanning runs over whole texts in tasks, without a shuffle.

Edge cases: null text is empty and has no spans; without credentials nothing is added; offsets
count code points, end exclusive; repeated rows and null ids are scanned like others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.sampling import bounded_per_class
from hearthline.llm.shipping import shipped
from hearthline.session import cut_lineage

#: The fixed patterns: kind, pattern, the group whose length counts, and the least length.
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
]
KINDS = [kind for kind, *_ in BASE]
ADDED = "grammar"
#: `[0-9a-f]+` matches whole runs, so those of the least length are found at once.
COMPILED = [(kind, re.compile(r"[0-9a-f]{16,}" if kind == "hex" else pattern, re.ASCII), group, least)
            for kind, pattern, group, least in BASE]
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{12,}")
PLAIN = re.compile(r"[A-Za-z0-9+/_=-]{6,}")
CREDENTIAL_BOUND = 300
#: Significance of the compatibility test; smaller merges more.
ALPHA = 0.05
UNSEEN = 1e-4

SPANS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long"


def symbol(c: str) -> str:
    if c in "0123456789":
        return "d"
    if c in "abcdef":
        return "h"
    if c in "ABCDEF":
        return "H"
    return "l" if c.islower() else "U" if c.isupper() else c


def symbols(token: str) -> str:
    return "".join(map(symbol, token))


#: `symbol` for all characters of PLAIN.
SYMBOL_TABLE = {c: symbol(chr(c)) for c in range(128)}


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, value) of the fixed patterns, in order."""
    found = []
    for k, (_, pattern, group, least) in enumerate(COMPILED):
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                found.append((m.start(), k, m.end(), m.group(group)))
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]):
    """Tokens with a digit that no base span touches."""
    at, reach = 0, 0  # base spans that begin before the token's end reach so far
    for m in CANDIDATE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][2])
            at += 1
        if reach <= m.start():
            yield m


@dataclass
class Automaton:
    """A probabilistic automaton: per state its visits, endings and counted transitions."""

    visits: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, list[int]]] = field(default_factory=lambda: [{}])
    least: float = 0.0

    def add(self, word: str) -> None:
        state = 0
        self.visits[0] += 1
        for s in word:
            if s not in self.moves[state]:
                self.visits.append(0)
                self.ends.append(0)
                self.moves.append({})
                self.moves[state][s] = [len(self.visits) - 1, 0]
            move = self.moves[state][s]
            move[1] += 1
            state = move[0]
            self.visits[state] += 1
        self.ends[state] += 1

    def alike(self, a: int, b: int, margin: float) -> bool:
        """Whether two states end and go on alike, and so do all states below them."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            n, m = self.visits[a], self.visits[b]
            if not n or not m:
                continue
            bound = margin * (n ** -0.5 + m ** -0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            for s in self.moves[a].keys() | self.moves[b].keys():
                x, y = self.moves[a].get(s), self.moves[b].get(s)
                if abs((x[1] if x else 0) / n - (y[1] if y else 0) / m) > bound:
                    return False
                if x and y:
                    pairs.append((x[0], y[0]))
        return True

    def fold(self, into: int, state: int) -> None:
        pairs = [(into, state)]
        while pairs:
            a, b = pairs.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for s, (target, n) in self.moves[b].items():
                if s in self.moves[a]:
                    self.moves[a][s][1] += n
                    pairs.append((self.moves[a][s][0], target))
                else:
                    self.moves[a][s] = [target, n]

    def merge_states(self, alpha: float = ALPHA) -> None:
        margin = math.sqrt(0.5 * math.log(2 / alpha))
        settled = [0]
        while True:
            known = set(settled)
            edge = next(((r, s) for r in settled for s in sorted(self.moves[r]) if self.moves[r][s][0] not in known), None)
            if edge is None:
                return
            move = self.moves[edge[0]][edge[1]]
            fresh = move[0]
            match = next((r for r in settled if self.alike(r, fresh, margin)), None)
            if match is None:
                settled.append(fresh)
            else:
                move[0] = match
                self.fold(match, fresh)

    def score(self, word: str) -> float:
        """Natural log likelihood per symbol, the end included."""
        state, total = 0, 0.0
        for s in word:
            move = self.moves[state].get(s) if state is not None else None
            if move is None:
                state = None
                total += math.log(UNSEEN)
            else:
                total += math.log(max(UNSEEN, move[1] / self.visits[state]))
                state = move[0]
        end = self.ends[state] / self.visits[state] if state is not None else 0.0
        return (total + math.log(max(UNSEEN, end))) / (len(word) + 1)


def infer(words: list[str], alpha: float = ALPHA) -> Automaton:
    """An automaton of `words`; its least score is that of the lowest hundredth of them."""
    automaton = Automaton()
    coded = sorted(map(symbols, words))
    for word in coded:
        automaton.add(word)
    automaton.merge_states(alpha)
    automaton.least = sorted(map(automaton.score, coded))[len(coded) // 100]
    return automaton


class PlainModel:
    """Symbol pairs of plain tokens, with one count added to each."""

    def __init__(self, pairs: dict[str, int]):
        self.pairs = pairs
        self.firsts: dict[str, int] = {}
        for pair, n in pairs.items():
            self.firsts[pair[0]] = self.firsts.get(pair[0], 0) + n

    def score(self, word: str) -> float:
        total = sum(math.log((self.pairs.get(a + b, 0) + 1) / (self.firsts.get(a, 0) + 14))
                    for a, b in zip("^" + word, word + "$"))
        return total / (len(word) + 1)


@dataclass
class Grammars:
    automata: dict[str, Automaton]
    plain: PlainModel
    scored: dict[str, bool] = field(default_factory=dict)

    def is_credential(self, token: str) -> bool:
        word = symbols(token)
        if word not in self.scored:
            if len(self.scored) > 100_000:
                self.scored.clear()
            best = max((a.score(word) - a.least for a in self.automata.values()), default=-1.0)
            likelihood = max((a.score(word) for a in self.automata.values()), default=-math.inf)
            self.scored[word] = best >= 0 and likelihood > self.plain.score(word)
        return self.scored[word]


def symbol_pairs(tokens: Counter) -> Counter:
    """Pairs of neighbouring symbols in counted tokens, their ends included."""
    words: Counter = Counter()
    for token, n in tokens.items():
        words[token.translate(SYMBOL_TABLE)] += n
    pairs: Counter = Counter()
    for word, n in words.items():
        for a, b in zip("^" + word, word + "$"):
            pairs[a + b] += n
    return pairs


def labelled_values(docs: DataFrame) -> DataFrame:
    """Different values of the fixed patterns by kind, and all symbol pairs of plain tokens (kind
    'plain'), with their counts. The alphabet bounds the pairs."""
    def run(batches):
        for batch in batches:
            out, tokens = set(), Counter()
            for text in batch["text"]:
                if not text:
                    continue
                out.update((KINDS[k], value) for _, k, _, value in base_spans(text))
                tokens.update(PLAIN.findall(text))
            rows = [(kind, value, 1) for kind, value in sorted(out)]
            rows += [("plain", pair, n) for pair, n in symbol_pairs(tokens).items()]
            yield pd.DataFrame(rows, columns=["kind", "value", "n"])

    found = docs.select("text").mapInPandas(run, "kind string, value string, n long")
    return cut_lineage(found.groupBy("kind", "value").agg(F.sum("n").alias("n")))


def learn(docs: DataFrame, credential_bound: int = CREDENTIAL_BOUND) -> Grammars:
    found = labelled_values(docs)
    plain = PlainModel({r["value"]: r["n"] for r in found.filter("kind = 'plain'").collect()})  # at most 12 * 12 pairs
    credentials = found.filter("kind != 'plain'").select("kind", "value")
    rows = bounded_per_class(credentials, "kind", credential_bound, key="value").collect()  # bounded
    by_kind: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["kind"], r["value"])):
        by_kind.setdefault(r["kind"], []).append(r["value"])
    return Grammars({kind: infer(values) for kind, values in by_kind.items()}, plain)


def scan_secrets(docs: DataFrame, credential_bound: int = CREDENTIAL_BOUND) -> DataFrame:
    """doc_id, base counts and digest, all spans as text, and the number of added ones."""
    texts = docs.selectExpr("cast(doc_id as bigint) as doc_id", "cast(text as string) as text")
    shared = shipped(docs.sparkSession, learn(texts, credential_bound))

    def run(batches):
        grammars = shared()
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text or ""
                base = base_spans(text)
                joined = ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end, _ in base)
                added = [(m.start(), len(KINDS), m.end(), "") for m in candidates(text, base) if grammars.is_credential(m.group())]
                everything = ",".join(f"{[*KINDS, ADDED][k]}:{start}:{end}" for start, k, end, _ in sorted(base + added))
                counts = [sum(1 for _, k, _, _ in base if k == n) for n in range(len(KINDS))]
                out.append((*counts, hashlib.sha256(joined.encode()).hexdigest(), everything, len(added)))
            frame = pd.DataFrame(out, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])
            frame.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield frame

    return texts.mapInPandas(run, SPANS)
