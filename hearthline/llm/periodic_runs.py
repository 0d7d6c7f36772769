"""Periodic runs: every highly repetitive stretch of words, found with string synchronising sets.

A run is a maximal stretch of words with smallest period q (words q apart are equal) and a length
of at least max(LEAST_LENGTH, LEAST_EXPONENT * q). Periods below SMALLEST_SCALE are found
directly, by comparing the words with themselves shifted. Every other period q belongs to the
dyadic scale t with t <= q < 2t. There each window of t words has a hash; the synchronising set
holds the positions i where the smallest hash among windows i..i+t is that of window i or i+t.
Membership depends on 2t words only, so equal contexts are in the set together, and any stretch
of 3t-1 words has a member among its first t positions unless it has a period of at most t/4.
Two consecutive members with equal 2t-word contexts at a distance d with t <= d < 2t propose the
period d, which is then extended word by word in both directions. A run with period q and four
periods always holds such a pair. Windows with a period of at most t/4 are left out of the
set: they lie in runs which smaller scales have found before, so their small periods are known
and do not crowd the set. Proposals are verified on the words; hashes (64 bits) only propose.

Each document is worked on whole, in the task that reads it, many documents at a time; there is no
shuffle. Memory grows with the longest document (some 100 bytes a word).

Edge cases: null and empty texts have no words, no runs and the digests of an empty string; null
and repeated ids are handled row by row, a null id is never rewritten; of several longest runs the
one with the smallest start, then period, is named; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Shorter periods are found by comparing shifted words; the smallest synchronising scale.
SMALLEST_SCALE = 4
#: Words that are searched together; a longer document makes a larger group of its own.
GROUP_WORDS = 400_000
EXCLUDED = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Rewrites a document's word numbers before the search: (doc_id, number of words) -> order or None.
Rewrite = Callable[[int | None, int], "np.ndarray | None"]

RUNS = "array<struct<start:long,length:long,period:long>>"
RESULT = (f"doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
          f"runs_sha256 string, collapsed_sha256 string, runs {RUNS}")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of 2 x `width` words from those of `width` words."""
    return mix(names[:-width] * np.uint64(0x9E3779B97F4A7C15) + names[width:])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, `width` a power of two."""
    step = 1
    while step < width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return x


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of true."""
    edges = np.diff(np.concatenate([[0], equal.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many leading entries agree."""
    at, step, n = 0, 64, min(len(left), len(right))
    while at < n:
        differs = left[at:min(n, at + step)] != right[at:min(n, at + step)]
        if differs.any():
            return at + int(differs.argmax())
        at, step = at + step, step * 2
    return n


def small_period_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of stretches with smallest period below SMALLEST_SCALE."""
    found = []
    for q in range(1, min(SMALLEST_SCALE, len(words))):
        starts, ends = stretches(words[:-q] == words[q:])
        long_enough = ends - starts + q >= LEAST_EXPONENT * q
        for a, b in zip(starts[long_enough].tolist(), ends[long_enough].tolist()):
            if not any(q % p == 0 and (words[a:a + q - p] == words[a + p:a + q]).all() for p in range(1, q)):
                found.append((a, b - a + q, q))
    return found


def synchronising_set(names: np.ndarray, scale: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Positions of the set at `scale`; `names` are the hashes of all windows of `scale` words."""
    ids = names.copy()
    for start, length, period in runs:
        if 4 * period <= scale <= length:
            ids[start:start + length - scale + 1] = EXCLUDED
    window = sliding_least(ids, scale)
    least = np.minimum(window[:-1], ids[scale:])  # over scale + 1 neighbours
    n = len(least)
    return np.flatnonzero(((least == ids[:n]) | (least == ids[scale:scale + n])) & (least != EXCLUDED))


def proposed_periods(members: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods from consecutive members with equal contexts, by period and position."""
    order = np.argsort(contexts, kind="stable")
    position, context = members[order], contexts[order]
    distance = position[1:] - position[:-1]
    ok = (context[1:] == context[:-1]) & (distance >= scale) & (distance < 2 * scale)
    at, period = position[:-1][ok], distance[ok]
    order = np.lexsort((at, period))
    return at[order], period[order]


def all_runs(words: np.ndarray, sizes: list[int]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) in documents laid one behind another, the longest first.

    `words` are word numbers; each document is followed by a number of its own, so that no
    stretch reaches beyond it. `sizes` counts the words of each document with that number.
    """
    runs = small_period_runs(words)
    ends = np.cumsum(sizes)
    names, width, scale = mix(words.astype(np.uint64) + np.uint64(1)), 1, SMALLEST_SCALE
    while sizes and LEAST_EXPONENT * scale <= sizes[0] - 1:
        # only documents long enough for four periods of this scale
        part = int(ends[np.searchsorted(-np.array(sizes), -(LEAST_EXPONENT * scale + 1), "right") - 1])
        words, names = words[:part], names[:part - width + 1]
        while width < scale:
            names, width = doubled(names, width), width * 2
        members = synchronising_set(names, scale, runs)
        contexts = doubled(names, scale)
        members = members[members < len(contexts)]
        done, last = -1, -1
        for at, period in zip(*(x.tolist() for x in proposed_periods(members, contexts[members], scale))):
            if period == last and at < done:
                continue  # within the stretch just extended
            ahead = agreeing(words[at:len(words) - period], words[at + period:])
            back = agreeing(words[:at][::-1], words[period:at + period][::-1])
            last, done = period, at + ahead
            if ahead + back + period >= LEAST_EXPONENT * period:
                runs.append((at - back, ahead + back + period, period))
        scale *= 2
    return sorted({r for r in runs if r[1] >= max(LEAST_LENGTH, LEAST_EXPONENT * r[2])}, key=lambda r: (r[0], r[2]))


def groups(texts: list[bytes | None]) -> Iterator[tuple[list[int], list[list[bytes]]]]:
    """Row numbers and words of consecutive texts with together about GROUP_WORDS words."""
    rows, parts, size = [], [], 0
    for i, text in enumerate(texts):
        rows.append(i)
        parts.append((text or b"").split())  # blanks, \t, \n, \v, \f and \r
        size += len(parts[-1]) + 1
        if size >= GROUP_WORDS:
            yield rows, parts
            rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


class Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def runs_of(documents: list[list[bytes]], orders: list[np.ndarray | None]) -> list[list[tuple[int, int, int]]]:
    """Runs of every document, its words taken in the given order."""
    number, laid, sizes = Numbers(), [], []
    longest_first = sorted(range(len(documents)), key=lambda k: -len(documents[k]))
    for k in longest_first:
        own = np.fromiter(map(number.__getitem__, documents[k]), np.int64, len(documents[k]))
        laid += [own if orders[k] is None else own[orders[k]], np.array([-1 - k], np.int64)]
        sizes.append(len(own) + 1)
    words = np.concatenate(laid) + len(documents)  # ends of documents get the smallest numbers
    found: list[list[tuple[int, int, int]]] = [[] for _ in documents]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    runs = all_runs(words, sizes)
    for (start, length, period), nth in zip(runs, np.searchsorted(begins, [r[0] for r in runs], "right") - 1):
        found[longest_first[nth]].append((start - int(begins[nth]), length, period))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when each run is cut down to its first period."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return keep


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, texts: bool = False) -> DataFrame:
    """Per document: its runs, the longest of them, and digests of the runs and of the text
    with every run cut down to one period; with `texts` that text itself as `collapsed`.

    `rewrite` may replace the words of a document by others of its words before the search.
    """
    schema = RESULT + (", collapsed string" if texts else "")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for rows, documents in groups(batch.column(1).to_pylist()):
                orders = [rewrite(ids[i], len(words)) if rewrite else None for i, words in zip(rows, documents)]
                out = []
                for i, words, order, runs in zip(rows, documents, orders, runs_of(documents, orders)):
                    if order is not None:
                        words = [words[k] for k in order.tolist()]
                    if runs:
                        keep = kept_words(len(words), runs)
                        words = [w for w, k in zip(words, keep.tolist()) if k]
                    collapsed = b" ".join(words)
                    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
                    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                    out.append((ids[i], len(runs), start, length, period, 1000 * length // period if runs else None,
                                sha256(listed.encode()).hexdigest(), sha256(collapsed).hexdigest(),
                                [dict(zip(("start", "length", "period"), r)) for r in runs])
                               + ((collapsed.decode("utf-8", "replace"),) if texts else ()))
                yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out), kinds)],
                                                 names=names)

    run_struct = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [run_struct] + [pa.string()] * texts
    names = [c.strip().split(" ")[0] for c in RESULT.split(RUNS)[0].split(",")] + ["collapsed"] * texts
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def seeded_repeats(doc_id: int | None, n: int) -> np.ndarray | None:
    """The audit's rewriting: one document in ten repeats a stretch of its words to its end.

    With h the CRC of the decimal id and g = h // 10, documents with h % 10 = 0 repeat from word
    a = g % n with the period 1 + (n - a) // (3 + g % 8).
    """
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order
