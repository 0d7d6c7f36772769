"""Packing: documents cut and packed into windows of at most 2048 tokens.

Method: non-negative least squares over the histogram of lengths. All combinations of one to
three lengths that fill a window exactly are enumerated, their repeat counts are fitted to
the histogram, rounded down to what is there, and what remains is packed greedily, largest
first, cutting a piece where nothing else fills the window.

Tokens leave the tokenizing tasks only as the tail behind a document's last full window (two
or four bytes an id). The histogram has at most `window - 1` lengths whatever the corpus, so
it and the plan are solved on the driver; the plan says which ranks of a length go where, and
documents find their place by their rank among the tails of equal length. Ranks are counted
in about sqrt(n) hash buckets for a length with n tails, so that a length which a third of
all rows share is still many small windows.

Edge cases: null or empty text is the end id alone; a document with exactly k full windows
has no tail; repeated rows and repeated or null ids are packed like any others; an empty table
gives no rows; columns besides `doc_id` and `text` are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from string import ascii_letters
from struct import pack

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.session import cut_lineage

WINDOW = 2048
END_ID = 1
#: Recent chunks whose ids a Python worker remembers, twice; a matter of speed only.
REMEMBERED_CHUNKS = 700_000

STAGED = ("doc_id long, row_id long, doc_tokens long, full_crc array<long>, full_seq long, "
          "tail_len int, tail_crc long, tail binary, wide boolean")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")

#: Letters of text whose chunks are looked up together, so that new words are encoded together.
BLOCK_LETTERS = 2_000_000

#: Words that are encoded together.
WORDS_AT_ONCE = 150

#: A comma or full stop that the tokenizer may join to a mark before it, or to the dot that U+0130 gets in lower case.
BEHIND_MARKS = re.compile(r"[,.](?<=[^\w\s].|[_\u0130].) ")
#: Runs of ASCII marks but for the apostrophe, single digits, and what is neither.
PARTS = re.compile(r"[!-&(-/:-@\[-`{-~]+|[0-9]|[^!-&(-@\[-`{-~]+")
#: First letters of the tokenizer's special words, which it finds within chunks.
SPECIAL = "<|"


def is_word(chunk: str) -> bool:
    """Letters only, in lower case too: one word to the tokenizer."""
    return chunk.isalpha() and (chunk.isascii() or chunk.lower().isalpha())


def parts_of(chunk: str) -> list[str] | None:
    """The tokenizer's words of a chunk: runs of letters, runs of marks, single digits. None where
    other characters leave that to the tokenizer."""
    if SPECIAL in chunk:
        return None
    parts = PARTS.findall(chunk)
    return parts if all(part.isascii() and not part[0].isalpha() and part.isprintable() and part[0] != "'" or is_word(part)
                        for part in parts) else None


class ChunkIds:
    """Ids of white-space separated chunks as little-endian 32-bit bytes.

    The tokenizer drops white space before merging, so no token spans two chunks, and the ids
    of a text are those of its chunks one after another. A comma or full stop behind a letter
    or digit is a word of its own to the tokenizer and becomes a chunk; texts where such marks
    stand behind others are cut at white space only. A chunk of several words has their ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        #: ASCII words need only the merges: splitting keeps them whole and no added token lies within them
        self.merges_only = not any(map(str.isalpha, added)) and all(
            self.merged(word) == self.encoded(word) for word in (ascii_letters, *ascii_letters, "Water", "theinandofon"))
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encoded(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, word: str) -> bytes:
        """Ids of a word of ASCII letters, by the tokenizer's merges alone."""
        ids = [token.id for token in self.model.tokenize(word.lower())]
        return pack(f"<{len(ids)}I", *ids)

    def learn_words(self, words: list[str]) -> None:
        """Words of letters are encoded together, as each is a word of its own; halves are tried
        where the tokenizer sees more words."""
        if len(words) < 2:
            self.known.update((word, self.encoded(word)) for word in words)
            return
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        counts = np.bincount(found.word_ids, minlength=len(words))
        if len(counts) > len(words):
            self.learn_words(words[:len(words) // 2])
            self.learn_words(words[len(words) // 2:])
            return
        data, at, known = np.array(found.ids, "<u4").tobytes(), 0, self.known
        for word, n in zip(words, (counts * 4).tolist()):
            known[word] = data[at:at + n]
            at += n

    def learn(self, chunks: set[str]) -> None:
        known, older, made = self.known, self.older, []
        if older:
            known.update((chunk, older[chunk]) for chunk in chunks if chunk in older)
            chunks = chunks.difference(older)
        words = {chunk for chunk in chunks if chunk.isalpha() and (chunk.isascii() or is_word(chunk))}
        for chunk in chunks.difference(words):
            parts = parts_of(chunk)
            if not parts or len(parts) == 1:
                known[chunk] = self.encoded(chunk)
                continue
            made.append((chunk, parts))
            for part in parts:
                if part in older:
                    known[part] = older[part]
                elif is_word(part):
                    if part not in known:
                        words.add(part)
                elif part not in known:
                    known[part] = self.encoded(part)
        if self.merges_only:
            plain = set(filter(str.isascii, words))
            known.update((word, self.merged(word)) for word in plain)
            words -= plain
        every = list(words)
        for at in range(0, len(every), WORDS_AT_ONCE):
            self.learn_words(every[at:at + WORDS_AT_ONCE])
        known.update((chunk, b"".join(map(known.__getitem__, parts))) for chunk, parts in made)

    @staticmethod
    def chunks_of(text: str) -> list[str]:
        try:  # in this range lower case is one letter for one, whatever the tokenizer does first
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        text = text.replace("\n", " ") + " "
        if BEHIND_MARKS.search(text) is None:
            text = text.replace(", ", " , ").replace(". ", " . ")
        return text.split(" ")

    def of_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text; new chunks of all of them are learned first."""
        if len(self.known) >= REMEMBERED_CHUNKS:
            self.older, self.known = self.known, {}
        cut = [self.chunks_of(text) for text in texts]
        new = set().union(*cut).difference(self.known)
        if new:
            self.learn(new)
        for chunks in cut:
            yield b"".join(map(self.known.__getitem__, chunks))

    def of(self, text: str) -> bytes:
        return next(self.of_all([text]))

    def in_blocks(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of every text, BLOCK_LETTERS looked up at a time."""
        block, letters = [], 0
        for text in texts:
            block.append(text)
            letters += len(text)
            if letters >= BLOCK_LETTERS:
                yield from self.of_all(block)
                block, letters = [], 0
        yield from self.of_all(block)


_LOADED: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One tokenizer per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = ChunkIds(path)
    return _LOADED[path]


def tokenized(docs: DataFrame, tokenizer_path: str, window: int, end_id: int) -> DataFrame:
    """Per document: checksums of its full windows, and the ids of the tail behind them."""
    def run(batches):
        ids_of = chunk_ids(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        row = full = 0
        for batch in batches:
            out = []
            every = ids_of.in_blocks(text or "" for text in batch["text"])
            for doc_id, ids in zip(batch["doc_id"], every):
                ids += end
                size, step = len(ids) // 4, window * 4
                n_full = size // window
                crcs = [zlib.crc32(ids[i * step:(i + 1) * step]) for i in range(n_full)]
                tail = ids[n_full * step:]
                numbers = np.frombuffer(tail, "<u4")
                wide = bool(numbers.size and numbers.max() > 65535)
                out.append((None if pd.isna(doc_id) else int(doc_id), (task << 33) + row, size, crcs, (task << 33) + full,
                            len(tail) // 4, zlib.crc32(tail),
                            tail if wide else numbers.astype("<u2").tobytes(), wide))
                row += 1
                full += n_full
            yield pd.DataFrame(out, columns=["doc_id", "row_id", "doc_tokens", "full_crc", "full_seq", "tail_len",
                                             "tail_crc", "tail", "wide"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(run, STAGED)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows of up to three lengths (0: unused) that sum to `window`, each combination once."""
    here = np.zeros(window + 1, bool)
    here[lengths] = True
    found = []
    pairs = lengths[(lengths * 2 <= window)]
    pairs = pairs[here[window - pairs]]
    found.append(np.stack([np.zeros_like(pairs), pairs, window - pairs], 1))
    for a in lengths[lengths * 3 <= window]:
        b = lengths[(lengths >= a) & (lengths * 2 <= window - a)]
        b = b[here[window - a - b]]
        found.append(np.stack([np.full_like(b, a), b, window - a - b], 1))
    return np.concatenate(found)


def least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, by accelerated projected gradients.

    Column j of A counts each length in combination j. Index 0 stands for an unused slot.
    """
    target = counts.astype(float)
    target[0] = 0

    def apply(x):
        used = sum(np.bincount(combos[:, k], x, minlength=len(target)) for k in range(3))
        used[0] = 0
        return used

    def transpose(r):
        return r[combos].sum(1)

    vector = np.ones(len(combos))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        vector = transpose(apply(vector))
        norm = np.linalg.norm(vector)
        vector /= norm
    step = 1 / (1.05 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * transpose(apply(y) - target))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded_repeats(combos: np.ndarray, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeat counts that use no length more often than it occurs."""
    used = sum(np.bincount(combos[:, k], x, minlength=len(counts)) for k in range(3))
    share = np.minimum(1, counts / np.maximum(used, 1e-12))
    share[0] = 1
    return np.floor(x * share[combos].min(1) + 1e-9).astype(np.int64)


@dataclass
class Plan:
    """Where ranks go: one row says that ranks [lo, lo + count) of tails of `tail_len` put
    the piece [start, start + length) at `offset` of the sequences from `seq` on."""

    rows: np.ndarray  # tail_len, lo, count, start, length, seq, offset, depth
    sequences: int


def pack_plan(histogram: dict[int, int], window: int) -> Plan:
    counts = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    # per length what is left: [tail_len, first rank, how many, start in the tail, cuts before]
    left = {int(n): deque([[int(n), 0, int(counts[n]), 0, 0]]) for n in np.flatnonzero(counts)}
    rows, seq = [], 0

    def take(length: int, n: int):
        while n:
            head = left[length][0]
            got = min(n, head[2])
            yield (head[0], head[1], got, head[3], head[4])
            head[1] += got
            head[2] -= got
            n -= got
            if not head[2]:
                left[length].popleft()

    def place(slots: list[tuple[int, int]], repeats: int):
        """`slots`: (length taken, length used); the rest of a cut piece is left over."""
        nonlocal seq
        offset = 0
        for length, used in slots:
            at = seq
            for tail, lo, n, start, depth in list(take(length, repeats)):
                rows.append((tail, lo, n, start, used, at, offset, depth))
                at += n
                if used < length:
                    left.setdefault(length - used, deque()).append([tail, lo, n, start + used, depth + 1])
            counts[length] -= repeats
            if used < length:
                counts[length - used] += repeats
            offset += used
        seq += repeats

    lengths = np.flatnonzero(counts)
    if len(lengths) and len(combos := combinations(lengths, window)):
        repeats = rounded_repeats(combos, least_squares(combos, counts), counts)
        for j in np.flatnonzero(repeats):
            place([(int(n), int(n)) for n in combos[j] if n], int(repeats[j]))

    while len(present := np.flatnonzero(counts)):
        slots, use, gap = [], {}, window
        at = len(present) - 1
        while gap:
            at = min(at, int(np.searchsorted(present, gap, "right")) - 1)
            while at >= 0 and counts[present[at]] <= use.get(int(present[at]), 0):
                at -= 1
            if at >= 0:
                pick, used = int(present[at]), int(present[at])
            else:
                longer = [int(n) for n in present[np.searchsorted(present, gap, "right"):] if counts[n] > use.get(int(n), 0)]
                if not longer:
                    break
                pick, used = longer[-1], gap
            slots.append((pick, used))
            use[pick] = use.get(pick, 0) + 1
            gap -= used
        place(slots, int(min(counts[n] // k for n, k in use.items())))
    return Plan(np.array(rows, np.int64).reshape(-1, 8), seq)


def placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    """The tails' pieces, found by (tail_len, rank) in the plan, level by level of cuts."""
    by_depth = []
    for depth in range(int(plan.rows[:, 7].max(initial=-1)) + 1):
        rows = plan.rows[plan.rows[:, 7] == depth]
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        by_depth.append((rows, (rows[:, 0] << 48) + rows[:, 1]))

    def run(batches):
        for batch in batches:
            key = (batch["tail_len"].to_numpy(np.int64) << 48) + batch["rank"].to_numpy(np.int64)
            tail_len = batch["tail_len"].to_numpy(np.int64)
            for rows, keys in by_depth:
                at = np.searchsorted(keys, key, "right") - 1
                hit = rows[np.maximum(at, 0)]
                ok = np.flatnonzero((at >= 0) & (hit[:, 0] == tail_len) & ((key & ((1 << 48) - 1)) < hit[:, 1] + hit[:, 2]))
                if not len(ok):
                    continue
                hit, own = hit[ok], batch.iloc[ok]
                rank = own["rank"].to_numpy(np.int64)
                crc = own["tail_crc"].to_numpy(np.int64).copy()
                for i in np.flatnonzero(hit[:, 4] < hit[:, 0]):  # cut tails
                    ids = np.frombuffer(own["tail"].iloc[i], "<u4" if own["wide"].iloc[i] else "<u2")
                    crc[i] = zlib.crc32(ids[hit[i, 3]:hit[i, 3] + hit[i, 4]].astype("<u4").tobytes())
                tokens = own["doc_tokens"].to_numpy(np.int64)
                yield pd.DataFrame({
                    "doc_id": own["doc_id"].astype("Int64"), "start": tokens - hit[:, 0] + hit[:, 3],
                    "length": hit[:, 4], "ids_crc32": crc, "doc_tokens": tokens,
                    "sequence_id": hit[:, 5] + rank - hit[:, 1], "offset": hit[:, 6]})

    return ranked.mapInPandas(run, PIECES)


def tail_ranks(staged: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """`rank` of each tail among the tails of its length, from 0 without gaps."""
    spark = staged.sparkSession
    buckets = spark.createDataFrame([(n, int(c ** 0.5) + 1) for n, c in histogram.items()],
                                    "tail_len int, buckets long")
    keyed = (staged.filter("tail_len > 0")
             .join(F.broadcast(buckets), "tail_len")  # at most window - 1 rows
             .withColumn("bucket", F.pmod(F.xxhash64("row_id"), F.col("buckets"))))
    before = Window.partitionBy("tail_len").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy("tail_len", "bucket").agg(F.count("*").alias("n"))
               .select("tail_len", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead")))
    within = Window.partitionBy("tail_len", "bucket").orderBy("row_id")
    return (keyed.withColumn("nth", F.row_number().over(within) - 1)
            .join(offsets.hint("shuffle_hash"), ["tail_len", "bucket"])
            .select("doc_id", "doc_tokens", "tail_len", "tail_crc", "tail", "wide",
                    (F.col("nth") + F.col("ahead")).alias("rank")))


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    staged = cut_lineage(tokenized(docs, tokenizer_path, window, end_id))
    histogram = {r["tail_len"]: r["n"] for r in staged.filter("tail_len > 0").groupBy("tail_len")
                 .agg(F.count("*").alias("n")).collect()}  # at most window - 1 rows
    plan = pack_plan(histogram, window)
    whole = (staged.filter(F.size("full_crc") > 0)
             .select("doc_id", "doc_tokens", "full_seq", F.posexplode("full_crc").alias("nth", "crc"))
             .select("doc_id", (F.col("nth") * F.lit(window).cast("long")).alias("start"),
                     F.lit(window).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
                     (F.col("full_seq") + F.col("nth") + F.lit(plan.sequences)).alias("sequence_id"),
                     F.lit(0).cast("long").alias("offset")))
    return whole.unionByName(placed(tail_ranks(staged, histogram), plan))
