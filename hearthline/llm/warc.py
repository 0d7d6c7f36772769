"""WARC archives of pages, and an index of their captures by external merging.

Archives are written by Spark's text sink with the four bytes that end a WARC record as line
separator, so they go to any file system Spark knows. Of equal payloads of at least LEAST_BYTES
the page with the largest id is a response and the others revisit it. Archives are read back
file by file; the captures of each make a run sorted by URL key, time and page. Runs are cut into
key ranges and in every range merged by a loser tree: the ranges, one after another, are the
capture histories in order. A URL that is captured ever so often is cut by time and page like
any other range.

Edge cases: null html is an empty payload; null URLs have no target header and an empty key; rows
without page_id are written and never referred to; rows that repeat a page_id are captures of
their own; line breaks in URLs are percent-encoded; an empty table gives no captures; other
columns are ignored. Pages have no capture time: it is a fixed start plus page_id seconds.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.lists import broadcast_if_small
from hearthline.session import cut_lineage, shared_dir

LEAST_BYTES = 1000
RECORDS_PER_ARCHIVE = 1000
START = "2024-01-01 00:00:00"
ID = "urn:hearthline:page:"
CAPTURES = ("run string, seq long, url_key string, captured string, page_id long, uri string, record_type string, "
            "payload_bytes long, payload_digest string, refers_to long, record_offset long, record_bytes long")
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """The text of each page's WARC record, up to the bytes that end it."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    rows = (rows.withColumn("size", F.octet_length("payload")).withColumn("digest", F.sha1(F.col("payload").cast("binary")))
            .withColumn("check", F.xxhash64("payload")))
    equal = (rows.filter((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("digest", "check", "size")
             .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies")).filter("copies > 1"))
    equal = broadcast_if_small(cut_lineage(equal.select("digest", "check", "size", "kept")), 200_000)
    rows = rows.join(equal, ["digest", "check", "size"], "left")
    revisit = F.col("kept").isNotNull() & F.col("page_id").isNotNull() & (F.col("page_id") != F.col("kept"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("size").cast("string"), F.lit("\r\n\r\n"))
    name = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none-"), F.monotonically_increasing_id().cast("string")))
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    second = F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(3_000_000_000))
    date = F.date_format(F.expr(f"timestamp_ntz'{START}'") + F.make_dt_interval(
        days=(second / 86400).cast("int"), secs=(second % 86400).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{ID}"), name, F.lit(">\r\nWARC-Date: "), date,
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), uri), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Refers-To: <{ID}"), F.col("kept").cast("string"),
                                 F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "))
    block = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    return rows.select(F.concat(head, block.cast("string"), F.lit("\r\n\r\n"), http,
                                F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(pages: DataFrame, path: str, records_per_archive: int = RECORDS_PER_ARCHIVE) -> None:
    (records(pages).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_archive).text(path))


def url_key(url: str) -> str:
    """Sort-friendly key: the host's labels from the last to the first, then the rest."""
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?(.*)", url, re.DOTALL)
    host, port, rest = m.groups()
    return ",".join(reversed(host.lower().split("."))) + (port or "") + ")" + (rest or "/")


def parse_archive(content: bytes):
    """Captures in an archive, in file order."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in lines[1:])
        begin = end + 4
        block = content[begin:begin + int(head["Content-Length"])]
        stop = begin + len(block) + 4
        if content[stop - 4:stop] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has another length than its header says")
        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
        if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
            raise ValueError(f"payload at byte {at} is not what its header says")
        name = head["WARC-Record-ID"].strip("<>").removeprefix(ID)
        refers = head.get("WARC-Refers-To")
        uri = head.get("WARC-Target-URI")
        yield (url_key(uri) if uri else "", head["WARC-Date"], None if name.startswith("none-") else int(name), uri, kind, size, digest,
               int(refers.strip("<>").removeprefix(ID)) if refers else None, at, stop - at)
        at = stop


def order_of(row) -> tuple:
    return (row[0], row[1], row[2] is not None, row[2] or 0)


def captures(spark, path: str) -> DataFrame:
    """Sorted runs, one per archive: rows (run, seq, url_key, captured, page_id, ...)."""
    def run(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = sorted(parse_archive(content), key=order_of)
                out = pd.DataFrame(rows, columns=["url_key", "captured", "page_id", "uri", "record_type", "payload_bytes", "payload_digest",
                                                  "refers_to", "record_offset", "record_bytes"]).astype({"page_id": "Int64", "refers_to": "Int64"})
                out.insert(0, "seq", range(len(out)))
                out.insert(0, "run", name.rsplit("/", 1)[-1])
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, CAPTURES)


class LoserTree:
    """Merges sorted sequences: inner nodes hold the loser of their match, the top the winner.

    Taking the smallest replays only the matches on its way up, log2(k) of them.
    """

    def __init__(self, runs: list[list]):
        self.runs = [iter(run) for run in runs]
        self.k = max(1, len(runs))
        self.heads = [next(run, None) for run in self.runs] + [None] * (self.k - len(runs))
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._enter(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _enter(self, leaf: int) -> None:
        """First matches: wait at the first free node, else play on."""
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.losers[0] = winner

    def __iter__(self):
        while True:
            leaf = self.losers[0]
            head = self.heads[leaf]
            if head is None:
                return
            yield head
            self.heads[leaf] = next(self.runs[leaf], None)
            winner, node = leaf, (leaf + self.k) // 2
            while node:
                if self._beats(self.losers[node], winner):
                    winner, self.losers[node] = self.losers[node], winner
                node //= 2
            self.losers[0] = winner


def merged(runs: DataFrame) -> DataFrame:
    """All captures in global order: by range_no, then nth."""
    def run(batches):
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        keys = [(u, c, not pd.isna(p), 0 if pd.isna(p) else int(p), i) for i, (u, c, p) in enumerate(
            zip(rows["url_key"], rows["captured"], rows["page_id"]))]
        begins = [0, *(i for i in range(1, len(rows)) if rows["run"].iat[i] != rows["run"].iat[i - 1]), len(rows)]
        order = [key[-1] for key in LoserTree([keys[a:b] for a, b in zip(begins, begins[1:])])]
        out = rows.iloc[order].drop(columns=["seq"])
        out["range_no"], out["nth"] = TaskContext.get().partitionId(), range(len(out))
        yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    ranges = runs.repartitionByRange("url_key", "captured", "page_id").sortWithinPartitions("run", "seq")
    return ranges.mapInPandas(run, CAPTURES.replace("seq long, ", "") + ", range_no int, nth long")


def capture_index(pages: DataFrame) -> DataFrame:
    """Writes the pages' archives to the shared folder, reads them back and merges their index."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path)
    return merged(cut_lineage(captures(spark, path)))


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS kept FROM p WHERE n >= {LEAST_BYTES} GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to
FROM p LEFT JOIN k ON p.d = k.d AND p.n >= {LEAST_BYTES}
"""
