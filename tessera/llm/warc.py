"""WARC archives: writing, reading back, and an index merged from sorted capture runs.

Records are made as strings and written by the text source with the record separator of the
format, CR LF CR LF, as line separator: each part file is a WARC/1.1 file, committed by the
usual protocol, so lost executors leave no half files. Payloads are UTF-8. A payload equal
to another of the same length and SHA-1 is stored once, in the record of its smallest page_id.

Reading parses by content length. The entries of an archive, sorted by URL key, timestamp and
page_id, are a capture run. Runs are dealt by ranges of that order, and each range merges its
slices of the runs with a loser tree, so the capture histories are in order globally.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import drop, give_back, in_batches, mapper, partitions, scratch, table
from tessera.plans.catalogue import small

#: Files, which are read back as a whole, hold pages by size: bytes of a page's html below which as many records share a file.
CLASSES = [(1 << 17, 4000), (1 << 23, 64), (1 << 62, 1)]
#: Index entries that one task merges.
RANGE = 200_000
#: Payloads that recur, up to which they are broadcast; beyond it pages are joined by shuffle.
REPEATED = 100_000
#: Time of capture of page 0; each page's is its id in seconds later, as pages carry none.
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
END = "\r\n"


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1, 32 characters."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def timestamp(page_id: int | None) -> str:
    return (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")


def _safe(url: str) -> str:
    """A URL without characters that would end a header line."""
    return "".join(c for c in url if c not in "\r\n")


def record(page_id: int | None, ordinal: str, url: str | None, payload: str, refers_to: int | None, refers_url: str | None, revisit: bool) -> str:
    """One record without the CR LF CR LF behind it: a response, or a revisit that holds only the HTTP head.

    A revisit names the response by its page, target URI and date; rows with one page_id differ by ``ordinal``.
    """
    raw = payload.encode("utf-8", "replace")
    head = END.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(raw)}", "", ""])
    block = head if revisit else head + raw.decode("utf-8")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:tessera:page:{'' if page_id is None else page_id}{ordinal}>",
        f"WARC-Date: {timestamp(page_id)}",
        *([f"WARC-Target-URI: {_safe(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest(raw)}",
        *(["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:tessera:page:{refers_to}>", f"WARC-Refers-To-Date: {timestamp(refers_to)}"] if revisit else []),
        *([f"WARC-Refers-To-Target-URI: {_safe(refers_url)}"] if revisit and refers_url is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block.encode('utf-8'))}",
        "",
        block,
    ]
    return END.join(lines)


def write(pages: DataFrame, path: str, smallest: int = 0) -> None:
    """Archives of all rows of ``pages`` (page_id, url, html) under ``path``, uncompressed WARC/1.1."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    body = F.col("html").cast("binary")
    keyed = rows.withColumn("sha", F.sha1(body)).withColumn("size", F.octet_length(body))
    firsts = keyed.where((F.col("size") >= smallest) & F.col("page_id").isNotNull()).groupBy("sha", "size").agg(F.min(F.struct(F.col("page_id").alias("first"), F.col("url").alias("first_url"))).alias("f"), F.count("*").alias("n")).where("n > 1").select("sha", "size", "f.*")
    # payloads that recur are few as a rule; then they go to the pages, so that no page is shuffled
    firsts = table(firsts, "firsts")
    found = keyed.join(small(firsts, REPEATED), ["sha", "size"], "left")
    # ids that recur are few as well; only their records need an ordinal to differ
    again = table(rows.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1 and page_id is not null").select("page_id", F.lit(True).alias("again")), "again")
    found = found.join(small(again, REPEATED), "page_id", "left").select("page_id", "url", "html", "first", "first_url", "again", "size")

    def maker(kind: int) -> Callable[[], Callable[[pa.Table], pa.Table]]:
        def make() -> Callable[[pa.Table], pa.Table]:
            from pyspark import TaskContext

            part, count = TaskContext.get().partitionId(), itertools.count()

            def step(t: pa.Table) -> pa.Table:
                cols = [t[c].to_pylist() for c in ("page_id", "url", "html", "first", "first_url", "again")]
                out = []
                for p, u, h, f, fu, a in zip(*cols, strict=True):
                    n = next(count)
                    # a later row with the response's own page_id repeats it, and stays a response; tasks of each size class count for themselves
                    out.append(record(p, f":{kind}-{part}-{n}" if a or p is None else "", u, h or "", f, fu, f is not None and f != p))
                return pa.table({"value": pa.array(out, pa.string())})

            return step

        return make

    sizes = [0, *(most for most, _ in CLASSES)]
    held = keyed.agg(*(F.count(F.when((F.col("size") >= a) & (F.col("size") < b), 1)) for a, b in itertools.pairwise(sizes))).first()
    for k, (a, b) in enumerate(itertools.pairwise(sizes)):
        if held[k] or not k:
            records = found.where((F.col("size") >= a) & (F.col("size") < b)).mapInArrow(mapper(maker(k)), "value string")
            records.write.mode("append").option("lineSep", END * 2).option("maxRecordsPerFile", CLASSES[k][1]).text(path)
    drop(firsts, again)


READ = "archive string, position long, length long, page_id long, url string, url_key string, captured string, record_type string, payload_bytes long, payload_digest string, refers_to long"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, in lower case, and no scheme, for sorting by domain."""
    rest = (url or "").partition("://")[2]
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:at].lower()
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + rest[at:] if rest else ""


def parse(name: str, data: bytes) -> Iterator[tuple]:
    """The records of one archive."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode("utf-8", "replace").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
        body, size = head_end + 4, int(fields["Content-Length"])
        block = data[body : body + size]
        http_end = block.index(b"\r\n\r\n") + 4
        kind = fields["WARC-Type"]
        if kind == "response":
            payload = block[http_end:]
            n, dig = len(payload), digest(payload)
            if f"sha1:{dig}" != fields["WARC-Payload-Digest"]:
                raise ValueError(f"{name}: the payload at byte {at} is damaged")
        else:
            http = dict(x.split(": ", 1) for x in block[:http_end].decode().split(END) if ": " in x)
            n, dig = int(http["Content-Length"]), fields["WARC-Payload-Digest"].partition(":")[2]
        page = fields["WARC-Record-ID"].rstrip(">").split(":")[3]
        ref = fields.get("WARC-Refers-To", "").rpartition(":")[2].rstrip(">")
        url = fields.get("WARC-Target-URI")
        end = body + size + 4
        yield name, at, end - at, int(page) if page else None, url, url_key(url), fields["WARC-Date"], kind, n, dig, int(ref) if ref else None
        at = end


def read(spark, path: str) -> DataFrame:
    """One row for each record of the archives under ``path``, from the archives alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def step(t: pa.Table) -> pa.Table | None:
        rows = [r for name, data in zip(t["path"].to_pylist(), t["content"].to_pylist(), strict=True) for r in parse(name.rpartition("/")[2], data)]
        rows.sort(key=lambda r: (r[5], r[6], -1 if r[3] is None else r[3], r[0], r[1]))  # a sorted capture run
        if not rows:
            return None
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in READ.split(", ")]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, zip(*rows, strict=True), kinds, strict=True)})

    return files.mapInArrow(mapper(lambda: step), READ)


class LoserTree:
    """Merges sorted runs: each inner node keeps the loser of its match, so the next winner costs one path."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.tree = [-1] * max(1, self.k)
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x = self.runs[a][self.at[a]] if self.at[a] < len(self.runs[a]) else None
        y = self.runs[b][self.at[b]] if self.at[b] < len(self.runs[b]) else None
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._less(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.k:
            i = self.tree[0]
            if self.at[i] >= len(self.runs[i]):
                return
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self._play(i)


KEY = ["url_key", "captured", "page_id", "archive", "position"]


def histories(records: DataFrame) -> DataFrame:
    """``records`` in global order of URL key, timestamp and page_id, over partitions by ranges, with history_range and history_rank.

    A hot URL's captures spread over ranges by their timestamps and ids. Each range holds a slice of
    every run, sorted as the runs are, and merges the slices; there are as many ranges as keep
    each near ``RANGE`` entries. history_rank is the place in the whole order, from 1.
    """
    spark = records.sparkSession
    kind = f"{records._jdf.schema().toDDL()}, history_range int, history_place long"
    ranges = max(partitions(spark), -(-records.count() // RANGE))
    # the runs were written sorted; a shuffle joins slices in any order, so each slice is restored by its archive
    dealt = records.repartitionByRange(ranges, *KEY).sortWithinPartitions("archive", *KEY[:3], "position")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = list(in_batches(rows, 1 << 30))
        if not held:
            return
        t = pa.concat_tables(held).combine_chunks()
        archives = t["archive"].combine_chunks()
        ids = [-1 if p is None else p for p in t["page_id"].to_pylist()]
        keys = list(zip(t["url_key"].to_pylist(), t["captured"].to_pylist(), ids, archives.to_pylist(), t["position"].to_pylist(), range(t.num_rows), strict=True))
        new = [i for i in range(1, len(keys)) if keys[i][3] != keys[i - 1][3]]
        runs = [keys[a:b] for a, b in itertools.pairwise([0, *new, len(keys)])]
        order = pa.array([k[5] for k in LoserTree(runs)], pa.int64())
        n = len(order)
        t = t.take(order).append_column("history_range", pa.array([TaskContext.get().partitionId()] * n, pa.int32())).append_column("history_place", pa.array(range(n), pa.int64()))
        yield from t.to_batches(max_chunksize=10_000)
        give_back()

    merged = table(dealt.mapInArrow(run, kind), "merged")
    counts = merged.groupBy("history_range").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("history_range").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    ranked = merged.join(F.broadcast(before.select("history_range", F.coalesce("before", F.lit(0)).alias("before"))), "history_range")
    return ranked.withColumn("history_rank", F.col("before") + F.col("history_place") + 1).drop("before", "history_place")


def archive(pages: DataFrame, smallest: int = 0, path: str | None = None) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC files, reads them back and merges their index.

    A row for each page, from the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to, then url, url_key, captured, archive, position, length, history_range and history_rank,
    the record's place in the merged index of all archives.
    Of pages with equal payloads of at least ``smallest`` bytes the one with the smallest page_id is
    the response, others are revisits of it. The files stay in the shared folder, or under ``path``.

    * Null html: an empty payload. Null url: no target URI, empty URL key. Null page_id: always a response.
    * Repeated rows get a record each; with the response's page_id they are responses as well.
      Where several rows have the page_id that revisits refer to, the target URI and date tell the response.
    * Pages of 8 MB or more have a file each, which is read as a whole; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path, smallest)
    runs = table(read(spark, path), "runs")
    out = histories(runs)
    drop(runs)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "url_key", "captured", "archive", "position", "length", "history_range", "history_rank"]
    return out.select(names)
