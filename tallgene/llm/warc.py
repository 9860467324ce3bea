"""Web archives: writing and reading WARC records, and an index merged from sorted runs by loser trees."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tallgene.functions.lineage import scratch_path

#: Runs that one merge reads, entries a row group of a run holds and entries that one merge task gives, about.
FAN_IN, GROUP, RANGE = 64, 2048, 250_000
#: A task begins another archive beyond so many bytes.
ARCHIVE_BYTES = 256_000_000
ENTRY = pa.schema([
    ("urlkey", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("record_type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
])
ENTRY_DDL = "urlkey string, ts string, page_id long, url string, digest string, record_type string, file string, offset long, length long"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def base32_of_hex(hexed: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five digits are four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for group in range(8):
        value = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(letters), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*out)


def url_key(url: str | None) -> str:
    """Host reversed by label, then path and query, lower-cased: pages of a site stand together. Unreadable addresses sort as they are."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port else ""
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}".lower()


@F.pandas_udf(T.StringType())
def url_keys(urls: pd.Series) -> pd.Series:
    return urls.map(url_key)


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(row: dict) -> bytes:
    """One gzip member with a response or revisit record. A revisit holds the HTTP head alone and names the response's record."""
    payload = (row["html"] or "").encode("utf-8", "surrogatepass")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if row["record_type"] == "response" else head
    fields = [("WARC-Type", row["record_type"])]
    if row["page_id"] is not None:
        fields.append(("WARC-Record-ID", f"<urn:x-page:{row['page_id']}>"))
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", _line(row["url"])))
    if row["ts"]:
        t = row["ts"]
        fields.append(("WARC-Date", f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"))
    if row["record_type"] == "revisit":
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:x-page:{row['refers_to']}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def parse_record(member: bytes) -> dict:
    """Fields and payload of a record's gzip member. The digest of a response is taken from its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    page = lambda name: int(fields[name][len("<urn:x-page:") : -1]) if name in fields else None
    response = fields["WARC-Type"] == "response"
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload_bytes": size,
        "payload_digest": b32encode(hashlib.sha1(payload).digest()).decode() if response else fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload": payload.decode("utf-8", "surrogatepass") if response else None,
    }


def with_roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``digest``, ``n_bytes``, ``record_type`` and ``refers_to``: of equal payloads of ``min_bytes`` at least, rows with the smallest
    page_id are responses and others revisit it.

    Digests are grouped with map-side minima; only those that occur twice are joined back, so a payload that many
    pages share is one row of the small side and its pages can be split over tasks.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    marked = pages.withColumns({"_sha": F.sha1(body), "n_bytes": F.octet_length(body).cast("long")})
    shared = marked.where(F.col("n_bytes") >= min_bytes).groupBy("_sha", "n_bytes").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 AND _first IS NOT NULL").drop("_n")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return marked.join(shared, ["_sha", "n_bytes"], "left").select(
        "page_id", "url", "html", "ts", base32_of_hex(F.col("_sha")).alias("digest"), "n_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_first")).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Each task writes its records in the order of URL key and time to archives of its own and a sorted run of index entries.

    Returns the manifest of runs (run, files, firsts), written once. Names are unique to the attempt and only files that the
    manifest names are read, so retries and lost executors leave at most unread files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = _open(folder)
        disk.create_dir(base, recursive=True)
        name = uuid.uuid4().hex
        archive, writer, entries, firsts, size, count, opened = None, None, [], [], 0, 0, 0

        def flush() -> None:
            nonlocal writer
            if entries:
                if writer is None:
                    writer = pq.ParquetWriter(f"{base}/{name}.run", ENTRY, filesystem=disk)
                firsts.append((entries[0]["urlkey"], entries[0]["ts"]))
                writer.write_table(pa.Table.from_pylist(entries, ENTRY), row_group_size=GROUP)
                entries.clear()

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in batch.slice(start, 64).to_pylist():
                    if archive is None or size > ARCHIVE_BYTES:
                        if archive is not None:
                            archive.close()
                        opened, size = opened + 1, 0
                        archive = disk.open_output_stream(f"{base}/{name}-{opened}.warc.gz", compression=None)
                    member = record_bytes(row)
                    archive.write(member)
                    entries.append({**{k: row[k] for k in ENTRY.names[:6]}, "file": f"{folder}/{name}-{opened}.warc.gz", "offset": size, "length": len(member)})
                    size, count = size + len(member), count + 1
                    if len(entries) == GROUP:
                        flush()
        flush()
        if count:
            writer.close()
            archive.close()
            yield pa.RecordBatch.from_pylist([{"files": [f"{folder}/{name}.run"], "firsts": [{"urlkey": u, "ts": t} for u, t in firsts], "n": count}], MANIFEST)

    ordered = records.withColumn("urlkey", url_keys("url")).withColumn("ts", F.coalesce(F.date_format("ts", "yyyyMMddHHmmss"), F.lit("")))
    columns = [*ENTRY.names[:6], "refers_to", "html"]
    return _kept(ordered.sortWithinPartitions("urlkey", "ts", "page_id").select(*columns).mapInArrow(run, MANIFEST_DDL))


MANIFEST = pa.schema([("files", pa.list_(pa.string())), ("firsts", pa.list_(pa.struct([("urlkey", pa.string()), ("ts", pa.string())]))), ("n", pa.int64())])
MANIFEST_DDL = "files array<string>, firsts array<struct<urlkey:string,ts:string>>, n long"


def _kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder once and read back."""
    path = scratch_path(df.sparkSession, "runs")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


class LoserTree:
    """Merges sorted iterators of (key, item): inner nodes hold the losers of the last matches, a new head replays one path."""

    def __init__(self, sources: list[Iterator[tuple]]):
        self.sources = sources
        self.heads = [next(s, None) for s in sources]
        k = len(sources)
        self.tree = [-1] * max(1, k)
        for i in range(k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _replay(self, winner: int) -> None:
        node = (winner + len(self.sources)) // 2
        while node:
            other = self.tree[node]
            if other < 0:  # still being built: wait here for an opponent
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.sources:
            winner = self.tree[0]
            head = self.heads[winner]
            if head is None:
                return
            yield head
            self.heads[winner] = next(self.sources[winner], None)
            self._replay(winner)


def _entries(files: list[str], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries of a run with low <= (urlkey, ts) < high, one row group in memory; groups outside are skipped by their statistics."""
    for path in files:
        disk, name = _open(path)
        with disk.open_input_file(name) as f:
            run = pq.ParquetFile(f)
            for g in range(run.num_row_groups):
                keys = run.metadata.row_group(g).column(0).statistics
                if keys is not None and keys.has_min_max and ((low and keys.max < low[0]) or (high and keys.min > high[0])):
                    continue
                for e in run.read_row_group(g).to_pylist():
                    at = (e["urlkey"], e["ts"])
                    if (low is None or at >= low) and (high is None or at < high):
                        yield (*at, e["page_id"] is None, e["page_id"] or 0), e


def merge_runs(manifest: DataFrame, folder: str) -> DataFrame:
    """Index entries in global order: ``range_no`` and ``place`` in it number them by URL key, time and page.

    Passes merge at most FAN_IN runs at once until so few are left. A merge is cut into key ranges at first keys of the runs'
    row groups; each (group of runs, range) is a task that streams its slices through a loser tree, whatever the lengths
    of the runs. A capture history, all entries of one URL key, may span ranges if it is long: the cuts fall between times too.
    """
    while True:
        runs = manifest.count()
        if runs <= FAN_IN:
            return _merge_tasks(manifest.withColumn("merge", F.lit(0))).mapInArrow(_merged_rows, f"range_no long, place long, {ENTRY_DDL}")
        numbered = manifest.withColumn("merge", F.pmod(F.xxhash64("files"), F.lit(-(-2 * runs // FAN_IN))).cast("int"))
        crowded = W.Window.partitionBy("merge").orderBy("files")
        numbered = numbered.withColumn("merge", F.concat_ws("-", "merge", F.floor((F.row_number().over(crowded) - 1) / FAN_IN).cast("string")))
        merged = _kept(_merge_tasks(numbered).mapInArrow(_to_runs(folder), f"merge string, range_no long, {MANIFEST_DDL}"))
        parts = merged.groupBy("merge").agg(F.array_sort(F.collect_list(F.struct("range_no", "files", "firsts", "n"))).alias("p"))
        manifest = _kept(parts.select(F.flatten("p.files").alias("files"), F.flatten("p.firsts").alias("firsts"), F.aggregate("p.n", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")))


def _merge_tasks(numbered: DataFrame) -> DataFrame:
    """(merge, range_no, runs, low, high): cuts at every so many row groups of a merge's runs, dealt out one range a task."""
    per_range = max(1, RANGE // GROUP)
    firsts = numbered.select("merge", F.explode("firsts").alias("key"))
    nth = F.row_number().over(W.Window.partitionBy("merge").orderBy("key")) - 1
    cuts = firsts.withColumn("nth", nth).where((F.col("nth") % per_range == 0)).select("merge", "key").distinct()
    order = W.Window.partitionBy("merge").orderBy("key")
    ranges = cuts.select("merge", (F.row_number().over(order) - 1).cast("long").alias("range_no"), "key", F.lead("key").over(order).alias("high"))
    ranges = ranges.withColumn("low", F.when(F.col("range_no") > 0, F.col("key"))).drop("key")
    listed = numbered.groupBy("merge").agg(F.array_sort(F.collect_list("files")).alias("runs"))
    n = max(1, numbered.sparkSession.sparkContext.defaultParallelism)
    return ranges.join(listed, "merge").select("merge", "range_no", "runs", "low", "high").repartition(4 * n, "merge", "range_no")


def _slices(row: dict) -> Iterator[tuple]:
    cut = lambda k: (k["urlkey"], k["ts"]) if k is not None else None
    return iter(LoserTree([_entries(files, cut(row["low"]), cut(row["high"])) for files in row["runs"]]))


def _grouped(row: dict) -> Iterator[list[dict]]:
    out: list[dict] = []
    for _, entry in _slices(row):
        out.append(entry)
        if len(out) == GROUP:
            yield out
            out = []
    if out:
        yield out


def _merged_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("range_no", pa.int64()), ("place", pa.int64()), *ENTRY])
    for batch in batches:
        for row in batch.to_pylist():
            place = 0
            for entries in _grouped(row):
                yield pa.RecordBatch.from_pylist([{"range_no": row["range_no"], "place": place + i, **e} for i, e in enumerate(entries)], schema)
                place += len(entries)


def _to_runs(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = _open(folder)
        schema = pa.schema([("merge", pa.string()), ("range_no", pa.int64()), *MANIFEST])
        for batch in batches:
            for row in batch.to_pylist():
                name, writer, firsts, n = f"{uuid.uuid4().hex}.run", None, [], 0
                for entries in _grouped(row):
                    writer = writer or pq.ParquetWriter(f"{base}/{name}", ENTRY, filesystem=disk)
                    writer.write_table(pa.Table.from_pylist(entries, ENTRY), row_group_size=GROUP)
                    firsts.append({"urlkey": entries[0]["urlkey"], "ts": entries[0]["ts"]})
                    n += len(entries)
                if writer:
                    writer.close()
                    yield pa.RecordBatch.from_pylist([{"merge": row["merge"], "range_no": row["range_no"], "files": [f"{folder}/{name}"], "firsts": firsts, "n": n}], schema)

    return run


def archive(pages: DataFrame, *, min_bytes: int = 0) -> DataFrame:
    """Archives of ``pages`` (page_id, url, html, ts) and their merged index: (range_no, place, urlkey, ts, page_id, url, digest, record_type, file, offset, length).

    A null html is an empty payload, a null url has the empty key and no target address, a null ts sorts first. Null page_ids sort last, are never
    the first of equal payloads and, if all are null, are responses; rows that repeat the smallest page_id are all responses. Extra columns are not
    read; an empty table gives an empty index.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    return merge_runs(write_archives(with_roles(pages.select("page_id", "url", "html", "ts"), min_bytes), folder), folder)


def read_archives(index: DataFrame) -> DataFrame:
    """Records at the index's places: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to. Each archive is read forward."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("payload", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                out = []
                for file, offset, length in zip(*[c.to_pylist() for c in batch.slice(start, 64).columns], strict=True):
                    if file != name:
                        disk, path = _open(file)
                        source, name = disk.open_input_file(path), file
                    source.seek(offset)
                    out.append(parse_record(source.read(length)))
                yield pa.RecordBatch.from_pylist(out, schema)

    places = index.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return places.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string")
