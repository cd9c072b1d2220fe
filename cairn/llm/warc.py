"""WARC archives: written by Spark's text writer, read back record by record, and indexed by an external merge.

Writing. A record is a string of headers and payload, all UTF-8, and ends with two line breaks; with these as the
line separator, Spark's text writer writes archives that are WARC/1.1 byte for byte, commits them task by task, and reaches any store that
Spark reaches. Payloads that occur more than once have one ``response`` record, that of the largest id; the others are ``revisit`` records that
name it and hold the HTTP header alone. A payload's group is counted before it is joined, so a page that a third of
all rows repeat is one row a task.

Reading. Each archive is unpacked as a stream; a record's extent follows from its Content-Length alone, so
payloads may hold anything, line breaks and whole WARC headers included. The payload of each response is held against its digest; a
damaged archive raises an error. The entries of an archive, sorted by URL key, time and id, are one run of the index.

Index. Runs are split at the same keys into ranges, and every range merges its slices of all runs by a loser tree.
The key goes down to the record's place, so a URL that a third of all captures share is spread over ranges.
Ranges follow one another, so their sizes, one row each, give every capture its place in the whole order and in the history of its URL.

Null html is an empty payload, a null URL has no WARC-Target-URI and the empty key, a null id is smaller than all others. Of repeated rows with one
id and payload, all are responses if the id is the largest with that payload. Line breaks in a URL are escaped, white space around it goes.
Columns other than id, URL, html and the date are not read. An empty table gives archives without records and an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.exprs import let
from cairn.llm.tables import fresh_path, settled_parquet

END = "\r\n\r\n"
#: Fixed values of RFC 4648 and of the WARC standard.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records without a date are given one second each from here on.
FIRST_DATE = int(datetime(2020, 1, 1, tzinfo=timezone.utc).timestamp())
#: Records to an archive, at most.
ARCHIVE_RECORDS = 20_000
#: Entries handed on at a time.
BATCH = 10_000

ENTRY = "url_key string, at string, id long, file string, offset long, length long, record_type string, payload_bytes long, payload_digest string, refers_to long"


def base32_sha1(text: Column) -> Column:
    """The SHA-1 of a string's bytes as 32 characters of bare base32."""

    def spelled(digest: Column) -> Column:
        out = []
        for i in range(8):  # five hexadecimal digits are four characters
            bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
            out += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
        return F.concat(*out)

    return let(F.sha1(text.cast("binary")), spelled)  # the digest is taken once


def _record_id(number: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(number.cast("string"), F.lit("none")), F.lit(">"))


def records(pages: DataFrame, least: int = 0, date: str | None = None) -> DataFrame:
    """``value``: each page's record without its two last line breaks. Payloads of fewer than ``least`` bytes are always stored."""
    seconds = F.unix_seconds(F.col(date)) if date else F.lit(FIRST_DATE) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(10**9))
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"), seconds.alias("seconds"))
    rows = rows.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    groups = rows.filter(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("id").alias("first"), F.count("*").alias("copies"))
    shared = groups.filter("copies > 1").select("digest", "bytes", "first", F.lit(True).alias("shared"))
    told = rows.join(shared, ["digest", "bytes"], "left")
    again = F.coalesce(F.col("shared") & ~F.col("id").eqNullSafe(F.col("first")), F.lit(False))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    body = F.when(again, http).otherwise(F.concat(http, "payload"))
    address = F.replace(F.replace(F.trim("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    headers = [
        F.lit("WARC/1.1"),
        F.when(again, "WARC-Type: revisit").otherwise("WARC-Type: response"),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"))),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.to_utc_timestamp(F.timestamp_seconds("seconds"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Target-URI: "), address),  # null goes
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    ]
    return told.select(F.concat(F.concat_ws("\r\n", *headers), F.lit(END), body).alias("value"))


def write(pages: DataFrame, path: str | None = None, least: int = 0, date: str | None = None, compression: str = "gzip") -> str:
    """Archives of ``pages`` (page_id, url, html) below ``path``, or below the shared folder; gives the path.

    ``date`` names a timestamp column; without one, dates follow the ids.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    out = records(pages, least, date).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", ARCHIVE_RECORDS)
    out.text(path)
    return path


def url_key(url: str) -> str:
    """A URL as a key that sorts hosts by domain: ``com,example)/path?query``, without scheme, user, default port, ``www.`` and fragment."""
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:]
    name, _, port = host.partition(":")
    name = name.removeprefix("www.")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (path if path.startswith("/") else "/" + path)


class _Unpacked(io.RawIOBase):
    """The bytes of an archive, unpacked as they are read if they are packed."""

    def __init__(self, data: memoryview):
        self.data, self.at, self.left = data, 0, b""
        self.unzip = zlib.decompressobj(31) if bytes(data[:2]) == b"\x1f\x8b" else None

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left and self.at < len(self.data):
            part = self.data[self.at : self.at + (1 << 16)]
            self.at += len(part)
            if self.unzip is None:
                self.left = bytes(part)
                continue
            self.left = self.unzip.decompress(part)
            while self.unzip.eof and self.unzip.unused_data:  # a member for each record
                more = self.unzip.unused_data
                self.unzip = zlib.decompressobj(31)
                self.left += self.unzip.decompress(more)
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def _block_headers(stream: BinaryIO) -> tuple[dict[str, str], int]:
    """Headers up to an empty line, by lower-case name, and how many bytes they took."""
    out, size = {}, 0
    while True:
        line = stream.readline()
        size += len(line)
        if not line.endswith(b"\n"):
            raise ValueError("a WARC record breaks off in its headers")
        line = line.rstrip(b"\r\n")
        if not line:
            return out, size
        name, _, value = line.decode().partition(":")
        out[name.strip().lower()] = value.strip()


def _number(record_id: str) -> int | None:
    text = record_id.strip("<>").removeprefix("urn:page:")
    return None if text == "none" else int(text)


def parsed(data: memoryview) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """Headers, payload, offset and length of each record of an archive, response or revisit; ``http-length`` is the payload's full size."""
    stream, offset = io.BufferedReader(_Unpacked(data), 1 << 16), 0
    while first := stream.readline():
        if not first.strip():
            offset += len(first)
            continue
        if not first.startswith(b"WARC/"):
            raise ValueError("a WARC record does not start with its version")
        headers, size = _block_headers(stream)
        block = stream.read(int(headers["content-length"]))
        length = len(first) + size + len(block)
        if len(block) < int(headers["content-length"]):
            raise ValueError("a WARC record breaks off")
        inner = io.BytesIO(block)
        inner.readline()
        http, _ = _block_headers(inner)
        headers["http-length"] = http["content-length"]
        payload = inner.read()
        if headers["warc-type"] == "response":
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if headers["warc-payload-digest"] != f"sha1:{digest}" or len(payload) != int(http["content-length"]):
                raise ValueError(f"the payload of {headers['warc-record-id']} is damaged")
        yield headers, payload, offset, length
        offset += length


def _sort_key(entry: tuple) -> tuple:
    """Where an entry of the index goes: by URL key, time, id (null first), archive and place in it."""
    return entry[0], entry[1], entry[2] is not None, entry[2] or 0, entry[3], entry[4]


def _entries(file: str, content: memoryview) -> list[tuple]:
    out = []
    for h, _, offset, length in parsed(content):
        refers = _number(h["warc-refers-to"]) if "warc-refers-to" in h else None
        out.append((url_key(h["warc-target-uri"]) if "warc-target-uri" in h else "", h["warc-date"], _number(h["warc-record-id"]), file, offset, length, h["warc-type"], int(h["http-length"]), h["warc-payload-digest"].removeprefix("sha1:"), refers))
    return sorted(out, key=_sort_key)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), BATCH):
        columns = list(zip(*rows[at : at + BATCH], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in (x.split() for x in text.split(", "))])


def archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """id, url, record_type and payload (null for a revisit) of every record below ``path``."""
    shape = "id long, url string, record_type string, payload string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                for h, payload, _, _ in parsed(memoryview(content.as_buffer())):
                    kind = h["warc-type"]
                    yield from _batches([(_number(h["warc-record-id"]), h.get("warc-target-uri"), kind, payload if kind == "response" else None)], _schema(shape))

    return archives(spark, path).select("content").mapInArrow(run, shape)


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The index entries of every archive, each archive's a sorted run, with their ``place`` in the run."""
    shape = f"{ENTRY}, place long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = _entries(file.rpartition("/")[2], memoryview(content.as_buffer()))
                yield from _batches([(*e, i) for i, e in enumerate(found)], _schema(shape))

    return archives(spark, path).select("path", "content").mapInArrow(run, shape)


class LoserTree:
    """Merges sorted lists: every inner node holds the loser of its match, so the next winner plays one path to the root."""

    def __init__(self, lists: list[list[tuple]]):
        self.lists, self.at = lists, [0] * len(lists)
        self.keys = [_sort_key(x[0]) if x else None for x in lists]
        self.k = len(lists)
        self.losers = [-1] * max(self.k, 1)
        self.winner = self._played(1) if self.k else -1

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _played(self, root: int) -> int:
        """The winner below a node; all matches of the tree are played bottom up."""
        won = [-1] * self.k + list(range(self.k))
        for node in range(self.k - 1, root - 1, -1):
            a, b = won[2 * node], won[2 * node + 1]
            won[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return won[root]

    def __iter__(self) -> Iterator[tuple]:
        while self.k and self.keys[self.winner] is not None:
            w = self.winner
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self.keys[w] = _sort_key(self.lists[w][self.at[w]]) if self.at[w] < len(self.lists[w]) else None
            node = (w + self.k) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merged(entries: DataFrame) -> DataFrame:
    """Runs merged range by range: the entries with ``range``, ``row`` (both from 0), ``nth`` capture of their URL in the range (from 1), and whether the URL is the range's first.

    A task holds one range; ranges are as even as Spark's sample of the keys.
    """
    names = [x.split()[0] for x in ENTRY.split(", ")]
    shape = f"{ENTRY}, row long, nth long, leads boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list] = {}
        for batch in batches:
            for *entry, place in zip(*(batch.column(n).to_pylist() for n in [*names, "place"]), strict=True):
                slices.setdefault(entry[3], []).append((place, tuple(entry)))
        lists = [[e for _, e in sorted(slices[f], key=lambda x: x[0])] for f in sorted(slices)]
        first = last = None
        nth, out = 0, []
        for row, entry in enumerate(LoserTree(lists)):
            first = entry[0] if row == 0 else first
            nth = nth + 1 if row and entry[0] == last else 1
            last = entry[0]
            out.append((*entry, row, nth, entry[0] == first))
            if len(out) == BATCH:
                yield from _batches(out, _schema(shape))
                out = []
        yield from _batches(out, _schema(shape))

    dealt = entries.repartitionByRange("url_key", "at", F.col("id").asc_nulls_first(), "file", "offset")
    return dealt.mapInArrow(run, shape).withColumn("range", F.spark_partition_id())


def index(spark: SparkSession, path: str) -> DataFrame:
    """All captures below ``path`` in order of URL key, time and id: the entries with ``history_rank`` in the whole order and ``capture`` in their URL's, both from 1."""
    found = settled_parquet(merged(settled_parquet(runs(spark, path))))
    edges = found.groupBy("range").agg(
        F.count("*").alias("rows"),
        F.min_by("url_key", "row").alias("first"),
        F.max_by("url_key", "row").alias("last"),
        F.count_if("leads").alias("firsts"),
        F.max_by("nth", "row").alias("lasts"),
    )
    starts, rank, last, seen = [], 0, None, 0
    for e in edges.orderBy("range").collect():  # one row for each range
        carried = seen if e.first == last else 0
        starts.append((e.range, rank, carried))
        seen = e.lasts + (carried if e.first == e.last else 0)
        rank, last = rank + e.rows, e.last
    offsets = spark.createDataFrame(starts or [(0, 0, 0)], "range int, rank long, carried long")
    numbered = found.join(F.broadcast(offsets), "range")
    capture = F.col("nth") + F.when(F.col("leads"), F.col("carried")).otherwise(0)
    return numbered.select(*(x.split()[0] for x in ENTRY.split(", ")), (F.col("rank") + F.col("row") + 1).alias("history_rank"), capture.alias("capture"))
