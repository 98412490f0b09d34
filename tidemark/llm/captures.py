"""A web archive with a two-level capture index.

Pages become WARC files in the shared folder: a warcinfo record, then a response record for each page, every record a gzip
member of its own, so that it can be read from its offset and length alone. The index sorts captures by reversed-host URL
key and writes them as lines in compressed blocks, one after the other in index files; a sparse directory keeps the first
key, file, offset and length of each block. A lookup binary-searches the directory, opens an index file, seeks and reads
the one block (or, for a key with many captures, the few) that can hold the key, binary-searches its lines, and reads
the records' ranges from the WARC files in the same way. Neither blocks nor records are ever shuffled.

The directory is cut into pages of ``PAGE_BLOCKS`` blocks. Only the first key of each page, one for about 190,000
captures, is held by every task to route lookups; the rest of the directory is searched where its keys are.

A task writes files under names of its own, so a task that runs twice (a lost executor, speculation) leaves at most files
that no entry names. Defined results:

* a null or blank URL has no key: it is neither indexed nor found; a null page is archived as an empty one;
* in headers, control characters and spaces of a URL are percent-encoded; its key is made of the URL as it is;
* the tables hold no time of capture: ``date`` is written for all records;
* keys compare by their bytes; ties are ordered by page_id (nulls first); repeated rows are captures each;
* ids are integers; pages and URLs may be of any length; an empty table gives an empty index; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, shared_folder, stored

BLOCK_LINES = 3000
PAGE_BLOCKS = 64
#: A WARC or index file ends after so many bytes.
FILE_BYTES = 256 << 20
DATE = "1970-01-01T00:00:00Z"

ENTRIES = "url_key string, page_id bigint, file string, offset bigint, length bigint"
DIRECTORY = "page bigint, number bigint, first_key string, lines bigint, file string, offset bigint, length bigint"
RECORDS = "page_id bigint, url_key string, n_bytes bigint, sha256 string"

#: The URL key, in SQL that both Spark and the oracle's engine read.
_STEPS = (
    ("u", "lower(trim(regexp_replace({url}, '[\\t\\r\\n]', '%09'{g})))"),
    ("r", "regexp_replace(regexp_replace(u, '^[a-z][a-z0-9+.-]*://', ''), '#.*$', '')"),
    ("h", "regexp_extract(r, '^([^/?]*)', 1)"),
    ("d", "regexp_replace(regexp_replace(regexp_replace(h, '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*[.]', '')"),
    ("o", "regexp_extract(d, '(:[0-9]*)$', 1)"),
    ("b", "regexp_replace(d, ':[0-9]*$', '')"),
    ("p", "regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '')"),
    ("q", "regexp_extract(r, '^[^?]*[?](.*)$', 1)"),
)


def url_key(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with the column ``url_key`` (in place of one of that name): host labels reversed, then the path, then the query's sorted parts."""
    df = packed(pages)
    for name, sql in _STEPS:
        df = df.withColumn(f"__{name}", F.expr(_own(sql.format(url=f"row.`{url}`", g=""))))
    key = F.concat(
        F.array_join(F.reverse(F.split("__b", "[.]")), ","), F.col("__o"), F.lit(")"), F.when(F.col("__p") == "", F.lit("/")).otherwise(F.col("__p")),
        F.when(F.col("__q") == "", F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(F.array_sort(F.split("__q", "&")), "&"))),
    )
    kept = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c != "url_key"]
    return df.select(*kept, F.when(F.col("__u") != "", key).alias("url_key"))


def _own(sql: str) -> str:
    """Refers to the steps under the names that they have here."""
    for name, _ in _STEPS:
        for before, after in (("(", ","), ("(", ")")):
            sql = sql.replace(f"{before}{name}{after}", f"{before}__{name}{after}")
    return sql


# ---- files ---------------------------------------------------------------------------------------------------------


class _Writer:
    """Byte strings, one after the other, in files below a folder of any file system that Arrow knows."""

    def __init__(self, folder: str, ending: str, first: bytes = b"") -> None:
        self.folder, self.ending, self.first, self.out, self.at = folder.rstrip("/"), ending, first, None, 0

    def add(self, data: bytes) -> tuple[str, int, int]:
        """Where the bytes are: file, offset and length."""
        if self.out is None:
            self.name = f"{self.folder}/{uuid.uuid4().hex}{self.ending}"
            system, path = _located(self.name)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self.out, self.at = system.open_output_stream(path, compression=None), len(self.first)
            self.out.write(self.first)
        place = (self.name, self.at, len(data))
        self.out.write(data)
        self.at += len(data)
        if self.at >= FILE_BYTES:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


class Reader:
    """Ranges of files; one file is open at a time. Counts the ranges and bytes that it read."""

    def __init__(self) -> None:
        self.name, self.file, self.ranges, self.bytes = None, None, 0, 0

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.close()
            system, path = _located(name)
            self.name, self.file = name, system.open_input_file(path)
        self.ranges, self.bytes = self.ranges + 1, self.bytes + length
        self.file.seek(offset)
        return self.file.read(length)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


# ---- archive -------------------------------------------------------------------------------------------------------


def _member(head: str, block: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _info(date: str) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, "tidemark")
    return _member(f"WARC-Type: warcinfo\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nContent-Type: application/warc-fields\r\n", b"software: tidemark\r\nformat: WARC File Format 1.0\r\n")


def _record(page_id: int | None, url: str, html: bytes, date: str) -> bytes:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}")
    target = re.sub("[\\x00-\\x20\\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = f"WARC-Type: response\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Target-URI: {target}\r\nContent-Type: application/http; msgtype=response\r\n"
    return _member(head, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode() + html)


def read_record(data: bytes) -> bytes:
    """The payload of one response record, from the bytes of its range."""
    record = zlib.decompress(data, 31)
    for _ in ("WARC", "HTTP"):  # headers hold no empty line, so the first one ends them
        head, _, rest = record.partition(b"\r\n\r\n")
        length = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
        record = rest[:length]
    return record


def _archive(folder: str, date: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Writer(folder, ".warc.gz", _info(date))
        for batch in batches:
            places = [out.add(_record(i, url, (html or "").encode(), date)) for i, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))]
            files, offsets, lengths = zip(*places) if places else ((),) * 3
            columns = [batch.column("url_key"), batch.column("page_id"), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())]
            yield pa.record_batch(columns, names=["url_key", "page_id", "file", "offset", "length"])
        out.close()

    return task


def _folder(pages: DataFrame, label: str) -> str:
    return f"{shared_folder(pages.sparkSession)}/{label}-{uuid.uuid4().hex}"


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE) -> DataFrame:
    """Writes the pages to WARC files; a stored row for each capture: its key, page, file, offset and length."""
    rows = url_key(pages.select(F.col(f"`{page_id}`").cast("bigint").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")))
    return stored(rows.where("url_key is not null").select("page_id", "url", "url_key", "html").mapInArrow(_archive(_folder(pages, "warc"), date), ENTRIES), "captures")


# ---- index ---------------------------------------------------------------------------------------------------------


def _blocks(folder: str, block_lines: int, page_blocks: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first, lines, number = _Writer(folder, ".cdx.z"), None, [], 0
        base = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            file, offset, length = out.add(zlib.compress("\n".join(lines).encode(), 6))
            return pa.record_batch([[base + number // page_blocks], [base + number], [first], [len(lines)], [file], [offset], [length]], names=["page", "number", "first_key", "lines", "file", "offset", "length"])

        for batch in batches:
            for key, page_id, file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length"))):
                if not lines:
                    first = key
                lines.append(f"{key}\t{'' if page_id is None else page_id}\t{file}\t{offset}\t{length}")
                if len(lines) == block_lines:
                    yield block()
                    lines, number = [], number + 1
        if lines:
            yield block()
        out.close()

    return task


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES, page_blocks: int = PAGE_BLOCKS) -> DataFrame:
    """Writes the blocks in key order; the stored directory: page and number of each block, its first key, file, offset and length."""
    by = ["url_key", F.col("page_id").asc_nulls_first(), "file", "offset"]
    ordered = captures.repartitionByRange(*by).sortWithinPartitions(*by)
    return stored(ordered.mapInArrow(_blocks(_folder(captures, "index"), block_lines, page_blocks), DIRECTORY), "directory")


# ---- lookup --------------------------------------------------------------------------------------------------------


def _route(pages: list[int], firsts: list[bytes]):
    """Each key with every directory page that can hold it: the last that begins before it, and those that begin with it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, to = [], []
            for key in batch.column("url_key").to_pylist():
                k = key.encode()
                for i in range(max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k)):
                    keys.append(key)
                    to.append(pages[i])
            yield pa.record_batch([pa.array(to, pa.int64()), pa.array(keys, pa.string())], names=["page", "url_key"])

    return task


def _search(queries: pa.Table, directory: pa.Table) -> pa.Table:
    """One directory page: its blocks' first keys are searched, then the lines of the blocks that can hold a key."""
    out: list[tuple] = []
    if directory.num_rows and queries.num_rows:
        blocks, reader, opened = directory.sort_by("number").to_pylist(), Reader(), (-1, ([], []))
        firsts = [b["first_key"].encode() for b in blocks]
        for k in sorted({q.encode() for q in queries.column("url_key").to_pylist()}):
            for b in range(max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k)):
                if opened[0] != b:  # keys come in order: earlier blocks are done
                    opened = (b, lines_of(reader.read(blocks[b]["file"], blocks[b]["offset"], blocks[b]["length"])))
                names, rows = opened[1]
                for i in range(bisect_left(names, k), bisect_right(names, k)):
                    _, page_id, file, offset, length = rows[i]
                    out.append((k.decode(), int(page_id) if page_id else None, file.decode(), int(offset), int(length)))
        reader.close()
    columns = zip(*out) if out else ((),) * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["url_key", "page_id", "file", "offset", "length"])


def lines_of(block: bytes) -> tuple[list[bytes], list[list[bytes]]]:
    """The keys of a block's lines, and the lines' fields."""
    rows = [line.split(b"\t") for line in zlib.decompress(block).split(b"\n")]
    return [r[0] for r in rows], rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        payloads = (read_record(reader.read(*place)) for place in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
        sizes, hashes = zip(*((len(p), hashlib.sha256(p).hexdigest()) for p in payloads)) if batch.num_rows else ((), ())
        yield pa.record_batch([batch.column("page_id"), batch.column("url_key"), pa.array(sizes, pa.int64()), pa.array(hashes, pa.string())], names=["page_id", "url_key", "n_bytes", "sha256"])
    reader.close()


def lookup(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of each distinct key of ``keys`` (column url_key): where their records are."""
    top = sorted((r["first"].encode(), r["page"]) for r in directory.groupBy("page").agg(F.min_by("first_key", "number").alias("first")).collect())
    routed = keys.where("url_key is not null").select("url_key").distinct().mapInArrow(_route([p for _, p in top], [k for k, _ in top]), "page bigint, url_key string")
    return routed.groupBy("page").cogroup(directory.groupBy("page")).applyInArrow(_search, ENTRIES)


def read_ranges(hits: DataFrame) -> DataFrame:
    """Page id, key, length and SHA-256 of the payload that each hit's range holds. Only hits move; ranges are read in file order."""
    return hits.repartition("file").sortWithinPartitions("file", "offset").select("page_id", "url_key", "file", "offset", "length").mapInArrow(_read, RECORDS)


def index_and_look_up(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives and indexes the pages, then looks up the URL of every page and reads all captures that it finds."""
    directory = build_index(archive(pages, page_id, url, html))
    found = lookup(directory, url_key(pages.select(F.col(f"`{url}`").alias("url"))))
    return read_ranges(found).withColumn("captures", F.count(F.lit(1)).over(Window.partitionBy("url_key")))


def oracle() -> str:
    steps = ", ".join(f"{sql.format(url='url', g=', ' + repr('g'))} AS {name}" for name, sql in _STEPS[:1])
    chain = f"SELECT page_id, html, {steps} FROM pages WHERE url IS NOT NULL"
    for name, sql in _STEPS[1:]:
        chain = f"SELECT *, {sql} AS {name} FROM ({chain})"
    key = (
        "array_to_string(list_reverse(string_split(b, '.')), ',') || o || ')' || CASE WHEN p = '' THEN '/' ELSE p END"
        " || CASE WHEN q = '' THEN '' ELSE '?' || array_to_string(list_sort(string_split(q, '&')), '&') END"
    )
    return (
        f"SELECT page_id, url_key, octet_length(encode(coalesce(html, ''))) AS n_bytes, sha256(coalesce(html, '')) AS sha256, count(*) OVER (PARTITION BY url_key) AS captures "
        f"FROM (SELECT *, {key} AS url_key FROM ({chain}) WHERE u <> '')"
    )
