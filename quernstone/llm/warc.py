"""WARC files, and not-modified revisits resolved by an as-of join.

``write_warc`` and ``read_warc`` move records between tables and WARC 1.1
files.  Written are files with one gzip member a record; read are records of
any kind, from files that are compressed by record, as a whole, or not at all.
``resolve_revisits`` finds for each revisit
the latest earlier full response of the same canonical URL, checks that the
validators agree and merges the headers that a 304 may update.

The as-of join sorts by (URL, time) into ranges, so that a URL with a third of
all records is spread over many tasks.  Inside a range a window carries the
latest response forward; the last response of each range of a URL is carried
into the next ranges by a window over one row for each range.
"""

from __future__ import annotations

import datetime
import gzip
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.shared import new_path, open_folder, written

#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[A-Za-z]+|ref|fbclid|gclid)(=|$)"
#: Fields of a stored response that a not-modified response never replaces (RFC 9111, 3.2), or that belong to a connection.
FIXED_FIELDS = ("connection", "proxy-connection", "keep-alive", "te", "trailer", "transfer-encoding", "upgrade", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization", "content-length", "content-encoding", "content-type", "content-range")
#: A record as a row; ``t``: microseconds since 1970, UTC.
RECORD = "record_id string, kind string, url string, t long, status int, headers map<string,string>, payload binary"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without end slashes, parameters sorted and without tracking; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#(?s).*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place = F.regexp_extract(bare, r"^[^?]*", 0)
    host = F.regexp_extract(place, r"^[^/]*", 0)
    path = F.regexp_replace(F.substr(place, F.length(host) + 1), r"/+$", "")
    query = F.substr(bare, F.length(place) + 2)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    name = F.regexp_replace(F.regexp_replace(F.lower(host), r":(80|443)$", ""), r"^www\.", "")
    return F.concat(name, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


# ---------------------------------------------------------------- files


EPOCH = datetime.datetime(1970, 1, 1)
OWN_ID = "urn:record:"


def warc_date(t: int) -> str:
    """Microseconds as a WARC-Date; years 1 to 9999 have one, others are an error."""
    return f"{(EPOCH + datetime.timedelta(microseconds=t)).isoformat(timespec='microseconds')}Z"


def ticks(date: str | None) -> int | None:
    """A WARC-Date of any precision as microseconds; None for what is no date."""
    try:
        found = datetime.datetime.fromisoformat(date + "-01-01"[: max(0, 10 - len(date))] if date[4:5] in ("", "-") and len(date) < 10 else date)
    except (TypeError, ValueError):
        return None
    if found.tzinfo is not None:
        found = found.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return (found - EPOCH) // datetime.timedelta(microseconds=1)


def _record_bytes(r: dict) -> bytes:
    url = None if r["url"] is None else r["url"].replace("\r", "%0D").replace("\n", "%0A")
    lines = "".join(f"{k}: {one}\r\n" for k, v in r["headers"] or () for one in (v or "").replace("\r", " ").split("\n"))
    payload = r["payload"] or b""
    if r["kind"] in ("response", "revisit"):
        block, content = f"HTTP/1.1 {'-' if r['status'] is None else r['status']} -\r\n{lines}\r\n".encode() + payload, "application/http; msgtype=response"
    elif r["kind"] == "request":
        block, content = f"GET {url or '/'} HTTP/1.1\r\n{lines}\r\n".encode() + payload, "application/http; msgtype=request"
    else:
        block, content = payload, "application/warc-fields" if r["kind"] in ("warcinfo", "metadata") else "application/octet-stream"
    own = str(r["record_id"])
    fields = {"WARC-Type": r["kind"], "WARC-Record-ID": f"<{own}>" if own.startswith("urn:") and not own.startswith(OWN_ID) else f"<{OWN_ID}{own}>"}
    if r["t"] is not None:
        fields["WARC-Date"] = warc_date(r["t"])
    if url is not None:
        fields["WARC-Target-URI"] = url
    fields |= {"Content-Type": content, "Content-Length": str(len(block))}
    if r["kind"] == "revisit":
        fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_warc(records: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Write the records (columns of ``RECORD``), a file for each partition; ``path, records`` of each.

    A null URL or time leaves its field out, a null payload is empty; a header
    value of several lines is that many fields.  A repeated
    attempt writes a file of another name, and only the returned ones count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        path, n = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
        with fs.open_output_stream(path, compression=None) as f:
            for batch in batches:
                for at in range(0, batch.num_rows, 64):
                    for r in batch.slice(at, 64).to_pylist():
                        f.write(gzip.compress(_record_bytes(r), level, mtime=0))
                        n += 1
        yield pa.RecordBatch.from_pydict({"path": [path.rsplit("/", 1)[1]], "records": [n]})

    return written(records.select(*[c.split()[0] for c in RECORD.split(", ")]).mapInArrow(run, "path string, records long"), "warc-files")


def _inflated(f) -> Iterator[bytes]:
    """A stream's bytes in pieces; gzip members, as many as there are, are decompressed."""
    data = f.read(1 << 16)
    if not data.startswith(b"\x1f\x8b"):
        while data:
            yield data
            data = f.read(1 << 16)
        return
    inflate = zlib.decompressobj(31)
    while data:
        yield inflate.decompress(data, 1 << 23)
        data = inflate.unconsumed_tail
        if inflate.eof:
            data, inflate = inflate.unused_data, zlib.decompressobj(31)
        data = data or f.read(1 << 16)


LENGTH = re.compile(rb"\r?\ncontent-length:[ \t]*(\d+)", re.IGNORECASE)


def _records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """Head and block of each record; one that is cut off at the end is an error."""
    parts, size, need = [], 0, 1
    for piece in pieces:
        parts.append(piece)
        size += len(piece)
        if size < need:
            continue
        data, at = b"".join(parts), 0
        while True:
            while data[at : at + 1] in (b"\r", b"\n"):
                at += 1
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                need = len(data) - at + 1
                break
            length = LENGTH.search(data, at, end)
            if not data.startswith(b"WARC/", at) or length is None:
                raise ValueError("no WARC record")
            stop = end + 4 + int(length[1])
            if stop > len(data):
                need = stop - at
                break
            yield data[at:end], data[end + 4 : stop]
            at = stop
        parts, size = [data[at:]], len(data) - at
    if size:
        raise ValueError("a WARC record is cut off")


def _fields(raw: bytes) -> list[tuple[str, str]]:
    """Names in lower case and values after the first line; folded lines belong to the one before."""
    out: list[tuple[str, str]] = []
    for line in raw.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip().decode('utf-8', 'replace')}".strip())
        elif line:
            name, _, value = line.partition(b":")
            out.append((name.strip().lower().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    return out


def _joined(fields: list[tuple[str, str]]) -> dict[str, str]:
    """One value for each name: repeated fields as a list, cookies, which a comma can't part, by lines."""
    out: dict[str, str] = {}
    for name, value in fields:
        out[name] = f"{out[name]}{chr(10) if name == 'set-cookie' else ', '}{value}" if name in out else value
    return out


def parse_record(head: bytes, block: bytes) -> dict:
    """A record as a row of ``RECORD``.  Blocks that aren't HTTP messages are payload, without status and headers."""
    fields = dict(_fields(head))
    own = fields.get("warc-record-id", "").strip("<>")
    http = fields.get("content-type", "").startswith("application/http")
    message, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    status = message[:64].split()[1:2] if message.startswith(b"HTTP/") else []
    return {
        "record_id": own.removeprefix(OWN_ID),
        "kind": fields.get("warc-type"),
        "url": fields["warc-target-uri"].removeprefix("<").removesuffix(">") if "warc-target-uri" in fields else None,
        "t": ticks(fields.get("warc-date")),
        "status": int(status[0]) if status and re.fullmatch(rb"[0-9]{1,9}", status[0]) else None,
        "headers": list(_joined(_fields(message)).items()),
        "payload": payload,
    }


def warc_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` of the WARC files that a folder holds."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = [(s.getPath().getName(),) for s in found if re.search(r"\.warc(\.gz)?$", s.getPath().getName())]
    return spark.createDataFrame(names, "path string")


def read_warc(spark: SparkSession, folder: str, files: DataFrame, *, payload: bool = True) -> DataFrame:
    """Records of the files that ``write_warc`` returned or ``warc_files`` lists; header names in lower case.  Without ``payload`` that column is null."""
    schema = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("t", pa.int64()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                some: list[dict] = []
                with fs.open_input_stream(f"{root}/{path}", compression=None) as f:
                    for head, block in _records(_inflated(f)):
                        some.append(parse_record(head, block) | ({} if payload else {"payload": None}))
                        if len(some) == 64:
                            yield pa.RecordBatch.from_pylist(some, schema)
                            some = []
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInArrow(run, RECORD)


# ---------------------------------------------------------------- revisits


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored fields, replaced and extended by those that a 304 may bring."""
    new = F.map_filter(fresh, lambda k, _: ~k.isin(*FIXED_FIELDS))
    old = F.map_filter(stored, lambda k, _: ~k.isin("connection", "keep-alive", "proxy-connection") & ~F.map_contains_key(new, k))
    return F.map_concat(old, new)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit: ``record_id, url_key, outcome, response_id, response_t, headers``.

    ``records``: ``record_id, kind, url, t, status, headers`` (names in lower
    case); others are ignored.  A full response has kind ``response`` and a
    status of 200 to 299 but 206.  The latest earlier one is the one with the
    largest (t, record_id) below the revisit's.  Outcomes: ``resolved``
    (entity tags agree weakly, or without tags on both sides the modification
    dates agree); ``mismatch`` (they differ); ``unverified`` (nothing to
    compare); ``missing`` (no earlier response, or no URL).  Headers are merged
    where the outcome is ``resolved``, else those of the revisit.  Null headers
    are empty; a null time is earliest; repeated records count as they stand.
    """
    empty = F.create_map().cast("map<string,string>")
    headers = F.coalesce("headers", empty)
    full = (F.col("kind") == "response") & F.col("status").between(200, 299) & (F.col("status") != 206)
    light = records.where(full | (F.col("kind") == "revisit")).select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.coalesce("t", F.lit(-(1 << 63))).alias("t"), F.coalesce(full, F.lit(False)).alias("full"), headers.alias("headers")
    )
    known = light.where("url_key IS NOT NULL")
    ranges = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = written(known.repartitionByRange(ranges, "url_key", "t", "record_id").withColumn("range", F.spark_partition_id()), "captures")
    response = F.when(F.col("full"), F.struct("t", "record_id", "headers"))
    inside = Window.partitionBy("range", "url_key").orderBy("t", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last(response, ignorenulls=True).over(inside)).where("NOT full")
    # Of each URL that lies in several ranges: the last response of each.
    spread = placed.groupBy("url_key").agg(F.min("range").alias("lo"), F.max("range").alias("hi")).where("hi > lo").select("url_key")
    tails = placed.join(spread, "url_key").groupBy("url_key", "range").agg(F.max_by(response, F.when(F.col("full"), F.struct("t", "record_id"))).alias("tail"))
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("url_key", "range", F.last("tail", ignorenulls=True).over(before).alias("far")).where("far IS NOT NULL")
    joined = near.join(carried, ["url_key", "range"], "left").withColumn("found", F.coalesce("near", "far"))
    nowhere = light.where("url_key IS NULL AND NOT full").select("record_id", "url_key", "headers", F.lit(None).cast("struct<t:bigint,record_id:string,headers:map<string,string>>").alias("found"))
    both = joined.select("record_id", "url_key", "headers", "found").union(nowhere)
    tag, old_tag = _weak(F.col("headers")["etag"]), _weak(F.col("found.headers")["etag"])
    date, old_date = F.col("headers")["last-modified"], F.col("found.headers")["last-modified"]
    agrees = F.when(tag.isNotNull() & old_tag.isNotNull(), tag == old_tag).when(date.isNotNull() & old_date.isNotNull(), date == old_date)
    outcome = F.when(F.col("found").isNull(), "missing").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    merged = F.when(outcome == "resolved", merged_headers(F.col("found.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return both.select("record_id", "url_key", outcome.alias("outcome"), F.col("found.record_id").alias("response_id"), F.col("found.t").alias("response_t"), merged.alias("headers"))


# ---------------------------------------------------------------- pages


def crawl_of(pages: DataFrame, later: int = 6000) -> DataFrame:
    """Pages as a crawl: a full response at time ``page_id`` and a not-modified revisit ``later`` ticks after it.

    Validators and lengths are those of the page's own html (null: empty), so a
    revisit whose URL has another page in between doesn't match.
    """
    html = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.encode(html, "UTF-8")), 1, 16), F.lit('"'))
    page = F.col("page_id").cast("string")

    def record(prefix: str, kind: str, t: Column, status: int, headers: dict, payload: Column) -> Column:
        fields = F.map_from_arrays(F.array(*map(F.lit, headers)), F.array(*headers.values()))
        return F.struct(F.concat(F.lit(prefix), page).alias("record_id"), F.lit(kind).alias("kind"), F.col("url").alias("url"), t.alias("t"), F.lit(status).alias("status"), fields.alias("headers"), payload.alias("payload"))

    t = F.col("page_id").cast("long")
    day = lambda x: F.concat(F.lit("t"), x.cast("string"))
    first = record("r", "response", t, 200, {"date": day(t), "etag": tag, "content-type": F.lit("text/html"), "content-length": F.octet_length(html).cast("string"), "x-cache": F.lit("MISS"), "connection": F.lit("close")}, F.encode(html, "UTF-8"))
    again = record("v", "revisit", t + later, 304, {"date": day(t + later), "etag": F.concat(F.lit("W/"), tag), "content-length": F.lit("0"), "x-cache": F.lit("HIT"), "connection": F.lit("close")}, F.lit(None).cast("binary"))
    return pages.where("page_id IS NOT NULL").select(F.inline(F.array(first, again)))


def revisits_of_pages(pages: DataFrame, later: int = 6000) -> DataFrame:
    """The pages' crawl, written to WARC files, read back and resolved: a row per page."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    records = read_warc(spark, folder, write_warc(crawl_of(pages, later), folder), payload=False)
    found = resolve_revisits(records.drop("payload"))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))), "\n")
    return found.select(F.substring("record_id", 2, 20).cast("long").alias("page_id"), "url_key", "outcome", F.substring("response_id", 2, 20).cast("long").alias("response_page_id"), F.md5(F.encode(fields, "UTF-8")).alias("headers_md5"))
