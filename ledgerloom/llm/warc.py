"""WARC records: reading, writing, and resolving not-modified revisits.

resolve() is an as-of join: every revisit gets the latest strictly earlier full
response of its canonical URL.  The join is a running last-value over (URL, time
block), then over the blocks of a URL, so a URL with a third of all captures is
spread over its time blocks and only one row a block meets in the second step.  Blocks
hold about equally many captures, in whatever unit time is given.
Payloads never move: the result names the response, and with_payload() fetches
bytes by id when they are wanted.

A resolved revisit must not contradict the response: entity tags compare weakly
(W/ dropped), Last-Modified and payload digests exactly, each only where both
sides have it; at least one must agree.  Its headers are the response's, updated by
those of the 304 that may update a stored response (not the ones that describe the
body that was not sent or the connection).

Edge cases: a null or empty URL is never resolved (`no_url`); captures at the same
instant are not earlier; responses that tie in time are ordered by id, the largest
winning; repeated rows give repeated results; an empty table gives no rows; null
headers are empty maps; of headers whose names differ in case only the one that
sorts last counts; extra columns are ignored.  In files, a record cut off by the end of the file or of its
gzip member is dropped, a record without a valid length is skipped, and repeated header
fields are joined by commas.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerloom.llm import shared

# Headers of a 304 that never update the stored response.
NOT_UPDATED = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)"
BLOCKS, COARSE = 1024, 32
SCHEMA = "record_id string, type string, url string, date string, status int, headers map<string,string>, payload binary, refers_to string, profile string"


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, www., default port, fragment, tracking parameters or closing slash; parameters sorted."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^www[0-9]*\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    wanted = F.sort_array(F.filter(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING)))
    query = F.array_join(wanted, "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _small(headers: Column) -> Column:
    """Header names in small letters; of equal ones that counts which sorts last as it was written."""
    entries = F.transform(F.sort_array(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def _block(captures: DataFrame, blocks: int) -> Column:
    """The time block of `ts`: between quantiles of all captures, found in two steps."""
    cuts = captures.agg(F.percentile_approx(F.col("ts").cast("long"), [k / blocks for k in range(1, blocks)], 20 * blocks)).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts or []))
    if not cuts:
        return F.lit(0)
    below = lambda limits: F.size(F.filter(limits, lambda x: x <= F.col("ts")))
    parts = [cuts[k : k + COARSE] for k in range(0, len(cuts), COARSE)]
    coarse = F.greatest(below(F.lit([p[0] for p in parts])), F.lit(1))
    return (coarse - 1) * COARSE + below(F.element_at(F.array(*(F.lit(p) for p in parts)), coarse))


def resolve(captures: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """One row for each revisit: id, url, key, ts, response_id, verdict, headers.

    `captures`: id, url, ts (long), kind ('response' or 'revisit'), etag, last_modified,
    digest, headers (map<string,string>); other columns are ignored.
    """
    rows = captures.where(F.col("kind").isin("response", "revisit")).select(
        "id", "url", F.col("ts").cast("long").alias("ts"), (F.col("kind") == "revisit").cast("int").alias("_again"), canonical_url(F.col("url")).alias("key"),
        F.regexp_replace(F.col("etag"), "^W/", "").alias("etag"), "last_modified", "digest",
        _small(F.col("headers")).alias("headers"),
    )
    response = F.when(F.col("_again") == 0, F.struct("ts", "id", "etag", "last_modified", "digest", "headers"))
    rows = rows.withColumns({"_block": _block(captures, blocks), "_r": response})
    good = rows.where("key IS NOT NULL AND ts IS NOT NULL")
    # At one instant revisits come first, so that a response then is not earlier.
    within = Window.partitionBy("key", "_block").orderBy("ts", F.desc("_again"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = good.withColumn("_near", F.last("_r", ignorenulls=True).over(within)).where("_again = 1").drop("_r")
    of_block = good.groupBy("key", "_block").agg(F.max_by("_r", F.when(F.col("_again") == 0, F.struct("ts", "id"))).alias("_last"))
    across = Window.partitionBy("key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = of_block.select("key", "_block", F.last("_last", ignorenulls=True).over(across).alias("_before"))
    found = near.join(before, ["key", "_block"], "left").withColumn("_r", F.coalesce("_near", "_before"))
    bad = rows.where("_again = 1 AND (key IS NULL OR ts IS NULL)").withColumns({"_r": F.lit(None).cast(rows.schema["_r"].dataType)})
    columns = ["id", "url", "key", "ts", "etag", "last_modified", "digest", "headers", "_r"]
    found = found.select(*columns).unionByName(bad.select(*columns))

    differs = lambda c: F.coalesce(F.col(c) != F.col(f"_r.{c}"), F.lit(False))
    agrees = lambda c: F.coalesce(F.col(c) == F.col(f"_r.{c}"), F.lit(False))
    checks = ("etag", "last_modified", "digest")
    verdict = (
        F.when(F.col("key").isNull(), "no_url")
        .when(F.col("_r").isNull(), "no_earlier_response")
        .when(differs("etag") | differs("last_modified") | differs("digest"), "validator_mismatch")
        .when(agrees(checks[0]) | agrees(checks[1]) | agrees(checks[2]), "resolved")
        .otherwise("no_validator")
    )
    update = F.map_filter("headers", lambda k, _: ~k.isin(*NOT_UPDATED))
    stored = F.map_filter("_r.headers", lambda k, _: ~F.array_contains(F.map_keys(update), k))
    out = found.withColumn("verdict", verdict)
    return out.select("id", "url", "key", "ts", F.when(F.col("verdict") == "resolved", F.col("_r.id")).alias("response_id"), "verdict", F.when(F.col("verdict") == "resolved", F.map_concat(stored, update)).otherwise(F.col("headers")).alias("headers"))


def with_payload(resolved: DataFrame, payloads: DataFrame) -> DataFrame:
    """Adds the payload (id, payload) of the response that each revisit resolved to; null for the others."""
    return resolved.join(payloads.select(F.col("id").alias("response_id"), "payload"), "response_id", "left")


# --- files


def render(record: dict) -> bytes:
    """A WARC/1.1 record of a dict with the fields of SCHEMA."""
    http = b""
    if record["type"] in ("response", "revisit") and record.get("status"):
        lines = [f"HTTP/1.1 {record['status']} {'Not Modified' if record['status'] == 304 else 'OK'}", *(f"{k}: {v}" for k, v in (record.get("headers") or {}).items())]
        http = ("\r\n".join(lines) + "\r\n\r\n").encode()
    body = http + (record.get("payload") or b"")
    head = ["WARC/1.1", f"WARC-Type: {record['type']}", f"WARC-Record-ID: {record['record_id']}", f"WARC-Date: {record['date']}"]
    for name, key in (("WARC-Target-URI", "url"), ("WARC-Refers-To", "refers_to"), ("WARC-Profile", "profile")):
        if record.get(key):
            head.append(f"{name}: {record[key]}")
    if http:
        head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = block.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name, value = name.strip().lower(), value.strip()
            out[name] = f"{out[name]}, {value}" if name in out else value
    return first, out


def _members(data: bytes) -> Iterator[bytes]:
    """The members of a gzipped file, one at a time, or the whole of a plain one; a damaged one as far as it goes."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        out, open_ = [], zlib.decompressobj(31)
        try:
            while not open_.eof and at < len(data):
                out.append(open_.decompress(data[at : at + 65536]))
                at += 65536
        except zlib.error:
            at = len(data)
        at = min(at, len(data)) - len(open_.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzipped by record; a cut-off record is dropped, one without a length skipped."""
    for member in _members(data):
        yield from _records(member)


def _records(data: bytes) -> Iterator[dict]:
    at = 0
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        _, fields = _fields(data[at:end])
        length = fields.get("content-length", "0").split(",")[0].strip()
        if not (length.isascii() and length.isdigit()):
            at = end + 4
            continue
        size = int(length)
        body = data[end + 4 : end + 4 + size]
        if len(body) < size:
            return
        at = end + 4 + size
        status, headers, payload = None, {}, body
        if fields.get("content-type", "").startswith("application/http"):
            head, _, payload = body.partition(b"\r\n\r\n")
            line, headers = _fields(head)
            parts = line.split()
            status = int(parts[1]) if len(parts) > 1 and len(parts[1]) < 6 and parts[1].isascii() and parts[1].isdigit() else None
        yield {"record_id": fields.get("warc-record-id"), "type": fields.get("warc-type"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "status": status, "headers": headers, "payload": payload, "refers_to": fields.get("warc-refers-to"), "profile": fields.get("warc-profile")}


_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("url", pa.string()), ("date", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("refers_to", pa.string()), ("profile", pa.string())])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files under `path`, by Spark's own reader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                part: list[dict] = []
                for r in parse(content.as_py() or b""):
                    part.append(r | {"headers": list(r["headers"].items())})
                    if len(part) == 256:
                        yield pa.RecordBatch.from_pylist(part, schema=_ARROW)
                        part = []
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema=_ARROW)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(shared.lean(run), SCHEMA)


def captures(records: DataFrame) -> DataFrame:
    """The input of resolve() from read(): 2xx responses and revisits, with their validators."""
    kind = F.when((F.col("type") == "revisit") | (F.col("status") == 304), "revisit").when((F.col("type") == "response") & F.col("status").between(200, 299), "response")
    return records.select(
        F.col("record_id").alias("id"), "url", F.unix_millis(F.try_to_timestamp("date")).alias("ts"), kind.alias("kind"),
        F.try_element_at("headers", F.lit("etag")).alias("etag"), F.try_element_at("headers", F.lit("last-modified")).alias("last_modified"),
        F.when(kind == "response", F.sha1("payload")).alias("digest"), "headers",
    ).where("kind IS NOT NULL")


RECRAWL = 5000


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every page is a response at time page_id and is asked for again RECRAWL later, answered by 304."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    tag = F.sha1(F.encode("html", "utf-8"))
    size = F.octet_length("html").cast("string")
    text = F.lit(None).cast("string")
    first = pages.select(F.col("page_id").alias("id"), "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), text.alias("last_modified"), text.alias("digest"), F.create_map(F.lit("ETag"), tag, F.lit("Content-Length"), size, F.lit("Age"), F.lit("0")).alias("headers"))
    again = pages.select(F.col("page_id").alias("id"), "url", (F.col("page_id") + RECRAWL).alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), tag).alias("etag"), text.alias("last_modified"), text.alias("digest"), F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("Age"), F.lit("7")).alias("headers"))
    found = resolve(first.unionByName(again))
    shown = F.array_join(F.sort_array(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return found.select(F.col("id").alias("page_id"), "url", F.col("key").alias("canonical"), F.col("response_id").alias("response_page_id"), "verdict", shown.alias("headers"))


ORACLE = r"""
WITH b AS (SELECT page_id, url, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u FROM pages),
h AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)), '^www[0-9]*\.', ''), ':(80|443)$', '') AS host,
        regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
        array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=|$)'))), '&') AS q FROM b),
k AS (SELECT page_id, url, CASE WHEN host <> '' THEN host || path || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS key, sha1(html) AS tag, strlen(html) AS n FROM h),
m AS (SELECT v.page_id, v.url, v.key, v.tag, r.page_id AS rid, r.tag AS rtag, r.n AS rn,
        row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS o
      FROM k v LEFT JOIN k r ON r.key = v.key AND r.page_id < v.page_id + 5000)
SELECT page_id, url, key AS canonical, CASE WHEN rtag = tag THEN rid END AS response_page_id,
       CASE WHEN key IS NULL THEN 'no_url' WHEN rid IS NULL THEN 'no_earlier_response' WHEN rtag <> tag THEN 'validator_mismatch' ELSE 'resolved' END AS verdict,
       CASE WHEN rtag = tag THEN 'age=7;content-length=' || rn || ';etag=' || rtag ELSE 'age=7;content-length=0' END AS headers
FROM m WHERE o = 1
"""
