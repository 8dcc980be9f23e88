"""WARC archives and a two-level capture index.

Archives hold one gzip member per record. Captures are sorted by reversed-host URL key
(``com,example,www)/path``) into compressed blocks of index lines; a sparse directory keeps every
block's first key. Looking a URL up is a binary search in the directory, one in the block, and a
range read of the archive. The block size follows from the number of captures so that the directory
has at most DIRECTORY_ROWS entries, which bounds what every task receives.

Payloads of at least REVISIT_BYTES that another record already holds become revisit records that
name the response's page; which record is the response is settled before the shuffle by one row per
digest and task.

Defined results: null or empty html is a response with 0 bytes; null and empty URLs are keyed ")/";
equal payloads under several URLs and equal URLs are separate captures; repeated rows of one page
write a record each, all responses or all revisits, also if the page has rows of other payloads; a page
without an id is a response that nothing refers to; an empty table writes nothing and gives an empty
result.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm import flat_files
from kinespark.llm.common import query, table
from kinespark.session import stage

# Fixed values of the format and of the contract.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
REVISIT_BYTES = 100

BLOCK_LINES = 3_000
DIRECTORY_ROWS = 65_536


def url_key(url: Column) -> Column:
    """Reversed host, then path and query: scheme, port, user and fragment dropped, host in small letters."""
    clean = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(clean, r"^[^/?]*", 0), r"^.*@|:\d*$", ""))
    rest = F.regexp_replace(clean, r"^[^/?]*", "")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def payload_digest() -> Column:
    return F.sha2(F.coalesce(F.col("html"), F.lit("")).cast("binary"), 256)


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the revisits, one row for all rows of one page and payload."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    hashed = stage(
        pages.select(
            "page_id", F.octet_length(payload).cast("long").alias("payload_bytes"), payload_digest().alias("digest")
        ),
        "payloads",
    )
    first = (
        hashed.filter(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    )
    revisit = F.col("page_id") > F.col("first_page")
    revisits = hashed.join(first, "digest").filter(revisit)
    return revisits.select("page_id", "digest", F.col("first_page").alias("refers_to")).distinct()


CAPTURES = "key string, page_id long, archive string, offset long, length long"


# Ids travel through pandas as strings, since a column of integers with nulls would become floats there.


def _id_text(page_id: object) -> str:
    return page_id if isinstance(page_id, str) else ""


def _ids(texts: list[str]) -> pd.array:
    return pd.array([int(t) if t else None for t in texts], dtype="Int64")


def _id_code(text: str) -> str:
    """A text in the order of the ids, missing ones first."""
    return f"{int(text) + 2**63:020d}" if text else ""


def _record(kind: str, page_id: str, url: str, digest: str, body: bytes, size: int, refers_to: str) -> bytes:
    head = [
        VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url),
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(head).encode() + body + b"\r\n\r\n"


def write_archives(pages: DataFrame) -> DataFrame:
    """Write every page as a record, one archive per task, and return the captures."""
    path = flat_files.folder(pages.sparkSession, "warc")
    # the revisits are ids and digests only, one row for each page and payload: every row of pages stays one row
    joined = pages.select("page_id", "url", "html", url_key(F.col("url")).alias("key"), payload_digest().alias("digest")).join(
        plan_records(pages), ["page_id", "digest"], "left"
    ).select(F.col("page_id").cast("string"), "url", "html", "key", "digest", F.col("refers_to").cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, out = flat_files.fresh(path, ".warc.gz"), None
        for frame in frames:
            rows = []
            for page, url, html, key, digest, first in frame.itertuples(index=False):
                out = out or flat_files.open_new(name)
                payload = html.encode() if isinstance(html, str) else b""
                revisit = isinstance(first, str)
                record = _record(
                    "revisit" if revisit else "response", _id_text(page), url if isinstance(url, str) else "",
                    digest, b"" if revisit else payload, len(payload), _id_text(first),
                )
                start = out.tell()
                out.write(gzip.compress(record, 3, mtime=0))
                rows.append((key, _id_text(page), name, start, out.tell() - start))
            done = pd.DataFrame(rows, columns=["key", "page_id", "archive", "offset", "length"])
            yield done.assign(page_id=_ids(done["page_id"]))
        if out is not None:
            out.close()

    return stage(joined.mapInPandas(run, CAPTURES), "captures")


BLOCKS = "first_key string, block string, lines binary"


def build_index(captures: DataFrame) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(blocks, directory): sorted captures in compressed blocks, and every block's first line and name.

    Lines are sorted across the cluster by (key, page_id, archive, offset).
    """
    rows = captures.count()
    lines = max(BLOCK_LINES, -(-rows // (DIRECTORY_ROWS // 2)))
    # a range may hold less than a block, so there are at most as many ranges as half the directory
    ranges = max(1, min(-(-rows // lines), DIRECTORY_ROWS // 2))
    line = F.concat_ws("\t", F.regexp_replace("key", r"[\t\n\r]", " "), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (
        "page_id", "archive", "offset", "length")])
    order = ["key", "page_id", "archive", "offset"]  # rows of one page may fill many ranges
    sorted_lines = (
        captures.select(F.regexp_replace("key", r"[\t\n\r]", " ").alias("key"), *order[1:], line.alias("line"))
        .repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .select("line")
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[str] = []

        def block(some):
            text = "\n".join(some).encode()
            key, page, archive, offset, _ = some[0].split("\t")
            first = f"{key}\t{_id_code(page)}\t{archive}\t{int(offset):020d}"  # in the order of the lines, without ties
            return (first, hashlib.sha256(text).hexdigest(), zlib.compress(text, 6))

        for frame in frames:
            held += frame["line"].tolist()
            full = []
            while len(held) >= lines:
                full.append(block(held[:lines]))
                held = held[lines:]
            if full:
                yield pd.DataFrame(full, columns=["first_key", "block", "lines"])
        if held:
            yield pd.DataFrame([block(held)], columns=["first_key", "block", "lines"])

    blocks = stage(sorted_lines.mapInPandas(run, BLOCKS), "blocks")
    directory = [(r[0], r[1]) for r in blocks.select("first_key", "block").collect()]  # at most DIRECTORY_ROWS
    return blocks, sorted(directory, key=lambda x: (x[0].encode(), x[1]))


FOUND = "page_id long, archive string, offset long, length long"


def find(wanted: DataFrame, blocks: DataFrame, directory: list[tuple[str, str]]) -> DataFrame:
    """The captures of wanted (key, page_id): directory search, then a search in the block.

    A key is asked for in the last block whose first line is before it, and in all blocks that begin
    with a line of it.
    """
    firsts = [x[0].encode() for x in directory]
    names = [x[1] for x in directory]

    def locate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, page in frame.itertuples(index=False):
                at = f"{key}\t{_id_code(_id_text(page))}".encode()
                low = max(0, bisect.bisect_left(firsts, at) - 1)
                high = bisect.bisect_left(firsts, at + b"\n")  # behind all lines of the page, which go on with a tab
                rows += [(names[b], key, page) for b in range(low, high)]
            yield pd.DataFrame(rows, columns=["block", "key", "page_id"])

    def search(keys: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=["page_id", "archive", "offset", "length"])
        lines = [x.split("\t") for x in zlib.decompress(block["lines"].iloc[0]).decode().split("\n")]
        sorted_keys = [(x[0].encode(), _id_code(x[1])) for x in lines]
        out = []
        for key, page in zip(keys["key"], map(_id_text, keys["page_id"])):
            at = (key.encode(), _id_code(page))
            for k in range(bisect.bisect_left(sorted_keys, at), bisect.bisect_right(sorted_keys, at)):
                out.append((page, lines[k][2], int(lines[k][3]), int(lines[k][4])))
        found = pd.DataFrame(out, columns=["page_id", "archive", "offset", "length"])
        return found.assign(page_id=_ids(found["page_id"]))

    asked = wanted.select(F.regexp_replace("key", r"[\t\n\r]", " ").alias("key"), F.col("page_id").cast("string")).distinct()
    located = asked.mapInPandas(locate, "block string, key string, page_id string")
    return located.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(search, FOUND)


READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != VERSION:
        raise ValueError("not at the start of a record")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def read_ranges(found: DataFrame, payloads: bool = True) -> DataFrame:
    """Range-read the records (archive, offset, length), in file order, and check their digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for archive, some in frame.groupby("archive", sort=False):
                with flat_files.open_ranges(archive) as data:
                    for offset, length in zip(some["offset"], some["length"]):
                        fields, body = _parse(gzip.decompress(data.read_at(length, offset)))
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].partition(":")[2]
                        if kind == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"damaged record in {archive} at {offset}")
                        rows.append((
                            fields["WARC-Record-ID"][10:-1], int(fields["X-Payload-Length"]), digest, kind,
                            fields.get("WARC-Refers-To", "")[10:-1], body if payloads else None,
                        ))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in READ.split(", ")])
            yield out.assign(page_id=_ids(out["page_id"]), refers_to=_ids(out["refers_to"]))

    spread = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = found.repartitionByRange(spread, "archive", "offset").sortWithinPartitions("archive", "offset")
    return placed.mapInPandas(run, READ)


@query("op7_warc", """
SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER same THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(coalesce(html, '')) >= 100 AND page_id > min(page_id) OVER same THEN min(page_id) OVER same END AS refers_to
FROM pages WINDOW same AS (PARTITION BY sha256(coalesce(html, '')))
""")
def op7_warc(spark, sf_dir):
    captures = write_archives(table(spark, sf_dir, "pages"))
    blocks, directory = build_index(captures)
    found = find(captures.select("key", "page_id"), blocks, directory)
    return read_ranges(found, payloads=False).drop("payload")
