"""Deterministic sharded WARC 1.1 archives.

Records are range-sorted by their key into shards that depend on the data alone; a shard rolls
to its next file once the compressed size of the open one reaches a limit. Headers and digests
are made anew from the payload. Every record is a gzip member of its own. A payload that an
earlier record holds is written as a revisit record, with the headers of the full payload and
no body.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discweave.llm import files
from discweave.llm.common import Workspace, plan_shards, shard_of, text_or_empty

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields]
    head += [("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def target(url: str | None) -> list[tuple[str, str]]:
    """A URI has no white space or control characters; others are percent-encoded."""
    if not url:
        return []
    return [("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f-￿\U00010000-\U0010ffff<>]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))]


def page_record(key, digest: str, url: str | None, payload: bytes, first, ordinal: int, level: int) -> bytes:
    """``ordinal``: how many rows with this key and digest came before. ``first``: of a revisit, the
    key of the response in a tuple; else None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own = f"urn:page:{'null' if key is None else key}:{digest[:16]}"
    fields = [*target(url), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if first is None:
        return record("response", own if not ordinal else f"{own}:{ordinal}", fields, http + payload, level)
    refers = f"urn:page:{first[0] if first[0] is not None else 'null'}:{digest[:16]}"
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers}>")]
    return record("revisit", f"{own}:{ordinal}r", fields, http, level)


def write_archives(pages: DataFrame, folder: str, key_col: str = "page_id", payload_col: str = "html", url_col: str = "url", shard_bytes: int = 32 << 20, roll_bytes: int = 64 << 20, least_revisit: int = 100, level: int = 6) -> list[dict]:
    """Write a record per row, range-sorted by ``key_col``; returns the manifest's entries.

    Of rows with equal payloads of at least ``least_revisit`` bytes the one with the smallest
    key is the response and the others revisit it; among rows that also share that key the
    first of them is the response. Smaller payloads are all responses. A null payload is
    empty; null keys sort last and lose to any other; a null url gives no target header. Rows
    that share a key are ordered by a hash of their payload and may lie in several shards.
    Columns other than these three are not read. No rows give no files.

    One shuffle moves the payloads. Which rows revisit is decided on digests alone, and those
    decisions travel in the same range shuffle, sorted right before the rows they are about.
    """
    own = pages.select(
        F.col(key_col).cast("long").alias("key"),
        text_or_empty(payload_col).cast("binary").alias("payload"),
        F.col(url_col).cast("string").alias("url"),
    ).withColumn("digest", F.sha2("payload", 256)).withColumn("tie", F.xxhash64("payload"))
    work = Workspace(pages.sparkSession, "warc")
    slim = own.where(F.octet_length("payload") >= least_revisit).select("key", "digest", "tie")
    shared = slim.groupBy("digest").agg(F.count("*").alias("n"), F.min("key").alias("first")).where("n > 1").drop("n")
    decided = work.put(slim.join(shared, "digest").groupBy("key", "digest", "tie").agg(F.min("first").alias("first")), "revisits")
    shards = plan_shards(own, "key", F.octet_length("payload") + 300, shard_bytes, F.col("tie"))
    roll_bytes = max(roll_bytes, int(shards.total / (files.MOST_FILES - len(shards))))
    rows = own.select("key", "digest", F.lit(1).alias("kind"), "payload", "url", F.lit(None).cast("long").alias("first"), "tie")
    notes = decided.select("key", "digest", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), F.lit(None).cast("string").alias("url"), "first", "tie")
    both = rows.unionByName(notes).withColumn("shard", shard_of(shards, F.col("key"), F.col("tie")))
    dealt = both.repartitionById(len(shards), F.col("shard")).sortWithinPartitions("shard", F.col("key").asc_nulls_last(), "tie", "digest", "kind", F.col("url").asc_nulls_first()).drop("tie")

    def write(batches):
        sink, shard, part, records, responses = None, None, 0, 0, 0
        note, note_first, last, ordinal = None, None, None, 0

        def done():
            sink.close()
            return pa.RecordBatch.from_pydict({"name": [sink.name], "temporary": [sink.temporary], "shard": pa.array([shard], pa.int32()), "part": pa.array([part], pa.int32()), "records": [records], "responses": [responses], "bytes": [sink.size]})

        def begin():
            out = files.Sink(folder, f"pages-{shard:06d}-{part:04d}.warc.gz")
            info = b"software: discweave\r\nformat: WARC File Format 1.1\r\n"
            out.write(record("warcinfo", f"urn:archive:{out.name}", [("WARC-Filename", out.name), ("Content-Type", "application/warc-fields")], info, level))
            return out

        for batch in batches:
            for values in zip(*batch.columns, strict=True):
                key, digest, kind, payload, url, first, at = (v.as_py() for v in values)
                if kind == 0:
                    note, note_first = (key, digest), first
                    continue
                if sink is not None and (at != shard or sink.size >= roll_bytes):
                    yield done()
                    sink, part = None, part + 1 if at == shard else 0
                if sink is None:
                    shard, records, responses = at, 0, 0
                    sink = begin()
                ordinal, last = (ordinal + 1 if last == (key, digest) else 0), (key, digest)
                revisits = note == last and (note_first != key or ordinal > 0)
                sink.write(page_record(key, digest, url, payload, (note_first,) if revisits else None, ordinal, level))
                records, responses = records + 1, responses + (not revisits)
        if sink is not None:
            yield done()

    written = dealt.mapInArrow(write, "name string, temporary string, shard int, part int, records long, responses long, bytes long")
    entries = files.commit(written, folder, ["shard", "part"])
    work.drop("revisits")
    return entries


def read_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record, a gzip member at a time."""
    unpack, data = zlib.decompressobj(31), []
    for chunk in chunks:
        while chunk:
            data.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if not unpack.eof:
                break
            whole = b"".join(data)
            head, _, rest = whole.partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
            fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            n = int(fields["content-length"])
            if len(rest) != n + 4 or not rest.endswith(b"\r\n\r\n"):
                raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
            yield fields, rest[:n]
            unpack, data = zlib.decompressobj(31), []
    if any(data):
        raise ValueError("the archive ends within a record")


def page_number(uri: str) -> int | None:
    name = uri.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def read_archives(spark: SparkSession, folder: str, entries: list[dict], keep_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url (and payload) of every
    page record. Block digests, and payload digests of responses, are checked; a mismatch raises."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"] + ["payload"] * keep_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def read(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                held = 0
                for fields, block in read_records(files.read_chunks(folder, name)):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    head, _, body = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                    if fields["warc-block-digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != length):
                        raise ValueError(f"digest mismatch in {name}: {fields['warc-record-id']}")
                    refers = page_number(fields["warc-refers-to"]) if kind == "revisit" else None
                    rows.append((page_number(fields["warc-record-id"]), length, digest, kind, refers, fields.get("warc-target-uri"), *([body if kind == "response" else None] if keep_payload else [])))
                    held += len(body) * keep_payload
                    if len(rows) >= 5000 or held > 16 << 20:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * keep_payload
    return files.one_task_each(spark, [{"name": e["name"]} for e in entries], "name string").mapInArrow(read, schema)
