import gzip
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from compare import canonical, connect, duck
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow.fs import FileSelector
from tokenizers import Tokenizer

from discweave.llm import bitplane, files, queries, warc
from discweave.llm.common import key_splits, open_fs, scratch

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, unit):
    array = np.array(ids, np.uint32)
    assert (bitplane.from_planes(bitplane.to_planes(array, unit), len(ids), unit) == array).all()


def test_documents_span_blocks(spark):
    folder = scratch(spark, "t")
    sink = files.Sink(folder, "x.bpl")
    writer = bitplane.Writer(sink, block_ids=8)
    docs = [(k, np.arange(k % 13, dtype=np.uint32) + k) for k in range(40)]
    for k, ids in docs:
        writer.add(k, ids)
    writer.close()
    back = list(bitplane.read_file(folder, sink.temporary))
    assert [k for k, _ in back] == [k for k, _ in docs] and all((a == b).all() for (_, a), (_, b) in zip(back, docs, strict=True))


def brute_ids(table):
    library = Tokenizer.from_file(BYTES)
    rows = sorted(((r.doc_id is None, r.doc_id, r.text or "") for r in table.collect()), key=lambda r: (r[0], r[1] or 0, r[2].encode()))
    start, out = 0, []
    for _, k, text in rows:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        out.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_ids_of_whole_tables(spark, odd):
    assert [tuple(r) for r in queries.op8_bitplane_ids(spark, SF).orderBy("doc_id").collect()] == brute_ids(spark.read.parquet(f"{SF}/documents.parquet"))
    folder = scratch(spark, "t")
    entries = bitplane.write_ids(odd, folder, BYTES, shard_bytes=100)
    assert entries == sorted(entries, key=lambda e: e["shard"]) and files.manifest(folder) == [{k: v for k, v in e.items() if k != "start"} for e in entries]
    got = sorted((tuple(r) for r in bitplane.read_ids(spark, folder, entries).collect()), key=lambda r: r[1])
    assert got == brute_ids(odd)
    assert bitplane.read_ids(spark, scratch(spark, "t"), bitplane.write_ids(odd.where("false"), scratch(spark, "t"), BYTES)).count() == 0


def test_splits_depend_on_the_data_alone(spark):
    from pyspark.sql import functions as F

    df = spark.range(5000).withColumnRenamed("id", "k")
    a = key_splits(df.repartition(3), "k", F.lit(1), 500)
    assert a == key_splits(df.repartition(7), "k", F.lit(1), 500) and len(a) == 9
    assert key_splits(df.where("false"), "k", F.lit(1), 500) == []


PAGES = "page_id long, url string, html string, key string, shard int"


def test_warc_query_against_sql(spark):
    got, want = canonical(queries.op1_warc(spark, SF).toArrow()), canonical(duck(connect(SF), queries.ORACLES["op1_warc"]))
    assert got == want


def test_warc_odd_pages(spark, rows):
    big = "<p>" + "x" * 200
    data = [(5, "http://a/ b", big, "k", 1), (2, None, big, "k", 1), (2, "u", big, "k", 1), (7, "u", "tiny", "k", 1), (8, "u", "tiny", "k", 1), (9, "u", None, "k", 1), (None, "u", big, "k", 1), (11, "é", "é" * 60, None, None)]
    df = spark.createDataFrame(data, PAGES)
    folder = scratch(spark, "t")
    entries = warc.write_archives(df, folder, shard_bytes=600, roll_bytes=300)
    assert len(entries) > 2
    got = rows(warc.read_archives(spark, folder, entries), "page_id", "payload_bytes", "record_type", "refers_to")
    assert got == [(2, 203, "response", None), (2, 203, "revisit", 2), (5, 203, "revisit", 2), (7, 4, "response", None), (8, 4, "response", None), (9, 0, "response", None), (11, 120, "response", None), (None, 203, "revisit", 2)]
    again = scratch(spark, "t")
    warc.write_archives(df.repartition(5), again, shard_bytes=600, roll_bytes=300)
    for e in entries:  # the same rows give the same bytes
        texts = []
        for f in (folder, again):
            fs, base = open_fs(f)
            with fs.open_input_stream(f"{base}/{e['name']}", compression=None) as s:
                texts.append(s.read())
        assert texts[0] == texts[1]
        assert gzip.decompress(texts[0]).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    fs, base = open_fs(folder)
    assert not [i for i in fs.get_file_info(FileSelector(base, recursive=True)) if "_temporary" in i.path]
    assert warc.read_archives(spark, folder, warc.write_archives(df.where("false"), scratch(spark, "t"))).count() == 0


def test_warc_reader_refuses_damage():
    good = warc.page_record(1, hashlib.sha256(b"abc").hexdigest(), "u", b"abc", None, 0, 6)
    assert len(list(warc.read_records(iter([good[:10], good[10:], good])))) == 2
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_records(iter([good[:-5]])))


def test_one_id_in_many_shards(spark):
    from pyspark.sql import functions as F

    table = spark.range(60_000).select(F.lit(7).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the same words in all").otherwise(F.concat(F.lit("number "), F.col("id").cast("string"))).alias("text"))
    table = table.unionByName(spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text")))
    folder = scratch(spark, "t")
    entries = bitplane.write_ids(table, folder, BYTES, shard_bytes=100_000)
    assert len(entries) > 8 and max(e["n_docs"] for e in entries) < 25_000 and sum(e["n_docs"] for e in entries) == 80_000
    rows = bitplane.read_ids(spark, folder, entries).orderBy("start").collect()
    assert [r.start for r in rows[1:]] == [r.start + r.n_tokens for r in rows[:-1]]
    assert [r.doc_id for r in rows] == [7] * 60_000 + [None] * 20_000
    same = np.array([*Tokenizer.from_file(BYTES).encode("the same words in all", add_special_tokens=False).ids, 0], "<u4")
    assert sum(r.ids_crc32 == zlib.crc32(same.tobytes()) for r in rows) == 30_000


def test_ranks_among_splits():
    import random

    from discweave.llm.common import rank

    rng = random.Random(1)
    points = sorted({tuple(rng.randint(0, 3) for _ in range(4)) for _ in range(40)})
    rows = [tuple(rng.randint(0, 4) for _ in range(4)) for _ in range(500)]
    got = rank([np.array(c) for c in zip(*points, strict=True)], [np.array(c) for c in zip(*rows, strict=True)])
    assert got.tolist() == [sum(p <= r for p in points) for r in rows]
