"""Token ids in files of compressed bit planes.

Layout of a file, numbers little-endian:

* ``BPL1``, then the blocks one after another. A block holds ``block_ids`` ids (the last of a
  file fewer), transposed into planes: plane ``p`` has bit ``p`` (or byte ``p``) of every id.
  Each plane is one zstandard frame; planes above the block's largest id are not stored.
* the chunk index, zstandard-compressed JSON: per block its offset, number of ids and the
  lengths of its planes, and per document its id and number of ids;
* the index's offset and length (two u64) and ``BPL1`` again.

Documents follow each other in the order of their ids, each closed by the end id, and may
span blocks.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from discweave.llm import files
from discweave.llm.common import open_fs, plan_shards, row_salt, shard_of, text_or_empty
from discweave.llm.words import dealt, row_groups, tidy

MAGIC = b"BPL1"
TAIL = struct.Struct("<QQ4s")


# --- planes ------------------------------------------------------------------------------------


def to_planes(ids: np.ndarray, unit: str = "bit") -> list[bytes]:
    """The planes of a block of 32-bit ids, lowest first, without those that are all zero above."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    ids = ids.astype("<u4", copy=False)
    if unit == "byte":
        return [(ids >> np.uint32(8 * p)).astype(np.uint8).tobytes() for p in range((width + 7) // 8)]
    return [np.packbits((ids >> np.uint32(p)).astype(np.uint8) & 1, bitorder="little").tobytes() for p in range(width)]


def from_planes(planes: list[bytes], n: int, unit: str = "bit") -> np.ndarray:
    out = np.zeros(n, "<u4")
    for p, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        if unit == "byte":
            out |= values.astype("<u4") << np.uint32(8 * p)
        else:
            out |= np.unpackbits(values, count=n, bitorder="little").astype("<u4") << np.uint32(p)
    return out


class Writer:
    def __init__(self, sink, block_ids: int = 1 << 16, unit: str = "bit", level: int = 3):
        self.sink, self.block_ids, self.unit = sink, block_ids, unit
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.blocks: list[list] = []
        self.docs: list[list] = []
        self.pending: list[np.ndarray] = []
        self.held = self.n_ids = 0
        sink.write(MAGIC)

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids)])
        self.pending.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block_ids:
            ids = np.concatenate(self.pending)
            whole = len(ids) // self.block_ids * self.block_ids
            for at in range(0, whole, self.block_ids):
                self._block(ids[at : at + self.block_ids])
            self.pending, self.held = [ids[whole:]], len(ids) - whole

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.compress(p) for p in to_planes(ids, self.unit)]
        self.blocks.append([self.sink.size, len(ids), [len(p) for p in planes]])
        self.sink.write(b"".join(planes))

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.pending))
        index = self.compress(json.dumps({"unit": self.unit, "blocks": self.blocks, "docs": self.docs}).encode())
        at = self.sink.size
        self.sink.write(index)
        self.sink.write(TAIL.pack(at, len(index), MAGIC))
        self.sink.close()


def read_file(folder: str, name: str) -> Iterator[tuple[object, np.ndarray]]:
    """Each document's id and ids, one block in memory at a time."""
    fs, base = open_fs(folder)
    expand = zstandard.ZstdDecompressor().decompress
    with fs.open_input_file(f"{base}/{name}") as f:
        size = f.size()
        at, length, magic = TAIL.unpack(f.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC or f.read_at(4, 0) != MAGIC:
            raise ValueError(f"{name} is not a bit-plane file")
        index = json.loads(expand(f.read_at(length, at)))
        blocks = iter(index["blocks"])
        rest = np.zeros(0, np.uint32)
        for doc_id, n in index["docs"]:
            parts, have = [rest], len(rest)
            while have < n:
                offset, count, lengths = next(blocks)
                data, planes, p = f.read_at(sum(lengths), offset), [], 0
                for length in lengths:
                    planes.append(expand(data[p : p + length]))
                    p += length
                parts.append(from_planes(planes, count, index["unit"]))
                have += count
            ids = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc_id, ids[:n]
            rest = ids[n:]


# --- encoding ----------------------------------------------------------------------------------


#: Bytes that are white space to Python, to the library, or to both; and ASCII letters.
SPACES, LETTERS = np.zeros(256, bool), np.zeros(256, bool)
SPACES[[*range(9, 14), *range(28, 33)]] = True
LETTERS[[*range(65, 91), *range(97, 123)]] = True
#: Closing marks: after a letter and before the end of a piece each is pre-split alone.
CLOSING = ",.;:!?"


class Encoder:
    """Ids of whole texts by the tokenizers library.

    A text is cut before every single space or line feed between two characters that are not white
    space; what follows such a cut is pre-split apart from what is before it, whatever the texts,
    and so encoded alike wherever it stands. So is a closing mark at the end of a word. Each
    distinct piece of a group of texts is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        added = {i: len(t.content.encode()) for i, t in self.library.get_added_tokens_decoder().items()}
        self.bytes_of = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        for name, i in vocabulary.items():
            self.bytes_of[i] = len(name)  # a character of a byte-level name is a byte
        for i, n in added.items():
            self.bytes_of[i] = n
        self.closing = self._library(list(CLOSING))
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of pieces."""
        self.known: dict[str, dict[str, bytes]] = {" ": {}, "\n": {}}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _after(self, before: str, pieces: list[str]) -> list[bytes]:
        """The ids of distinct pieces and the space or line feed ``before`` each of them.

        The library sees many unknown ones in one text; its ids are dealt back to them by the bytes
        that each id stands for.
        """
        known = self.known[before]
        found = list(map(known.get, pieces))
        unseen = [k for k, f in enumerate(found) if f is None]
        if unseen:
            names = [pieces[k] for k in unseen]
            data = b"".join(self._library([before + before.join(names[at : at + 128]) for at in range(0, len(names), 128)]))
            sizes = pc.binary_length(pa.array(names, pa.string())).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            ends = 4 * (np.searchsorted(np.cumsum(self.bytes_of[np.frombuffer(data, "<u4")]), np.cumsum(sizes), side="left") + 1)
            if ends[-1] != len(data):
                raise ValueError("pieces were not encoded apart from each other")
            if len(known) + len(names) > REMEMBERED:
                known.clear()
            begin, longest = 0, int(sizes.max())
            for k, name, end in zip(unseen, names, ends.tolist(), strict=True):
                found[k] = ids = data[begin:end]
                begin = end
                if longest <= 200 or len(name) <= 200:
                    known[name] = ids
        return found

    def __call__(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The ids of texts (none null) in a row, and the number of ids up to the end of each."""
        lines = pc.split_pattern(texts, "\n")
        line_ends = lines.offsets.to_numpy().astype(np.int64)
        parts = pc.split_pattern(lines.flatten(), " ")
        part_ends = parts.offsets.to_numpy().astype(np.int64)
        found = parts.flatten().dictionary_encode()
        codes, spelled = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary
        n = len(codes)
        starts = (part_ends - part_ends[0])[line_ends - line_ends[0]]  # of the texts' parts, and n
        before = np.full(n, 2, np.int8)  # a space, 1 a line feed, 0 nothing
        before[part_ends[:-1] - part_ends[0]] = 1
        before[starts[:-1]] = 0
        # a part is joined to the one before where what is between them is no cut
        size = pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64)
        data, first = np.frombuffer(spelled.buffers()[2] or b"\0", np.uint8), np.cumsum(size) - size
        opening, closing = np.zeros(len(size), np.uint8), np.zeros(len(size), np.uint8)
        full = size > 0
        opening[full], closing[full] = data[first[full]], data[first[full] + size[full] - 1]
        bad_start, bad_end = SPACES[opening] | ~full, SPACES[closing] | ~full
        for k in np.flatnonzero((opening >= 128) | (closing >= 128)).tolist():
            name = spelled[k].as_py()
            bad_start[k], bad_end[k] = name[0].isspace(), name[-1].isspace()
        joined = bad_start[codes]
        joined[1:] |= bad_end[codes[:-1]]
        joined[before == 0] = False
        heads = np.flatnonzero(~joined)  # the first part of every piece
        sizes = np.diff(np.concatenate([heads, [n]]))
        plain = (sizes == 1) & (before[heads] > 0)
        # single parts: the word and, if one closes it, the mark
        mark = np.full(len(size), -1, np.int64)
        long = size > 1
        letter = np.zeros(len(size), bool)
        letter[long] = LETTERS[data[first[long] + size[long] - 2]]
        for k, c in enumerate(CLOSING):
            mark[letter & (closing == ord(c))] = k
        marked = mark >= 0
        stems = np.zeros(len(size), np.int64)
        names = pa.concat_arrays([spelled.filter(pa.array(~marked)), pc.binary_slice(spelled.filter(pa.array(marked)).cast(pa.binary()), 0, -1).cast(pa.string())]).dictionary_encode()
        stems[np.concatenate([np.flatnonzero(~marked), np.flatnonzero(marked)])] = names.indices.to_numpy(zero_copy_only=False)
        names = names.dictionary.to_pylist()
        own = codes[heads]
        table: list[bytes] = list(self.closing)
        code = np.zeros(len(heads), np.int64)
        for value, text in ((1, "\n"), (2, " ")):
            here = plain & (before[heads] == value)
            wanted = np.flatnonzero(np.bincount(stems[own[here]], minlength=len(names)))
            place = np.zeros(len(names), np.int64)
            place[wanted] = len(table) + np.arange(len(wanted))
            code[here] = place[stems[own[here]]]
            table += self._after(text, [names[k] for k in wanted.tolist()])
        other = np.flatnonzero(~plain)
        longer = []
        for h, k in zip(heads[other].tolist(), sizes[other].tolist(), strict=True):
            pieces = []
            for gap, c in zip(before[h : h + k].tolist(), codes[h : h + k].tolist(), strict=True):
                pieces += [("", "\n", " ")[gap], spelled[c].as_py()]
            longer.append("".join(pieces))
        code[other] = len(table) + np.arange(len(other))
        for at in range(0, len(longer), 1000):
            table += self._library(longer[at : at + 1000])
        # a marked word is two codes
        closed = plain & marked[own]
        place = np.arange(len(heads)) + np.concatenate([[0], np.cumsum(closed)[:-1]])
        row = np.zeros(len(heads) + int(closed.sum()), np.int64)
        row[place] = code
        row[place[closed] + 1] = mark[own[closed]]
        out, upto = dealt(table, row)
        until = np.concatenate([place, [len(row)]])[np.searchsorted(heads, starts[1:])]
        return out, np.concatenate([[0], upto // 4])[until]


#: Pieces that a task remembers after either separator, of up to 200 characters each; they are
#: dropped with the task.
REMEMBERED = 400_000


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """The library's tokenizer, some ten MB, which a worker keeps."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Encoder(path)


# --- the operator ------------------------------------------------------------------------------


def write_ids(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_bytes: int = 32 << 20, block_ids: int = 1 << 16, unit: str = "bit") -> list[dict]:
    """Encode every whole text and write the ids in ascending order of ``id_col``.

    Shards are ranges of ids with about ``shard_bytes`` of text, found from the data alone, so
    the same table gives the same files; each is one file. Null texts are empty: just the end
    id. Null ids come last; rows that share an id are ordered by a hash of their text and may
    lie in several shards. (Rows alike in id and text that fill more than half a shard are dealt
    to shards by their place in the input, so a table stored otherwise may part them elsewhere;
    the order of all ids is the same.) Other columns are not read. An empty table gives an empty
    manifest. Returns the manifest's entries, with the number of ids before each file (``start``).
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    shards = plan_shards(own, "id", F.octet_length("text"), shard_bytes, F.col("tie"), salted=True)
    dealt_out = own.select("id", "text", shard_of(shards, F.col("id"), F.col("tie"), row_salt()).alias("shard"), "tie")
    dealt_out = dealt_out.repartitionById(len(shards), F.col("shard")).sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "tie", "text")

    def write(batches):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4")
        writer = None
        shard = docs_in = 0

        def row():
            writer.close()
            return pa.RecordBatch.from_pydict({"name": [writer.sink.name], "temporary": [writer.sink.temporary], "shard": pa.array([shard], pa.int32()), "n_docs": [docs_in], "n_ids": [writer.n_ids], "bytes": [writer.sink.size]})

        try:
            for batch in batches:
                for a, b in row_groups(batch.column(1)):
                    data, ends = encode(batch.column(1)[a:b])
                    ids, before = np.frombuffer(data, "<u4"), 0
                    for key, at, upto in zip(batch.column(0)[a:b].to_pylist(), batch.column(2)[a:b].to_pylist(), ends.tolist(), strict=True):
                        if writer is None or at != shard:
                            if writer:
                                yield row()
                            shard, docs_in = at, 0
                            writer = Writer(files.Sink(folder, f"ids-{shard:06d}.bpl"), block_ids, unit)
                        writer.add(key, np.concatenate([ids[before:upto], end]))
                        before = upto
                        docs_in += 1
            if writer:
                yield row()
        finally:
            encode.forget()
            tidy()

    written = dealt_out.mapInArrow(write, "name string, temporary string, shard int, n_docs long, n_ids long, bytes long")
    start = 0
    entries = files.commit(written, folder, ["shard"])
    for entry in entries:
        entry["start"] = start
        start += entry["n_ids"]
    return entries


def read_ids(spark: SparkSession, folder: str, entries: list[dict], keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep_ids else "")

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for doc_id, ids in read_file(folder, name):
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), *([ids.tolist()] if keep_ids else [])))
                    start += len(ids)
                    held += len(ids)
                    if len(rows) >= 5000 or keep_ids and held > 500_000:
                        yield as_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows)

    def as_batch(rows):
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(rows[0])])

    tasks = files.one_task_each(spark, [{"name": e["name"], "start": e["start"]} for e in entries], "name string, start long")
    return tasks.mapInArrow(read, schema)
