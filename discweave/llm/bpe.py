"""BPE encoding and decoding by a tokenization automaton.

The merges are compiled into a deterministic automaton over tokens whose paths from the start
are exactly the correct tokenizations. It starts as one state that accepts every sequence of
base symbols. Each merge ``(u, v) -> w``, in rank order, applies a merge gadget: the arcs
labelled ``u`` are redirected to a copy of their target that lacks the ``v`` arc, and every
state with a ``u`` arc gets a ``w`` arc to where ``u v`` led. All arcs with one label lead to
one state, so the finished table has the target of each label and the labels that each state
lacks. An arc ``w`` is lost with its own label, and with a label on its left spine that was
lost before the next spine label was made. Numbered in the order of the tree of left spines,
the labels that a state lacks are a few ranges; all ranges of all states are one sorted array,
and a transition is one search in it. Every word has exactly one accepting path; encoding
follows the arcs that spell it. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from array import array
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from discweave.llm.words import Remembered, dealt, row_groups, tidy, whole, words_of

#: Stands for the word end in the spelling of tokens; no byte-level character is this one.
END = "\n"
NONE = -1
#: The pre-splitting pattern of the word-end vocabulary for lower-case Latin-1 text.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\t-\r \x85\xa0a-z0-9\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")


class Automaton:
    """``merges``: (left, right, merged) token numbers in rank order; ``base``: the base symbols;
    ``spell``: the characters of a token."""

    def __init__(self, base: list[int], merges: list[tuple[int, int, int]], spell):
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.lost: list[tuple[int, int, int]] = [(-1, -1, -1)]  # copied from, label lost, when
        self.target = dict.fromkeys(base, 0)
        for rank, (u, v, w) in enumerate(merges):
            if w in self.left or w in self.target:
                raise ValueError(f"token {w} is made by two merges")
            self._gadget(rank, u, v, w)
        self._tabulate(base, merges)
        labels = {spell(t): t for t in self.target}
        most = max(self.target, default=0) + 1
        by_token = lambda known, default: array("q", [known.get(t, default) for t in range(most)])
        self.target, self.place = by_token(self.target, NONE), by_token(self.place, 0)
        self.size = by_token({t: len(name) for name, t in labels.items()}, 0)
        self.longest = max(map(len, labels), default=0)
        self.best: dict[str, int] = {}  # the longest label that begins a path along the labels
        shorter: dict[int, int] = {}  # the longest label that begins a label
        for name in sorted(labels):
            above = NONE
            for size in range(1, len(name) + 1):
                here = labels.get(name[:size], NONE)
                if here != NONE:
                    shorter[here] = above
                    above = here
                self.best[name[:size]] = above
        self.shorter = by_token(shorter, NONE)
        del self.left, self.born, self.lost
        self._index()

    def _index(self) -> None:
        trie = ahocorasick.Automaton()
        for path in self.best:
            trie.add_word(path, True)
        self.reach = trie.longest_prefix  # how far the labels go along a text

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "reach"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._index()

    def _copy(self, state: int, label: int, when: int) -> int:
        self.lost.append((state, label, when))
        return len(self.lost) - 1

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        self.left[w], self.born[w] = u, rank
        if u not in self.target or v not in self.target or not self._has_arc(self.target[u], v):
            return  # no path has u v next to each other, so the merge never happens
        before, beyond = self.target[u], self.target[v]
        self.target[u] = self._copy(before, v, rank)
        if u == v:  # u u u becomes w u, so w may not follow a lone u either
            self.target[u] = self._copy(self.target[u], w, rank)
        self.target[w] = beyond

    def _has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` leaves ``state``, while the automaton is being built."""
        spine = {token: 1 << 60}
        at = token
        while at in self.left:
            spine[self.left[at]] = self.born[at]
            at = self.left[at]
        while state > 0:
            state, label, when = self.lost[state]
            if when < spine.get(label, -1):
                return False
        return True

    def _tabulate(self, base: list[int], merges: list[tuple[int, int, int]]) -> None:
        """Number the labels so that those under one spine label follow each other, the youngest
        last, and list for each state the ranges of labels that it lacks."""
        size = dict.fromkeys(base, 1)
        for u, _, w in merges:
            size.setdefault(u, 1)
            size[w] = 1
        for u, _, w in reversed(merges):
            size[u] += size[w]
        self.place = {}
        free: dict[int, int] = {}
        at = 0
        for t in size:
            if t not in self.left:
                self.place[t], free[t] = at, at + 1
                at += size[t]
        below: dict[int, tuple[list[int], list[int]]] = {}
        for rank, (u, _, w) in enumerate(merges):
            ranks, places = below.setdefault(u, ([], []))
            self.place[w], free[w] = free[u], free[u] + 1
            ranks.append(rank)
            places.append(free[u])
            free[u] += size[w]
        self.width = at + 1
        parent, own, begin, end = (np.zeros(len(self.lost), np.int64) for _ in range(4))
        for state, (from_, label, when) in enumerate(self.lost[1:], 1):
            ranks, places = below.get(label, ([], []))
            younger = bisect_right(ranks, when)
            parent[state], own[state], end[state] = from_, self.place[label], self.place[label] + size[label]
            begin[state] = places[younger] if younger < len(places) else end[state]
        state = np.unique(np.array([s for s in self.target.values() if s > 0], np.int64))
        walk, lows, highs = state.copy(), [], []
        while len(state):
            key = state * self.width
            lows += [key + own[walk], key + begin[walk]]
            highs += [key + own[walk] + 1, key + end[walk]]
            walk = parent[walk]
            state, walk = state[walk > 0], walk[walk > 0]
        low, high = np.concatenate([[0], *lows]), np.concatenate([[0], *highs])
        order = np.argsort(low, kind="stable")
        low, high = low[order], np.maximum.accumulate(high[order])
        first = np.concatenate([[True], low[1:] > high[:-1]])
        last = np.concatenate([first[1:], [True]])
        #: Where ranges begin and end, in turn; state * width + place is a lost arc between the two.
        self.bounds = array("q", np.column_stack([low[first], high[last]]).reshape(-1).astype(np.int64).tobytes())

    def encode(self, word: str) -> list[int]:
        """The tokens of one pre-split word.

        Follows arcs from the start, the longest label first, and steps back where none
        exists. A prefix has one accepting path at most, so a position that proved a dead end
        is one for good and no position is tried twice: steps are linear in the word.
        """
        n, longest, width, reach, best, shorter, length, place, target, bounds = len(word), self.longest, self.width, self.reach, self.best.get, self.shorter, self.size, self.place, self.target, self.bounds
        out: list[int] = []
        back: list[tuple[int, int]] = []
        dead: set[int] = set()
        i = state = 0
        rest = word[:longest]
        token = best(rest[: reach(rest)], NONE)
        while i < n:
            low = state * width
            while token != NONE and (bisect_right(bounds, low + place[token]) & 1 or i + length[token] in dead):
                token = shorter[token]
            if token != NONE:
                out.append(token)
                back.append((i, state))
                i, state = i + length[token], target[token]
                rest = word[i : i + longest]
                token = best(rest[: reach(rest)], NONE)
            else:
                if not out:
                    raise ValueError(f"no path spells {word[:80]!r}")
                dead.add(i)
                token = shorter[out.pop()]
                i, state = back.pop()
        return out


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Codec:
    """Encodes and decodes whole texts as a tokenizer file of the word-end kind says.

    Normalising and pre-splitting are those of the file; the merges run in the automaton.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        names = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        #: What an id decodes to, a space after it.
        self.emitted = pa.array([f"{names.get(i, '')} ".encode() for i in range(max(names) + 1)], pa.large_binary())
        suffix = model.get("end_of_word_suffix") or ""
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        made = {w for _, _, w in merges}
        spell = lambda t: names[t].removesuffix(suffix) + END if suffix and names[t].endswith(suffix) else names[t]
        self.automaton = Automaton([i for i in vocab.values() if i not in made], merges, spell)
        self.byte_names = byte_symbols()
        self.forget()

    def forget(self) -> None:
        """Drop what is remembered of words; the compiled tables stay."""
        self.words = Remembered(self._word, 60_000)
        self.chunks = Remembered(self._chunk, 60_000)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("words", "chunks")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.forget()

    def _word(self, word: str) -> bytes:
        """The ids of one pre-split word in byte-level characters."""
        ids = self.automaton.encode(word + END)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        words = self.words
        if text.isascii() and text.isprintable():
            return b"".join([words[word] for word in LATIN.findall(text.lower())])
        if max(text) < "\u0100":  # composed already, and lower case is one to one
            names = self.byte_names
            return b"".join([words["".join([names[b] for b in word.encode()])] for word in LATIN.findall(text.lower())])
        return b"".join([words[word] for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))])

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a stretch without white space."""
        if "<" not in chunk:
            return self._plain(chunk)
        return b"".join([struct.pack("<I", self.special[part]) if part in self.special else self._plain(part) for part in self.at_special.split(chunk) if part])

    def encode(self, texts: pa.Array) -> tuple[memoryview, np.ndarray]:
        """Little-endian 32-bit ids of texts (none null) in a row, and the number of ids up to the
        end of each text. White space always parts words, so the chunks between ASCII white space
        are independent of each other."""
        words = words_of(texts)
        chunks = self.chunks
        data, ends = dealt([chunks[w] for w in words.spelled], words.codes)
        return data, np.concatenate([[0], ends // 4])[words.ends]

    def decode(self, ids: memoryview) -> tuple[memoryview, np.ndarray]:
        """The labels of the arcs, special tokens kept, each with the space after it that parts it
        from the next (there is no decoder), and where each ends."""
        taken = self.emitted.take(pa.array(np.frombuffer(ids, "<u4")))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)
        return memoryview(taken.buffers()[2] or b"")[: int(ends[-1])], ends

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """Ids and decoded text of one text."""
        ids, _ = self.encode(pa.array([text]))
        return bytes(ids), bytes(self.decode(ids)[0][:-1]) if len(ids) else b""


@lru_cache(maxsize=1)
def codec(path: str) -> Codec:
    """Compiled on the driver, once; workers get the finished tables."""
    own = Codec(path)
    tidy()
    return own


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, keep_text: bool = True) -> DataFrame:
    """Token ids of every whole text by the automaton, and the text decoded from them.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (array) and,
    unless ``keep_text`` is false, decoded. A null text is the empty text: no ids, and the digests of
    nothing. Ids may be null or repeated: each input row gives one row. Other columns are
    dropped, so their names cannot clash. Time is linear in the text, whatever its words; memory
    is that of one text or ``GROUP_BYTES`` of texts, the compiled tables (broadcast; as large as
    the vocabulary file makes them) and two caches of bounded size that end with the task. There
    is no shuffle; a table without rows gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(codec(tokenizer))
    keep_text = keep_ids and keep_text
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids + ["decoded"] * keep_text

    def rows(own: Codec, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        ids, ends = own.encode(texts)
        decoded, places = own.decode(ids)
        starts = np.concatenate([[0], ends[:-1]])
        cut = list(zip(starts.tolist(), ends.tolist(), strict=True))
        spans = [(int(places[a]), int(places[b]) - 1) if b > a else (0, 0) for a, b in cut]
        columns = [keys, pa.array(ends - starts), pa.array([hashlib.sha256(ids[4 * a : 4 * b]).hexdigest() for a, b in cut]), pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in spans])]
        if keep_ids:
            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.frombuffer(ids, "<i4"))))
        if keep_text:
            columns.append(pa.array([str(decoded[a:b], "utf-8") for a, b in spans], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        own = sent.value
        try:
            for batch in batches:
                texts = whole(batch.column(1))
                for a, b in row_groups(texts):
                    yield rows(own, batch.column(0)[a:b], texts[a:b])
                batch = texts = None
                tidy()
        finally:
            own.forget()
            tidy()

    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
