import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from discweave.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def as_library(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_small_automaton_equals_merging_by_rank():
    names = ["a", "b", "c", "aa", "ab", "bc", "aab", "abc", "aaaa", "cab"]
    at = {n: i for i, n in enumerate(names)}
    merges = [(at[x], at[y], at[x + y]) for x, y in (("a", "a"), ("a", "b"), ("b", "c"), ("aa", "b"), ("ab", "c"), ("aa", "aa"), ("c", "ab"))]
    automaton = bpe.Automaton([0, 1, 2], merges, lambda t: names[t])

    def merged(word):
        parts = [at[c] for c in word]
        for u, v, w in merges:
            k, out = 0, []
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == (u, v):
                    out.append(w)
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    for n in range(1, 9):
        for k in range(3**n):
            word = "".join("abc"[k // 3**i % 3] for i in range(n))
            assert automaton.encode(word) == merged(word), word


def test_random_texts_as_the_library(library):
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyzéßñ'<|>0123 .,!?\x85\xa0　​\x1c\t\x00日本語İǅſ́A\U0001f600ΣΟÀª²½"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts += ["".join(rng.choice("the inaontersd") for _ in range(40)) for _ in range(500)] + ["a" * k for k in range(40)]
    texts += ["x<|endoftext|>y <|startoftext|> <|endoftext|", "I'll we've 'storm", ""]
    own = bpe.Codec(PATH)
    for text in texts:
        ids, decoded = own.encode_decode(text)
        assert (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()) == as_library(library, text), repr(text)


def test_whole_table_and_odd_rows(spark, library, odd):
    for table in (odd, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd.where("false")):
        texts = {}
        for r in table.collect():
            texts.setdefault(r.doc_id, []).append(r.text)
        got = bpe.encode_documents(table, PATH).collect()
        assert len(got) == sum(map(len, texts.values()))
        for r in got:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) in [as_library(library, t) for t in texts[r.doc_id]]


def test_ids_themselves(docs, library):
    r = bpe.encode_documents(docs([(1, "Hello there")]), PATH, keep_ids=True).first()
    assert r.ids == library.encode("Hello there", add_special_tokens=False).ids and r.decoded == "hello</w> there</w>"


def test_long_words_take_linear_time(library):
    import time

    own = bpe.Codec(PATH)
    rng = random.Random(3)
    for text in ("".join(rng.choice("abcdefghijé") for _ in range(20_000)), "a" * 5000, "日本" * 2000, "don't " * 3000 + "x" * 9000):
        ids, decoded = own.encode_decode(text)
        assert (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()) == as_library(library, text)
    took = []
    for n in (250_000, 1_000_000):
        word = "".join(rng.choice("abcdefghij") for _ in range(n))
        began = time.process_time()
        own.encode_decode(word)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5
