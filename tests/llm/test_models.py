import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from discweave.llm import editembed, language, licences, mixing, queries, toxicity

SF = "/root/testdata/sf0.01"


# --- languages -----------------------------------------------------------------------------------


def test_languages_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op7_language(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_never_sees_labels_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    spoiled = docs.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("x"))
    a = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predict_languages(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in language.predict_languages(spoiled).collect()}


def test_language_odd_rows(spark, docs, odd):
    train = docs([(i, "the cat and the dog", "en") for i in range(20)] + [(100 + i, "le chat et le chien", "fr") for i in range(20)])
    got = language.predict_languages(train.unionByName(odd.withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {r.lang_pred for r in got if r.doc_id == 1 and r.score == 0} == {"und"} and len(got) == 50
    assert all(r.lang_pred == "und" for r in language.predict_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect())
    assert language.predict_languages(odd.where("false")).count() == 0
    kept = language.keep_identified(train.unionByName(docs([(900, "123 !!!", "en"), (901, None, "en")])))
    assert kept.count() == 40 and kept.columns == train.columns


def test_backoff_from_words_to_grams():
    model = language.fit({"en": {"thing": 9, "thinking": 4}, "de": {"schule": 9, "schaden": 4}})
    best = lambda w: model.languages[int(model.word(w).argmax())]
    assert best("thing") == "en" and best("schulbus") == "de" and best("rethink") == "en"
    assert (model.word("日本") == 0).all()


# --- toxicity ------------------------------------------------------------------------------------


def test_folding():
    assert toxicity.fold("1D10T") == " idiot " and toxicity.fold("mоrоn") == " moron " and toxicity.fold("$tup!d") == " stupid "
    assert toxicity.fold("ＩＤＩＯＴ​") == " idiot " and toxicity.fold("word$$$ x").split() == ["word", "x"]


def test_exceptions_and_weights():
    lexicon = toxicity.Lexicon({" trash ": 4.0, " low": 3.0}, curve=(-4.0, 3.0, 1.0))
    assert lexicon.score("put it in the trash can") < 0.1 < 0.7 < lexicon.score("you are trash")
    assert lexicon.score("so loweish of you") > 0.7 and lexicon.score("") == lexicon.score("nothing here") < 0.1


def test_toxicity_held_out(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_toxicity_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 0, 1), (6, 0, 0), (6, 0, 1), (None, 1, 1), (9, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(odd, labels).collect()
    assert len(got) == 10 and not any(r.predicted for r in got)
    assert toxicity.score_toxicity(odd.where("false"), labels.where("false")).count() == 0


# --- fingerprints --------------------------------------------------------------------------------


def slow_walk(text):
    """The walk a step at a time."""
    out, i, step = [], 0, 0
    while i < len(text) and step < 3 * len(text):
        out.append(text[i])
        i += int(editembed.BITS[ord(text[i]) % editembed.CLASSES, step % editembed.PERIOD])
        step += 1
    return out


def test_fast_walks_equal_slow_ones():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdé日😀 ") for _ in range(n)) for n in [0, 1, 2, 5, *(rng.randint(1, 400) for _ in range(150)), 3000]]
    codes = [editembed.code_points(t) for t in texts]
    for text, steps in zip(texts, editembed.walk(codes, [0] * len(codes)), strict=True):
        slow = slow_walk(text)
        for i, c in enumerate(text):
            for step in range(int(steps[i]), min(int(steps[i + 1]), len(slow))):
                assert slow[step] == c


def test_edited_texts_by_definition(spark, docs, odd):
    import hashlib

    for table in (docs([(i, f"text number {i} " * (i % 5)) for i in range(40)]), docs([(1, "alone here")]), odd):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in table.collect()), key=lambda r: (-r[0], -r[1], r[2].encode()))
        got = editembed.edited_likeness(table, shard_bytes=60).collect()
        assert len(got) == len(rows)
        want = []
        for i, (known, k, text) in enumerate(rows):
            nxt = rows[(i + 1) % len(rows)][2]
            edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
            a, b, c = (f for f in editembed.fingerprints_of([text, edited, nxt]))
            want.append((k if known else None, len(text), hashlib.sha256(edited.encode()).hexdigest(), editembed.as_text(a), editembed.as_text(b), editembed.likeness(a, b), editembed.likeness(a, c)))
        key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
        assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    assert editembed.edited_likeness(odd.where("false")).count() == 0


def test_fingerprints_tell_edits_from_others(docs):
    rng = random.Random(6)
    data = []
    for i in range(30):
        text = "".join(rng.choice("abcdefghij ") for _ in range(1500))
        spot = rng.randint(0, 1400)
        data += [(2 * i, text), (2 * i + 1, text[:spot] + "xyz" + text[spot + 5 :])]
    prints = editembed.fingerprint(docs(data))
    pairs = {(r.doc_id, r.head) for r in editembed.near_pairs(prints, threshold=0.6).collect()}
    # walks fall into step again after an edit, but how soon is chance
    assert pairs <= {(2 * i + 1, 2 * i) for i in range(30)} and len(pairs) >= 24


def test_every_two_members_of_a_bucket_are_compared(docs, monkeypatch):
    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    opening, body = line(40), line(1500)
    data = [(1, opening + line(1500)), (2, opening + body), (3, opening + body[:-9] + "xyz"), (4, opening + body[:-7] + "uvw")]
    data += [(10, "a"), (11, "a"), (12, "b"), (20, ""), (21, None), (30, "x"), (30, "y"), (None, "a")]
    for most in (editembed.TASK_PRINTS, 1):  # in one task, and in blocks
        monkeypatch.setattr(editembed, "TASK_PRINTS", most)
        got = {(r.doc_id, r.head): r.likeness for r in editembed.near_pairs(editembed.fingerprint(docs(data))).collect()}
        assert set(got) == {(3, 2), (4, 2), (4, 3), (11, 10), (21, 20)}
        best = max(editembed.likeness(*editembed.fingerprints_of([data[1][1], data[2][1]], k)) for k in range(editembed.WALKS))
        assert got[3, 2] == best and got[11, 10] == got[21, 20] == 1.0


def test_every_copy_with_one_edit_is_found(docs):
    rng = random.Random(6)
    data = []
    for i in range(30):
        text = "".join(rng.choice("abcdefghij ") for _ in range(1500))
        spot = rng.randint(0, 1400)
        data += [(2 * i, text), (2 * i + 1, text[:spot] + "xyz" + text[spot + 5 :])]
    pairs = {(r.doc_id, r.head) for r in editembed.near_pairs(editembed.fingerprint(docs(data))).collect()}
    assert pairs == {(2 * i + 1, 2 * i) for i in range(30)}


def test_only_near_copies_count_once_in_training(spark, docs, monkeypatch):
    long = " ".join(f"word{a}{b}" for a in "abcdef" for b in "abcdefghij")
    texts = [" ".join(["shared words of all"] * 3 + ["part" + "abc"[i // 10], "more" + "abcdefghij"[i % 10], "vile"] * 3) for i in range(30)]
    texts += [" ".join(["shared words of all"] * 3 + ["other" + "abc"[i // 10], "less" + "abcdefghij"[i % 10], "fine"] * 3) for i in range(30)] + [f"{long} {'abcdefghijklmnopqrst'[i] * 4}" for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(80)], "doc_id long, toxic int")
    seen, select = [], toxicity.select
    monkeypatch.setattr(toxicity, "select", lambda t, c, a, b: seen.append((a, b)) or select(t, c, a, b))
    lexicon = toxicity.learn(docs(list(enumerate(texts))), labels, F.lit(True))
    assert seen == [(30, 31)] and lexicon.weights  # the 20 near copies are one text


# --- mixing --------------------------------------------------------------------------------------

TOKENS = {"a": 800, "b": 150, "c": 50}


def test_exponent_meets_its_target():
    x = mixing.bisect_exponent(TOKENS, max_repeats=3.0)
    assert max(mixing.repeats(TOKENS, mixing.tempered(TOKENS, x), None).values()) == pytest.approx(3.0, abs=1e-6)
    half = (mixing.entropy(mixing.tempered(TOKENS, 1)) + math.log(3)) / 2
    x = mixing.bisect_exponent(TOKENS, target_entropy=half)
    assert mixing.entropy(mixing.tempered(TOKENS, x)) == pytest.approx(half, abs=1e-6)
    assert mixing.bisect_exponent(TOKENS, max_repeats=1e9) == 0 and mixing.bisect_exponent(TOKENS, max_repeats=0.5) == 1
    assert mixing.bisect_exponent({}, max_repeats=2.0) in (0.0, 1.0)
    with pytest.raises(ValueError):
        mixing.bisect_exponent(TOKENS)


def mixture_rows(docs):
    data, k = [], 0
    for source, n in (("big", 300), ("mid", 60), (None, 30)):
        for i in range(n):
            data.append((k, "w " * (1 + i % 7), "en", source))
            k += 1
    return docs(data)


def test_mixture_by_counting(docs):
    table = mixture_rows(docs)
    size = {r.doc_id: len((r.text or "").split()) for r in table.collect()}
    decision, rows = mixing.mix(table, max_repeats=2.0, block_tokens=40)
    got = rows.select("row.doc_id", "key", "epoch", "block", "at").collect()
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert max(decision.epochs.values()) == pytest.approx(2.0, abs=1e-6) and min(decision.epochs.values()) == pytest.approx(1.0)
    assert {r.doc_id for r in got} == set(size)
    for key, epochs in decision.epochs.items():
        tokens = sum(size[r.doc_id] for r in got if r.key == key)
        assert tokens <= round(epochs * decision.tokens[key]) and tokens > epochs * decision.tokens[key] - 8
        for e in range(int(epochs)):  # a full epoch has every document once
            assert len([r for r in got if r.key == key and r.epoch == e]) == len({r.doc_id for r in got if r.key == key})
    assert all(0 <= r.at <= 1 for r in got)
    again = mixing.mix(table.repartition(5), max_repeats=2.0, block_tokens=40)[1].select("row.doc_id", "key", "epoch", "block", "at").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    capped, some = mixing.mix(table, target_entropy=1.0, budget=300.0, block_tokens=40)
    assert 280 <= sum(size[r.doc_id] for r in some.select("row.doc_id").collect()) <= 300 and sum(capped.weights.values()) == pytest.approx(1)


def test_mixing_odd_rows(odd, spark):
    assert mixing.mixed_rows(odd).count() == 10 and mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mixed_rows(odd.where("false")).count() == 0
    assert queries.op3_mixing(spark, "/root/testdata/sf0.001").count() >= 200


# --- licences ------------------------------------------------------------------------------------


def test_licence_rules(docs):
    mit = "\n".join(licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "as-is-software"))
    wrapped = licences.SENTENCES["apache-grant"].replace(" in compliance", "\n    in compliance")
    data = [(1, "Some prose.\n" + mit + "\nMore."), (2, wrapped + "\n" + licences.SENTENCES["apache-copy"]), (3, "Licensed under CC BY-NC 4.0."), (4, "x.\nReleased under the MIT License. Then y.\nLicensed under the Apache License, Version 2.0."), (5, "MIT is a school."), (6, licences.SENTENCES["bsd-grant"] + " " + licences.SENTENCES["bsd-source"]), (7, "a | b\nThis work is licensed under the GNU General Public License, version 3."), (8, None), (9, "")]
    got = {r.doc_id: r.licences for r in licences.scan_licences(docs(data)).collect()}
    assert got == {1: "MIT", 2: "Apache-2.0", 3: "CC-BY-NC-4.0", 4: "MIT;Apache-2.0", 5: "", 6: "", 7: "GPL-3.0", 8: "", 9: ""}


def test_licences_with_a_word_to_a_line(docs):
    mit = "\n".join(licences.SENTENCES[k] for k in ("mit-grant", "mit-notice", "as-is-software"))
    data = [(1, "\n".join(mit.split())), (2, "\n# \n".join(mit.split())), (3, mit), (4, "\n#" * 100_000)]
    assert {r.doc_id: r.licences for r in licences.scan_licences(docs(data)).collect()} == {1: "MIT", 2: "MIT", 3: "MIT", 4: ""}


def test_licences_of_a_whole_table_by_brute_force(spark, odd):
    import re

    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT"}
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    pattern = re.compile("|".join(map(re.escape, lines)))
    got = {r.doc_id: r.licences for r in queries.op2_licences(spark, SF).collect()}
    assert got == {r.doc_id: ";".join(lines[m] for m in pattern.findall(r.text)) for r in table}
    assert any(got.values())
    assert licences.scan_licences(odd).count() == 10 and licences.scan_licences(odd.where("false")).count() == 0


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as cp
    from discweave.llm.common import materialize

    base = " ".join(f"w{i}" for i in range(80))
    data = [(i, f"the cat and the dog number {i} " + " ".join(f"v{i}x{j}" for j in range(30)), "en", f"s{i % 3}") for i in range(40)]
    data += [(100, base, "en", "s0"), (101, base.replace(" ", "  "), "en", "s0"), (102, base.replace("w5 ", "zz "), "en", "s0"), (200, "123 456", "en", "s0"), (201, None, "en", "s0")]
    table, seen = docs(data), {}
    for name, stage in cp.STAGES:
        table = materialize(stage(spark, table, ""), "t")
        seen[name] = table.select("doc_id").collect()
        if name != cp.STAGES[-1][0]:
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {k: {r.doc_id for r in v} for k, v in seen.items()}
    assert ids["language_id"] == set(range(40)) | {100, 101, 102}
    assert ids["exact_dedup"] == set(range(40)) | {101, 102}
    assert ids["minhash_dedup"] == ids["mixing"] == set(range(40)) | {101}
    assert len(seen["bpe"]) == len(seen["mixing"])
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "minhash_dedup", "mixing", "bpe"]


def test_pipeline_keeps_texts_where_no_language_was_learned(docs):
    data = [(i, t, None) for i, t in enumerate(["plain words", "été", "123", "", None, "日本語"])]
    kept = language.keep_identified(docs(data))
    assert {r.doc_id for r in kept.collect()} == {0, 1, 5} and kept.columns == docs(data).columns
    tied = docs([(i, "same words here", lang) for i, lang in enumerate(["de", "en", "fr"] * 60)])
    assert language.keep_identified(tied).count() == 0


def test_pipeline_of_nothing(spark, docs):
    import corpus_pipeline as cp

    table = docs([(1, "x")]).where("false")
    for _, stage in cp.STAGES:
        table = stage(spark, table, "")
    assert table.count() == 0


def test_licence_rules_by_brute_force(docs):
    rng = random.Random(11)
    names, noise = sorted(licences.SENTENCES), ["Some prose here", "Copyright 2020 A. Author", "Licensed", "THE SOFTWARE"]
    data, want = [], {}
    for k in range(120):
        planted = [rng.choice([None, *names]) for _ in range(rng.randint(0, 6))]
        for licence_, sequence in rng.sample(licences.RULES, 2):
            planted += sequence + [None] * rng.randint(0, 1)
        breaks = lambda s: "".join(rng.choice(["\n", "\n  # ", " "]) if c == " " and rng.random() < 0.2 else c for c in s)
        data.append((k, "\n".join(rng.choice(noise) if p is None else breaks(licences.SENTENCES[p]) for p in planted)))
        found, at = [], 0
        while at < len(planted):  # the longest rule that the sentences from here on are, the first of equals
            fits = [(len(s), -i, n) for i, (n, s) in enumerate(licences.RULES) if planted[at : at + len(s)] == s]
            if fits:
                found.append(max(fits)[2])
            at += max(fits)[0] if fits else 1
        want[k] = ";".join(found)
    got = {r.doc_id: r.licences for r in licences.scan_licences(docs(data)).collect()}
    assert got == want and len({x for w in want.values() for x in w.split(";")}) > 30


def test_exceptions_take_linear_time_and_cover_what_they_hold():
    import time

    lexicon = toxicity.Lexicon({" trash ": 4.0, " can ": 1.0, " clown ": 2.0})
    assert lexicon.evidence("the trash can, and a clown fish") == (0.0, 0.0)
    assert lexicon.evidence("trash can trash")[0] == pytest.approx(math.log1p(4.0)) and lexicon.evidence("can trash")[0] == pytest.approx(math.log1p(5.0))
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert lexicon.evidence("trash can " * n) == (0.0, 0.0)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_scores_by_brute_force():
    rng = random.Random(2)
    weights = {" vile ": 3.0, " foul": 2.0, " trash ": 1.5, " scum ": 2.5}
    lexicon = toxicity.Lexicon(weights, curve=(-4.0, 2.0, 1.0))
    for _ in range(300):
        text = " ".join(rng.choice(["vile", "foully", "foul", "trash", "trash can", "pond scum", "scum", "fine", "v1le", "word"]) for _ in range(rng.randint(0, 30)))
        words = toxicity.fold(text).split()
        total, k = 0.0, 0
        while k < len(words):
            if words[k : k + 2] in (["trash", "can"], ["pond", "scum"]):
                k += 2
                continue
            total += {"vile": 3.0, "foully": 2.0, "foul": 2.0, "trash": 1.5, "scum": 2.5}.get(words[k], 0.0)
            k += 1
        a, b = math.log1p(total), math.log1p(100 * total / max(20, len(words) + 1)) if total else 0.0
        assert lexicon.score(text) == pytest.approx(1 / (1 + math.exp(-(-4 + 2 * a + b))))


def test_near_classes_by_brute_force(docs):
    """Against all pairs that share a band, joined by hand; copies, edits, strays and short texts."""
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    data, k = [], 0
    for _ in range(6):
        base = line(900)
        for _ in range(5):
            spot = rng.randint(0, 880)
            data.append((k, base[:spot] + line(2) + base[spot + rng.randint(0, 4) :]))
            k += 1
        data += [(k, base), (k + 1, base), (k + 2, base[:200] + line(700))]
        k += 3
    data += [(900, "a"), (901, "a"), (902, "b"), (903, ""), (904, None), (None, "a"), (905, "a"), (905, "zz")]
    table = docs(data)
    got = editembed.edited_likeness(table, shard_bytes=3000, near=0.8).select("doc_id", "fingerprint", "near_class").collect()
    prints = [editembed.fingerprints_of([t or ""])[0] for _, t in data]
    up = list(range(len(data)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            same = len(prints[i]) == len(prints[j]) and (prints[i] == prints[j]).all()
            if same or set(editembed.buckets_of(prints[i])) & set(editembed.buckets_of(prints[j])) and editembed.likeness(prints[i], prints[j]) >= 0.8:
                up[root(i)] = root(j)
    want = []
    for i, (key, _) in enumerate(data):
        ids = [d[0] for j, d in enumerate(data) if root(j) == root(i) and d[0] is not None]
        want.append((key, editembed.as_text(prints[i]), min(ids, default=None)))
    order = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert len({w[2] for w in want}) < len(data) - 25


def test_language_scores_by_brute_force(spark):
    import pyarrow as pa

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language.learn(table, F.lit(True), per_language=20)
    texts = [r.text or "" for r in table.select("text").collect()] + ["", "123", "日本語", "qzx wvkj", " a  b ", "x" * 3000, "El niño 3 años"]
    names, scores = language.Scorer(model)(pa.array(texts))
    for text, name, score in zip(texts, names, scores, strict=True):
        rows = [model.word(w) for w in language.words_of(text)]
        if not rows and not any(map(str.isalpha, text)):
            assert (name, score) == ("und", 0.0)
            continue
        mean = [sum(float(r[k]) for r in rows) / max(1, len(rows)) for k in range(len(model.languages))]
        odds = [math.exp((m - max(mean)) * min(max(1, len(rows)), 12)) for m in mean]
        assert score == pytest.approx(1 / sum(odds), rel=1e-4) and mean[model.languages.index(name)] == pytest.approx(max(mean), abs=1e-5)


def test_mixing_query_by_brute_force(spark):
    import re

    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hashes = table.select("doc_id", "source", "text", mixing.place_hash(F.col("doc_id"), 17).alias("h")).withColumn("b", F.xxhash64("h")).collect()
    tokens = {}
    for r in hashes:
        tokens[r.source] = tokens.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0D]{1,16}", r.text or ""))
    low, high = 0.0, 1.0  # of epochs t ** (x - 1), over the least, the most is 2
    for _ in range(80):
        x = (low + high) / 2
        rates = [t ** (x - 1) for t in tokens.values()]
        low, high = (x, high) if max(rates) / min(rates) > 2 else (low, x)
    rates = {s: t ** (high - 1) for s, t in tokens.items()}
    epochs = {s: r / min(rates.values()) for s, r in rates.items()}
    blocks = {s: max(1, math.ceil(t / 3000)) for s, t in tokens.items()}
    turns = spark.createDataFrame([(e, b) for e in range(2) for b in range(max(blocks.values()))], "epoch int, block long").select("epoch", "block", F.xxhash64(F.lit(17), "epoch", "block").alias("r")).collect()
    rank = {(t.epoch, t.block): t.r for t in turns}
    want = set()
    for source in tokens:
        held = {}
        for r in hashes:
            if r.source == source:
                held.setdefault(r.b % blocks[source], []).append((r.h, r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]{1,16}", r.text or ""))))
        for e in range(math.ceil(epochs[source] - 1e-9)):
            room = round(min(1.0, epochs[source] - e) * tokens[source])
            for b in sorted(held, key=lambda b: (rank[e, b], b)):
                used = 0
                for _, doc, n in sorted(held[b]):
                    used += n
                    if room > 0 and used <= room:
                        want.add((doc, e))
                room -= sum(n for _, _, n in held[b])
    got = [(r.doc_id, r.epoch) for r in mixing.mixed_stream(table, block_tokens=3000).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_extra_columns_with_clashing_names(spark, odd):
    from discweave.llm import bitplane, bpe, exact, minhash
    from discweave.llm.common import scratch

    names = ["id", "k", "tie", "cls", "set", "_row", "_key", "_word", "_place", "label", "at", "key", "epoch", "block", "row", "n", "digest", "body", "shard", "task", "score", "held_out", "h", "mark", "signature", "tail"]
    wide = odd
    for name in names:
        wide = wide.withColumn(name, F.lit(1))
    import public_tokenizers

    labels = spark.createDataFrame([(6, 0, 1)], "doc_id long, quality int, toxic int")
    count = lambda f: (sorted(map(str, f(wide).select(*f(odd).columns).collect())), sorted(map(str, f(odd).collect())))
    for f in (licences.scan_licences, lambda d: bpe.encode_documents(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: exact.exact_groups(d).select("doc_id", "keep_id", "group_size", "text_sha256"), exact.keep_first,
              minhash.keep_one, mixing.mixed_rows, language.keep_identified, editembed.edited_likeness, lambda d: toxicity.score_toxicity(d, labels)):
        a, b = count(f)
        assert a == b
    assert exact.keep_first(wide).columns == wide.columns == minhash.keep_one(wide).columns == mixing.mixed_rows(wide).columns
    entries = [bitplane.write_ids(d, scratch(spark, "t"), public_tokenizers.path("byte_bpe_50k.json"), shard_bytes=100) for d in (wide, odd)]
    assert entries[0] == entries[1]
