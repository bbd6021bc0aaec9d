import random

import pytest
from compare import canonical, connect, duck
from pyspark.sql import functions as F

from discweave.llm import components, exact, minhash, queries
from discweave.llm.common import Workspace, keep_rows, with_filter

SF = "/root/testdata/sf0.001"


def test_exact_query_against_sql(spark):
    assert canonical(queries.op4_exact_dedup(spark, SF).toArrow()) == canonical(duck(connect(SF), queries.ORACLES["op4_exact_dedup"]))


@pytest.mark.parametrize("digest", [exact.text_digest, lambda body: F.substring(exact.text_digest(body), 1, 1), lambda body: F.lit("x")])
def test_exact_groups_survive_colliding_digests(docs, digest):
    data = [(i, f"text  {i % 7}" + " " * (i % 3)) for i in range(40)] + [(100, None), (101, ""), (102, " \n")]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs(data), digest=digest).collect()}
    groups = {}
    for k, t in data:
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), k))
    for members in groups.values():
        keep = min(members)[1]
        for _, k in members:
            assert got[k] == (keep, len(members), k == keep)


def test_exact_odd_rows(odd):
    got = exact.exact_groups(odd).collect()
    assert len(got) == 10 and sum(r.kept for r in got if r.doc_id == 6) == 1
    assert {r.keep_id for r in got if r.doc_id in (1, 2, 3)} == {3}
    assert [r.keep_id for r in got if r.doc_id is None] == [None]
    assert exact.exact_groups(odd.where("false")).count() == 0
    left = exact.keep_first(odd).collect()
    assert sorted(r.doc_id or 0 for r in left) == [0, 3, 4, 5, 6, 8, 9] and left[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_filters_let_everything_through_that_is_there(spark):
    df = spark.range(2000)
    keys = spark.range(0, 2000, 7).withColumnRenamed("id", "k")
    for bits in (64, 1 << 20):
        hit = {r.id for r in with_filter(df, F.col("id"), keys, "k", bits).collect()}
        rest = {r.id for r in with_filter(df, F.col("id"), keys, "k", bits, keep=False).collect()}
        assert hit >= set(range(0, 2000, 7)) and hit | rest == set(range(2000)) and not hit & rest


def test_keep_rows(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c")], "k int, v string")
    decided = spark.createDataFrame([(1, True), (2, True), (2, False), (3, False)], "key int, kept boolean")
    assert rows(keep_rows(df, F.col("k"), decided)) == [(1, "a"), (2, "b")]


def test_components_of_paths_stars_and_noise(spark, rows):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randint(2000, 2060), rng.randint(2000, 2060)) for _ in range(70)] + [(5, 5), (None, 4)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            up[b] = a
    got = rows(components.star_components(spark.createDataFrame(edges, "u long, v long")))
    assert got == sorted((x, root(x)) for x in up)
    assert components.star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute(rows, width=4, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + min(width, len(w))]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return sorted((k, len(sets[i]), least.get(root(i))) for i, (k, _) in enumerate(rows) if k is not None)


def edited(rng, words, share):
    return [rng.choice("uvwxyz") * 3 if rng.random() < share else w for w in words]


def group(n, size, share, seed=1):
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(size)]
    return [(i, " ".join(edited(rng, base, share))) for i in range(n)]


def test_near_copies_in_blocks_as_by_brute_force(docs, monkeypatch):
    data = group(60, 90, 0.02) + [(1000 + k, t) for k, t in group(20, 40, 0.03, seed=2)] + [(2000 + k, t.upper()) for k, t in group(5, 90, 0.0)]
    want = brute(data)
    get = lambda: sorted(tuple(r) for r in minhash.near_duplicates(docs(data), width=4).select("doc_id", "n_shingles", "component_id").collect())
    assert get() == want
    monkeypatch.setattr(minhash, "TASK_CLASSES", 9)  # clusters over nine classes are dealt into blocks
    assert get() == want


def test_near_query_and_odd_rows(spark, docs, odd):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in queries.op5_minhash(spark, SF).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute([tuple(r) for r in table])
    for width in (4, 5):
        got = minhash.near_duplicates(odd, width=width).collect()
        assert len(got) == 10
        assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id in (1, 2, 3, 6, None)} == {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (6, 1, 6, True), (None, 1, None, True)}
    assert minhash.near_duplicates(odd.where("false")).count() == 0
    short = docs([(1, "one two"), (2, "ONE  two"), (3, "one two three")])
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(short, width=4).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_the_longest_spelling_stays_also_where_ids_are_shared(spark, docs):
    data = [(6, "a b"), (6, "a  b   "), (6, "ab"), (7, "a b"), (8, "x"), (8, "x"), (None, " y"), (None, "y")]
    assert sorted((r.doc_id or 0, r.text) for r in exact.keep_first(docs(data)).collect()) == [(0, " y"), (6, "a  b   "), (8, "x")]
    table = spark.createDataFrame([(1, "a", "p"), (1, "a", "q"), (2, "b", "r")], "doc_id long, text string, best string")
    kept = exact.keep_first(table)
    assert kept.columns == table.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]


def test_near_copies_hand_the_driver_small_plans(docs, monkeypatch):
    """A plan's tables, counted as often as it reads them: what the driver holds grows with their number."""
    leaves = lambda df: df._jdf.queryExecution().analyzed().collectLeaves().size()
    put, seen = Workspace.put, {}

    def counted(work, df, name):
        seen[name] = max(leaves(df), seen.get(name, 0))
        return put(work, df, name)

    monkeypatch.setattr(Workspace, "put", counted)
    rng = random.Random(5)
    data, words = [], None
    for k in range(120):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(60)] if k % 12 == 0 else [w if rng.random() > 0.02 else "x" for w in words]
        data.append((k, " ".join(words)))
    left = minhash.keep_one(docs(data), width=4)
    assert 0 < left.count() < 120
    seen["result"] = leaves(left)
    assert max(seen.values()) <= 6, seen
