"""Near duplicates, repeated passages and benchmark leaks against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from stemma.llm import decontaminate, minhash_dedup, queries, suffix_dedup
from stemma.llm.shingles import range_hashes
from stemma.llm.suffix_array import suffix_array

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute_components(docs, size=4):
    """{doc_id: (size, component)} of (doc_id, text) rows."""
    sets = {d: shingles(t, size) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def made_up():
    rng = random.Random(5)
    word = lambda: "w%d" % rng.randrange(3000)
    docs, base = [], [word() for _ in range(120)]
    for i in range(60):  # a chain: each differs a little from the one before
        base = list(base)
        base[rng.randrange(120)] = word()
        docs.append(" ".join(base))
    passage = " ".join(word() for _ in range(60))
    docs += [passage + " " + " ".join(word() for _ in range(40 + i)) for i in range(30)]  # a passage that many share
    docs += ["a b c", "A B  c", "a b", "", "   ", None, docs[0], docs[0].upper().replace("W", "w")]
    rng.shuffle(docs)
    return [(i, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("words", [1, 4, 5])
def test_near_duplicates_equal_brute_force(spark, words):
    docs = made_up() + [(None, "x y z"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumnRenamed("text", "text")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(df, words).collect() if r.doc_id is not None}
    assert got == brute_components([d for d in docs if d[0] is not None], words)


def test_op3_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(docs)
    rows = queries.op3_minhash_dedup(spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want and len(rows) == len(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_deduplicate_keeps_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e", "k"), (2, "a b c d e", "l")], "doc_id long, text string, id string")
    assert [tuple(r) for r in minhash_dedup.deduplicate(df).collect()] == [(1, "a b c d e", "k")]
    assert minhash_dedup.deduplicate(df.limit(0)).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for k in range(60):
        t = np.append(rng.integers(1, int(rng.integers(2, 7)), int(rng.integers(1, 150))), 0)
        if k % 3 == 0:
            t = np.append(np.tile(t[:-1], 4), 0)
        assert list(suffix_array(t)) == sorted(range(len(t)), key=lambda i: list(t[i:]))


def brute_repeats(docs):
    seen, out = {}, {}
    for d, t in sorted(docs):
        raw = (t or "").encode()
        for i in range(len(raw) - 49):
            seen.setdefault(raw[i : i + 50], d)
    for d, t in docs:
        raw = (t or "").encode()
        off = np.zeros(len(raw), bool)
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < d:
                off[i : i + 50] = True
        kept = bytes(b for b, o in zip(raw, off, strict=True) if not o)
        spans = int(off[:1].sum() + (off[1:] & ~off[:-1]).sum())
        out[d] = (len(raw), int(off.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_op6_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert {r.doc_id: tuple(r)[1:] for r in queries.op6_suffix_dedup(spark, SF).collect()} == brute_repeats(docs)


def test_op6_deals_large_inputs_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "GROUPS", 60)
    monkeypatch.setattr(suffix_dedup, "GROUPS_A_TASK", 2)
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op6_suffix_dedup(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 30), REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") > 0
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == brute_repeats(docs)


def test_repeats_of_odd_texts(spark):
    docs = [(1, "ab" * 200), (2, "x" + "ab" * 60 + "é" * 40), (3, None), (4, ""), (5, "a" * 49), (6, "a" * 49), (7, "a" * 50), (8, "b" + "a" * 50), (9, "é" * 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == brute_repeats(docs)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [["short", "short"], [None, ""], ["", ""], ["a" * 49] * 3, [None], ["a" * 50, "a" * 50]])
def test_tables_of_short_texts(spark, texts):
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert {r.doc_id: tuple(r)[1:5] for r in suffix_dedup.remove_repeats(df).collect()} == brute_repeats(docs)


def test_repeats_of_large_and_null_ids_repeated_rows_and_other_columns(spark):
    text = "a passage that is longer than fifty bytes, so that it can be found again"
    big = (1 << 53) + 1
    rows = [(None, text, "x"), (big, text, "y"), (big, text, "y"), (big - 1, "before " + text, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, grp string")
    got = sorted(((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()))
    assert got == [(0, len(text)), (big - 1, 0), (big, len(text)), (big, len(text))]


def test_runs_and_periods_take_linear_time():
    for period in ([7], [3, 5], [3, 5, 4, 4, 9, 1, 1]):
        began = time.perf_counter()
        sa = suffix_array(np.append(np.tile(period, (1 << 20) // len(period)), 0))
        assert time.perf_counter() - began < 5 and len(np.unique(sa)) == len(sa)


def test_long_repetitive_texts(spark):
    docs = [(1, "x" + " " * 200_000), (2, " " * 150_000 + "y"), (3, "ab" * 100_000), (4, "c" + "ab" * 90_000)]
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert rows == {1: (200_001, 0, 0), 2: (150_001, 150_000, 1), 3: (200_000, 0, 0), 4: (180_001, 180_000, 1)}


def test_slices_give_the_same_owners(monkeypatch):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha ", "beta ", "gamma ", "delta "])
    part = "".join(word() for _ in range(300))
    texts = [(part[: rng.randrange(200, 900)] + "".join(word() for _ in range(50))).encode() for _ in range(20)]
    raw, size = np.frombuffer(b"".join(texts), np.uint8), np.array([*map(len, texts)])
    start, owner = np.cumsum(size) - size, np.arange(20)
    results = []
    for most in (1 << 16, 120):
        monkeypatch.setattr(suffix_dedup, "SLICE", most)
        # strings as they are, under one minimizer at a time in the same array
        a, b, _, of = suffix_dedup.pieces(raw, np.append(start, len(raw)))
        found = suffix_dedup.least_owners(raw, a, b - a, owner[of], range_hashes(raw, a, b))
        results.append(found[np.concatenate([np.arange(x, y - 49) for x, y in zip(a, b, strict=True)])])
    assert (results[0] == results[1]).all()


def test_large_minimizers_are_cut_anew(monkeypatch):
    rng = random.Random(3)
    parts = ["".join(rng.choice("abcd") for _ in range(200)) for _ in range(40)]
    texts = [(p[:90] + "the same thirty bytes of text.." + p[90:]).encode() for p in parts + parts[:10]]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([*map(len, texts)])
    start = np.cumsum(size) - size
    owner = np.arange(len(texts))
    h = range_hashes(raw, start, start + size)
    results = []
    for most in (1 << 19, 2000):
        monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", most)
        a, b, _, of = suffix_dedup.pieces(raw, np.append(start, len(raw)))
        found = suffix_dedup.least_owners(raw, a, b - a, owner[of], range_hashes(raw, a, b))
        results.append(found[np.concatenate([np.arange(x, y - 49) for x, y in zip(a, b, strict=True)])])
    assert len(h) == 50 and (results[0] == results[1]).all()


def test_reparameterised_questions(spark):
    item = "If Anna buys 12 apples and 7 pears at the market for 30 dollars then how many pieces of fruit does she carry home"
    docs = [
        (1, "Some words before. " + item + " and words after"),
        (2, item.replace("12", "55").replace("Anna", "Ben").replace("30", "8")),
        (3, "If the weather is fine we will walk along the river and have some fruit at the market on the way home"),
        (4, None),
        (5, ""),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.verdicts(df, bench).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert decontaminate.drop_contaminated(df, bench.limit(0)).count() == 5


def test_slots_must_agree(spark):
    item = "A train goes 60 miles in an hour and after 60 minutes it stops so how far did the train go today"
    one, two = item.replace("60", "45"), item.replace("60", "45", 1).replace("60", "99", 1)
    df = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.verdicts(df, bench).collect()} == {1: True, 2: False}


def leaks(spark, texts, items):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return [r.contaminated for r in sorted(decontaminate.verdicts(df, bench).collect(), key=lambda r: r.doc_id)]


def test_near_copies_of_short_items(spark):
    items, texts = [], []
    for n in range(11, 32):  # whatever single word is replaced
        items.append([f"i{n}x{chr(97 + k)}" for k in range(n)])
        texts += [" ".join(["before", "it", *items[-1][:k], "other", *items[-1][k + 1 :], "after"]) for k in range(n)]
    items.append([f"long{k}x" for k in range(59)])
    texts.append(" ".join(["before", "it", *items[-1][10:42], "after"]))  # 32 of 59 words
    clean = [" ".join(["before", "it", *x[: len(x) // 2], "after"]) for x in items]
    assert leaks(spark, texts + clean, [" ".join(x) for x in items]) == [True] * len(texts) + [False] * len(clean)


def test_a_clashing_slot_spoils_its_windows_only(spark):
    item = "A train goes 60 miles in an hour and after 60 minutes it stops so how far did the train go today"
    first, second = item.replace("60", "45", 1), item.replace("60 minutes", "45 minutes")
    assert leaks(spark, [item, first, second, item.replace("60", "45", 1).replace("60", "99", 1)], [item]) == [True, True, True, False]
