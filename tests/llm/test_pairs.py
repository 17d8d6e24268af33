"""Substring dedup, similarity join and decontamination against brute force, and their edge cases."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest

from odonymy.llm import decontaminate, exchange, jaccard_join, queries, substring_dedup
from odonymy.llm.text import U64


def rows_of(frame, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in frame.collect()}


@pytest.mark.parametrize("length", [3, 13, 50])
def test_dedup_equals_brute_force(frame, corpus, length):
    got = rows_of(substring_dedup.find(frame(corpus), length, block_bytes=2000), "n_words", "n_removed", "kept_sha256")
    assert got == brute.dedup(corpus, length)


def test_dedup_levels_double_and_spans_are_given(frame):
    assert [substring_dedup.level_lengths(n) for n in (3, 11, 13, 50, 100)] == [[3], [6, 11], [7, 13], [7, 13, 25, 50], [7, 13, 25, 50, 100]]
    rng = random.Random(5)
    word = lambda: f"u{rng.randint(0, 10**9)}"
    long = [word() for _ in range(120)]
    rows = [(1, " ".join(long)), (2, " ".join([word(), *long[:27], word(), *long[60:75]])), (3, " ".join([*long, word()])), (4, " ".join(long[:5]))]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in substring_dedup.find(frame(rows), 13).collect()}
    assert got == {1: [], 2: [(1, 28), (29, 44)], 3: [(0, 120)], 4: []}


def test_least_of_consecutive_values():
    h = np.random.default_rng(1).integers(0, 99, 50).astype(U64)
    for n in range(1, 20):
        assert substring_dedup._least(h, n)[: 51 - n].tolist() == [min(h[i : i + n].tolist()) for i in range(51 - n)]


@pytest.mark.parametrize("length", [13, 50])
def test_dedup_of_repeated_rows_null_ids_and_nothing(frame, length):
    text = " ".join(f"a{i}" for i in range(60))
    got = substring_dedup.find(frame([(7, text), (7, text), (9, text), (None, text), (None, None), (11, None), (12, "")]), length).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in got) == [(False, 7, 0), (False, 7, 0), (False, 9, 60), (False, 11, 0), (False, 12, 0), (True, 0, 0), (True, 0, 0)]
    assert substring_dedup.find(frame([(1, "x")]).limit(0), length).count() == 0


def test_each_text_of_an_id_is_a_document(frame):
    one, two = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    rows = [(1, one), (1, two), (1, two), (8, f"x {one}"), (9, f"{two} y"), (9, "z"), (8, one)]
    got = substring_dedup.find(frame(rows), 13).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 20, 0), (1, 20, 0), (1, 20, 0), (8, 20, 20), (8, 21, 20), (9, 1, 0), (9, 21, 20)]
    left = substring_dedup.remove_repeats(frame(rows), 13).collect()
    assert sorted((r.doc_id, r.text) for r in left) == sorted([(1, one), (1, two), (1, two), (8, "x"), (9, "y"), (9, "z")])


def test_removing_repeats_keeps_columns_and_clean_texts(frame):
    shared = " ".join(f"p{i}" for i in range(60))
    docs = frame([(1, f"intro  {shared}"), (2, f"own words\n{shared} end"), (3, shared), (4, "clean  text"), (5, None)])
    out = substring_dedup.remove_repeats(docs, 50)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (f"intro  {shared}", len(shared) + 7), 2: ("own words end", 13), 4: ("clean  text", 11), 5: (None, 0)}
    clash = docs.selectExpr("*", "7 AS n_removed", "'k' AS kept_text", "1 AS _id", "2 AS a", "3 AS b", "4 AS row", "5 AS key", "6 AS lost", "true AS removed", "0 AS kept_sha256", "9 AS place")
    again = substring_dedup.remove_repeats(clash, 50)
    assert again.columns == clash.columns and sorted(r.text or "" for r in again.collect()) == sorted(r.text or "" for r in out.collect())


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_join_equals_brute_force(frame, corpus, size, percent):
    got = rows_of(jaccard_join.similar(frame(corpus), size, percent, block_bytes=2000, cap=2000), "n_shingles", "component_id")
    assert got == brute.jaccard(corpus, size, percent)


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        for n in (*range(1, 40), 100, 371):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(U64))
            drop = rng.integers(0, max(1, n * (100 - percent) // 100) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[: n - drop], rng.integers(0, 1 << 63, int(rng.integers(0, drop + 2))).astype(U64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * len(np.union1d(a, b)):
                text, sig = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(sig[text == 0].tolist()) & set(sig[text == 1].tolist())


def test_links_within_connect_all_linked_pairs():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 60).astype(U64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(54, 61)], rng.integers(0, 1 << 63, rng.integers(0, 4)).astype(U64)])) for _ in range(40)]
    label = list(range(40))
    for i, j in jaccard_join.links_within(sets, list(range(40)), 90):
        both = len(np.intersect1d(sets[i], sets[j]))
        assert 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both)
        label = [label[i] if x == label[j] else x for x in label]
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                assert label[i] == label[j]


def test_join_of_repeated_rows_null_ids_and_nothing(frame):
    got = jaccard_join.similar(frame([(4, "a b c d"), (4, "a b c d"), (6, "A  b c\nD"), (None, "a b c d"), (8, None), (9, "")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(4, 2, 4), (4, 2, 4), (6, 2, 4), (8, 0, 8), (9, 0, 9)]
    assert jaccard_join.similar(frame([(1, "x")]).limit(0)).count() == 0


def test_one_of_each_class_stays(frame, corpus):
    docs = frame(corpus)
    kept = jaccard_join.keep_one(docs)
    want = {d for d, (_, c) in brute.jaccard(corpus, 5, 80).items() if d == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns


def test_repeated_rows_without_a_smaller_copy_stay_once(spark):
    text, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, text), (3, text), (3, text), (5, text), (7, other), (7, other), (8, None), (8, None), (9, "x y"), (None, text), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = jaccard_join.keep_one(docs)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(3, text), (7, other), (8, None), (9, "x y"), (None, text), (None, text)], key=str) and kept.columns == docs.columns


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and more words"), (2, "short item"), (3, "word"), (4, None), (5, " ,. "), (None, "quick brown"), (6, "ÉTÉ été x9 ÿ"), (2, "another text of item two")]


@pytest.mark.parametrize(("block", "shingle"), [(200_000, 3), (3, 3), (200_000, 1), (200_000, 20)])
def test_contamination_equals_brute_force(spark, frame, block, shingle):
    rng = random.Random(2)
    pieces = [t for _, t in ITEMS if t] + ["the QUICK brown fox jumps over the lazy dog and", "Short-item!", "filler text here", "ÉTé été X9 ÿ", "été été x9 ÿ"]
    rows = [(i, " ".join(rng.choice(pieces) for _ in range(rng.randint(0, 6)))) for i in range(60)] + [(90, None), (91, ""), (92, "word" * 3), (93, "x " * 9000 + "short item")]
    items = spark.createDataFrame([(i, t, "e") for i, t in ITEMS], "item_id long, text string, n_words string")
    got = rows_of(decontaminate.digest(decontaminate.contamination(frame(rows), items, block_windows=block, shingle=shingle)), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == brute.contamination(rows, [x for x in ITEMS if x[0] is not None])


def test_contamination_of_and_by_nothing(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.digest(decontaminate.contamination(frame([(1, "a b")]), none)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert decontaminate.contamination(frame([(1, "a")]).limit(0), none).count() == 0


def test_clean_documents_stay(spark, frame):
    items = spark.createDataFrame([(1, " ".join(f"k{i}" for i in range(12)))], "item_id long, text string")
    docs = frame([(1, "x " + " ".join(f"K{i}" for i in range(1, 11))), (2, " ".join(f"k{i}" for i in range(9))), (3, None)])
    assert sorted(r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()) == [2, 3]


@pytest.mark.parametrize("block", [200_000, 1])
def test_rows_without_id_and_rows_of_one_id_have_their_own_hits(spark, frame, block):
    items = spark.createDataFrame([(1, "short item"), (2, "other piece")], "item_id long, text string")
    rows = [(None, "a short item"), (None, "clean"), (4, "an other piece of short item"), (4, "nothing here"), (4, "short item"), (5, None), (None, None), (6, "other piece"), (6, "other piece")]
    want = [0 if "short item" not in (t or "") and "other piece" not in (t or "") else 4 if t.startswith("an") else 2 for _, t in rows]
    got = decontaminate.digest(decontaminate.contamination(frame(rows), items, block_windows=block)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in got) == sorted((str(d), len((t or "").split()), n) for (d, t), n in zip(rows, want, strict=True))
    clean = decontaminate.remove_contaminated(frame(rows), items, block_windows=block).collect()
    assert sorted(((r.doc_id, r.text) for r in clean), key=str) == sorted([x for x, n in zip(rows, want, strict=True) if not n], key=str)


def test_exchange_lists_each_key_once():
    hi, lo, owner, many = exchange.distinct_keys(np.array([5, 5, 7, 5], U64), np.array([1, 1, 0, 2], np.uint32), np.array([9, 4, 3, 3]))
    assert (hi.tolist(), lo.tolist(), owner.tolist(), many.tolist()) == ([5, 5, 7], [1, 2, 0], [4, 3, 3], [True, False, False])
    keys = (hi, lo, owner)
    assert exchange.look_up(keys, np.array([5, 5, 5, 8], U64), np.array([2, 1, 3, 0], np.uint32)).tolist() == [3, 4, exchange.ABSENT, exchange.ABSENT]


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op4_jaccard_join", "op8_decontaminate"])
def test_queries_equal_their_oracles(compare, name):
    compare(queries.queries()[name], queries.oracle_sql()[name])
