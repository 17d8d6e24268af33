"""Classifiers by held-out accuracy, rules against brute force, rollups, and their edge cases."""

from __future__ import annotations

import random
import zlib
from collections import Counter

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from odonymy.llm import language, quality, queries, rules, samples, token_rollup, toxicity
from odonymy.llm.frames import table

SF = "/root/testdata/sf0.1"


def held_out(spark, name, label, held):
    found = queries.queries()[name](spark, SF).where(F.col("held_out") == held)
    labels = table(spark, SF, "labels").select("doc_id", F.col(label).alias("y"))
    return found.join(labels, "doc_id").select("doc_id", "score", "predicted", "y").collect()


def test_toxicity_held_out(spark):
    rows = held_out(spark, "op2_toxicity", "toxic", True)
    hit = sum(r.predicted and r.y for r in rows)
    assert len(rows) > 500 and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert hit / sum(r.y for r in rows) > 0.75
    assert hit / sum(r.predicted for r in rows) > 0.95


def test_quality_held_out(spark):
    rows = held_out(spark, "op5_quality_classifier", "quality", True)
    assert sum(r.predicted == r.y for r in rows) / len(rows) > 0.98


def test_language_held_out(spark):
    found = queries.queries()["op9_language_id"](spark, SF).where("held_out").join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in found)
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.99
    assert all(0 <= r.score <= 1 for r in found)


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def plain(spark, frame):
    """Clean and bad texts: bad ones have a marked word in one of their sentences."""
    rng = random.Random(6)
    words = [f"word{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(words) for _ in range(8)) for _ in range(6)]
        if i % 4 == 0:
            sentences[rng.randrange(6)] += " vilefool"
        rows.append((i, ". ".join(sentences) + "."))
        marks.append((i, int(i % 4 != 0), int(i % 4 == 0)))
    return frame(rows), labels_of(spark, marks), dict(rows)


def test_scores_do_not_depend_on_what_else_is_in_a_batch(spark, plain, frame):
    """Each text scored by itself, against all in batches of any make-up."""
    docs, marks, texts = plain
    some = [*list(texts.items())[:60], *[(10_000 + i, t) for i, (_, t) in enumerate(EDGES) if t is None or len(t) < 1000]]
    tox, good = toxicity.fit(docs, marks), quality.fit(docs, marks)
    lang = language.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb")))
    one = lambda t: pa.array([t], pa.string())
    want = {d: (float(tox.documents(toxicity.bags(one(t)))[0]), float(good.scores(one(t))[0]), float(lang.predict(one(t))[1][0])) for d, t in some}
    for parts in (1, 7):
        rows = frame(some, parts)
        found = [{r.doc_id: r.score for r in scored.collect()} for scored in (toxicity.score(rows, tox), quality.score(rows, good), language.predict(rows, lang))]
        for d, t in some:
            assert found[0][d] == pytest.approx(want[d][0], abs=1e-6) and found[1][d] == pytest.approx(want[d][1], abs=1e-6)
            assert found[2][d] == pytest.approx(want[d][2] if any(c.isalpha() for c in t or "") else 0, abs=1e-5)


def test_samples_are_bounded_by_rows_not_ids(spark):
    rows = [(1, f"text {i}", "en") for i in range(300)] + [(i, "other", f"l{i}") for i in range(2, 300)] + [(None, "none", "en"), (5, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = labels_of(spark, [(i, 1, 0) for i in range(1, 300)] + [(1, 0, 0), (None, 1, 1)])
    got = samples.labelled(docs, marks, "quality", 40).collect()
    assert 0 < len(got) <= 40
    every = samples.labelled(docs, marks, "quality", 10_000).collect()
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(1, 300)) and len([r for r in every if r.text.startswith("text")]) <= 1
    model = language.fit(docs, languages=20, sample=50)
    assert 0 < len(set(model.languages)) <= 20


EDGES = [(1, None), (2, ""), (3, "?!. \n"), (4, "vilefool"), (5, "x" * 300_000), (5, "x" * 300_000), (6, "a. " * 30_000), (None, "b")]


def test_toxic_sentences_are_located(plain, frame):
    docs, marks, texts = plain
    model = toxicity.fit(docs, marks)
    hits = clean = 0
    for r in toxicity.score(docs, model).collect():
        raw = texts[r.doc_id].encode()
        found = [raw[s.start : s.end].decode() for s in r.offending]
        assert all("vilefool" in x and "." not in x for x in found)
        hits += bool(found) and r.predicted
        clean += r.predicted == 0
    assert hits > 140 and clean == 450
    got = {r.doc_id: r for r in toxicity.score(frame(EDGES), model).collect()}
    assert got[1].score == got[2].score == got[3].score == 0 and got[4].predicted == 1 and got[6].predicted == 0 and None in got
    assert toxicity.score(frame(EDGES).limit(0), model).count() == 0


@pytest.mark.parametrize("marks", [[], [(1, 1, 0), (2, 1, 0)], [(1, 0, 1), (2, 0, 1)], [(1, None, None), (None, 1, 1)]])
def test_models_of_one_class_or_none(spark, frame, marks):
    docs = frame([(1, "some text"), (2, "other text"), (3, None)])
    for operator in (toxicity, quality):
        got = operator.score(docs, operator.fit(docs, labels_of(spark, marks))).collect()
        assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)


def test_quality_learns_and_keeps_columns(plain, frame):
    docs, marks, _ = plain
    model = quality.fit(docs, marks, epochs=40)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < 600
    again = quality.fit(docs, marks, epochs=40)
    assert model.bias == again.bias
    got = quality.score(frame(EDGES), model).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    alike = {r.score for r in got if r.doc_id == 5}
    assert len(alike) == 1


def test_language_edges(spark, frame):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(40))
    rows = [(i, make("abcde" if i % 2 else "vwxyz"), "aa" if i % 2 else "zz") for i in range(200)] + [(500, "abcd bcda", None), (501, "12 34 !", "aa"), (502, None, "zz"), (503, "", "aa"), (504, "ABCDE edcba", "aa"), (505, "日本語", "aa"), (506, "abc de " * 40_000, "aa")]
    docs = spark.createDataFrame([(d, t, g, "x") for d, t, g in rows], "doc_id long, text string, lang string, letters string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(got[i].lang_pred == ("aa" if i % 2 else "zz") for i in range(200))
    assert [got[i].lang_pred for i in (500, 501, 502, 503, 504, 506)] == ["aa", "und", "und", "und", "aa", "aa"]
    assert got[505].lang_pred in ("aa", "zz") and got[502].score == 0 and got[502].rejected
    none = language.predict(docs, language.fit(docs.where("lang is null")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_rule_counts_equal_brute_force(frame, corpus):
    rows = [*corpus, (900, "a\nb\na\n a\n\n \na"), (901, "# * $ % & | < > ## x"), (902, "p q r s t u v w " * 2), (903, "ß é 日本 𝕏"), (904, "w " * 5000)]
    found = rules.judge(frame(rows)).collect()
    want = {d: brute.rules(t) for d, t in rows}
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found} == want
    assert not any(r.kept and r.base_failed for r in found)


def test_rules_reject_what_differs_from_the_language(spark):
    docs = table(spark, SF, "documents")
    found = rules.judge(docs).join(table(spark, SF, "labels"), "doc_id").where("not base_failed").select("quality", "kept").collect()
    good, bad = [r.kept for r in found if r.quality == 1], [r.kept for r in found if r.quality == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.35


def test_rules_on_nothing_and_without_languages(frame):
    assert rules.judge(frame([(1, "x")]).limit(0)).count() == 0
    got = rules.judge(frame([(1, "w " * 40)]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert got[0].kept is False and got[0].base_failed
    got = rules.judge(frame([(1, " ".join(f"w{i}" for i in range(40)))]).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert got[0].kept is True


def test_every_language_is_a_reference(spark):
    plain, loud = " ".join(f"word{chr(97 + i % 26)}" for i in range(60)), " ".join(f"{1000 + i}" for i in range(60))
    rows = [(2 * i + j, plain, f"l{i:03d}") for i in range(203) for j in range(2)] + [(9000, loud, "zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert len(found) == len(rows) and found[9000].kept and found[9000].char_distance == 0
    by_blocks = {r.doc_id: r for r in rules.judge(docs, block=70).collect()}
    assert by_blocks == found


@pytest.fixture
def rollup(spark, tmp_path):
    return token_rollup.Rollup(spark, str(tmp_path / "roll"))


def totals(roll):
    return sorted((tuple(r) for r in roll.totals().collect()), key=str)


def counted(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, tokenizer_version string, n_tokens long")


def test_rollup_inserts_deletes_revises(spark, rollup):
    assert totals(rollup) == []
    rows = counted(spark, [(1, "a", "en", "v1", 10), (2, "a", "en", "v1", 5), (3, None, None, "v2", None)])
    assert rollup.commit("b1", token_rollup.inserted(rows))
    assert rollup.commit("b1", token_rollup.inserted(rows))  # sent again: no change
    assert [r for r in totals(rollup) if r[0]] == [("a", "en", "v1", 2, 15)] and len(rollup.totals().collect()) == 2
    rollup.commit("b2", token_rollup.revised(rows.where("doc_id = 1"), rows.where("doc_id = 1").withColumn("n_tokens", F.lit(7).cast("long"))))
    rollup.compact()
    assert not rollup.commit("b1", token_rollup.inserted(rows))
    rollup.commit("b3", token_rollup.deleted(rows.where("doc_id > 1")))
    assert totals(rollup) == [("a", "en", "v1", 1, 7)]
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == [("a", "en", "v1", 1, 7)]


def test_rollup_ignores_half_written_batches(spark, rollup):
    rows = counted(spark, [(1, "a", "en", "v1", 10)])
    rollup.commit("b1", token_rollup.inserted(rows))
    token_rollup.inserted(rows).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{rollup.path}/batches/b2/00")
    assert totals(rollup) == [("a", "en", "v1", 1, 10)]
    rollup.commit("b3", token_rollup.inserted(rows.limit(0)))
    rollup.commit("b2", token_rollup.inserted(rows))
    assert totals(rollup) == [("a", "en", "v1", 2, 20)]


def test_rollup_keeps_a_committed_batch_when_it_is_sent_again(spark, rollup):
    rows = counted(spark, [(1, "a", "en", "v1", 10)])
    rollup.commit("b1", token_rollup.inserted(rows))

    def lost(batches):
        raise RuntimeError("executor lost")

    broken = token_rollup.inserted(rows).mapInArrow(lost, "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
    rollup.commit("b1", broken)  # not even read
    with pytest.raises(Exception, match="executor lost"):
        rollup.commit("b2", broken)
    assert totals(rollup) == [("a", "en", "v1", 1, 10)]
    rollup.commit("b2", token_rollup.inserted(rows))
    token_rollup._summed(token_rollup.inserted(rows)).write.parquet(f"{rollup.path}/batches/b2/zz")  # a second attempt at the same time
    assert totals(rollup) == [("a", "en", "v1", 2, 20)]


def test_rollup_commit_during_compaction_counts_once(spark, rollup):
    rows = counted(spark, [(1, "a", "en", "v1", 10)])
    rollup.commit("b1", token_rollup.inserted(rows))
    inner = rollup._totals
    reader = rollup.totals()

    def meanwhile(*args):
        rollup.commit("b2", token_rollup.inserted(rows))
        return inner(*args)

    rollup._totals = meanwhile
    rollup.compact()
    rollup._totals = inner
    assert totals(rollup) == [("a", "en", "v1", 2, 20)]
    assert reader.collect()[0].n_docs == 1  # began before the compaction
    for _ in range(3):
        rollup.compact()
        assert totals(rollup) == [("a", "en", "v1", 2, 20)]
    assert not rollup.commit("b2", token_rollup.inserted(rows)) and rollup._names("batches") == []


def test_replay_counts_negative_and_null_ids(spark, tmp_path):
    rows = [(d, "a b c", "en", "s") for d in [*range(-40, 40), -(2**63), 2**63 - 1, None]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = token_rollup.replay(docs, str(tmp_path / "replay")).collect()
    assert {r.tokenizer_version: (r.n_docs, r.n_tokens) for r in got} == {v: (len(rows), 3 * len(rows)) for v in token_rollup.versions()}
    assert token_rollup.replay(docs.limit(0), str(tmp_path / "none")).count() == 0


def test_counts_equal_the_tokenizers(frame):
    texts = [(1, "Don't x-y été 12!"), (2, None), (3, ""), (3, ""), (None, "日本 " * 2000), (4, "<|endoftext|> a")]
    got = sorted((r.doc_id or 0, r.tokenizer_version, r.n_tokens) for r in token_rollup.counted(frame(texts)).collect())
    want = []
    for name, path in token_rollup.versions().items():
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        want += [(d or 0, name, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in texts]
    assert got == sorted(want)


def test_totals_equal_brute_force(spark):
    sf, want = "/root/testdata/sf0.001", Counter()
    docs = table(spark, sf, "documents").collect()
    for name, path in token_rollup.versions().items():
        tokenizer = Tokenizer.from_file(path)
        for r in docs:
            want[r.source, r.lang, name, "docs"] += 1
            want[r.source, r.lang, name, "tokens"] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    got = Counter()
    for r in queries.queries()["op3_token_counts"](spark, sf).collect():
        got[r.source, r.lang, r.tokenizer_version, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer_version, "tokens"] += r.n_tokens
    assert got == want


@pytest.mark.parametrize("name", ["op10_quality_rules"])
def test_queries_equal_their_oracles(compare, name):
    compare(queries.queries()[name], queries.oracle_sql()[name])
