"""The pipeline's stages on small tables: what each takes out, and what it leaves alone."""

from __future__ import annotations

import itertools
import random

import brute
import corpus_pipeline as pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from odonymy.llm import quality
from odonymy.llm.frames import table
from odonymy.llm.tokens import Encoder, public_path

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = table(spark, SF, "documents"), []
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        after = spark.read.parquet(f"{folder}/{name}")
        out.append((docs, after))
        docs = after
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    assert all(after.columns == before.columns for before, after in stages[:-1])


def test_bad_quality_goes(spark, stages):
    labels = table(spark, SF, "labels")
    before, after = stages[0]
    left = after.join(labels, "doc_id").groupBy("quality").count().collect()
    had = {r.quality: r["count"] for r in before.join(labels, "doc_id").groupBy("quality").count().collect()}
    left = {r.quality: r["count"] for r in left}
    assert left[1] >= 0.98 * had[1] and left.get(0, 0) <= 0.1 * had[0]


def test_one_of_each_class_stays(stages):
    before, after = stages[1]
    want = {d for d, (_, c) in brute.jaccard(list(texts(before).items()), 5, 80).items() if d == c}
    assert set(texts(after)) == want


def test_passages_stay_once(stages):
    before, after = (texts(x) for x in stages[2])
    want = brute.dedup(list(before.items()), pipeline.PASSAGE_WORDS)
    for d, (n, gone, sha) in want.items():
        if gone == n and n:
            assert d not in after
        elif gone:
            assert brute.hashlib.sha256(after[d].encode()).hexdigest() == sha
        else:
            assert after[d] == before[d]


def test_benchmark_windows_go(spark, stages):
    before, after = (texts(x) for x in stages[3])
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = {d for d, r in brute.contamination(list(before.items()), items).items() if not r[-1]}
    assert set(after) == want and len(after) < len(before)


def test_all_that_is_left_is_packed(stages):
    before, after = stages[4]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == set(texts(before))
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_is_the_stages_in_order(spark, stages):
    got = sorted(map(tuple, pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()))
    assert got == sorted(map(tuple, stages[-1][1].select("doc_id", "piece", "ids_crc32").collect()))


CLASH = "'n' AS n_removed, 'k' AS kept_text, 1 AS _id, 2 AS a, 3 AS b, 4 AS row, 5 AS id, 6 AS lost, 'h' AS hit_id, 's' AS hit_sha, 't' AS sha, 7 AS _sha, 8 AS block, 9 AS component_id, 0.5 AS score, 1 AS n, 'w' AS words, array(1) AS hit_spans, true AS removed, 3 AS place"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with null and repeated ids, two texts under one id, repeated rows, empty, null and very long texts, and columns of clashing names."""
    rng = random.Random(21)
    words = [f"word{i}" for i in range(400)]
    story = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bad = lambda n: " ".join(["zzz"] * n)
    passage, item, copy = story(60), story(12), story(90)
    near = copy.split()
    near[40] = "changed"
    rows = [(i, story(rng.randint(30, 90))) for i in range(1, 60)] + [(100 + i, bad(rng.randint(20, 60))) for i in range(40)]
    rows += [(201, f"{story(20)} {passage} {story(5)}"), (202, f"{story(30)}\n{passage}"), (203, passage), (204, f"{story(8)} {item} {story(30)}"), (205, item.upper())]
    rows += [(301, copy), (302, " ".join(near)), (303, copy), (301, copy), (304, story(40)), (304, story(50)), (304, bad(30))]
    rows += [(None, copy), (None, f"{item} {story(20)}"), (None, passage), (401, None), (402, ""), (403, " \n "), (404, story(8000)), (404, None), (None, None)]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.selectExpr("*", *CLASH.split(", ")).repartition(5).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, 0) for i in range(1, 60)] + [(100 + i, 0, 0) for i in range(40)] + [(None, 1, 1), (1, None, 0), (9999, 1, 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([("i1", item), ("i2", None), (None, story(15))], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, [("i1", item)]


def brute_stages(spark, folder, rows, items):
    """Rows left after each of the first four stages, in plain Python but for the trained model."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = [(d, t) for d, t in rows if model.scores(pa.array([t], pa.string()))[0] >= 0.5]
    yield rows
    texts = {}
    for d, t in rows:
        texts.setdefault(d, set()).add(t or "")
    # An id is one vertex: it links where any of its texts does.
    sets = {(d, t): brute.shingles(t, 5) for d in texts if d is not None for t in texts[d]}
    label = {d: d for d in texts if d is not None}
    for (d, x), (e, y) in itertools.combinations(sorted(sets), 2):
        both = len(sets[d, x] & sets[e, y])
        if both and 100 * both >= 80 * len(sets[d, x] | sets[e, y]):
            low, high = sorted((label[d], label[e]))
            label = {k: low if v == high else v for k, v in label.items()}
    seen, kept = set(), []
    for d, t in rows:
        if d is None or (label[d] == d and (d, t or "") not in seen):
            seen.add((d, t or ""))
            kept.append((d, t))
    yield (rows := kept)
    first = {}
    split = {t: (t or "").split() for _, t in rows}
    for d, t in rows:
        for i in range(len(split[t]) - 49):
            w = tuple(split[t][i : i + 50])
            first[w] = min(first.get(w, d if d is not None else 10**9), d if d is not None else 10**9)
    kept = []
    for d, t in rows:
        gone = {i + k for i in range(len(split[t]) - 49) if d is not None and first[tuple(split[t][i : i + 50])] < d for k in range(50)}
        rest = " ".join(w for i, w in enumerate(split[t]) if i not in gone)
        if not gone or rest:
            kept.append((d, rest if gone else t))
    yield (rows := kept)
    yield [(d, t) for d, t in rows if not brute.contamination([(0, t)], items)[0][-1]]


def test_stages_and_run_equal_brute_force_on_odd_rows(spark, odd, tmp_path):
    folder, rows, items = odd
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    own, want = lambda found: sorted(((r.doc_id, r.text) for r in found), key=str), None
    for (name, stage), want in zip(pipeline.STAGES, brute_stages(spark, folder, rows, items), strict=False):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs.collect()
        assert own(got) == sorted(want, key=str), name
        assert {(r.n_removed, r.kept_text, r._id, r.a, r.b, r.hit_id, r._sha, r.component_id) for r in got} == {("n", "k", 1, 2, 3, "h", 7, 9)}, name
    encode = Encoder(public_path("word_bpe_49k.json"))
    pieces = []
    for d, t in want:
        ids = encode([t])[0].tolist()
        pieces += [(d, k // 2048, k, len(ids[k : k + 2048]), brute.crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    packed = pipeline.run(spark, folder).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == sorted(pieces, key=str)
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_stages_take_empty_tables(spark, odd):
    folder = odd[0]
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name
