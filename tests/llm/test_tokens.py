"""Tokenization, packing and the token file: exact against the tokenizer and by round trip."""

from __future__ import annotations

import random
from collections import defaultdict

import brute
import numpy as np
import pytest

from odonymy.llm import packing, queries, repair_codec
from odonymy.llm.frames import table
from odonymy.llm.text import planes
from odonymy.llm.tokens import Encoder, public_path

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD = ["", None, " ", "  a", "a  b", "a \n b  c", " 's it's  ''s ..'s 'tis", "x\n\n y", "a\t b \t", "É é ́x", "　 a 　b", "12 345 a1b2", "İ ß ﬁ ªº½²", "<|endoftext|> hi", "\x1c a \x1d b", " \x85 a", "Café  x", "日本 語", "can'T'll", "a" * 5000]


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("limit", [40, 100_000])
def test_encoder_equals_tokenizer(name, limit):
    encode = Encoder(public_path(name), limit)
    rng = random.Random(3)
    alphabet = [*"ab Zz'  \n\t.,!19é²\u0085", "İ", "'re", " the", "日"]
    for _ in range(40):
        texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        ids, bounds = encode(texts)
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("name", FILES)
def test_every_character_below_the_rare_ones(name):
    encode = Encoder(public_path(name))
    texts = [t for c in map(chr, range(0x132)) for t in (c, c + c, f" {c}", f"a{c}b {c}É", f"1{c} x{c}", f"({c}) {c} é{c}")]
    ids, bounds = encode(texts)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*encode.tokenizer.encode(t, add_special_tokens=False).ids, 0], t


@pytest.mark.parametrize("name", FILES)
def test_only_odd_units_are_looked_at_one_by_one(name, monkeypatch):
    seen, inner = [], Encoder._ids
    monkeypatch.setattr(Encoder, "_ids", lambda self, texts: seen.extend(texts) or inner(self, texts))
    Encoder(public_path(name))(["Plain words, größer und élégant.\nIt's ..."])
    assert seen and not {"Plain", " words", ",", " größer", " und", " élégant"} & set(seen)


def test_best_fit_and_search_keep_all_pieces():
    rng = random.Random(9)
    for room, sizes in ((10, [rng.randint(1, 10) for _ in range(200)]), (100, [rng.randint(20, 60) for _ in range(300)]), (10, []), (10, [10] * 3), (2048, [rng.randint(1, 2047) for _ in range(900)])):
        for first in (packing.best_fit(sizes, room), [[i] for i in range(len(sizes))]):
            after, steps = packing.improve([list(b) for b in first], sizes, room)
            assert sorted(i for b in after for i in b) == list(range(len(sizes)))
            assert all(sum(sizes[i] for i in b) <= room for b in after) and len(after) <= len(first)
            assert len(after) <= len(packing.best_fit(sorted(sizes, reverse=True), room)) * 1.03 + 1


def test_each_step_raises_the_squared_fill(monkeypatch):
    rng, seen = random.Random(4), []
    inner = packing.Search._apply

    def watched(self, *step):
        inner(self, *step)
        seen.append(sum((self.room - r) ** 2 for r in self.rest))

    monkeypatch.setattr(packing.Search, "_apply", watched)
    sizes = [rng.randint(20, 60) for _ in range(400)]
    search = packing.Search([[i] for i in range(400)], sizes, 100)
    assert search.run() == len(seen) > 100
    assert all(a < b for a, b in zip([sum(s * s for s in sizes), *seen], seen, strict=False))


def test_search_empties_bins_by_exchange():
    sizes = [6, 3, 5, 4, 2]
    # No bin of 10 has room for the 2: only after 6 is exchanged for 5 there is.
    bins = lambda first, sizes: packing.improve(first, sizes, 10)[0]
    assert len(bins([[0, 1], [2, 3], [4]], sizes)) == 2
    assert len(bins([[0], [1], [2]], [4, 4, 2])) == 1
    # 3 is exchanged for the 2 beside the 7; the 2 then moves to the 8.
    assert sorted(map(sorted, bins([[0, 1], [2], [3]], [7, 2, 3, 8]))) == [[0, 2], [1, 3]]
    # Two for one: 3 + 3 for the 5 beside the 4.
    assert len(bins([[0, 1], [2, 3], [4]], [4, 5, 3, 3, 5])) == 2
    # One for two: 4 for the 1 + 2 beside the 6; they then fit the 9 and the 8.
    assert len(bins([[0, 1, 2], [3], [4], [5]], [6, 1, 2, 9, 4, 8])) == 3


def check_packing(rows, encode, docs, length):
    want = {}
    for d, t in docs:
        ids = [*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), length):
            want[d, k // length] = (k, len(ids[k : k + length]), brute.crc(ids[k : k + length]))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for members in bins.values():
        at = 0
        for offset, size in sorted(members):
            assert offset == at
            at += size
        assert at <= length
    total = sum(r.length for r in rows)
    return len(bins), -(-total // length)


def test_packing_of_the_corpus(frame, corpus):
    path = public_path(FILES[0])
    rows = packing.pack(packing.pieces(frame(corpus), path, 256), 256).collect()
    used, least = check_packing(rows, Encoder(path), corpus, 256)
    assert used <= max(least, sum(r.length > 128 for r in rows)) * 1.02 + 1


def test_search_packs_real_documents_into_the_fewest_sequences(spark):
    path = public_path(FILES[0])
    found = packing.pieces(table(spark, "/root/testdata/sf0.1", "documents"), path).select("length").where("length < 2048")
    sizes = [r.length for r in found.collect()]
    first = packing.best_fit(sizes, 2048)
    after, steps = packing.improve(first, sizes, 2048)
    assert steps > 500 and len(first) > len(after) == -(-sum(sizes) // 2048)


def test_packing_fills_real_documents_completely(spark):
    rows = queries.queries()["op6_best_fit_packing"](spark, "/root/testdata/sf0.1").collect()
    used, least = len({r.sequence_id for r in rows}), -(-sum(r.length for r in rows) // 2048)
    assert used == least


def test_underfull_bins_of_all_shards_are_packed_together(frame):
    rng = random.Random(2)
    rows = frame([(i, "a " * rng.randint(1, 120)) for i in range(9000)])
    path = public_path(FILES[0])
    found = packing.pack(packing.pieces(rows, path), 256, 20_000, merge=2).collect()
    used, least = len({r.sequence_id for r in found}), -(-sum(r.length for r in found) // 256)
    assert len(found) == 9000 and used == least


def test_packing_of_repeated_rows_and_nothing(frame):
    path = public_path(FILES[0])
    rows = packing.pack(packing.pieces(frame([(1, "a b"), (1, "a b"), (None, "c"), (2, None)]), path)).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4 and len({r.sequence_id for r in rows}) == 1
    assert packing.pack(packing.pieces(frame([(1, "a")]).limit(0), path)).count() == 0


def test_grammar_round_trip_and_random_access():
    rng = np.random.default_rng(4)
    for ids in (np.zeros(0, np.uint32), np.array([5], np.uint32), np.full(5000, 7, np.uint32), rng.integers(0, 50_000, 3000).astype(np.uint32), np.tile(rng.integers(0, 50, 40), 300).astype(np.uint32), (rng.zipf(1.3, 20_000) % 500).astype(np.uint32)):
        symbols, rules, base = repair_codec.compress(ids)
        size = repair_codec.rule_sizes(rules, base)
        per = np.concatenate([np.ones(base, np.int64), size])[symbols]
        row = {"symbols": planes(symbols), "rules": planes(rules), "rule_sizes": planes(size), "positions": planes((np.cumsum(per) - per)[:: repair_codec.STEP]), "base": base, "n_ids": len(ids)}
        grammar = repair_codec.Grammar(row)
        assert (grammar.expand(symbols) == ids).all() and (grammar.all_ids() == ids).all()
        for _ in range(20):
            lo, hi = sorted(rng.integers(0, len(ids) + 1, 2).tolist())
            assert (grammar.read_range(lo, hi) == ids[lo:hi]).all()
    assert len(symbols) < len(ids) and len(rules)


def test_grammar_ends_only_when_no_pair_is_frequent():
    rng = np.random.default_rng(7)
    ids = np.concatenate([rng.zipf(1.2, 30_000) % 3000, np.tile(rng.integers(3000, 6000, 500), 20)]).astype(np.uint32)
    symbols, rules, base = repair_codec.compress(ids)
    pairs = np.unique(np.stack([symbols[:-1], symbols[1:]], 1), axis=0, return_counts=True)[1]
    assert pairs.max() < 8 and len(symbols) < len(ids) * 0.7 and rules.max() < base + len(rules)


def test_frequent_pairs_are_counted_whole():
    rng = np.random.default_rng(8)
    for pairs in (np.zeros(0, np.uint32), np.full(9, 3, np.uint32), rng.integers(0, 40, 300).astype(np.uint32), (rng.zipf(1.2, 40_000) % 5000).astype(np.uint64), np.repeat(np.arange(50, dtype=np.uint32), rng.integers(1, 500, 50))):
        for min_count, share in ((8, 16), (2, 3), (1, 1)):
            every, n = np.unique(rng.permutation(pairs), return_counts=True)
            want = n >= max(min_count, n.max(initial=0) // share)
            count, found = repair_codec._frequent(pairs, min_count, share)
            kept = count >= max(min_count, count.max(initial=0) // share)
            assert found[kept].tolist() == every[want].tolist() and count[kept].tolist() == n[want].tolist()


def check_file(rows, encode, docs):
    at = 0
    for (d, t), r in zip(sorted(docs), sorted(rows, key=lambda r: r.doc_id), strict=True):
        ids = [*encode.tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), brute.crc(ids))
        at += len(ids)


def test_token_file_round_trip(spark, frame, corpus, tmp_path):
    path = public_path(FILES[1])
    repair_codec.write(frame(corpus, 7), path, str(tmp_path / "f"), shard_tokens=3000, part_bytes=40_000)
    files = spark.read.parquet(str(tmp_path / "f"))
    assert files.count() >= 8
    rows = repair_codec.read(files).collect()
    check_file(rows, Encoder(path), corpus)
    encode = Encoder(path)
    every = np.concatenate([encode([t])[0] for _, t in sorted(corpus)])
    for start, stop in ((0, 10), (0, len(every)), (2990, 3010), (5000, 12_000), (len(every) - 5, len(every) + 5), (7, 7)):
        assert (repair_codec.read_range(files, start, stop) == every[start:stop]).all()


def test_token_file_of_real_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    check_file(queries.queries()["op7_token_file"](spark, sf).collect(), Encoder(public_path(FILES[1])), docs)


def test_token_file_of_repeated_rows_null_ids_and_nothing(frame):
    path = public_path(FILES[1])
    rows = repair_codec.round_trip(frame([(3, "x y"), (3, "x y"), (None, "z"), (1, None)]), path).collect()
    assert sorted(((r.doc_id or 0), r.start, r.n_tokens) for r in rows) == [(0, 0, 2), (1, 2, 1), (3, 3, 3), (3, 6, 3)]
    hot = repair_codec.round_trip(frame([(5, "same")] * 300 + [(5, f"other {i}") for i in range(50)] + [(4, "first")]), path).collect()
    ends = sorted((r.start, r.start + r.n_tokens) for r in hot)
    assert len(hot) == 351 and ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    assert repair_codec.round_trip(frame([(1, "a")]).limit(0), path).count() == 0
