"""Language identification, quality, BPE, decontamination and language model."""

from types import SimpleNamespace

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vacanta.llm import bpe, language_id, language_model, quality
from vacanta.llm.batches import table
from vacanta.llm.decontaminate import Benchmark, decontaminate, find_benchmark, judged, suffix_array
from vacanta.llm.elias_fano import EliasFano
from vacanta.llm.language_model import MASS, STEPS_PER_OCTAVE, pack, pack_tokens, probability, quantised, score_texts, unpack, unpack_tokens
from vacanta.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_language_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = QUERIES["op1_language_id"](spark, sf_dir)
    assert out.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    rows = out.join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.9 * len(rows)
    assert all(r.held_out == (brute.crc(r.doc_id) % 5 == 0) for r in rows)


def test_language_awkward_rows(spark, awkward, nothing):
    model = language_id.train(awkward, key=F.col("doc_id"))
    assert model.languages == ["de", "en", "fr"]
    rows = language_id.identify(awkward.withColumn("score", F.lit("clash")), model).collect()
    assert len(rows) == len(brute.AWKWARD)
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letter) and (r.score == 0) == (not letter) and 0 <= r.score <= 1
    assert language_id.identify(nothing, model).count() == 0
    none = language_id.train(nothing)
    assert {r.lang_pred for r in language_id.identify(awkward, none).collect()} == {"und"}
    one = language_id.train(awkward.where("lang = 'en'"))
    assert {(r.lang_pred, r.score) for r in language_id.identify(awkward.where("doc_id = 10"), one).collect()} == {("en", 1.0)}


def test_language_frequencies_equal_counting(spark):
    texts = ["abca", "", "b", "ab ab é", "x" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = language_id.document_frequencies(df, bits=15)
    expected = np.zeros((1 << 15) + 1, int)
    for t in texts:
        _, bucket, n = language_id._counted(pa.array([t]), 15, language_id.ORDERS)
        assert n.sum() == sum(max(len(t) - k + 1, 0) for k in language_id.ORDERS)
        expected[np.unique(bucket)] += 1
        expected[-1] += 1
    assert (got == expected).all()


def test_temperature_lowers_loss():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 3, 500)
    logits = rng.normal(size=(500, 3)) + 2 * np.eye(3)[labels]
    t = language_id.best_temperature(5 * logits, labels)
    loss = lambda x: -np.log(language_id.softmax(x)[np.arange(500), labels]).mean()
    assert t > 2 and loss(5 * logits / t) < loss(5 * logits)
    assert language_id.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_elastic_net_makes_weights_sparse():
    rng = np.random.default_rng(0)
    labels = rng.integers(0, 2, 300)
    rows = [(np.array([y, 2 + int(k)]), np.array([1.0, 1.0])) for y, k in zip(labels, rng.integers(0, 100, 300), strict=True)]
    dense = language_id.follow_the_leader(rows, labels, 2, 102, l1=0.0)
    sparse = language_id.follow_the_leader(rows, labels, 2, 102, l1=2.0)
    assert (sparse == 0).sum() > (dense == 0).sum() + 50 and sparse[0, 0] > 0 > sparse[1, 0]


def test_quality_against_labels(spark, sf_dir):
    out = QUERIES["op5_quality"](spark, sf_dir)
    assert out.count() == table(spark, sf_dir, "documents").count()
    rows = out.withColumnRenamed("quality", "p").join(table(spark, sf_dir, "labels"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.accepted for r in good) >= 0.97 * len(good)
    assert sum(r.accepted for r in bad) <= 0.3 * max(len(bad), 1)


def test_quality_awkward_rows(spark, awkward, nothing):
    model = quality.train(awkward)
    rows = quality.score_quality(awkward.withColumn("quality", F.lit("clash")), model).collect()
    assert len(rows) == len(brute.AWKWARD)
    for r in rows:
        if not (r.text or "").split():
            assert r.quality == 0 and not r.accepted and r.labels == "-" * len(quality.LABELLERS)
    assert len({r.quality for r in rows if r.text == brute.PROSE}) == 1
    empty = quality.train(nothing)
    assert quality.score_quality(nothing, empty).count() == 0
    assert quality.score_quality(awkward.where("doc_id = 1"), empty).first().accepted


def test_quality_sample_is_bounded_by_distinct_texts(spark, monkeypatch):
    """A text on most rows neither fills the sample nor keeps other texts of its class out."""
    bad = [f"$$## @@{i} ^^~~ ||{{}} <<>> ##{i}%% &&** == ++{i}" * 4 for i in range(200)]
    good = [f"{brute.PROSE} It was the year {i}." for i in range(300)]
    fitted, fit = [], quality.fit_linear

    def seen(row, column, value, size, target, weight, *rest):
        fitted.append(target)
        return fit(row, column, value, size, target, weight, *rest)

    monkeypatch.setattr(quality, "fit_linear", seen)
    docs = spark.createDataFrame([(t,) for t in bad + good + bad[:1] * 4000 + good[:1] * 4000], "text string").repartition(5)
    model = quality.train(docs, sample=50)
    assert (fitted[0] < 0.5).sum() == 50 and (fitted[0] >= 0.5).sum() == 50
    judged = quality.score_quality(spark.createDataFrame([(t,) for t in bad + good], "text string"), model)
    assert {r.text for r in judged.where("accepted").collect()} == set(good)


def test_estimation_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.7
    accuracy = (0.95, 0.85, 0.75, 0.9)
    votes = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in accuracy], axis=1).astype(np.int8)
    votes[rng.random(votes.shape) < 0.2] = quality.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, t, share = quality.estimate(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.03
    for j, a in enumerate(accuracy):
        assert abs(t[quality.GOOD, j, 1] / (t[quality.GOOD, j, 1] + t[quality.GOOD, j, 0]) - a) < 0.04


def library(texts):
    tokenizer = Tokenizer.from_file(PATH)
    coded = tokenizer.encode_batch(["" if t is None else t for t in texts], add_special_tokens=False)
    return [(e.ids, tokenizer.decode(e.ids, skip_special_tokens=False)) for e in coded]


def test_bpe_equals_the_library(spark, awkward, nothing):
    rows = bpe.encode_texts(awkward.withColumn("ids", F.lit("clash")), PATH, decode=True).collect()
    assert len(rows) == len(brute.AWKWARD)
    for r, (ids, text) in zip(rows, library([r.text for r in rows]), strict=True):
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == text and r.n_tokens == len(ids)
    assert bpe.encode_texts(nothing, PATH).count() == 0


def test_bpe_random_texts():
    rng = np.random.default_rng(3)
    parts = ["a", "aa", " ", "  ", "\n", "é", "'s", "'", "<|endoftext|>", "1", "x", "the", "e", "\u3000", "!", "\U0001f600", "\t", "\0"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 50))) for _ in range(1500)] + ["a" * 3000, " " * 3000]
    ids, sizes = bpe.codec(PATH).encode(texts)
    cut = np.cumsum(sizes) - sizes
    for (expected, _), a, n in zip(library(texts), cut, sizes, strict=True):
        assert ids[a : a + n].tolist() == expected


def test_bpe_decodes_partial_characters(spark):
    ids = library(["é"])[0][0]
    frame = spark.createDataFrame([(np.array(ids[:1], "<u4").tobytes(),), (None,), (np.array([4_000_000_000], "<u4").tobytes(),)], "ids binary")
    out = [r.decoded for r in bpe.decode_ids(frame, PATH).collect()]
    assert out[0] == Tokenizer.from_file(PATH).decode(ids[:1], skip_special_tokens=False) and out[1] == ""


def test_bpe_query(spark, sf_dir):
    rows = QUERIES["op7_bpe"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    expected = library([texts[r.doc_id] for r in rows])
    for r, (ids, text) in zip(rows, expected, strict=True):
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(text))


def test_suffix_array_sorts_to_depth():
    rng = np.random.default_rng(2)
    for n, kinds, depth in ((1, 1, 4), (50, 2, 16), (400, 3, 8), (300, 1, 64)):
        x = rng.integers(0, kinds, n)
        order = suffix_array(x, depth).tolist()
        assert sorted(order) == list(range(n))
        keys = [tuple(x[i : i + depth]) for i in order]
        assert keys == sorted(keys)


ITEM = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, ITEM), (2, "short item here"), (3, None), (4, ""), (10, ITEM), (None, "nameless words"), (2, "other text of two")]


def contaminated_documents():
    return [
        (1, ITEM), (2, ITEM.upper()), (3, " ".join(ITEM.split()[:13])), (4, " ".join(ITEM.split()[:12])), (5, "x " * 500 + ITEM), (6, None), (7, ""),
        (8, "short, item! here"), (9, "short item"), (9, "here short item here short item here"), (10, "nameless words"), (11, "short item"), (12, "here and there"),
        (13, " ".join(f"w{i}" for i in range(5, 19)) + " z " + ITEM + " " + ITEM), (None, "short item here"), (14, "w0 " * 50), (15, "a" * 70_000 + " short item here " + "b " * 9000),
    ]


@pytest.mark.parametrize("block_bytes", [1 << 20, 30])
def test_decontamination_equals_trying_all_places(spark, block_bytes):
    docs = spark.createDataFrame([(*d, "clash") for d in contaminated_documents()], "doc_id long, text string, hits string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = judged(find_benchmark(docs.drop("hits"), bench, block_bytes=block_bytes)).collect()
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in rows)
    expected = sorted((d or 0, *brute.contamination(t, ITEMS)) for d, t in contaminated_documents())
    assert got == expected
    for r in rows:
        w = brute.words(r.text)
        for m in r.matches:
            sources = [brute.words(t) for i, t in ITEMS if ("" if i is None else str(i)) == m.item_id]
            piece = w[m.doc_word : m.doc_word + m.n_words]
            assert any(s[m.item_word : m.item_word + m.n_words] == piece for s in sources)
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, t in contaminated_documents() for n, h, _ in [brute.contamination(t, ITEMS)] if not (h and 20 * h >= n))


def test_decontamination_empty_tables(spark, awkward, nothing):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert find_benchmark(nothing, bench).count() == 0
    assert {r.n_hit for r in judged(find_benchmark(awkward, bench.limit(0))).collect()} == {0}
    assert decontaminate(awkward, bench).count() == len(brute.AWKWARD)


def test_benchmark_longest_matches():
    bench = Benchmark(["a"], [ITEM], 13)
    from vacanta.llm.decontaminate import _matched

    (n, hits, matches), = _matched(pa.array(["x " + ITEM + " y"]), bench)
    assert (n, hits) == (22, [{"start": 1, "end": 21}]) and matches == [{"item_id": "a", "item_word": 0, "doc_word": 1, "n_words": 20}]


def test_elias_fano_successor():
    rng = np.random.default_rng(4)
    for n, universe in ((0, 10), (1, 1), (5, 5), (100, 101), (1000, 10**6), (1000, 2**50), (3000, 4000)):
        values = np.unique(rng.integers(0, universe, n))
        asked = np.concatenate([values, rng.integers(0, universe, 300)])
        coded = EliasFano(values, universe)
        if n:
            assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
        place = {v: i for i, v in enumerate(values.tolist())}
        assert coded.find(asked).tolist() == [place.get(v, -1) for v in asked.tolist()]


def test_quantisation_rounds_down_by_a_step_at_most():
    p = np.concatenate([np.exp2(-np.linspace(0, 60, 5000)), [1.0, 0.96, 0.999999, 1e-300]])
    step = np.log2(p / probability(quantised(p)))
    assert (step >= -1e-9).all() and (step <= 1 / STEPS_PER_OCTAVE + 1e-9).all()


def test_a_context_never_gives_more_than_one():
    rng = np.random.default_rng(1)
    for n in (1, 3, 1000, 10**10):
        counts = rng.multinomial(n, rng.dirichlet(np.ones(50) * 0.2))
        counts = counts[counts > 0]
        given = probability(quantised(counts / (n + MASS))).sum() + MASS / (n + MASS)
        assert 0.957 <= given <= 1 + 1e-9


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_language_model_equals_counting(spark, sf_dir, monkeypatch, shard):
    monkeypatch.setattr("vacanta.llm.language_model.SHARD", shard)
    monkeypatch.setattr("vacanta.llm.language_model.CONTEXT_PART", 7)
    texts = [t for _, t, *_ in brute.AWKWARD] + ["the end of the end", "the end", "unseen words the end"]
    rows = [(i, i % 3 != 2, t, "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, training boolean, text string, score string").repartition(3)
    got = {r.id: r for r in score_texts(docs).collect()}
    for (i, training, _, _), expected in zip(rows, brute.language_model([(r[1], r[2]) for r in rows], MASS, STEPS_PER_OCTAVE), strict=True):
        r = got[i]
        assert r.training == training and (r.n_tokens, r.n_known, r.train_tokens) == expected[:3]
        assert r.base_score == pytest.approx(expected[3], rel=1e-12, abs=1e-9) and r.score == pytest.approx(expected[4], rel=1e-9, abs=1e-9)
        assert r.pair_score == pytest.approx(expected[5], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("shard", [1 << 20, 40])
def test_language_model_third_level_equals_counting(spark, monkeypatch, shard):
    """A context of two words changes the score: pairs are alike in both orders, triples are not."""
    monkeypatch.setattr("vacanta.llm.language_model.SHARD", shard)
    monkeypatch.setattr("vacanta.llm.language_model.CONTEXT_PART", 7)
    texts = ["a b c"] * 9 + ["x b d"] * 9 + ["a b d", "x b c", "a b c", "new b c", "a b new c", "b c", "", None, "a"] + [t for _, t, *_ in brute.AWKWARD]
    rows = [(i, i % 5 != 2, t) for i, t in enumerate(texts)]
    wanted = brute.language_model([(r[1], r[2]) for r in rows], MASS, STEPS_PER_OCTAVE)
    got = {r.id: r.score for r in score_texts(spark.createDataFrame(rows, "doc_id long, training boolean, text string").repartition(3)).collect()}
    for (i, *_), expected in zip(rows, wanted, strict=True):
        assert got[i] == pytest.approx(expected[4], rel=1e-9, abs=1e-9)
    assert got[texts.index("a b d")] < got[texts.index("a b c")] - 0.3 and got[texts.index("x b c")] < got[texts.index("x b d")] - 0.3


def test_language_model_texts_are_not_shuffled(spark, sf_dir):
    """Two rounds in the last job; only answers come to the blocks."""
    plan = QUERIES["op10_lm_score"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 2 and plan.count("Exchange hashpartitioning(block#") == 2


@pytest.mark.parametrize("bits", [0, 3])
def test_language_model_rounds_with_split_contexts(monkeypatch, bits):
    """The rounds in this process: blocks of two partitions, successors of hot words and pairs dealt to several shards."""
    monkeypatch.setattr(language_model, "CONTEXT_PART", 7)
    texts = ["a b c", "a b d", "a b e"] * 30 + ["a b", "b a b a b", "c", "", None, "new b c"] + [t for _, t, *_ in brute.AWKWARD]
    rows = [(i, i % 5 != 2, t) for i, t in enumerate(texts)]
    made = []
    for k in (0, 1):
        monkeypatch.setattr(language_model, "TaskContext", SimpleNamespace(get=lambda k=k: SimpleNamespace(partitionId=lambda: k)))
        part = pa.RecordBatch.from_pylist([dict(zip(("id", "training", "text"), r, strict=True)) for r in rows[k::2]], pa.schema([("id", pa.int64()), ("training", pa.bool_()), ("text", pa.string())]))
        made += [pa.Table.from_batches([b]) for b in language_model._blocks(iter([part]))]
    groups = lambda t, key: [t.filter(pc.equal(t[key], k)) for k in sorted(set(t[key].to_pylist()))]
    level = lambda t, n: t.append_column("level", pa.array([n] * t.num_rows, pa.int64()))
    asked = pa.concat_tables(pa.Table.from_batches(language_model._word_requests(bits)(iter(b.to_batches()))) for b in made)
    words = pa.concat_tables(language_model._word_shard(bits)(g) for g in groups(asked, "shard"))
    total, distinct = (sum(words[c].to_pylist()) for c in ("total", "distinct"))
    told = level(words, 1)
    of = lambda b: told.filter(pc.equal(told["block"], b["block"][0]))
    for n, requests in ((2, language_model._pair_requests), (3, language_model._triple_requests)):
        sent = pa.concat_tables(requests(bits)(b, of(b)) for b in made)
        if bits:
            assert any(sum(unpack(r["totals"], "u8", r["n_contexts"])) for r in sent.to_pylist()) and len(groups(sent, "shard")) > 1
        told = pa.concat_tables([told, *(level(language_model._successor_shard(MASS, n == 2)(g), n) for g in groups(sent, "shard"))])
    got = {r["id"]: r for b in made for r in language_model._scores(bits, total, distinct, MASS)(b, of(b)).to_pylist()}
    for (i, *_), e in zip(rows, brute.language_model([(r[1], r[2]) for r in rows], MASS, STEPS_PER_OCTAVE), strict=True):
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == e[:3]
        assert [got[i][c] for c in ("base_score", "score", "pair_score")] == pytest.approx(e[3:], rel=1e-9, abs=1e-9)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for kind, most in (("u2", 3), ("u2", 65535), ("u4", 70000), ("u8", 2**40), ("u8", 2**64 - 1)):
        for n in (0, 1, 500):
            x = rng.integers(0, most, n, np.dtype(kind), endpoint=True)
            assert unpack(pack(x), kind, n).tolist() == x.tolist()
    tokens = np.array([0, 1, 0, 2, 2, 3, 1])
    assert unpack_tokens(pack_tokens(tokens), 7).tolist() == tokens.tolist()


def test_language_model_without_training_or_rows(spark, awkward, nothing):
    rows = score_texts(awkward.withColumn("training", F.lit(None).cast("boolean"))).collect()
    assert len(rows) == len(brute.AWKWARD) and all(r.base_score == 0 and r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert score_texts(nothing.withColumn("training", F.lit(True))).count() == 0


def test_language_model_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    ids = list(docs)
    expected = brute.language_model([(brute.crc(i) % 7 != 2, docs[i]) for i in ids], MASS, STEPS_PER_OCTAVE)
    got = {r.doc_id: r for r in QUERIES["op10_lm_score"](spark, sf_dir).collect()}
    for i, e in zip(ids, expected, strict=True):
        r = got[i]
        assert r.held_out == (brute.crc(i) % 7 == 2) and (r.n_tokens, r.n_known, r.train_tokens) == e[:3]
        assert r.base_score == pytest.approx(e[3], rel=1e-12) and r.score == pytest.approx(e[4], rel=1e-9) and r.pair_score == pytest.approx(e[5], rel=1e-9)
