"""Components, near-duplicate documents and embeddings."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacanta.llm import minhash
from vacanta.llm.batches import table
from vacanta.llm.components import components
from vacanta.llm.forest import near_embeddings
from vacanta.llm.queries import QUERIES
from vacanta.sources.staging import stage


@pytest.mark.parametrize(("n", "m"), [(1, 0), (40, 25), (200, 190)])
def test_components(spark, n, m):
    rng = random.Random(n)
    links = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(500 + i, 501 + i) for i in range(m)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == brute.unite(linked, [x for x in links if x[0] != x[1]])


def documents(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in texts], "doc_id long, text string")


def groups(df):
    return {r.id: r.group_id for r in minhash.near_duplicates(df).collect()}


def prose(rng, n):
    return [f"word{rng.randrange(5000)}" for _ in range(n)]


def test_near_copies_and_clean_documents(spark):
    rng = random.Random(5)
    texts, group = [], {}
    common = prose(rng, 60)
    for g in range(30):
        base = prose(rng, 120 + 10 * g)
        if g % 3 == 0:  # a passage that many documents share
            base = base[:40] + common + base[40:]
        for k in range(1 + g % 5):
            own = list(base)
            for _ in range(k and 1 + len(base) // 200):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(10**6)}"
            i = len(texts)
            texts.append((i, " ".join(own)))
            group[i] = g
    found = groups(documents(spark, texts))
    sets = {i: brute.shingles(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and group[a] == group[b] and brute.jaccard(sets[a], sets[b]) >= 0.8]
    assert found == brute.unite(sets, links)


def test_large_group_of_near_copies_is_one_group(spark):
    rng = random.Random(6)
    base = prose(rng, 200)
    texts = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(200)] = f"edit{i}"
        texts.append((i, " ".join(own)))
    texts += [(1000 + i, " ".join(prose(rng, 200))) for i in range(20)]
    found = groups(documents(spark, texts))
    assert {found[i] for i in range(400)} == {0} and all(found[1000 + i] == 1000 + i for i in range(20))


def test_links_beyond_the_first_leader(spark):
    """A chain whose neighbours are alike and whose ends are not stays one group."""
    rng = random.Random(7)
    words = prose(rng, 300)
    texts = []
    for i in range(12):
        texts.append((i, " ".join(words)))
        words = list(words)
        words[10 + 20 * i : 14 + 20 * i] = prose(rng, 4)
    sets = [brute.shingles(t) for _, t in texts]
    assert brute.jaccard(sets[0], sets[1]) > 0.85 and brute.jaccard(sets[0], sets[11]) < 0.6
    assert set(groups(documents(spark, texts)).values()) == {0}


def test_bucket_rounds_lose_no_link(spark):
    """Members of one bucket that form several groups: all links inside the bucket are found."""
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = prose(rng, 100)
        for _ in range(rng.randrange(1, 5)):
            own = list(base)
            own[rng.randrange(100)] = f"edit{rng.randrange(10**6)}"
            texts.append((len(texts), " ".join(own)))
    df = documents(spark, texts)
    idf = spark.sparkContext.broadcast(minhash.idf_table(df, "text"))
    sets = minhash.weighted_sets(df, idf, "doc_id", "text")
    members = df.select(F.lit(1).cast("long").alias("bucket"), F.col("doc_id").alias("id"), F.lit(100).cast("long").alias("size"))
    links = [(r.a, r.b) for r in minhash.bucket_links(members, sets, idf).collect()]
    plain = {i: brute.shingles(t) for i, t in texts}
    expected = [(a, b) for a in plain for b in plain if a < b and brute.jaccard(plain[a], plain[b]) >= 0.8]
    assert brute.unite(plain, links) == brute.unite(plain, expected)


def test_a_large_group_below_the_threshold_makes_few_rows(spark, monkeypatch):
    """Copies edited at random, most pairs near 0.7, in several chunks: all groups right, rows follow the members."""
    monkeypatch.setattr(minhash, "CHUNK", 64)
    rng = random.Random(12)
    base, texts = prose(rng, 150), []
    for i in range(500):
        own = list(base)
        for _ in range(rng.randrange(1, 7)):
            own[rng.randrange(150)] = f"edit{rng.randrange(10**6)}"
        texts.append((i, " ".join(own)))
    made = []
    for name in ("with_leaders", "among_members"):
        monkeypatch.setattr(minhash, name, lambda *a, f=getattr(minhash, name): made.append(stage(f(*a), "made")) or made[-1])
    df = documents(spark, texts)
    found = groups(df)
    ids, counts, cut, _ = minhash.shingles(pa.array([t for _, t in texts]))
    sets = [(ids[a:b], counts[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    alike = minhash.similarities(sets, sets, minhash.idf_table(df, "text"))
    assert 0.6 < np.median(alike) < 0.8
    wanted = brute.unite(range(500), [(a, b) for a, b in zip(*np.nonzero(alike >= 0.8), strict=True) if a < b])
    # A pair may miss all bands with a probability of 0.04 % at most; here nearly all have other ways.
    assert sum(found[i] != wanted[i] for i in wanted) <= 2
    assert 40 < len(set(wanted.values())) and made[0].count() <= minhash.BANDS * 500 and made[1].count() <= 9 * minhash.BANDS * 500


@pytest.mark.parametrize("seed", range(4))
def test_matrix_similarities_equal_plain_sums(seed):
    rng = np.random.default_rng(seed)
    idf = rng.uniform(0.9, 1, 1 << minhash.IDF_BITS).astype(np.float32)
    pool = np.sort(rng.choice(2**32, 80, replace=False)).astype(np.uint32)

    def some(n):
        out = []
        for _ in range(n):
            own = np.sort(rng.choice(pool, rng.integers(1, 60), replace=False))
            out.append((own, np.where(rng.random(len(own)) < 0.7, 1, rng.integers(1, 400, len(own)))))
        return out

    def plain(a, b):
        weight = lambda x: {int(i): (1 + np.log(c)) * float(idf[i >> np.uint32(32 - minhash.IDF_BITS)]) for i, c in zip(*x, strict=True)}
        p, q = weight(a), weight(b)
        common = sum(min(p[i], q[i]) for i in p.keys() & q.keys())
        return common / (sum(p.values()) + sum(q.values()) - common)

    left, right = some(7), some(5)
    assert np.allclose(minhash.similarities(left, right, idf), [[plain(a, b) for b in right] for a in left], atol=1e-12)
    assert np.allclose(minhash.similarities(left, left, idf), [[plain(a, b) for b in left] for a in left], atol=1e-12)


def test_unlike_texts_of_one_id_all_stay(spark):
    rng = random.Random(13)
    a, b, c = (" ".join(prose(rng, 80)) for _ in range(3))
    rows = [(1, a), (1, b), (1, a + " more"), (2, b), (3, c), (None, a), (0, c + " x")]
    for some in (rows, rows[::-1]):
        kept = minhash.without_near_duplicates(documents(spark, some).selectExpr("*", "'x' AS row", "2 AS c0").repartition(3))
        assert kept.columns == ["doc_id", "text", "row", "c0"]
        assert sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in kept.collect())) == sorted([(False, 1, min(a, a + " more", key=brute.sha)), (False, 1, b), (False, 0, c + " x"), (True, 0, a)])


def test_counts_of_long_repetitive_texts_are_whole(spark):
    """About 0.81 with true counts and 0.77 with counts cut to 255; about 0.74 with true counts and 1 with cut ones."""
    rng = random.Random(10)
    block, other = prose(rng, 50), prose(rng, 50)
    texts = [(i, " ".join(block * 2000 + [f"own{i}x{k}" for k in range(50)])) for i in range(2)]
    texts += [(2, " ".join(other * 300)), (3, " ".join(other * 3000))]
    texts += [(4 + i, " ".join(prose(rng, 50))) for i in range(60)]
    df = documents(spark, texts)
    idf = spark.sparkContext.broadcast(minhash.idf_table(df, "text"))
    members = spark.createDataFrame([(1, 0, 100), (1, 1, 100), (2, 2, 100), (2, 3, 100)], "bucket long, id long, size long")
    found = {r.id: r.similarity for r in minhash.with_leaders(members, minhash.weighted_sets(df, idf, "doc_id", "text"), idf).collect()}
    assert 0.80 < found[1] < 0.82 and 0.73 < found[3] < 0.76
    expected = {i: i for i in range(64)} | {1: 0}
    assert groups(df) == expected


def test_sampling_agrees_with_weighted_similarity():
    rng = np.random.default_rng(9)
    ids = np.sort(rng.choice(2**32, 300, replace=False)).astype(np.uint32)
    a, b = np.arange(0, 250), np.arange(50, 300)
    w = rng.uniform(0.9, 3.0, 300).astype(np.float32)
    agree = []
    for salt in range(40):
        moved = ids ^ np.uint32(salt * 7919)
        both = np.concatenate([moved[a], moved[b]])
        drawn = minhash.draw_samples(both, np.log(np.concatenate([w[a], w[b]])), np.array([0, 250]))
        agree.append((drawn[:, 0] == drawn[:, 1]).mean())
    expected = w[50:250].sum() / w.sum()
    assert abs(np.mean(agree) - expected) < 0.03


def test_minhash_awkward_rows(spark, awkward, nothing):
    rows = minhash.near_duplicates(awkward).collect()
    found = {r.id: (r.group_id, r.kept) for r in rows}
    assert len(rows) == len({r[0] for r in brute.AWKWARD})
    assert found[1] == (1, True) and found[2] == (1, False) and found[7][0] == 1 and found[11] == (10, False)
    assert all(found[i] == (i, True) for i in (3, 4, 5, 6, 8, 9, 10, 12, 13)) and found[None] == (None, True)
    kept = minhash.without_near_duplicates(awkward.withColumn("id", F.lit("clash")).withColumn("group_id", F.lit("clash")))
    assert kept.columns == [*awkward.columns, "id", "group_id"]
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 4, 5, 6, 8, 9, 10, 12, 13] and ids.count(None) == 2
    assert minhash.near_duplicates(nothing).count() == 0 and minhash.without_near_duplicates(nothing).count() == 0


def test_minhash_query_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    sets = {i: brute.shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and not sets[a].isdisjoint(sets[b]) and brute.jaccard(sets[a], sets[b]) >= 0.8]
    got = {r.doc_id: r.group_id for r in QUERIES["op9_minhash"](spark, sf_dir).collect()}
    assert got == brute.unite(sets, links)


def exact(vectors, least=0.9):
    ids = list(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)]
    return dict(zip(ids, near.sum(axis=1).tolist(), strict=True)), brute.unite(ids, links)


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 5, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, dim))
    x[: n // 10] = x[0]  # a common vector
    return {i: [float(np.float32(v)) for v in row] for i, row in enumerate(x)}


def test_forest_recall_and_links(spark):
    vectors = clustered(3000, 24, 1)
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int")
    got = {r.id: r for r in near_embeddings(df, leaf=100).collect()}
    counts, component = exact(vectors)
    assert all(got[i].n_links <= counts[i] for i in counts)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(counts.values())
    assert sum(got[i].component == component[i] for i in component) >= 0.97 * len(component)
    assert all(r.kept == (r.component == i) for i, r in got.items())


def test_large_groups_of_distinct_near_copies_have_all_links(spark):
    """A tight group of 12,000, one whose vectors are only partly linked, copies, and vectors around them."""
    rng = np.random.default_rng(3)
    dim = 24
    centre = rng.normal(size=(40, dim))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    size, spread = [12_000, 4000, *[20] * 38], [0.02, 0.068, *[0.05] * 38]
    x = np.concatenate([c + s * rng.normal(size=(n, dim)) for c, n, s in zip(centre, size, spread, strict=True)])
    x = np.concatenate([x, x[:500], x[12_000:12_100], centre[:1] + 0.1 * rng.normal(size=(1000, dim))]).astype(np.float32)
    x = x[rng.permutation(len(x))]
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    counts = np.concatenate([(unit[a : a + 500] @ unit.T >= 0.9).sum(axis=1) - 1 for a in range(0, len(x), 500)])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>")
    got = {r.id: r for r in near_embeddings(df).collect()}
    found = np.array([got[i].n_links for i in range(len(x))])
    hot = counts >= 1000
    assert hot.sum() > 14_000 and (found[hot] == counts[hot]).all() and (found <= counts).all()
    assert found.sum() >= 0.999 * counts.sum() and len({got[i].component for i in np.flatnonzero(counts >= 10_000)}) == 1


def test_forest_query_recall(spark, sf_dir):
    vectors = {r.vec_id: r.embedding for r in table(spark, sf_dir, "embeddings").collect()}
    counts, component = exact(vectors)
    got = {r.vec_id: r for r in QUERIES["op2_embedding_dedup"](spark, sf_dir).collect()}
    assert {i: r.n_links for i, r in got.items()} == counts and {i: r.component_id for i, r in got.items()} == component


def test_forest_awkward_rows(spark):
    one, nan, inf = [1.0, 0.0, 0.0], float("nan"), float("inf")
    rows = [
        (1, one), (1, one), (2, [2.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]),
        (9, [1.0, 0.0]), (None, one), (10, [-1.0, 0.0, 0.0]), (11, [1e30, 0.0, 1e28]), (12, [3.0, 0.0]), (13, one),
    ]
    out = near_embeddings(spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, component int")).collect()
    got = {r.id: (r.n_links, r.component, r.kept) for r in out}
    assert len(out) == len(got) == 14
    assert {i: got[i] for i in (1, 2, 11, 13)} == {1: (3, 1, True), 2: (3, 1, False), 11: (3, 1, False), 13: (3, 1, False)}
    assert got[9] == (1, 9, True) and got[12] == (1, 9, False) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 10))
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
