import random

import numpy as np

from tidemill.llm.components import components
from tidemill.llm.hashing import Words
from tidemill.llm.near_dup import merged, minima, near_duplicate_groups, near_duplicate_pairs, packed, registers, shingles, similarity, unpacked


def corpus(rng, n):
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randrange(5, 60))
        rows.append((3 * i, " ".join(words)))
        for e in range(rng.randrange(3)):
            w = list(words)
            for _ in range(e):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((3 * i + e + 1, " ".join(w)))
    return rows


def brute(rows, threshold, width):
    sets = [(i, set(shingles(t, width, Words()).tolist())) for i, t in rows if t and t.strip()]
    out = set()
    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if a and b and len(a & b) >= threshold * len(a | b):
                out.add((min(i, j), max(i, j)))
    return out


def test_pairs_equal_brute_force_on_either_path(spark):
    rows = corpus(random.Random(5), 120)
    df = spark.createDataFrame([(i, t, t) for i, t in rows], "id long, text string, key string").repartition(3)
    want = brute(rows, 0.6, 3)
    assert len(want) > 60
    for limit in (500, 2):
        got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, threshold=0.6, width=3, bucket_limit=limit).collect()}
        assert got == want, limit


def test_near_copies_of_one_template(spark):
    """Every pair of 400 near-copies is a pair; their buckets and their runs are far larger than the limit."""
    rows = [(i, " ".join(f"t{k}" for k in range(50)) + f" own{i} x{i % 7}") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = near_duplicate_pairs(df, threshold=0.6, width=3, bucket_limit=50)
    assert got.count() == 400 * 399 // 2 and got.where("id_a >= id_b").count() == 0


def test_no_pair_is_lost_at_the_threshold(spark):
    """1,500 pairs of similarity 0.600 and 0.604: 32 bands would lose about 16 of them, 72 bands 0.05."""
    rows = []
    for i in range(1500):
        n, shared = ((80, 60), (77, 58))[i % 2]
        # runs of three words that are different everywhere: the first ``shared`` runs are common to both
        for e in range(2):
            words = [f"a{i}x{k}" for k in range(shared + 2)] + [f"b{i}x{e}x{k}" for k in range(n - shared)]
            rows.append((2 * i + e, " ".join(words)))
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df, threshold=0.6, width=3).collect()}
    assert got == {(2 * i, 2 * i + 1) for i in range(1500)}


def test_nulls_blanks_copies_and_short_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One!"), (6, "two words"), (7, "two words"), (8, "x " * 9000), (9, "x " * 9000), (10, "?")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {(r.id_a, r.id_b) for r in near_duplicate_pairs(df).collect()}
    assert got == {(4, 5), (6, 7), (8, 9)}
    groups = {r.id: (r.group_id, r.n_links) for r in near_duplicate_groups(df).collect()}
    assert len(groups) == 10 and groups[7] == (6, 0) and groups[5] == (4, 1) and groups[1] == (1, 0)
    assert near_duplicate_pairs(df.where("false")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = pool[:2000], pool[500:2600]
    assert (np.minimum(minima(a[:900]), minima(a[900:])) == minima(a)).all()
    many = np.r_[a[:1], a, b[:3000], a[:7]]
    each = minima(many, np.array([0, 1, 2001, 4101]))
    assert (each == np.vstack([minima(x) for x in (a[:1], a, b, a[:7])])).all()
    s1, s2 = (registers(minima(x)) for x in (a, b))
    parts = [packed(registers(minima(x)))[0] for x in (a[:900], a[900:])]
    assert merged(*parts) == packed(s1)[0] and (unpacked(packed(s1)) == s1).all()
    got = similarity(s1, s2, np.array([2000.0]), np.array([2100.0]))[0]
    assert abs(got - 1500 / 2600) < 0.15


def test_components_of_a_long_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3)]
    got = {r.node: r["class"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and len(got) == 101
