"""The near-duplicate stage: five-word shingles, similarity of 0.8 or more, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from pairforge.llm import ngram_join as N
from pairforge.llm.common import Scratch
from tests.llm.test_dedup_and_mixing import near_texts, simple, union_find


def sets_of(texts, width):
    words = [t.split() for t in texts]
    return [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set() for w in words]


def similar(texts, width, percent):
    s = sets_of(texts, width)
    return [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]


def least_ids(texts):
    component = union_find(len(texts), similar(texts, 5, 80))
    return [i for i, c in enumerate(component) if c == i]


def changed(words, at):
    return " ".join("new" + w if i in at else w for i, w in enumerate(words))


def test_stage_finds_near_copies_between_the_two_rules(spark):
    words = [f"w{i}" for i in range(104)]
    far = [f"v{i}" for i in range(104)]
    texts = [" ".join(words), changed(words, {30, 70}), " ".join(far), changed(far, {20, 50, 80})]
    assert similar(texts, 5, 80) == [(1, 0)] and not similar(texts, 3, 90)
    assert sorted(r.doc_id for r in P.near_duplicates(spark, simple(spark, texts), "").collect()) == [0, 2, 3] == least_ids(texts)


@pytest.mark.parametrize("sizes,vocabulary", [([5, 8, 9, 11, 14, 20, 28], 6), ([30, 44, 60, 110, 150, 330], 400), ([640, 700, 1400], 900), ([5100, 5300, 6500], 3000)])
def test_join_of_five_words_loses_no_link(spark, sizes, vocabulary):
    rng = random.Random(len(sizes))
    texts = near_texts(rng, 12, sizes, 14 if max(sizes) < 5000 else 4, vocabulary)
    got = {r.doc_id: r for r in N.jaccard_join(simple(spark, texts), width=5, percent=80).collect()}
    links = similar(texts, 5, 80)
    assert links
    component, degree = union_find(len(texts), links), [0] * len(texts)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    for i, s in enumerate(sets_of(texts, 5)):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(s), component[i], degree[i])


def test_thresholds_follow_percent():
    assert [N.smallest(p) for p in (80, 90)] == [4, 9]
    assert [N.least_overlap(n, p) for n, p in ((10, 90), (11, 90), (5, 80), (6, 80))] == [9, 10, 4, 5]
    assert N.levels(20, 90)[1] == (20, 16) and N.levels(40, 80)[1:3] == [(40, 32), (640, 192)]


def test_a_dropped_row_does_not_take_another_of_its_id(spark):
    words, other = [f"w{i}" for i in range(60)], [f"v{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words) + " end", " ".join(other)]
    out = P.near_duplicates(spark, simple(spark, texts, [1, 2, 2]), "").select("doc_id", "text").collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, texts[0]), (2, texts[2])]


def test_bitmaps_lose_no_link_and_tell_most_others_apart():
    rng = random.Random(4)
    texts = near_texts(rng, 25, [6, 12, 30, 90, 300], 8, 300)
    for width, percent in ((3, 90), (5, 80)):
        shingles = N.Shingler(width)
        sets = [shingles(t.encode()) for t in texts]
        may = N.may_link([N.bitmap(s) for s in sets], np.array(list(map(len, sets))), percent)
        links = similar(texts, width, percent)
        assert links and all(may[i, j] and may[j, i] for i, j in links)
        assert may.sum() / 2 < 2 * len(links) + 20


@pytest.mark.parametrize("group", [256, 3])
def test_links_are_found_when_every_cluster_counts_as_wide(spark, monkeypatch, group):
    monkeypatch.setattr(N, "WIDE", 0)
    monkeypatch.setattr(N, "GROUP", group)
    rng = random.Random(group)
    texts = near_texts(rng, 10, [9, 14, 60, 150], 12, 300)
    got = {r.doc_id: r for r in N.jaccard_join(simple(spark, texts), width=5, percent=80).collect()}
    links = similar(texts, 5, 80)
    component, degree = union_find(len(texts), links), [0] * len(texts)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    assert links and all((got[i].component_id, got[i].n_links) == (component[i], degree[i]) for i in range(len(texts)))


def test_a_chain_of_weak_edges_is_not_compared_in_full(spark):
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(40)) for _ in range(600)]
    texts[1] = texts[0] + " end"
    shingles = N.Shingler(3)
    sets = [shingles(t.encode()) for t in texts]
    maps = spark.createDataFrame([(i, len(s), bytearray(N.bitmap(s))) for i, s in enumerate(sets)], "rid long, n long, map binary")
    # Each set shares a subset with the next one, so star edges would chain all 600 into one cluster.
    keys = spark.createDataFrame([(k, r) for k in range(599) for r in (k, k + 1)], "key long, rid long")
    edges = N.narrowed(keys, maps, 90, Scratch(spark, "t")).collect()
    clusters = Counter(union_find(600, [(r.u, r.v) for r in edges]))
    assert (1, 0) in {(r.u, r.v) for r in edges}
    assert sum(c * (c - 1) // 2 for c in clusters.values()) < 10 < 600 * 599 // 2


def test_bitmaps_are_compared_in_slices(monkeypatch):
    import numpy as np

    from pairforge.llm import ngram_join as N

    rng = np.random.default_rng(6)
    pool = rng.integers(0, 2**63, 4000, np.int64).astype(np.uint64)
    sets = [pool[:n] for n in (10, 40, 75, 80, 300, 310, 2000, 2100, 3900, 4000)] + [pool[1000:3000], pool[5:85]]
    maps, n = [N.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    whole = N.may_link(maps, n, 90)
    monkeypatch.setattr(N, "SLICE", 64)
    assert (N.may_link(maps, n, 90) == whole).all() and whole.any()
    exact = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b))
    assert all(whole[i, j] for i in range(len(sets)) for j in range(len(sets)) if i != j and exact(sets[i], sets[j]))
