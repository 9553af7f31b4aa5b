"""Similarity join, line and exact deduplication, mixing and the pipeline against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from pairforge.llm import line_dedup as L
from pairforge.llm import ngram_join as N
from pairforge.llm.common import Scratch, located, lookup
from pairforge.llm.components import components
from pairforge.llm.exact_dedup import exact_dedup
from pairforge.llm.line_dedup import line_dedup
from pairforge.llm.mixing import WEIGHTS, mix, mixed

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def simple(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return docs(spark, [(i, t, "en", "s", 0) for i, t in zip(ids, texts, strict=True)])


def union_find(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_exact_dedup_goes_on_after_two_of_four_batches(spark, tmp_path, monkeypatch):
    from pairforge.llm import exact_dedup as E

    rng = random.Random(12)
    rows = [(i, rng.choice(["a b", "a  b", "c", None, "", f"own {i}"])) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    want = sorted(map(tuple, exact_dedup(docs).collect()))
    real, done = E.fetch, []

    def failing(found, places):
        if len(done) == 2:
            raise RuntimeError("stopped")
        done.append(1)
        return real(found, places)

    monkeypatch.setattr(E, "fetch", failing)
    with pytest.raises(Exception, match="stopped"):
        exact_dedup(docs, deliveries=4, folder=f"file://{tmp_path}/run")
    calls = []
    monkeypatch.setattr(E, "fetch", lambda found, places: calls.append(1) or real(found, places))
    assert sorted(map(tuple, exact_dedup(docs, deliveries=4, folder=f"file://{tmp_path}/run").collect())) == want
    assert len(calls) == 2  # the batches that were left
    with pytest.raises(ValueError, match="plain scan"):
        exact_dedup(docs.distinct(), folder=f"file://{tmp_path}/other")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500 + i) for i in range(100)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "x").collect()}
    want = union_find(601, edges)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: want[x] for x in nodes}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "t"), "x").count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(words, words[1:], words[2:], strict=False))


def brute_join(texts):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    degree = [0] * len(sets)
    for i, j in links:
        degree[i] += 1
        degree[j] += 1
    return [len(s) for s in sets], union_find(len(sets), links), degree


def edited(rng, words, share):
    return [rng.choice(["zz", "qq", "xx"]) + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


def near_texts(rng, groups, sizes, copies, vocabulary=400):
    out = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, vocabulary)}" for _ in range(rng.choice(sizes))]
        out += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.06]))) for _ in range(rng.randint(1, copies))]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sizes,vocabulary", [([9, 11, 12, 14, 20, 25], 6), ([30, 60, 110, 150, 330], 400), ([700, 1400], 900)])
def test_join_loses_no_link(spark, sizes, vocabulary):
    rng = random.Random(len(sizes))
    texts = near_texts(rng, 12, sizes, 14, vocabulary)
    got = {r.doc_id: r for r in N.jaccard_join(simple(spark, texts)).collect()}
    n, component, degree = brute_join(texts)
    assert any(c != i for i, c in enumerate(component))
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (n[i], component[i], degree[i])


def test_join_of_many_blocks_and_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_SETS", 4)
    monkeypatch.setattr(N, "GATHER", 3000)
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    texts = near_texts(rng, 3, [150], 40) + [" ".join(passage + [f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(3, 90))]) for _ in range(60)]
    got = {r.doc_id: r for r in N.jaccard_join(simple(spark, texts)).collect()}
    n, component, degree = brute_join(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (n[i], component[i], degree[i])


def test_join_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(5, "A b"), (3, "a  B"), (4, None), (6, ""), (7, " \n"), (None, "x y z w"), (9, "x y z w"), (9, "x y z w"), (10, long), (11, long + " tail"), (12, "é"), (13, "É")]
    df = docs(spark, [(i, t, 1, 2, "c", "d") for i, t in rows], "doc_id long, text string, n long, rid long, digest string, n_links string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in N.jaccard_join(df).collect()), key=str)
    want = [(5, 1, 3), (3, 1, 3), (4, 0, 4), (6, 0, 6), (7, 0, 7), (None, 2, 9), (9, 2, 9), (9, 2, 9), (10, 19998, 10), (11, 19999, 10), (12, 1, 12), (13, 1, 13)]
    assert got == sorted(want, key=str)
    assert N.jaccard_join(df.limit(0)).count() == 0


def brute_lines(rows, least=50):
    """rows: (order, text); which lines go."""
    seq = []
    for d, (_, text) in enumerate(rows):
        for i, line in enumerate((text or "").split("\n")):
            words = re.findall(r"[^\x20\x09-\x0D]+", line)
            if words:
                seq.append((d, i, tuple(words)))
    gone = set()
    for p in range(len(seq)):
        for q in range(p):
            k = total = 0
            while p + k < len(seq) and seq[p + k][0] == seq[p][0] and q + k < len(seq) and seq[q + k][0] == seq[q][0] and seq[p + k][2] == seq[q + k][2]:
                total += len(seq[p + k][2])
                k += 1
            if total >= least:
                gone |= {(seq[p + j][0], seq[p + j][1]) for j in range(k)}
    out = []
    for d, (_, text) in enumerate(rows):
        kept, off = [], False
        for i, line in enumerate((text or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                off = (d, i) in gone
            if not off:
                kept.append(line)
        out.append((None if text is None else "\n".join(kept), sum(x == d for x, _ in gone)))
    return out


@pytest.mark.parametrize("least", [7, 50])
def test_lines_against_brute_force(spark, least):
    rng = random.Random(least)
    pool = [" ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.choice([1, 2, 5, 13, 55]))) for _ in range(12)] + ["", "  "]
    texts = []
    for _ in range(30):
        lines = [rng.choice(pool) for _ in range(rng.randint(1, 14))]
        texts.append("\n".join(lines))
    texts += [texts[0], texts[0].replace(" ", " \t "), None, "", "\n\n", ("a b c\n" * 60).strip()]
    got = {r.doc_id: (r.clean_text, r.gone_lines) for r in line_dedup(simple(spark, texts), least).collect()}
    for i, want in enumerate(brute_lines(list(enumerate(texts)), least)):
        assert got[i] == want, (i, texts[i])


def test_lines_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(51))
    long = "\n".join(f"line {i} of a long text" for i in range(20_000))
    rows = [(2, passage), (1, "start\n" + passage + "\nend"), (None, passage), (3, long), (4, long + "\n" + passage)]
    df = docs(spark, [(i, t, "x", 5, 6, 7) for i, t in rows], "doc_id long, text string, gone string, row_at long, at long, rank long")
    out = line_dedup(df)
    assert out.columns == [*df.columns, "clean_text", "gone_lines", "gone_words"]
    got = {r.doc_id: r for r in out.collect()}
    assert {(r.gone, r.row_at, r.at, r.rank) for r in got.values()} == {("x", 5, 6, 7)}
    assert got[1].clean_text == rows[1][1] and got[2].clean_text == "" and got[None].clean_text == "" and got[3].clean_text == long and got[4].clean_text == ""
    assert (got[2].gone_lines, got[2].gone_words, got[2].at) == (1, 51, 6)
    same = docs(spark, [(1, passage, "en", "s", 0)] * 3)
    assert sorted(r.clean_text for r in line_dedup(same).collect()) == ["", "", passage]
    assert line_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_order_and_common_prefixes(spark, seed, monkeypatch):
    monkeypatch.setattr(L, "PARTS", 5)
    monkeypatch.setattr(L, "CELLS", 3)
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice("ab" if seed == 1 else "abcd") * (1 if rng.random() < 0.9 else 2) for _ in range(rng.randint(1, 25))) for _ in range(25)]
    texts += [texts[3], texts[3], texts[4] + "\nonce\n" + texts[5], "\n".join("a" * 40)]
    scratch = Scratch(spark, "t")
    rows = located(simple(spark, texts), scratch).select("row_file", "row_at", "row.doc_id", "row.text")
    lines, span = L.placed_lines(rows, scratch, 5)
    table = {(r.doc_id, r["at"]): r for r in lines.collect()}
    shared = lines.filter("line_rank is not null").select("row_file", "row_at", "doc_id", "at", "left", "lo", "hi", F.col("line_rank").alias("rank"))
    suffixes, begun = L.suffix_array(shared, span, scratch)
    found = suffixes.collect()
    text = {(r.doc_id, r["at"]): tuple(table[r.doc_id, r["at"] + j].line_rank for j in range(r.left)) for r in found}
    assert len(text) == span == sum(r.line_rank is not None for r in table.values())
    for r in found:
        own = text[r.doc_id, r["at"]]
        assert r["rank"] == sum(t < own for t in text.values())
        nxt = table.get((r.doc_id, r["at"] + r.left))
        assert nxt is None or nxt.line_rank is None
    classes = L.classes_of(suffixes)
    got = L.common_prefixes(classes, begun, lines, span, scratch, all_of_them=True).orderBy("rank").collect()
    before = ()
    for r in got:
        own = text[r.place.doc_id, r.place["at"]]
        same = next((i for i, (x, y) in enumerate(zip(own, before, strict=False)) if x != y), min(len(own), len(before)))
        assert r.lcp == same, (own, before)
        before = own


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), t in zip(rows, norm, strict=True):
        ids = [j for (j, _), u in zip(rows, norm, strict=True) if u == t]
        known = [j for j in ids if j is not None]
        out.append((i, min(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("chars,deliveries", [(64, 1), (64, 3), (1, 1), (1, 4)])
def test_exact_dedup(spark, chars, deliveries):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 5)))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\t"), (103, " "), (None, "unique"), (None, "a b"), (104, "x" * 300_000), (105, "x" * 300_000), (106, "a b"), (7, "twice"), (7, "twice")]
    df = docs(spark, [(*r, "clash", 1) for r in rows], "doc_id long, text string, digest string, self long").repartition(5)
    got = exact_dedup(df, chars, deliveries).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(brute_exact(rows), key=str)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_sha256, []).append(r)
    for group in by_text.values():
        kept = [r for r in group if r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id
    assert exact_dedup(df.limit(0)).count() == 0


def brute_targets(sizes):
    """By source (None last): the contract's shares, capped and reshared."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("shape", ["even", "hot", "tiny"])
def test_mixing(spark, shape):
    rng = random.Random(shape)
    names = ["b", "a", "é", "Z", None, "c"]
    heavy = {"even": [1] * 6, "hot": [1, 60, 1, 1, 1, 1], "tiny": [0.05, 1, 1, 0.05, 0.05, 1]}[shape]
    rows = [(i, " ".join("w" for _ in range(rng.randint(1, 30))), "en", rng.choices(names, heavy)[0], 0) for i in range(600)]
    rows += [(1000, None, None, "a", None), (1001, "", None, "b", None), (None, "w w w", None, "c", None), (3, rows[3][1], "en", rows[3][3], 0), (1002, "only", None, "solo", None)]
    df = docs(spark, rows)
    got = mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        assert r.size == len((r.text or "").split())
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    targets = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(targets[s])
        taken = sum(r.size * r.copies for r in own)
        assert abs(taken - targets[s]) <= max(r.size for r in own)
        epochs = int(targets[s] // sizes[s]) if sizes[s] else 0
        assert {r.copies for r in own} <= {min(3, epochs), min(3, epochs + 1)}
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(df.repartition(7)).collect()), key=str)
    assert mix(df.limit(0)).count() == 0


def test_quality_weights_raise_the_chance(spark):
    rows = [(i, "w " * 25 + ("." if i % 2 else ""), "en", "big" if i < 2000 else "small", 0) for i in range(2010)]
    got = mix(docs(spark, rows)).filter("source = 'big'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg("copies").alias("c")).collect()
    share = {r.good: r.c for r in got}
    assert share[1] >= share[0]


def test_mixed_keeps_columns(spark):
    df = docs(spark, [(i, "w w", "x", "s", 7) for i in range(20)], "doc_id long, text string, size string, source string, target long")
    out = mixed(df)
    assert out.columns == df.columns and {(r.size, r.target) for r in out.collect()} == {("x", 7)}


def test_lookup_splits_hot_keys(spark, monkeypatch):
    import pairforge.llm.common as common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 3)
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 200}") for i in range(400)], "id long, key string")
    right = left.groupBy("key").agg(F.count("*").alias("size"))
    got = lookup(left, right, "key", "size")
    assert got.count() == 400 and got.filter("key = 'hot'").select("size").distinct().collect()[0][0] == 200
    some = lookup(left, right.filter("key <> 'k0'"), "key", "size", "left")
    assert some.count() == 400 and some.filter("size is null").count() == 2


def test_rows_are_located(spark, tmp_path):
    df = simple(spark, [str(i) for i in range(50)]).repartition(3)
    df.write.parquet(str(tmp_path / "t"))
    rows = located(spark.read.parquet(str(tmp_path / "t")), Scratch(spark, "t"))
    assert sorted(rows.collect()) == sorted(rows.collect())
    assert located(df, Scratch(spark, "t")).select("row_file", "row_at").distinct().count() == 50
    # Rows that come twice after the scan have two places.
    twice = spark.read.parquet(str(tmp_path / "t")).withColumn("again", F.explode(F.array(F.lit(1), F.lit(2))))
    assert located(twice, Scratch(spark, "t")).select("row_file", "row_at").distinct().count() == 100


INNER = ["row_file", "row_at", "gone", "part", "cut", "epochs", "_text", "_gone", "_id", "_first", "_size", "_key", "_source", "row", "own", "stays", "Copies", "rank", "_metadata", "a.b", "clean_text", "size"]


def test_columns_named_like_inner_ones_come_back(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(12)
    base = simple(spark, [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(60)) for _ in range(6)])
    df = base.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in INNER])
    path = str(tmp_path / "t")
    df.write.parquet(path)
    stored = spark.read.parquet(path)
    for stage, rows in ((P.quality_rules, stored), (P.line_deduplication, stored), (P.near_duplicates, stored), (P.near_duplicates, df), (P.mixing, stored)):
        out = stage(spark, rows, "")
        assert out.columns == df.columns, stage
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in INNER), stage
    out = line_dedup(df)
    assert out.columns == [c for c in df.columns if c != "clean_text"] + ["clean_text", "gone_lines", "gone_words"]
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in INNER if c != "clean_text")
    out = mix(stored)
    assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in INNER if c not in ("size", "Copies"))


def test_pipeline_against_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rng = random.Random(6)
    syllables = [c + v + e for c in "bcdfglmnprst" for v in "aeiou" for e in ("", "n", "r")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    prose = lambda n: "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(n))
    passage = " ".join(word() for _ in range(60))
    clean = [prose(rng.randint(5, 12)) for _ in range(40)]
    texts = clean + [clean[0], clean[1] + " more", "too short", "again and again " * 60, None]
    texts += [clean[2] + "\n" + passage + "\n" + prose(6), passage + "\n" + prose(7)]
    rows = [(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    (tmp_path / "sf").mkdir()
    docs(spark, rows).coalesce(1).write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    df = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    scratch = Scratch(spark, "t")
    one = scratch.write(P.quality_rules(spark, df, ""), "1")
    assert {r.doc_id for r in one.collect()} == set(range(40)) | {40, 41, 45, 46}
    two = scratch.write(P.line_deduplication(spark, one, ""), "2")
    kept = [(i, texts[i]) for i in sorted(r.doc_id for r in one.collect())]
    want = {i: t for (i, _), (t, _) in zip(kept, brute_lines(kept), strict=True) if t.strip()}
    got = {r.doc_id: r for r in two.collect()}
    assert {i: r.text for i, r in got.items()} == want and 40 not in got
    assert all(r.n_chars == len(r.text) for r in got.values()) and two.columns == df.columns
    assert all(got[i].text == clean[i] for i in range(40))
    three = scratch.write(P.near_duplicates(spark, two, ""), "3")
    ids = sorted(got)
    component = brute_join([got[i].text for i in ids])[1]
    assert sorted(r.doc_id for r in three.collect()) == [i for k, i in enumerate(ids) if component[k] == k]
    four = scratch.write(P.mixing(spark, three, ""), "4")
    assert four.columns == df.columns and {r.doc_id for r in four.collect()} <= {r.doc_id for r in three.collect()}
    out = P.run(spark, str(tmp_path / "sf"))
    assert out.count() == four.count()
    text = {r.doc_id: r.text for r in four.collect()}
    for r in out.collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() and len(r.token_ids) == 4 * r.n_tokens


def test_near_duplicates_of_repeated_and_null_rows(spark):
    import corpus_pipeline as P

    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (2, text, "en", "s", 1), (None, text, "en", "s", 1), (None, None, None, None, None), (3, "", "en", "s", 0)]
    out = P.near_duplicates(spark, docs(spark, rows), "")
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]


def test_rows_without_a_weight_come_last(spark):
    """a gives the target of a third of all words; its weightless rows are taken after all others."""
    odd = [0.0, -1.0, None, float("nan")]
    rows = [(i, "ab"[i % 2], "one two three four", odd[i // 2 % 4] if i % 8 < 4 else 1.0 + i % 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, w double")
    got = mix(docs, weight=F.col("w")).filter("source = 'a'").collect()
    assert sum(r["copies"] for r in got) == sum(r["copies"] > 0 for r in got) == round(got[0].target / 4)
    live, dead = ([r["copies"] for r in got if (r.w is not None and r.w > 0 and r.w == r.w) == is_live] for is_live in (True, False))
    assert len(live) == len(dead) == 100 and min(live) == 1 and 0 < sum(dead) < 100
    assert [r["copies"] for r in sorted(got, key=lambda r: r.doc_id) if not (r.w is not None and r.w > 0 and r.w == r.w)] == [1] * sum(dead) + [0] * (100 - sum(dead))
    ints = mix(docs.withColumn("w", F.lit(0)), weight=F.col("w"))
    assert ints.filter("copies > 0").count() > 0
