"""The passes over documents of the alignment: which columns they read, and how texts are cut and handed on."""

import numpy as np
import pyarrow as pa

from pairforge.llm import token_align
from pairforge.llm.token_align import SUMS, Splitter, align, edged, edged_ones, packed, runs, stretched, unpacked
from tests.llm.test_token_align import ODD, A, B, by_id, direct, found


def test_counts_are_added_up_without_the_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("pairforge.llm.token_align.BLOCK_BYTES", 100)
    texts = [*ODD, "some plain words", "some more words", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/docs")
    made = align(spark.read.parquet(f"{tmp_path}/docs"), A, B)
    assert "text" not in made._jdf.queryExecution().optimizedPlan().toString().split("Relation")[-1]
    assert by_id(found(made)) == by_id([(i, *r) for i, r in enumerate(direct(texts))])
    assert made.columns == ["doc_id", *SUMS, "groups_sha256"]


def test_stretches_of_many_texts_are_those_of_each():
    texts = [*ODD, "one two", "a b  c", " ", "", None, "three"]
    for some in (texts, texts[5:], ["plain only", "one"], [None, ""], []):
        said, of, sizes = stretched(pa.array(some, pa.string()), Splitter())
        want = [Splitter()(t) if t else [] for t in some]
        assert sizes.tolist() == [len(w) for w in want]
        assert said.take(pa.array(of, pa.int64())).to_pylist() == [s for w in want for s in w]


def test_white_space_at_edges_is_that_of_python():
    parts = [p for t in ODD if t for p in t.split(" ")] + [c + "x" + d for c in "\x1c\x85 a日" for d in "\x1f　b本"]
    assert edged_ones(pa.array(parts, pa.string())).tolist() == [not p or edged(p) for p in parts]
    assert edged_ones(pa.array(parts, pa.large_string())[3:]).tolist() == [not p or edged(p) for p in parts[3:]]


def test_rows_go_on_by_block_and_bytes(monkeypatch):
    monkeypatch.setattr(token_align, "CUT_BYTES", 10)
    rows = [(1, "abc"), (1, None), (1, "x" * 30), (1, "d"), (2, "e"), (2, ""), (1, "f")]
    batch = pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.string())], ["block", "text"])
    parts = [(block, part.column(1).to_pylist()) for block, part in runs(iter([batch, batch.slice(0, 0)]))]
    assert [(b, t) for b, ts in parts for t in ts] == rows
    assert [b for b, _ in parts] == [1, 1, 2, 1]


def test_numbers_come_back_as_they_were_packed():
    lists = packed(np.array([1, 2, 3, 70_000], np.int32), np.array([0, 1, 1, 4]))
    for part, want, starts in ((lists, [1, 2, 3, 70_000], [0, 1, 1, 4]), (lists[1:], [2, 3, 70_000], [0, 0, 3]), (pa.array([b"", b""]), [], [0, 0, 0])):
        got = unpacked(part)
        assert got[0].tolist() == want and got[1].tolist() == starts
