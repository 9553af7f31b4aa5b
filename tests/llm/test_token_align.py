"""Cross-tokenizer alignment against a direct computation over whole texts."""

import hashlib
from collections import Counter
from pathlib import Path

import public_tokenizers as P
import pytest

from pairforge.llm.token_align import SUMS, Side, Splitter, align, byte_alphabet

DATA = Path("/root/testdata/sf0.001")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", "one two", "  lead and  double   spaces ", "tab\tand\nline \n x", "it's we'll 'twas isn 't", "naïve café — “quoted” …", "日本語 の テキスト 🙂🙃 x",
    "a b   c　d \x1c e \x85 f", "with ▁ mark", "▁", "<|endoftext|> and </s><unk> <0x41>", "nul\x00 here", "12345 67,890.12 3.14", "a" * 700 + " " + "é" * 300,
    "x" * 5 + " " * 40 + "y", "http://example.org/a?b=c#d  end", "one two", "word, word; word.", "\n\n\nstart", "end\n", "\U0001f468‍\U0001f469‍\U0001f467 family", "ſharp ẞ ﬁne Ⅷ", "é à",
]


def direct(texts):
    """Whole texts through the libraries, cut where ends meet, all links listed."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b, back = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), byte_alphabet()
    a.encode_special_tokens = True
    special = {i for i in range(b.vocab_size()) if b.is_control(i) or b.is_unknown(i)}

    def b_bytes(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b"" if i in special else b.id_to_piece(i).replace("▁", " ").encode()

    every = []
    for text in texts:
        if not text:
            every.append(None)
            continue
        left, right, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), b" " + text.encode()
        sides = [[(i, bytes(back[c] for c in a.id_to_token(i))) for i in left], [(i, b_bytes(i)) for i in right]]
        if any(b"".join(r for _, r in s) != want for s in sides):
            every.append(None)
            continue
        ends = []
        for s in sides:
            at, found = 0, []
            for _, r in s:
                found.append(at := at + len(r))
            ends.append(found)
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            k, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
            groups.append((left[i:k], right[j:m]))
            i, j = k, m
        every.append((left, right, groups, [(x, y) for p, q in groups for x in p for y in q]))
    counts = Counter(p for e in every if e for p in set(e[3]))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for e in every:
        if e is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        left, right, groups, linked = e
        said = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((len(left), len(right), len(groups), len(linked), sum(counts[p] == most[p[0]] for p in linked), sum(counts[p] for p in linked), hashlib.sha256(said.encode()).hexdigest()))
    return out


def found(df):
    return [(r.doc_id, *(r[c] for c in SUMS), r.groups_sha256) for r in df.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_odd_texts_as_the_libraries_align_them(spark):
    rows = list(enumerate(ODD)) + [(None, "one two"), (3, "again and again and again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as block", "2 as no", "3 as `a.b`")
    want = [(i, *r) for (i, _), r in zip(rows, direct([t for _, t in rows]), strict=True)]
    assert by_id(found(align(docs, A, B))) == by_id(want)
    assert any(w[1] for w in want)


@pytest.mark.skipif(not DATA.is_dir(), reason="the tables are not here")
def test_documents_as_the_libraries_align_them(spark, monkeypatch):
    monkeypatch.setattr("pairforge.llm.token_align.BLOCK_BYTES", 40_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = [(i, *r) for (i, _), r in zip(rows, direct([t for _, t in rows]), strict=True)]
    assert by_id(found(align(docs, A, B))) == by_id(want)


def test_links_of_large_stretches_are_those_of_small_ones(spark, monkeypatch):
    text = "éèêë" * 30 + " ñandú " + "日本" * 9
    docs = spark.createDataFrame([(1, text), (2, text[5:]), (3, "plain words")], "doc_id long, text string")
    whole = by_id(found(align(docs, A, B)))
    monkeypatch.setattr("pairforge.llm.token_align.SMALL", 0)
    assert by_id(found(align(docs, A, B))) == whole
    assert [w[1:] for w in whole] == [tuple(r) for r in direct([text, text[5:], "plain words"])]


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert align(docs, A, B).collect() == []
    assert by_id(found(align(spark.createDataFrame([(1, None), (2, "")], docs.schema), A, B))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_a_text_is_cut_at_single_spaces_only():
    split = Splitter()
    for text in ("a b", "a  b", " a b ", "a \tb c", "a  b c", "a", " "):
        assert " ".join(split(text)) == text
    assert split("a b  c d") == ["a", "b  c", "d"]


def test_a_stretch_that_is_not_given_back_spoils_no_other():
    side = Side.piece_level(Path(B).read_bytes())
    ids, counts = side.each(["one", "▁", "two", "three", " ", "four "])
    assert [bool(n) for n in counts] == [True, False, True, True, True, True] and counts.sum() == len(ids)
    assert b"".join(side.raw[i] for i in ids) == b" one two three   four "
