"""Token counts, byte-level BPE and quality rules against libraries and brute force."""

import hashlib
import random
import re
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pairforge.llm.byte_bpe import REJECT, Codec, Utf8Machine, encode, read_ranks  # noqa: E402
from pairforge.llm.quality_rules import Bands, Rules, judge, keep_good  # noqa: E402
from pairforge.llm.token_counts import PieceCounter, count_tokens  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", " ", "\n\n", "  a   b\n\n c\t▁▁ x", "<s>hi</s> <|endoftext|> <0x41>", "ﬁ½ 梦ゼ 😀😀", "a" * 700, "ab" * 400, " " * 77, "é́x​", "'s'T've", "1234567 12", "\x00\x01"]


SYLLABLES = [c + v + e for c in "bcdfglmnprst" for v in "aeiou" for e in ("", "n", "r")]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    alphabet = [" ", " ", "\n", "\t", "a", "b", "e", "é", "▁", "😀", "<", "0", "x", ".", "th", "tion", "ing"]
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, kept string, lang string, source string, n_chars long")


def rows_of(values):
    return [(i, t, "clash", "clash", None, None, None) for i, t in enumerate(values)]


def test_token_counts_equal_the_library():
    import sentencepiece

    counter = PieceCounter.from_model(open(MODEL, "rb").read())
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for t in texts():
        assert counter.count(t) == len(sp.encode(t)), t


def test_token_counts_of_a_long_text_and_odd_rows(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    long = "tion " * 60_000 + "x" * 5000
    df = table(spark, [*rows_of(["a b", None, "", long]), (None, "a b", None, None, None, None, None), (0, "a b", "x", "x", "en", "s", 3)])
    got = sorted(map(tuple, count_tokens(df, MODEL).collect()), key=str)
    n = len(sp.encode(long))
    want = [(0, 3, 2, False), (0, 3, 2, False), (1, 0, 0, False), (2, 0, 0, False), (3, len(long), n, n > 4096), (None, 3, 2, False)]
    assert got == sorted(want, key=str)
    assert count_tokens(df.limit(0), MODEL).count() == 0


def test_unknown_space_marks_are_refused():
    with pytest.raises(ValueError):
        PieceCounter([("a▁b", -1.0)])


def test_ids_equal_the_library_and_decode():
    import tiktoken

    ranks = read_ranks(open(RANKS, "rb").read())
    codec = Codec(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for t in texts() + letters:
        want = library.encode_ordinary(t)
        assert codec.ids(t) == struct.pack(f"<{len(want)}I", *want), t
        assert codec.text(codec.ids(t)) == t


def test_transducer_equals_merging_by_definition():
    ranks = read_ranks(open(RANKS, "rb").read())
    fst = Codec(ranks, public_tokenizers.PATTERN).fst
    rng = random.Random(7)
    for _ in range(300):
        piece = bytes(rng.choice(b"thieonagr \xc3\xa9") for _ in range(rng.randint(1, 30)))
        assert fst.encode(piece) == fst.merge(piece)


def test_utf8_machine_equals_strict_decoding():
    machine = Utf8Machine({})
    rng = random.Random(8)
    edges = [0x00, 0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xEC, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF]
    for _ in range(20_000):
        raw = bytes(rng.choice(edges) for _ in range(rng.randint(1, 5)))
        try:
            raw.decode()
            good = True
        except UnicodeDecodeError:
            good = False
        assert (machine.run(0, raw) == 0) == good, raw
    assert machine.run(0, "é".encode()[:1]) not in (0, REJECT)


def test_decoding_in_blocks_cut_anywhere():
    import tiktoken

    ranks = read_ranks(open(RANKS, "rb").read())
    codec = Codec(ranks, public_tokenizers.PATTERN)
    text = "aé梦ゼ😀😀 z" * 3
    ids = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(text)
    packed = struct.pack(f"<{len(ids)}I", *ids)
    for block in range(1, 12):
        assert codec.text(packed, block) == text
    first = struct.pack("<I", ranks[b"\xf0"])
    with pytest.raises(ValueError):
        codec.text(first)
    with pytest.raises(ValueError):
        codec.text(first + struct.pack("<I", ranks[b"a"]))


def test_other_patterns_and_entries_without_merges():
    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"xyz": 257, b" a": 258, b" ab": 259}
    for pattern in (public_tokenizers.PATTERN, r"\S+\s+\S+|\s+|\S+", r"(?:a|b)+|[^ab]"):
        codec = Codec(ranks, pattern)
        library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for text in ("xyz ab a b xyz", "ab", "xyz", " ab  ab", "b a\nxyz"):
            want = library.encode_ordinary(text)
            assert codec.ids(text) == struct.pack(f"<{len(want)}I", *want), (pattern, text)


def test_encode_digests_and_odd_rows(spark):
    import tiktoken

    ranks = read_ranks(open(RANKS, "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    values = ["a b", None, "", "héllo\n" * 2000]
    df = table(spark, rows_of(values) + [(None, "a b", None, None, None, None, None)])
    got = {r.doc_id: r for r in encode(df, RANKS, public_tokenizers.PATTERN, ids=True, keep=["doc_id", "n_tokens", "lang"]).collect()}
    assert len(got) == 5
    for i, t in enumerate(values):
        ids = library.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert bytes(r.token_ids) == packed
    assert encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_base_rules_equal_brute_force(spark):
    rng = random.Random(11)
    values = texts(60) + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["a b\n a b\na b\n\n", None]
    got = {r.doc_id: r for r in judge(table(spark, rows_of(values))).collect()}
    assert len(got) == len(values)
    for i, t in enumerate(values):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise_and_keep_prose():
    rng = random.Random(13)
    rules = Rules(Bands())
    syllables = SYLLABLES
    prose = " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(800))
    noise = " ".join("".join(chr(rng.randint(33, 0x2FFF)) for _ in range(9)) for _ in range(300))
    loop = " ".join(f"row {i % 10} of the same table again and again number {i}" for i in range(400))
    assert rules.judge(prose)[6]
    assert not rules.in_bands(len(noise.encode()), rules.ratios(noise.encode()))
    assert not rules.in_bands(len(loop.encode()), rules.ratios(loop.encode()))


def test_kept_equals_brute_force(spark):
    import zstandard

    rng = random.Random(23)
    bands, word = Bands(), lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    values = [prose(rng.randint(15, 900)) for _ in range(60)]
    values += [v + " " + "buy this now " * rng.randint(1, 200) for v in values[:25]] + ["".join(chr(rng.randint(33, 0x2FFF)) if rng.random() < 0.9 else " " for _ in range(rng.randint(50, 4000))) for _ in range(15)]
    ratio = lambda b: len(b) / len(zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False).compress(b))
    limit = lambda n: [(lo, hi) for below, lo, hi in bands.whole if n < below][0]

    def good(text):
        raw = text.encode()
        cut = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
        full, rest = [c for c in cut if len(c) == 2048], [c for c in cut if len(c) < 2048]
        if brute(text)[5] or not limit(len(raw))[0] <= ratio(raw) <= limit(len(raw))[1]:
            return False
        if full and not (1.35 <= sum(map(ratio, full)) / len(full) <= 2.17 and max(map(ratio, full)) <= 2.6):
            return False
        return not full or not rest or limit(len(rest[0]))[0] / 1.25 <= ratio(rest[0]) <= limit(len(rest[0]))[1] * 1.25

    want = [good(v) for v in values]
    assert 10 < sum(want) < len(values) - 10
    assert [r.kept for r in sorted(judge(table(spark, rows_of(values))).collect(), key=lambda r: r.doc_id)] == want


def test_a_repetitive_tail_is_rejected():
    rng = random.Random(29)
    rules = Rules(Bands(whole=((float("inf"), 0.5, 9.0),), slack=1.0))
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(341))
    assert len(text) < 2048 and rules.ratios(text.encode())[2] is None
    whole, chunks, tail = Rules(Bands()).ratios((text + " " + "win big " * 230).encode())
    assert len(chunks) == 1 and tail > 4 * chunks[0]
    assert not Rules(Bands(whole=((2048, 0.5, 3.0), (float("inf"), 0.5, 9.0)))).in_bands(2048 + 1500, (whole, chunks, tail))


@pytest.mark.parametrize("name", ["op5_language_id", "op6_token_counts", "op7_url_filter", "op8_quality_rules", "op9_byte_bpe"])
def test_queries_without_sql_give_a_row_for_each_input(spark, name):
    import sentencepiece
    import tiktoken

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").count()
    got = entry.queries()[name](spark, sf).collect()
    assert len(got) == {"op5_language_id": len(docs) + pages, "op7_url_filter": pages}.get(name, len(docs))
    if name == "op6_token_counts":
        sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
        assert all(r.n_tokens == len(sp.encode(docs[r.doc_id])) and r.n_bytes == len(docs[r.doc_id].encode()) for r in got)
    elif name == "op8_quality_rules":
        assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == brute_counts(docs[r.doc_id]) for r in got)
    elif name == "op9_byte_bpe":
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(open(RANKS, "rb").read()), special_tokens={})
        for r in got:
            ids = library.encode_ordinary(docs[r.doc_id])
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    elif name == "op7_url_filter":
        assert {r.verdict for r in got} <= {"allow", "block"}
    else:
        langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
        assert sum(r.lang == langs[r.doc_id] for r in got if r.doc_id is not None) >= 0.98 * len(docs)


def brute_counts(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))


def test_models_that_are_not_counted_are_refused():
    from pairforge.llm.token_counts import refuse_unknown

    proto = open(MODEL, "rb").read()
    refuse_unknown(proto)
    piece = b"\x0a\x03new\x18\x04"  # a user-defined piece
    for more in (b"\x0a" + bytes([len(piece)]) + piece, b"\x12\x02\x18\x01", b"\x1a\x02\x20\x01"):
        with pytest.raises(ValueError):
            refuse_unknown(proto + more)


def test_keep_good_filters_whole_rows(spark):
    rng = random.Random(17)
    prose = " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(200))
    df = table(spark, [(1, prose, "x", None, "en", "s", 9), (2, "short", None, None, None, None, None), (None, prose, None, None, None, None, None), (3, None, None, None, None, None, None)])
    assert sorted(map(tuple, keep_good(df).collect()), key=str) == sorted([(1, prose, "x", None, "en", "s", 9), (None, prose, None, None, None, None, None)], key=str)
    assert keep_good(df.limit(0)).count() == 0


def test_the_transducer_empties_its_stores_within_a_pre_token():
    import public_tokenizers as P

    from pairforge.llm.byte_bpe import Transducer, read_ranks

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = read_ranks(f.read())
    rng = random.Random(9)
    piece = bytes(rng.choice(b"abcdefgh\xc3\xa9") for _ in range(6000))
    small, large = Transducer(ranks, 0.0005), Transducer(ranks)
    assert small.encode(piece) == large.encode(piece) and len(large.steps) > 4 * small.most
    assert len(small.steps) <= small.most + 1 and len(small.states) <= small.most + 2
