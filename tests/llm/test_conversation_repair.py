"""Conversation repair against a search over all edits of each conversation, one by one."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest

from pairforge.llm import conversation_repair as R
from pairforge.llm.conversation_repair import Trie, finished, repair

DATA = Path("/root/testdata/sf0.01")
GOOD = re.compile(r"(s?(ua)+)?")


def digest(text):
    return hashlib.sha256(text.encode()).digest()


def cheapest(rows):
    """(cost, audit, repaired lines) by a shortest-path search; rows are (role, text, fault)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        state = (i, roles[-1:] if roles else "", bool(roles))
        if i == len(rows) and GOOD.fullmatch(roles):
            return cost, audit, lines
        if state in done:
            continue
        done.add(state)

        def go(letter, more, j, initial, line):
            new = roles + initial
            # Only beginnings of good orders go on.
            if re.fullmatch(r"(s?(ua)*u?)?", new) and not (initial == "s" and roles):
                heapq.heappush(heap, (cost + more, audit + letter, j, new, lines + ((line,) if line is not None else ())))

        for role in ("user", "assistant"):
            go("I", 3, i, role[0], role + ":")
        if i < len(rows):
            role, text, fault = rows[i]
            go("D", 4, i + 1, "", None)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    go("K", extra, i + 1, role[0], f"{role}:{text}")
                for new in ("user", "assistant"):
                    go("R", 3 + extra, i + 1, new[0], f"{new}:{text}")
    raise AssertionError


def brute(table):
    """table: (conv_id, turn, role, text)."""
    every, out = defaultdict(list), {}
    for conv, turn, role, text in table:
        rows = every[conv]
        said = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, rows in every.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[2])))
        seen, faults = set(), []
        for _, role, text in rows:
            plain = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults, strict=True)])
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r.conv_id: (*(r[c] for c in R.COUNTS), r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n, longest):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", "s", None])
            text = rng.choice(["Yes.", "No!", "well", " ", "", None, "Why?  ", "end.\n", f"line {rng.random()}.", "é…"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_random_conversations(spark):
    table = made(3, 150, 12) + [(None, 0, "user", "Hi."), (None, None, None, None), (7000, None, "user", None)]
    docs = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 as key", "2 as audit", "3 as `x.y`")
    assert found(repair(docs)) == brute(table)


def test_long_conversations_are_solved_in_parts(spark, monkeypatch):
    table = made(5, 12, 90)
    for size in (1, 7):
        monkeypatch.setattr(R, "SEGMENT", size)
        assert found(repair(spark.createDataFrame(table, SCHEMA).repartition(3))) == brute(table)


def test_repeated_rows_and_one_long_conversation(spark):
    table = [(1, 0, "user", "Same.")] * 40 + [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(700)] + [(3, None, "assistant", "x")] * 3
    assert found(repair(spark.createDataFrame(table, SCHEMA))) == brute(table)


def test_no_rows(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    assert found(repair(spark.createDataFrame([(9, gone, "user", "Hi.")], SCHEMA))) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_layers_are_made_once_for_a_shared_prefix():
    trie, sigs = Trie(), sorted(["ua", "uaua", "uauaU", "uaub", "s1ua"])
    for sig in sigs:
        assert trie.solve(sig) == Trie().solve(sig)
    assert trie.made == len({s[:i] for s in sigs for i in range(1, len(s) + 1)})
    assert finished(Trie().solve("ua")[R.START]) == (0, "KK")
    assert finished(Trie().solve("u")[R.START]) == (3, "KI")
    assert finished(Trie().solve("")[R.START]) == (0, "")


@pytest.mark.skipif(not DATA.is_dir(), reason="the tables are not here")
def test_the_table(spark):
    rows = spark.read.parquet(f"{DATA}/conversations.parquet")
    assert found(repair(rows)) == brute([(r.conv_id, r.turn, r.role, r.text) for r in rows.collect()])
