"""Conversation repair against a plain search over all edits."""

import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from gaugeframe.llm import queries, turn_repair

WORD = re.compile("[^\x20\x09-\x0d]")
SCHEMA = "conv_id long, turn long, role string, text string, size string, part string, chunk string, digest string"


def plain_damage(rows):
    out, convs = [], {}
    for conv, turn, role, text in rows:
        convs[conv] = None
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return list(convs), out


def plain_edits(turns):
    """(cost, audit) by trying every edit at every place; turns are (role initial, truncated, must go)."""
    say = {"0": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(turns) and state in "0a":
            options.append((0, ""))
        if inserted < 2:
            for r in "ua":
                if r in say[state]:
                    c, a = best(i, r, inserted + 1)
                    options.append((c + 5, "I" + a))
        if i < len(turns):
            initial, cut, goes = turns[i]
            c, a = best(i + 1, state, 0)
            options.append((c + 2, "D" + a))
            if not goes:
                for r in "ua":
                    if r in say[state]:
                        c, a = best(i + 1, r, 0)
                        options.append((c + 1 + 5 * cut, "R" + a))
                if initial in say[state]:
                    c, a = best(i + 1, initial, 0)
                    options.append((c + 5 * cut, "K" + a))
        return min(options, default=(10**9, "~"))

    for i in range(len(turns), -1, -1):  # from the end, so that the recursion stays flat
        for state in say:
            best(i, state, 0)
    return best(0, "0", 0)


def plain_repair(conv, rows, by_hash):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), by_hash[r[3]]))
    seen, counts, turns = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
    for _, _, role, text in rows:
        found = WORD.findall(text)
        fault = "blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = plain_edits(tuple(turns))
    state, i, out = "0", 0, []
    for letter in audit:
        role = "assistant" if state == "u" else "user"
        if letter != "D":
            out.append(f"{role}:" if letter == "I" else f"{rows[i][2] if letter == 'K' else role}:{rows[i][3]}")
            state = out[-1][0]
        i += letter != "I"
    sha = hashlib.sha256("\n".join(out).encode()).hexdigest()
    return conv, gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, sha


def conversations():
    r = random.Random(8)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "It is. ", "soé .", "end ?\n", "\x1c", "日本。"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "Useful", "sys"]
    rows = []
    for conv in range(120):
        for turn in range(r.randint(0, 9)):
            good = r.random() < 0.6
            role = ("system" if turn == 0 and r.random() < 0.3 else ("user", "assistant")[turn % 2]) if good else r.choice(roles)
            text = f"{r.choice(texts)}{turn} is said." if good else r.choice([*texts, None])
            rows.append((conv, r.choice([turn, turn, turn, turn * 2, None]), role, text))
    rows += [(None, 0, "user", "Of no conversation."), (None, None, None, None), (500, None, "user", "a."), (500, None, "user", "a.")]
    rows += [(600, 7, "assistant", "Same row.")] * 5
    rows += [(700, i, ("user", "assistant")[i % 2], f"Turn {i}." if i % 7 else f"turn {i}") for i in range(2500) if i % 11]
    rows += [(700, 5000 + i, "assistant", "Again and again.") for i in range(600)]
    rows += [(800, i, "user", "x" * 5000 + f"{i}.") for i in range(400)]
    dropped = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(dropped, 0, "user", "Gone.")]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([r + ("x",) * 4 for r in conversations()], SCHEMA).repartition(3)


def test_repair_against_a_plain_search(spark, frame, tmp_path):
    by_hash = {r.text: r.h for r in spark.createDataFrame([(t,) for t in {x[3] for x in plain_damage(conversations())[1]}], "text string").select("text", F.xxhash64("text").alias("h")).collect()}
    frame.write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.QUERIES["op13_turn_repair"](spark, str(tmp_path))
    assert [f.simpleString() for f in got.schema.fields] == ["conv_id:bigint", *[f"{c}:bigint" for c in turn_repair.STATS], "audit:string", "repaired_sha256:string"]
    convs, rows = plain_damage(conversations())
    held = {c: [r for r in rows if r[0] == c] for c in convs}
    want = {c: plain_repair(c, held[c], by_hash) for c in convs}
    found = {r.conv_id: tuple(r) for r in got.collect()}
    assert found.keys() == want.keys()
    for c in want:
        assert found[c] == want[c], c
    assert any(not held[c] and found[c][7] == "" for c in convs)


def test_repaired_turns_follow_the_grammar(frame):
    out = turn_repair.repair(frame, keep_turns=True)
    turns = out.turns.collect()
    by_conv = {}
    for r in sorted(turns, key=lambda r: (str(r.conv_id), r.part or 0, r.chunk or 0, r.place)):
        by_conv.setdefault(r.conv_id, []).append(r)
    for rows in by_conv.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in rows))
    digests = {r.conv_id: r.repaired_sha256 for r in out.summary.collect()}
    for c, digest in digests.items():
        said = "\n".join(f"{r.role}:{r.text}" for r in by_conv.get(c, []))
        assert hashlib.sha256(said.encode()).hexdigest() == digest


def test_no_conversations(frame):
    out = turn_repair.repair(frame.limit(0), keep_turns=True)
    assert out.summary.count() == 0 and out.turns.count() == 0


def test_edits_are_least_and_ascii_least():
    r = random.Random(9)
    for _ in range(3000):
        n = r.randint(0, 9)
        turns = [(r.choice("ssuuaax"), r.random() < 0.3, r.random() < 0.2) for _ in range(n)]
        codes = bytes("suax".index(i) + (turn_repair.GOES if goes else turn_repair.CUT if cut else 0) for i, cut, goes in turns)
        turns = [(i, cut and not goes, goes) for i, cut, goes in turns]
        assert turn_repair.edits(codes) == plain_edits(tuple(turns))
