import hashlib
import random
import re
import zlib

import pytest

from tidemark.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows):
    """The damage of the contract, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def all_ways(marks, allowed):
    """(cost, letters, (role, text) list) of every edit of the turns that gives a fitting conversation, with few inserts."""
    found = []

    def go(i, roles, cost, letters, out):
        if not re.fullmatch(r"(s?(ua)*u?)?", roles):
            return
        if i == len(marks):
            for more in ("", "u", "a", "ua"):
                if re.fullmatch(r"(s?(ua)+)?", roles + more):
                    add = [({"u": "user", "a": "assistant"}[x], "") for x in more]
                    found.append((cost + 2 * len(more), letters + "I" * len(more), out + add))
            return
        role, text, must_go, cut = marks[i]
        for ins in ("", "u", "a", "ua"):
            if len(ins) > allowed:
                continue
            r, c, s = roles + ins, cost + 2 * len(ins), letters + "I" * len(ins)
            o = out + [({"u": "user", "a": "assistant"}[x], "") for x in ins]
            go(i + 1, r, c + 3, s + "D", o)
            if not must_go:
                go(i + 1, r + (role[:1] if role[:1] in ("s", "u", "a") else "?"), c + cut, s + "K", [*o, (role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, r + new[0], c + 2 + cut, s + "R", [*o, (new, text)])

    go(0, "", 0, "", [])
    return min(found, key=lambda x: (x[0], x[1]))


def brute(rows):
    """The contract's row of one conversation (rows after damage) from all edits there are."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, marks, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        signs = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marks.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters, out = all_ways(marks, 2)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, *counts.values(), illegal, cost, letters, digest


COLS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def by_conv(df):
    rows = df.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLS) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, n, most=4):
    rng = random.Random(seed)
    texts = ["Yes.", "Yes.", "No", "", " \t", "One!", "Why?", "a\nb", None, "ünde."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    rows = []
    for conv in range(n):
        for t in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([t, t, t + 1, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_against_all_edits(spark):
    rows = random_rows(1, 150)
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = brute([(c, t, r or "", x) for c, t, r, x in [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows] if c == conv])
    assert by_conv(cr.audited(spark.createDataFrame(rows, SCHEMA))) == want


def test_query_with_damage(spark, tmp_path):
    rows = random_rows(2, 120) + [(None, 1, "user", "Null id."), (None, 2, "assistant", "Yes.")]
    rows += [(900 + i, 0, "user", "Gone or not.") for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "conv_id AS live", "text AS digest", "turn AS first", "role AS c")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    hurt = damage(rows)
    empty = hashlib.sha256(b"").hexdigest()
    want = {}
    for conv in {r[0] for r in rows}:
        own = [r for r in hurt if r[0] == conv]
        want[conv] = brute(own) if own else (0, 0, 0, 0, 0, 0, "", empty)
    assert any(v[6] == "" for v in want.values())
    assert by_conv(cr.query(spark, str(tmp_path))) == want


def dynamic(marks):
    """Cost and letters by whole strings per state, for conversations too long for all_ways."""
    best = {0: (0, "")}

    def inserted(b):
        b = dict(b)
        for _ in range(2):
            for s, (c, w) in list(b.items()):
                to = cr.NEXT[s]
                if to not in b or (c + 2, w + "I") < b[to]:
                    b[to] = (c + 2, w + "I")
        return b

    for role, must_go, cut in marks:
        new = {}
        for s, (c, w) in inserted(best).items():
            ways = [(s, c + 3, w + "D")]
            if not must_go:
                if (s, role[:1]) in cr.AFTER:
                    ways.append((cr.AFTER[s, role[:1]], c + cut, w + "K"))
                ways.append((cr.NEXT[s], c + 2 + cut, w + "R"))
            for to, cc, ww in ways:
                if to not in new or (cc, ww) < new[to]:
                    new[to] = (cc, ww)
        best = new
    end = inserted(best)
    return min(end[s] for s in (0, 3) if s in end)


@pytest.mark.parametrize("seed", range(6))
def test_long_conversations_keep_few_undecided(seed):
    rng = random.Random(seed)
    marks = [(rng.choice(["user", "assistant", "assistant", "user", "system", "tool"]), rng.random() < 0.1, rng.random() < 0.2) for _ in range(1500)]
    s, letters, most = cr.Survivors(), [], 0
    for role, must_go, cut in marks:
        letters += s.turn(role[:1] if role[:1] in "sua" else "", must_go, cut)
        most = max(most, len(s.parent))
    cost, rest = s.end()
    assert (cost, "".join(letters + rest)) == dynamic(marks)
    assert most < 300  # nodes that were ever held at once


@pytest.mark.parametrize("role", ["u", "a", "s", ""])
def test_ties_that_stay_open_to_the_end(role):
    """One role only: two ways of equal cost never meet, so nothing may be given out too early."""
    for n in (1, 2, 3, 8, 9, 40, 41):
        s = cr.Survivors()
        letters = [x for _ in range(n) for x in s.turn(role, False, False)]
        cost, rest = s.end()
        assert (cost, "".join(letters + rest)) == dynamic([(role or "tool", False, False)] * n)


def test_a_long_conversation_is_linear():
    import time

    def seconds(n):
        s, start = cr.Survivors(), time.perf_counter()
        for i in range(n):
            for _ in s.turn("ua"[i % 2], False, False):
                pass
        s.end()
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.01)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Still there?"), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (1, 3, "user", "Good")]
    got = [tuple(r)[1:] for r in cr.repaired(spark.createDataFrame(rows, SCHEMA)).orderBy("step").collect()]
    audit = "".join(r[1] for r in got)
    want = brute(rows)
    assert audit == want[6]
    text = "\n".join(f"{r[3]}:{r[4]}" for r in got if r[1] != "D")
    assert hashlib.sha256(text.encode()).hexdigest() == want[7]
    assert all(r[3] is None and r[4] is None for r in got if r[1] == "D")


def test_very_long_text_and_empty_table(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (1, 2, "user", long)]
    got = by_conv(cr.audited(spark.createDataFrame(rows, SCHEMA)))
    assert got[1] == brute(rows)
    assert cr.audited(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cr.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


def test_turns_far_apart(spark):
    rows = [(1, -(1 << 63), "user", "A."), (1, (1 << 63) - 1, "assistant", "B.")]
    assert by_conv(cr.audited(spark.createDataFrame(rows, SCHEMA)))[1][0] == (1 << 63) - 1
