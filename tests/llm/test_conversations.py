import hashlib
import itertools
import random
import re
import zlib

import pytest

from fourthtick.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\f\r"
SHAPE = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(role, text, fault) of one conversation's rows, sorted."""
    rows = sorted(
        ((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()),
    )
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(SPACES):
            fault = 3
        elif (role, text) in seen:
            fault = 2
        else:
            fault = 0 if text.strip(SPACES)[-1] in ".!?" else 1
        seen.add((role, text))
        out.append((role, text, fault))
    return [r[0] for r in rows], out


def apply(rows, audit):
    """Messages and cost that an audit leads to, or None where it does not fit the shape."""
    out, cost, initials, k = [], 0, "", 0
    for edit in audit:
        want = "a" if initials.endswith("u") else "u"
        name = {"u": "user", "a": "assistant"}[want]
        if edit == "I":
            out.append((name, ""))
            cost, initials = cost + 2, initials + want
            continue
        role, text, fault = rows[k]
        k += 1
        if edit == "D":
            cost += 3
            continue
        if fault > 1:
            return None
        cost += fault
        if edit == "K":
            initials += role[:1] or "?"
            out.append((role, text))
        else:
            initials, cost = initials + want, cost + 2
            out.append((name, text))
    return (cost, out) if SHAPE.fullmatch(initials) else None


def every_audit(rows):
    """The cheapest and then least of all audits with at most two turns put in at any place."""
    best = None
    for edits in itertools.product("DKR", repeat=len(rows)):
        for added in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "".join("I" * n + e for n, e in zip(added, edits)) + "I" * added[-1]
            if done := apply(rows, audit):
                if best is None or (done[0], audit) < best:
                    best = (done[0], audit)
    return best


def by_states(rows):
    """The same by a plain table over states with whole strings."""
    table = {"": (0, "")}
    ends = {"": ("s", "u"), "s": "u", "u": "a", "a": "u"}

    def put(new, state, entry):
        if state not in new or entry < new[state]:
            new[state] = entry

    def inserted(old):
        new = dict(old)
        for _ in range(3):
            for state, (cost, audit) in list(new.items()):
                put(new, "a" if state == "u" else "u", (cost + 2, audit + "I"))
        return new

    for role, _, fault in rows:
        new = {}
        for state, (cost, audit) in inserted(table).items():
            put(new, state, (cost + 3, audit + "D"))
            if fault < 2:
                put(new, "a" if state == "u" else "u", (cost + 2 + fault, audit + "R"))
                if role[:1] and role[:1] in ends[state]:
                    put(new, role[:1], (cost + fault, audit + "K"))
        table = new
    table = inserted(table)
    return min(table[s] for s in ("", "a") if s in table)


def brute(rows):
    """The rows of the contract for damaged rows (conv_id, turn, role, text)."""
    out = []
    for conv_id in dict.fromkeys(r[0] for r in rows):
        own = [r[1:] for r in rows if r[0] == conv_id]
        turns, told = faults(own)
        known = {t for t in turns if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        pairs = zip(told, told[1:])
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in pairs)
        cost, audit = by_states(told)
        lines = "\n".join(f"{r}:{t}" for r, t in apply(told, audit)[1])
        n = [sum(f == k for *_, f in told) for k in (3, 2, 1)]
        out.append((conv_id, gaps, *n, illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()))
    return sorted(out, key=repr)


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(name.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def rows_of(frame):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    return sorted((tuple(r) for r in frame.select(*names).collect()), key=repr)


def drawn(seed, n, longest):
    draw = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "Ua"]
    texts = ["Yes.", "No", "", " \t", None, "Why?", "So!  \n", "a. b", "Ünd…", "x" * 30 + "."]
    return [
        (i, draw.choice([k, k, k, None, 2]), draw.choice(roles), draw.choice(texts) if draw.random() < 0.5 else f"t{draw.random()}.")
        for i in range(n)
        for k in range(draw.randrange(longest))
    ]


def test_states_equal_all_audits():
    draw = random.Random(3)
    for _ in range(60):
        rows = [
            (draw.choice(["system", "user", "assistant", "x"]), "", draw.choice([0, 0, 1, 2, 3]))
            for _ in range(draw.randrange(4))
        ]
        assert by_states(rows) == (every_audit(rows) or (0, ""))


def test_grammar_equals_states():
    draw = random.Random(4)
    grammar = conv.Grammar()
    grammar.add_round([(4, 8), (8, 4), (0, 4), (5, 8)])
    grammar.add_round([(16, 16), (17, 17), (18, 17), (19, 3)])
    grammar.add_round([(20, 20), (22, 21), (20, 16)])
    roles = ["system", "user", "assistant", "x"]
    for _ in range(300):
        codes = draw.choices([0, 4, 8, 4, 8, 4, 8, 5, 9, 3, 6, 12, 13], k=draw.randrange(1, 60))
        rows = [(roles[c // 4], "", c % 4) for c in codes]
        cut = draw.randrange(len(codes))
        parts = [p for p in (codes[:cut], codes[cut:]) if p]
        cost, states, missing = conv.choose([grammar.matrix(p) for p in parts])
        audit = "".join(grammar.edits(p, a, b) for p, a, b in zip(parts, states, states[1:]))
        assert (cost, audit + "I" * missing) == by_states(rows)


@pytest.mark.parametrize("chunk", [conv.CHUNK, 4])
def test_matches_brute_force(spark, chunk):
    rows = drawn(5, 80, 12) + drawn(6, 1, 150)
    rows += [(500, 1, "user", "same.")] * 40 + [(None, 1, "user", "hm"), (None, None, "system", "x.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(conv.repair_conversations(frame, chunk=chunk)) == brute(rows)


def test_query_on_given_rows(spark):
    from fourthtick.llm.queries import op13_conversation_repair

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    want = {r[0]: r for r in brute(damaged(rows))}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    whole = sorted((want.get(i, (i, *none)) for i in {r[0] for r in rows}), key=repr)
    assert rows_of(op13_conversation_repair(spark, sf_dir)) == whole


def test_dropped_conversations_empty_tables_and_other_columns(spark):
    rows = [(i, t, "user", "Hello.") for i in range(90) for t in ((0, 2) if i % 3 == 0 else (0,))]
    rows.append((7, None, None, None))
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", edits string, at int")
    got = rows_of(conv.repair_conversations(conv.damage(frame), frame))
    left = brute(damaged(rows))
    missing = {r[0] for r in rows} - {r[0] for r in left}
    assert missing and {r[0] for r in got} == {r[0] for r in rows}
    assert [r for r in got if r[0] not in missing] == left
    assert {r[1:] for r in got if r[0] in missing} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    empty = frame.limit(0)
    assert rows_of(conv.repair_conversations(empty)) == []
    assert {r[1:] for r in rows_of(conv.repair_conversations(empty, frame.where("conv_id < 3")))} == {
        (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    }
    wide = spark.createDataFrame([(1, -(2**63), "user", "a."), (1, 2**63 - 1, "user", "b.")], SCHEMA)
    assert [r[:2] for r in rows_of(conv.repair_conversations(wide))] == [(1, None)]


def test_repaired_messages(spark):
    rows = drawn(8, 25, 9)
    frame = spark.createDataFrame(rows, SCHEMA)
    _, _, edits = conv.plan_repair(frame, 4)
    got = {}
    for r in conv.repaired_rows(frame, edits).collect():
        got.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    for conv_id in {r[0] for r in rows}:
        _, told = faults([r[1:] for r in rows if r[0] == conv_id])
        want = apply(told, by_states(told)[1])[1]
        assert sorted(got.get(conv_id, [])) == [(k, *m) for k, m in enumerate(want)]
