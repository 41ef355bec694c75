"""Cheapest repair of a conversation's structure, evaluated over a grammar of its rows.

A row counts by the initial of its role and by its fault; a conversation is a sequence of
such codes. Re-Pair turns frequent neighbours, counted over all conversations, into rules.
Every rule has one min-plus transfer matrix: for each pair of states of the wanted shape
``(s?(ua)+)?`` the least cost and the place of its edits among those of the same first
state, and, as the rope of its edits, the state between its two halves. Matrices are
evaluated from the shortest rules up, once for all conversations that use them.

Why ranks replace strings: edits that take the same rows from one state end in a row's own
edit and lead to different states, so no two of them are equal and none is the beginning
of another. Which of two chains is less is therefore decided by their first halves, or
within the second half where these are the same.

Long conversations are cut into chunks of rows: a chunk is one matrix, whatever its length,
and only the matrices of a conversation meet.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourthtick.sources.storage import stage

#: Rows of a chunk at most, and the size of the grammar: rounds, and new rules in each.
CHUNK = 4096
ROUNDS = 6
RULES_A_ROUND = 64

# States of the wanted shape: nothing yet, after s, after u, after a.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
# By state: the state after the only user or assistant turn that fits there.
_FORCED = (_USER, _USER, _ASSISTANT, _USER)
_INITIALS = ("s", "u", "a")
_NEXT = ({0: _SYSTEM, 1: _USER}, {1: _USER}, {2: _ASSISTANT}, {1: _USER})
#: Turns missing at the end, by state.
_MISSING = (0, 2, 1, 0)
_ROLE_INTO = {_USER: "user", _ASSISTANT: "assistant"}

_SPACES = r"\x20\x09-\x0D"
_FINE, _TRUNCATED, _DUPLICATE, _BLANK = range(4)
_CODES = 16
_NEVER = 1 << 50


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults dealt by crc32 of ``conv_id:turn`` modulo 20; nulls read as one space.

    0 drops the row, 1 empties its text, 2 takes its ``. ! ?``, 3 repeats it, 4 makes it a user's.
    """
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", "role", "text").withColumn("_kind", kind)
    text = F.coalesce("text", space)
    return rows.where("_kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))),
    ).drop("col")


# ---- the algebra of edits -------------------------------------------------------------


def _base_matrix(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """For each (state before, after) the cheapest edits of one row: turns put before it, then its own edit."""
    role, fault = divmod(code, 4)
    found: dict[tuple[int, int], tuple[int, str]] = {}
    for start in range(4):
        state, added = start, 0
        while added < 3:
            own = [(state, 3, "D")]
            if fault < _DUPLICATE:
                own.append((_FORCED[state], 2 + fault, "R"))
                if role in _NEXT[state]:
                    own.append((_NEXT[state][role], fault, "K"))
            for end, cost, edit in own:
                new = (2 * added + cost, "I" * added + edit)
                if (start, end) not in found or new < found[start, end]:
                    found[start, end] = new
            state, added = _FORCED[state], added + 1
    return found


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.argsort(np.argsort(keys, axis=1, kind="stable"), axis=1, kind="stable")


def _product(left: tuple, right: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost, rank among the edits from the same state, and state in between."""
    (cost, rank), (cost2, rank2) = left[:2], right[:2]
    total = np.minimum(cost[:, :, None] + cost2[None], _NEVER)
    between = np.argmin(total * 8 + rank[:, :, None], axis=1)
    at = np.arange(len(cost))[:, None]
    least = total[at, between, np.arange(4)]
    order = rank[at, between] * 8 + rank2[between, np.arange(4)]
    return least, _ranks(np.where(least < _NEVER, order, 99)), between


class Grammar:
    """Rules by rounds, the matrix of every symbol, and the edits behind its entries."""

    def __init__(self) -> None:
        self.rounds: list[dict[tuple[int, int], int]] = []
        self.parts: list[tuple[int, int] | None] = [None] * _CODES
        self.strings = [_base_matrix(code) for code in range(_CODES)]
        self.matrices = []
        for found in self.strings:
            cost = np.full((4, 4), _NEVER, np.int64)
            place = np.full((4, 4), 99)
            for start in range(4):
                ends = sorted((s, e) for (b, e), (_, s) in found.items() if b == start)
                for k, (_, end) in enumerate(ends):
                    cost[start, end], place[start, end] = found[start, end][0], k
            self.matrices.append((cost, _ranks(place), None))

    def add_round(self, pairs: list[tuple[int, int]]) -> None:
        rules = {}
        for pair in pairs:
            rules[pair] = len(self.parts)
            self.parts.append(pair)
            self.matrices.append(_product(self.matrices[pair[0]], self.matrices[pair[1]]))
        self.rounds.append(rules)

    def compress(self, codes: list[int]) -> list[int]:
        for rules in self.rounds:
            out, i = [], 0
            while i < len(codes):
                new = rules.get((codes[i], codes[i + 1])) if i + 1 < len(codes) else None
                out.append(codes[i] if new is None else new)
                i += 1 if new is None else 2
            codes = out
        return codes

    def matrix(self, codes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Cost and rank of the whole sequence."""
        symbols = self.compress(codes)
        whole = self.matrices[symbols[0]]
        for symbol in symbols[1:]:
            whole = _product(whole, self.matrices[symbol])
        return whole[0], whole[1]

    def edits(self, codes: list[int], start: int, end: int) -> str:
        """The edits of the sequence that lead from one state to the other."""
        symbols = self.compress(codes)
        whole = (self.matrices[symbols[0]][0][start : start + 1], self.matrices[symbols[0]][1][start : start + 1])
        back = []
        for symbol in symbols[1:]:
            whole = _product(whole, self.matrices[symbol])
            back.append(whole[2][0])
        states = [end]
        for between in reversed(back):
            states.append(int(between[states[-1]]))
        states = [start, *reversed(states)]
        return "".join(self.expand(s, states[k], states[k + 1]) for k, s in enumerate(symbols))

    def expand(self, symbol: int, start: int, end: int) -> str:
        if self.parts[symbol] is None:
            return self.strings[symbol][start, end][1]
        left, right = self.parts[symbol]
        between = int(self.matrices[symbol][2][start, end])
        return self.expand(left, start, between) + self.expand(right, between, end)


def choose(matrices: list[tuple[np.ndarray, np.ndarray]]) -> tuple[int, list[int], int]:
    """Of consecutive chunks: least cost, the states before, between and after them, turns missing at the end."""
    whole = tuple(a[:1] for a in matrices[0])
    back = []
    for matrix in matrices[1:]:
        whole = _product(whole, matrix)
        back.append(whole[2][0])
    cost, rank = whole[0][0], whole[1][0]
    end = min(range(4), key=lambda j: (cost[j] + 2 * _MISSING[j], rank[j]))
    states = [end]
    for between in reversed(back):
        states.append(int(between[states[-1]]))
    return int(cost[end] + 2 * _MISSING[end]), [_START, *reversed(states)], _MISSING[end]


# ---- rows, codes and chunks ------------------------------------------------------------


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows with the keys that order them: by turn (null first), role and digest of the text."""
    text = F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text.alias("text"),
    )


_ORDER = ["conv_id", "turn", "role", "digest"]


def codes_of(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, ``at`` (places in the order of all rows), fault and code; no texts.

    The order is dealt by ranges of its keys and a running number, so a conversation of any
    size and rows repeated any number of times spread over tasks.
    """
    keyed = _keyed(rows)
    fault = F.when(~F.col("text").rlike(f"[^{_SPACES}]"), _BLANK).when(
        ~F.col("text").rlike(rf"[.!?][{_SPACES}]*\z"), _TRUNCATED
    )
    light = keyed.select(*_ORDER, F.coalesce(fault, F.lit(_FINE)).alias("own"))
    light = light.withColumn("_copy", F.monotonically_increasing_id())
    spread = light.repartitionByRange(*_ORDER, "_copy").sortWithinPartitions(*_ORDER, "_copy")
    spread = stage(
        spread.drop("_copy").withColumn("at", F.monotonically_increasing_id()), "turns"
    )
    # The first of equal rows, found by partial minima: no group of equal rows is gathered.
    full = spread.where(F.col("own") != _BLANK)
    firsts = full.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("_first"))
    told = spread.join(firsts.select("_first"), F.col("at") == F.col("_first"), "left")
    fault = F.when(F.col("own") == _BLANK, _BLANK).when(F.col("_first").isNull(), _DUPLICATE)
    initial = F.substring("role", 1, 1)
    role = F.coalesce(*[F.when(initial == c, i) for i, c in enumerate(_INITIALS)], F.lit(3))
    return told.select(
        *_ORDER, "at", F.coalesce(fault, F.col("own")).alias("fault"), role.alias("_role")
    ).withColumn("code", (F.col("_role") * 4 + F.col("fault")).cast("int"))


def chunks_of(coded: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """conv_id, chunk, codes in order and the keys of the first row, for at most ``chunk`` rows each."""
    part = F.call_function("div", "at", F.lit(chunk)).cast("long")
    rows = coded.groupBy("conv_id", part.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct("at", "code"))).alias("_rows"),
        F.min(F.struct("at", "turn", "role", "digest")).alias("_head"),
    )
    return rows.select(
        "conv_id",
        "chunk",
        F.transform("_rows", lambda r: r["code"]).alias("codes"),
        F.col("_head.turn").alias("turn"),
        F.col("_head.role").alias("role"),
        F.col("_head.digest").alias("digest"),
    )


def learn_grammar(chunks: DataFrame, rounds: int = ROUNDS, rules: int = RULES_A_ROUND) -> Grammar:
    """Re-Pair over the codes of all chunks, each distinct sequence once with its count.

    A round counts neighbours in everything as the rules so far have left it and replaces
    the most frequent, ``rules`` of them at once. What no rule covers stays as it is.
    """
    grammar = Grammar()
    sequences = stage(chunks.groupBy("codes").agg(F.count("*").alias("n")), "sequences")
    for _ in range(rounds):
        sent = chunks.sparkSession.sparkContext.broadcast(grammar.rounds)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            so_far = Grammar()
            so_far.rounds = sent.value
            pairs: Counter[tuple[int, int]] = Counter()
            for batch in batches:
                for codes, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    symbols = so_far.compress(codes)
                    last = None
                    for pair in zip(symbols, symbols[1:]):
                        # Three equal symbols hold the pair once.
                        if last == pair and pair[0] == pair[1]:
                            last = None
                            continue
                        pairs[pair] += n
                        last = pair
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([p[0] for p in pairs], pa.int32()),
                    pa.array([p[1] for p in pairs], pa.int32()),
                    pa.array(list(pairs.values()), pa.int64()),
                ],
                names=["a", "b", "n"],
            )

        counted = sequences.mapInArrow(count, "a int, b int, n long")
        found = counted.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 1")
        top = found.orderBy(F.desc("n"), "a", "b").limit(rules).collect()
        if not top:
            break
        grammar.add_round([(r["a"], r["b"]) for r in top])
    return grammar


def _figures(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """Each chunk as its matrix, its breaks of order and the roles at its ends."""
    sent = chunks.sparkSession.sparkContext.broadcast(grammar)
    kind = "costs array<long>, ranks array<long>, illegal long, head int, tail int"
    fields = ", ".join(f"{c} {chunks.schema[c].dataType.simpleString()}" for c in ("conv_id", "chunk"))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value

        @lru_cache(maxsize=50_000)
        def figures(codes: tuple[int, ...]) -> tuple:
            cost, rank = rules.matrix(list(codes))
            breaks = sum(not _fits(a // 4, b // 4) for a, b in zip(codes, codes[1:]))
            return cost.ravel().tolist(), rank.ravel().tolist(), breaks, codes[0] // 4, codes[-1] // 4

        for batch in batches:
            rows = [figures(tuple(codes)) for codes in batch.column(2).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "chunk", "costs", "ranks", "illegal", "head", "tail"],
            )

    return chunks.select("conv_id", "chunk", "codes").mapInArrow(evaluate, f"{fields}, {kind}")


def _fits(a: int, b: int) -> bool:
    return (a, b) in ((0, 1), (1, 2), (2, 1))


def choose_states(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """Per chunk the states of the cheapest edits of its conversation, ``missing`` turns after its last chunk.

    ``cost`` and ``illegal`` of the conversation stand with its last chunk. Only matrices
    of a conversation meet in one row, one for every ``CHUNK`` rows.
    """
    parts = F.struct("chunk", "costs", "ranks", "illegal", "head", "tail")
    figures = _figures(chunks, grammar)
    whole = figures.groupBy("conv_id").agg(F.array_sort(F.collect_list(parts)).alias("parts"))
    key = chunks.schema["conv_id"].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=50_000)
        def single(costs: tuple, ranks: tuple) -> tuple:
            return choose([(np.array(costs).reshape(4, 4), np.array(ranks).reshape(4, 4))])

        for batch in batches:
            ids, out = [], []
            for k, chunks in enumerate(batch.column(1).to_pylist()):
                if len(chunks) == 1:
                    found = single(tuple(chunks[0]["costs"]), tuple(chunks[0]["ranks"]))
                else:
                    found = choose(
                        [tuple(np.array(c[x]).reshape(4, 4) for x in ("costs", "ranks")) for c in chunks]
                    )
                cost, states, missing = found
                illegal = sum(c["illegal"] for c in chunks)
                illegal += sum(not _fits(a["tail"], b["head"]) for a, b in zip(chunks, chunks[1:]))
                last = len(chunks) - 1
                for i, c in enumerate(chunks):
                    ids.append(k)
                    end = (missing, cost, illegal) if i == last else (0, None, None)
                    out.append((c["chunk"], states[i], states[i + 1], *end))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64()))]
                + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["conv_id", "chunk", "before", "after", "missing", "cost", "illegal"],
            )

    return whole.mapInArrow(
        decide, f"conv_id {key}, chunk long, before int, after int, missing int, cost long, illegal long"
    )


def edits_of(chunks: DataFrame, states: DataFrame, grammar: Grammar) -> DataFrame:
    """Each chunk's first keys with the initials of its edits, in order."""
    sent = chunks.sparkSession.sparkContext.broadcast(grammar)
    chosen = states.select(
        F.col("conv_id").alias("_conv"), F.col("chunk").alias("_chunk"), "before", "after", "missing"
    )
    same = chunks["conv_id"].eqNullSafe(chosen["_conv"]) & (chunks["chunk"] == chosen["_chunk"])
    rows = chunks.join(chosen, same).select(*_ORDER, "chunk", "codes", "before", "after", "missing")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:5])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = sent.value

        @lru_cache(maxsize=50_000)
        def edits(codes: tuple[int, ...], before: int, after: int) -> str:
            return rules.edits(list(codes), before, after)

        for batch in batches:
            codes, before, after, missing = (batch.column(i).to_pylist() for i in range(5, 9))
            spelled = [
                edits(tuple(c), b, a) + "I" * m for c, b, a, m in zip(codes, before, after, missing)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(spelled, pa.string())],
                names=[*batch.schema.names[:5], "edits"],
            )

    return rows.mapInArrow(spell, f"{fields}, edits string")


def _meet(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits and texts of a conversation in one task, in order, each chunk's edits before its rows.

    The one shuffle of whole texts. A task streams its rows: none of them is held longer
    than the edits of a chunk.
    """
    texts = _keyed(rows).select(
        *_ORDER,
        F.lit(1).alias("_kind"),
        F.lit(0).cast("long").alias("chunk"),
        F.col("text").cast("binary").alias("text"),
        F.lit(None).cast("string").alias("edits"),
    )
    no_text = F.lit(None).cast("binary").alias("text")
    marks = edits.select(*_ORDER, F.lit(0).alias("_kind"), "chunk", no_text, "edits")
    order = [*_ORDER, "_kind", "chunk"]
    return texts.unionByName(marks).repartition("conv_id").sortWithinPartitions(*order)


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edits, messages) of the sorted rows of a partition, a batch's worth at a time.

    A conversation comes in parts; the last part of it has True as fourth entry.
    """
    current, begun, state, pending = None, False, _START, ""

    def inserts(messages: list) -> None:
        nonlocal state, pending
        while pending[:1] == "I":
            state, pending = _FORCED[state], pending[1:]
            messages.append((_ROLE_INTO[state].encode(), b""))

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "_kind", "text", "edits")]
        used, messages = [], []
        for conv_id, role, kind, text, edits in zip(*columns):
            if not begun or conv_id != current:
                if begun:
                    yield current, "".join(used), messages, True
                used, messages = [], []
                current, begun, state, pending = conv_id, True, _START, ""
            if kind == 0:
                used.append(edits)
                pending += edits
                if pending == "I" * len(pending):
                    inserts(messages)
                continue
            inserts(messages)
            edit, pending = pending[0], pending[1:]
            if edit == "K":
                state = _NEXT[state][_INITIALS.index(role[0])]
                messages.append((role.encode(), text))
            elif edit == "R":
                state = _FORCED[state]
                messages.append((_ROLE_INTO[state].encode(), text))
            if pending == "I" * len(pending):
                inserts(messages)
        if begun:
            yield current, "".join(used), messages, False
    if begun:
        yield current, "", [], True


def audits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """conv_id, audit (initials of all edits) and repaired_sha256 (of ``role:text`` lines)."""
    met = _meet(rows, edits)
    kind = met.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = []
        parts, sha, lines = [], hashlib.sha256(), 0
        for conv_id, used, messages, ended in _replay(batches):
            parts.append(used)
            for role, text in messages:
                sha.update((b"\n" if lines else b"") + role + b":")
                sha.update(text)
                lines += 1
            if ended:
                done.append((conv_id, "".join(parts), sha.hexdigest()))
                parts, sha, lines = [], hashlib.sha256(), 0
                if len(done) == 10_000:
                    yield _as_batch(done, kind)
                    done = []
        yield _as_batch(done, kind)

    return met.mapInArrow(digest, f"conv_id {kind}, audit string, repaired_sha256 string")


def _as_batch(done: list[tuple], kind: str) -> pa.RecordBatch:
    ids, audit, sha = zip(*done) if done else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, _arrow(kind)), pa.array(audit, pa.string()), pa.array(sha, pa.string())],
        names=["conv_id", "audit", "repaired_sha256"],
    )


def repaired_rows(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role and text of every message."""
    met = _meet(rows, edits)
    kind = met.schema["conv_id"].dataType.simpleString()

    def messages_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = 0
        for conv_id, _, messages, ended in _replay(batches):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([conv_id] * len(messages), _arrow(kind)),
                    pa.array(range(place, place + len(messages)), pa.int64()),
                    pa.array([r.decode() for r, _ in messages], pa.string()),
                    pa.array([t.decode() for _, t in messages], pa.string()),
                ],
                names=["conv_id", "place", "role", "text"],
            )
            place = 0 if ended else place + len(messages)

    return met.mapInArrow(messages_of, f"conv_id {kind}, place long, role string, text string")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def plan_repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The coded rows, the chosen states and the edits of all conversations, each staged."""
    coded = stage(codes_of(rows), "coded")
    chunks = stage(chunks_of(coded, chunk), "chunks")
    grammar = learn_grammar(chunks)
    states = stage(choose_states(chunks, grammar), "states")
    return coded, states, stage(edits_of(chunks, states, grammar), "edits")


def repair_conversations(
    rows: DataFrame, ids: DataFrame | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Faults, cheapest cost, audit and digest of the repaired conversation, per conv_id.

    rows: conv_id (bigint, int or string), turn (integer), role, text; other columns are not
    read. A null role or text reads as one space. Rows go by turn, null first, rows of one turn by
    role and by SHA-256 of their text. An empty role has no initial and fits nowhere, as has any
    whose initial is not s, u or a. Repeated rows are duplicates from the second on. A null
    conv_id is a conversation like others. Conversations of ``ids`` without rows get zeros, an
    empty audit and the digest of nothing; no rows and no ids: no conversations. ``gaps`` is
    null where turns span more than a long holds.
    """
    coded, states, edits = plan_repair(rows, chunk)
    is_fault = [
        F.count(F.when(F.col("fault") == kind, 1)).alias(name)
        for name, kind in (("blank", _BLANK), ("duplicate", _DUPLICATE), ("truncated", _TRUNCATED))
    ]
    # Turns first, so that a conversation's rows are summed up where they are.
    turns = coded.groupBy("conv_id", "turn").agg(*is_fault)
    span = F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count("turn")
    numbers = turns.groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).try_cast("long").alias("gaps"),
        *[F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    ends = states.where("cost IS NOT NULL").select("conv_id", "illegal", "cost")
    told = audits(rows, edits)
    whole = (ids if ids is not None else rows).select("conv_id").distinct()
    for part in (numbers, ends, told):
        part = part.withColumnRenamed("conv_id", "_conv")
        whole = whole.join(part, whole["conv_id"].eqNullSafe(part["_conv"]), "left").drop("_conv")
    none = hashlib.sha256().hexdigest()
    zero = F.lit(0).cast("long")
    return whole.select(
        "conv_id",
        F.when(F.col("cost").isNull(), zero).otherwise(F.col("gaps")).alias("gaps"),
        *[_or(name, zero) for name in ("blank", "duplicate", "truncated", "illegal", "cost")],
        _or("audit", F.lit("")),
        _or("repaired_sha256", F.lit(none)),
    )


def _or(name: str, value: Column) -> Column:
    return F.coalesce(F.col(name), value).alias(name)
