"""Secret scans: fixed patterns, and character Markov models for what they miss.

Two first-order character models are trained from labelled samples of the corpus:
strings that the patterns mark as secret, and ordinary identifiers, that is the
other long runs. A long run is a secret when the log-likelihood ratio of
random string to identifier is high enough per character. Everything is built-in
expressions; the models travel as one array literal of fixed size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourthtick.llm.common import documents_of

# The patterns, and the shortest match of each kind that counts.
ASSIGN = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ["assign", "access", "hex", "random"]

RUN = r"[A-Za-z0-9+/_=-]"
RUN_LEAST = 12
#: Nats per character by which a run has to look more random than like an identifier; a run
#: under ``FULL_RUN`` characters needs as many in all as one of that length.
MARGIN = 1.0
FULL_RUN = 20
#: Bounds of the fit: documents with secrets, and documents for identifiers.
SAMPLE_DOCUMENTS = 2000

# Character classes of the models: letters and digits each their own, all signs one, and the start.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGN = len(ALPHABET)
START = SIGN + 1
STATES = START + 1

SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


def _split(text: Column, pattern: str) -> Column:
    """The text cut into (gap, match) pairs, as two columns of equal length.

    Each step takes the shortest gap before the next match, or what is left at the
    end of the text with an empty match, so the text is walked once.
    """
    walk = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    return F.arrays_zip(
        F.regexp_extract_all(text, walk, F.lit(1)).alias("gap"),
        F.regexp_extract_all(text, walk, F.lit(2)).alias("match"),
        F.regexp_extract_all(text, walk, F.lit(3)).alias("value"),
    )


def _spans(text: Column, pattern: str, kind: int, keep, only_if: Column | None = None) -> Column:
    """Matches of ``pattern`` (with one group, the value) that ``keep(match, value)``.

    Positions are in code points. Texts without any match skip the walk, and those
    that fail the cheap necessary condition ``only_if`` the pattern too.
    """
    walked = F.aggregate(
        _split(text, pattern),
        F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")),
        lambda seen, step: F.struct(
            (seen["at"] + F.char_length(step["gap"]) + F.char_length(step["match"])).alias("at"),
            F.when(
                keep(step["match"], step["value"]),
                F.concat(
                    seen["spans"],
                    F.array(
                        F.struct(
                            (seen["at"] + F.char_length(step["gap"])).alias("start"),
                            F.lit(kind).alias("kind"),
                            (
                                seen["at"]
                                + F.char_length(step["gap"])
                                + F.char_length(step["match"])
                            ).alias("end"),
                            step["value"].alias("value"),
                        )
                    ),
                ),
            )
            .otherwise(seen["spans"])
            .alias("spans"),
        ),
        lambda seen: seen["spans"],
    )
    has = text.rlike(pattern) if only_if is None else only_if & text.rlike(pattern)
    return F.when(has, walked).otherwise(F.array().cast(SPAN))


def _may_assign(text: Column) -> Column:
    return text.contains("=") | text.contains(":")


def base_spans(text: str = "text") -> list[Column]:
    """Spans of the three fixed kinds: assign, access, hex."""
    t = F.col(text)
    return [
        _spans(
            t,
            ASSIGN,
            0,
            lambda m, v: (m != "") & (F.char_length(v) >= ASSIGN_LEAST),
            _may_assign(t),
        ),
        _spans(
            t,
            f"({ACCESS[:-1]}{{{ACCESS_LEAST - 4},}})",
            1,
            lambda m, v: m != "",
            t.contains("AKIA"),
        ),
        _spans(t, f"({HEX[:-1]}{{{HEX_LEAST},}})", 2, lambda m, v: m != ""),
    ]


def with_base(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` with base spans: ``assign``, ``access``, ``hex``."""
    assign, access, hexes = base_spans()
    return docs.select(*columns, assign.alias("assign"), access.alias("access"), hexes.alias("hex"))


#: What a run that a base span touches holds; the rest of such a run is looked at by itself.
IN_BASE = rf"AKIA|{HEX[:-1]}{{{HEX_LEAST}}}|(?i:password|passwd|secret|token|api_?key)"


def _outside(run: Column, base: Column) -> Column:
    """The pieces of a run that no base span covers."""

    def piece(start: Column, end: Column) -> Column:
        return F.struct(
            start.alias("start"),
            run["kind"].alias("kind"),
            end.alias("end"),
            run["value"].substr(start - run["start"] + 1, end - start).alias("value"),
        )

    def and_piece(seen: Column, end: Column) -> Column:
        return F.when(
            end > seen["at"], F.concat(seen["pieces"], F.array(piece(seen["at"], end)))
        ).otherwise(seen["pieces"])

    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.aggregate(
        F.array_sort(touching),
        F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("pieces")),
        lambda seen, b: F.struct(
            F.greatest(seen["at"], b["end"]).alias("at"),
            and_piece(seen, b["start"]).alias("pieces"),
        ),
        lambda seen: and_piece(seen, run["end"]),
    )


def _state(c: Column) -> Column:
    at = F.instr(F.lit(ALPHABET), c)
    return F.when(at > 0, at - 1).otherwise(F.lit(SIGN))


def _steps(value: Column) -> Column:
    """Numbers of the (character before, character) steps of a string."""
    return F.transform(
        F.sequence(F.lit(1), F.char_length(value)),
        lambda i: F.when(i == 1, F.lit(START)).otherwise(_state(F.substring(value, i - 1, F.lit(1))))
        * STATES
        + _state(F.substring(value, i, F.lit(1))),
    )


def _allow_case(log: list[list[float]]) -> None:
    """An identifier may capitalise its words: such steps are as likely as in lower case.

    A capital after a small letter or a digit starts a word.
    """
    small = {i: ALPHABET.index(c.lower()) for i, c in enumerate(ALPHABET) if c.isupper()}
    for before in range(SIGN):
        for after in range(SIGN):
            like = (small.get(before, before), small.get(after, after))
            if after in small and before not in small:
                like = (START, small[after])
            log[before][after] = max(log[before][after], log[like[0]][like[1]])


def fit_ratio(docs: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> list[float]:
    """Log-likelihood ratios, random over identifier, of every (before, character) step.

    Labelled samples are read from at most ``sample_documents`` documents each, the
    smallest hashes: the values of base spans are random strings; ordinary
    identifiers are the words (runs of six and more) of any documents outside such
    spans. The random model starts from the uniform law over letters and digits, the
    identifier model from a thin one, so an empty sample leaves a usable prior. Only
    the step counts, ``STATES`` squared at most, reach the driver.
    """
    key = F.xxhash64("doc_id", "text")
    texts = docs.select("doc_id", "text").where("text IS NOT NULL")
    text = F.col("text")
    marked = texts.where(
        (_may_assign(text) & text.rlike(f"{ASSIGN[:-2]}{{{ASSIGN_LEAST},}})"))
        | text.contains("AKIA")
        | text.rlike(f"{HEX[:-1]}{{{HEX_LEAST},}}")
    )

    def sample(rows: DataFrame) -> DataFrame:
        """Rows up to the n-th smallest key: only keys are sorted, no text is moved."""
        keys = rows.select(key.alias("_key")).orderBy("_key").limit(sample_documents)
        cut = keys.agg(F.max("_key").alias("cut")).first()["cut"]
        return rows.where(key <= F.lit(cut))

    secret = with_base(sample(marked), ["doc_id"]).select(
        F.lit(1).alias("label"), F.explode(F.concat("assign", "access", "hex")).alias("s")
    )
    secret = secret.select("label", F.col("s.value").alias("value"))
    unmarked = F.regexp_replace(
        F.regexp_replace("text", ASSIGN, " "), f"{ACCESS}|{HEX[:-1]}{{{HEX_LEAST},}}", " "
    )
    ordinary = sample(texts).select(
        F.lit(0).alias("label"),
        F.explode(F.regexp_extract_all(unmarked, F.lit(f"({RUN}{{6,}})"), F.lit(1))).alias("value"),
    )
    counted = (
        secret.unionByName(ordinary)
        .select("label", F.explode(_steps(F.col("value"))).alias("step"))
        .groupBy("label", "step")
        .agg(F.count(F.lit(1)).alias("n"))
        .collect()
    )
    tables = []
    for label, prior in ((0, 0.1), (1, 2.0)):
        n = [[prior] * (SIGN + 1) for _ in range(STATES)]
        for r in counted:
            if r["label"] == label:
                n[r["step"] // STATES][r["step"] % STATES] += r["n"]
        tables.append([[math.log(x / sum(row)) for x in row] for row in n])
    ordinary_log, random_log = tables
    _allow_case(ordinary_log)
    # Signs join the words of paths and identifiers as they join parts of keys: they tell nothing.
    return [
        random_log[a][b] - ordinary_log[a][b] if a != SIGN and b < SIGN else 0.0
        for a in range(STATES)
        for b in range(STATES)
    ]


def scan_secrets(
    docs: DataFrame, keep: list[str] | None = None, margin: float = MARGIN, ratio: list[float] | None = None
) -> DataFrame:
    """``keep`` columns (doc_id by default) with the spans of each kind in every whole text.

    ``assign``, ``access`` and ``hex`` are the fixed patterns; ``random`` are further
    runs of ``RUN_LEAST`` and more characters, or pieces of runs beside such spans, whose
    log-likelihood ratio is at least ``margin`` per character. Null texts are empty and have no
    spans. Repeated rows are each scanned; an empty table gives none.
    """
    keep = keep or ["doc_id"]
    if ratio is None:
        ratio = fit_ratio(documents_of(docs, "doc_id", "text"))
    table = F.array(*[F.lit(x) for x in ratio])
    text = F.coalesce(F.col("text"), F.lit(""))

    def is_random(value: Column) -> Column:
        total = F.aggregate(_steps(value), F.lit(0.0), lambda acc, s: acc + F.get(table, s))
        return total >= margin * F.greatest(F.char_length(value), F.lit(FULL_RUN))

    rows = with_base(
        docs.select(*keep, *([] if "text" in keep else ["text"])).withColumn("text", text),
        [*dict.fromkeys([*keep, "text"])],
    )
    runs = _spans(
        F.col("text"),
        f"({RUN}{{{RUN_LEAST},}})",
        3,
        lambda m, v: (m != "") & (v.rlike(IN_BASE) | is_random(v)),
    )
    rows = rows.withColumn("runs", runs)
    pieces = F.flatten(
        F.transform("runs", lambda r: _outside(r, F.concat("assign", "access", "hex")))
    )
    random = F.filter(
        pieces, lambda r: (F.char_length(r["value"]) >= RUN_LEAST) & is_random(r["value"])
    )
    rows = rows.withColumn(
        "random", F.when(F.size("runs") > 0, random).otherwise(F.array().cast(SPAN))
    )
    return rows.select(*keep, "assign", "access", "hex", "random")


def spans_text(*spans: str) -> Column:
    """Spans as kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat(*spans))
    return F.array_join(
        F.transform(
            every,
            lambda s: F.concat_ws(
                ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")
            ),
        ),
        ",",
    )


def redact(docs: DataFrame, mask: str = "[secret]", margin: float = MARGIN) -> DataFrame:
    """The documents with every secret span replaced by ``mask``; all columns stay.

    A document without secrets keeps its text as it is, null included; ``n_chars``,
    if there is one, follows the new text. Overlapping spans become one mask.
    """
    names = docs.columns
    ratio = fit_ratio(documents_of(docs, "doc_id", "text"))
    found = scan_secrets(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "text"),
        ["_row", "text"],
        margin,
        ratio,
    )
    every = F.array_sort(F.concat("assign", "access", "hex", "random"))
    text = F.col("text")
    cleaned = F.aggregate(
        every,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda seen, s: F.when(
            s["start"] < seen["at"],
            F.struct(F.greatest(seen["at"], s["end"]).alias("at"), seen["out"].alias("out")),
        ).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(
                    seen["out"],
                    text.substr(seen["at"] + 1, s["start"] - seen["at"]),
                    F.lit(mask),
                ).alias("out"),
            )
        ),
        lambda seen: F.concat(seen["out"], text.substr(seen["at"] + 1, F.char_length(text))),
    )
    rows = found.withColumn("_dirty", F.size(every) > 0).withColumn(
        "_clean", F.when(F.col("_dirty"), cleaned)
    )
    out = {c: F.col("_row").getField(c) for c in names}
    new = {**out, "text": F.when(F.col("_dirty"), F.col("_clean")).otherwise(out["text"])}
    if "n_chars" in names:
        new["n_chars"] = (
            F.when(F.col("_dirty"), F.char_length("_clean").cast("long"))
            .otherwise(out["n_chars"])
        )
    return rows.select(*[new[c].alias(c) for c in names])
