"""Repair of conversations by dynamic programming over runs of rows (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.common import kept, key_text, read, spread_join, text_key

#: States of `(s?(ua)+)?` by the role that came last: none, s, u, a. Where a role of each initial leads, and where an inserted one does.
STATES = 4
NEXT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
INSERTED = (2, 2, 3, 2)
#: Costs of edits, and letters in the audit's order of ties (ASCII).
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Cost of what is missing after the last row, by state, and the letters for it.
AT_END, LAST_EDITS = (0, 6, 3, 0), ("", "II", "I", "")
FAR = 1 << 60
#: Rows of a conversation that are worked on together, and blocks of a run whose letters are remembered, as a power of two.
SEGMENT_BITS, REMEMBERED = 14, 8
Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def edits(symbol: str, state: int) -> list[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with a row: X must go, a capital is truncated, other letters are role initials (o: any other)."""
    out = [("D", DELETE, state)]
    if symbol == "X":
        return out
    more = TRUNCATED if symbol.isupper() else 0
    to = NEXT.get(symbol.lower(), (None,) * STATES)[state]
    if to is not None:
        out.append(("K", more, to))
    return [*out, ("R", REROLE + more, INSERTED[state])]


def with_insertions(costs: Sequence[int]) -> Vector:
    """Costs where roles may be inserted first."""
    out = list(costs)
    for _ in range(STATES):
        out = [min(c, INSERT + out[INSERTED[s]]) for s, c in enumerate(out)]
    return tuple(out)


@lru_cache(maxsize=None)
def power(symbol: str, k: int) -> Matrix:
    """Least costs from state to state over 2 ** k rows of a symbol: min-plus squares of one row's transition."""
    if k:
        return product(power(symbol, k - 1), power(symbol, k - 1))
    columns = []
    for t in range(STATES):
        columns.append(with_insertions([min((c for _, c, to in edits(symbol, s) if to == t), default=FAR) for s in range(STATES)]))
    return tuple(zip(*columns, strict=True))


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(FAR, *(a[s][m] + b[m][t] for m in range(STATES))) for t in range(STATES)) for s in range(STATES))


def before(m: Matrix, after: Vector) -> Vector:
    """Costs to the end ahead of rows, from those behind them."""
    return tuple(min(m[s][t] + after[t] for t in range(STATES)) for s in range(STATES))


def blocks(length: int) -> list[int]:
    """Powers of two that add up to a length, the largest first."""
    return [k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]


def runs(symbols: str) -> list[tuple[str, int]]:
    return [(x, len(list(same))) for x, same in groupby(symbols)]


def advanced(symbols: str) -> Matrix:
    """The transition over rows, run by run."""
    out = tuple(tuple(0 if s == t else FAR for t in range(STATES)) for s in range(STATES))
    for symbol, length in runs(symbols):
        for k in blocks(length):
            out = product(out, power(symbol, k))
    return out


def _letters(symbol: str, k: int, after: Vector, state: int) -> tuple[str, int]:
    """The letters of the cheapest edits of 2 ** k rows, ASCII-least, and the state behind them."""
    if k:
        middle = before(power(symbol, k - 1), after)
        one, state = letters(symbol, k - 1, middle, state)
        two, state = letters(symbol, k - 1, after, state)
        return one + two, state
    here, out = before(power(symbol, 0), after), ""
    while True:
        ways = [(letter, to) for letter, cost, to in edits(symbol, state) if cost + after[to] == here[state]]
        if INSERT + here[INSERTED[state]] == here[state]:
            ways.append(("I", INSERTED[state]))
        letter, state = min(ways)
        out += letter
        if letter != "I":
            return out, state


@lru_cache(maxsize=1 << 16)
def _remembered(symbol: str, k: int, after: Vector, state: int) -> tuple[str, int]:
    return _letters(symbol, k, after, state)


def letters(symbol: str, k: int, after: Vector, state: int) -> tuple[str, int]:
    least = min(after)
    return (_remembered if k <= REMEMBERED else _letters)(symbol, k, tuple(x - least for x in after), state)


def unrolled(symbols: str, after: Vector) -> tuple[list[str], list[int]]:
    """For each state ahead of rows: the letters of their edits, and the state behind. after: costs to the end behind the rows."""
    steps = []
    for symbol, length in reversed(runs(symbols)):
        for k in reversed(blocks(length)):
            steps.append((symbol, k, after))
            after = before(power(symbol, k), after)
    texts, ends = [], []
    for state in range(STATES):
        out = []
        for symbol, k, behind in reversed(steps):
            some, state = letters(symbol, k, behind, state)
            out.append(some)
        texts.append("".join(out))
        ends.append(state)
    return texts, ends


def applied(letters: str, roles: Sequence[str], texts: Sequence[str], last: str) -> list[tuple[str, str]]:
    """Roles and texts after a row's edits. last: the initial of the role ahead."""
    out, k = [], 0
    for letter in letters:
        new = "assistant" if last == "u" else "user"
        if letter == "I":
            out.append((new, ""))
        else:
            if letter != "D":
                out.append((roles[k] if letter == "K" else new, texts[k]))
            k += 1
        if letter != "D":
            last = out[-1][0][:1]
    return out


def in_order(rows: DataFrame) -> DataFrame:
    """The rows of all conversations in one order, with a number `pos` that grows along it: by conv_id, turn (nulls first), role and text (by 64 characters, then a hash). Written once, so that all steps see the same numbers.

    Ranges of that order are dealt out, so a conversation may be of any length, and equal rows any share of all.
    """
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    some = some.withColumn("conv", key_text(F.col("conv_id"))).withColumn("same", text_key(F.concat("conv", F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")))
    some = some.withColumns({"r": F.substring("role", 1, 64), "t": F.substring("text", 1, 64), "row": F.monotonically_increasing_id()})
    key = ["conv_id", "turn", "r", "t", "same", "row"]
    return kept(some.repartitionByRange(*key).sortWithinPartitions(*key).drop("r", "t", "row").withColumn("pos", F.monotonically_increasing_id()), "turns")


def marked(ordered: DataFrame) -> DataFrame:
    """conv, turn, pos, segment, initial, fault (of each row the first of blank, duplicate, truncated) and symbol, without the texts."""
    again = ordered.groupBy("same").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = spread_join(ordered.select("same", "pos"), again.select("same", "first"), ["same"], ["pos"]).where("pos > first").select("pos", F.lit(True).alias("later"))
    text = F.col("text")
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    some = ordered.select("conv", "turn", "pos", F.shiftright("pos", SEGMENT_BITS).alias("segment"), F.substring("role", 1, 1).alias("initial"), (~F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]"))).alias("empty"), (~last.isin(".", "!", "?")).alias("open"))
    fault = F.when(F.col("empty"), "blank").when(F.col("later"), "duplicate").when(F.col("open"), "truncated")
    initial = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    some = some.join(later, "pos", "left").withColumn("fault", fault)
    return some.withColumn("symbol", F.when(F.col("fault").isin("blank", "duplicate"), "X").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)).drop("empty", "open", "later")


def _gathered(rows: DataFrame, by: Sequence[str], order: str, *columns: str) -> DataFrame:
    """A row for each key with its columns as arrays, in an order."""
    all_of = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("all"))
    return all_of.select(*by, *[F.col(f"all.{c}").alias(c) for c in (order, *columns)])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that a model can be trained on, by the cheapest edits.

    Roles have to read `(s?(ua)+)?` by their initials. Keeping a row costs 0 and needs that its role fits; giving it the role user or
    assistant 3, deleting it 4, inserting an empty row of user or assistant 3. Blank rows (no character but blanks) and duplicates (role and text
    of an earlier row) have to be deleted; a truncated one (its last other character is not one of .!?) that stays costs 3 more.
    Among edits of one cost those count whose letters (D, I, K, R) are ASCII-least.

    Returns a row per conversation (conv, conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit), and the repaired turns
    a row per segment of a conversation (conv, segment, turns: role and text).

    Equal neighbouring symbols (initial of the role, and fault) are one run, and powers of two of its min-plus transition take it
    in steps that depend on the logarithm of its length. A conversation may be of any length: segments of 2 ** SEGMENT_BITS rows
    know their own transitions, the conversation joins those, and then each segment unrolls its letters for every state it may begin in.

    Nulls: a null role or text is one blank, null turns come first, and rows of a null conv_id are one conversation. Repeated rows are
    duplicates. An empty table gives none. Other columns are not read.
    """
    ordered = in_order(rows)
    marks = kept(marked(ordered), "marks")
    segments = kept(_gathered(marks, ["conv", "segment"], "pos", "symbol", "initial").select("conv", "segment", F.array_join("symbol", "").alias("symbols"), "initial"), "segments")

    def transitions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            wrong = [sum(a + b not in ("su", "ua", "au") for a, b in zip(x[:-1], x[1:], strict=True)) for x in f["initial"]]
            yield pd.DataFrame({"conv": f["conv"], "segment": f["segment"], "way": [[c for line in advanced(s) for c in line] for s in f["symbols"]], "wrong": wrong, "first": [x[0] for x in f["initial"]], "last": [x[-1] for x in f["initial"]]})

    ways = segments.mapInPandas(transitions, "conv string, segment long, way array<long>, wrong long, first string, last string")

    def suffixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                after = AT_END
                behind = []
                for way in reversed(list(row.way)):
                    behind.append(list(after))
                    after = before(tuple(tuple(int(x) for x in way[STATES * s : STATES * s + STATES]) for s in range(STATES)), after)
                wrong = sum(row.wrong) + sum(a + b not in ("su", "ua", "au") for a, b in zip(row.last[:-1], row.first[1:], strict=True))
                out.append((row.conv, list(row.segment), behind[::-1], after[0], wrong))
            yield pd.DataFrame(out, columns=["conv", "segments", "behind", "cost", "illegal"])

    whole = kept(_gathered(ways, ["conv"], "segment", "way", "wrong", "first", "last").mapInPandas(suffixes, "conv string, segments array<long>, behind array<array<long>>, cost long, illegal long"), "costs")
    behind = whole.select("conv", F.explode(F.arrays_zip("segments", "behind")).alias("s")).select("conv", F.col("s.segments").alias("segment"), F.col("s.behind").alias("behind"))

    def unroll(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [unrolled(s, tuple(int(x) for x in b)) for s, b in zip(f["symbols"], f["behind"], strict=True)]
            yield pd.DataFrame({"conv": f["conv"], "segment": f["segment"], "texts": [d[0] for d in done], "ends": [d[1] for d in done]})

    choices = segments.select("conv", "segment", "symbols").join(behind, ["conv", "segment"]).mapInPandas(unroll, "conv string, segment long, texts array<string>, ends array<int>")

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                state, picked, ahead = 0, [], []
                for texts, ends in zip(row.texts, row.ends, strict=True):
                    ahead.append(state)
                    picked.append(texts[state])
                    state = int(ends[state])
                picked[-1] += LAST_EDITS[state]
                out.append((row.conv, list(row.segment), picked, ahead))
            yield pd.DataFrame(out, columns=["conv", "segments", "letters", "ahead"])

    plans = kept(_gathered(choices, ["conv"], "segment", "texts", "ends").mapInPandas(chosen, "conv string, segments array<long>, letters array<string>, ahead array<int>"), "edits")
    pieces = plans.select("conv", F.explode(F.arrays_zip("segments", "letters", "ahead")).alias("s")).select("conv", F.col("s.segments").alias("segment"), F.col("s.letters").alias("letters"), F.col("s.ahead").alias("ahead"))

    def edit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [applied(row.letters, row.role, row.text, "-sua"[row.ahead]) for row in f.itertuples(index=False)]
            yield pd.DataFrame({"conv": f["conv"], "segment": f["segment"], "turns": [[{"role": a, "text": b} for a, b in d] for d in done]})

    texts = _gathered(ordered.withColumn("segment", F.shiftright("pos", SEGMENT_BITS)), ["conv", "segment"], "pos", "role", "text")
    turns = texts.join(pieces, ["conv", "segment"]).mapInPandas(edit, "conv string, segment long, turns array<struct<role:string,text:string>>")

    faults = marks.groupBy("conv").agg(*[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    steps = marks.where("turn IS NOT NULL").select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    names = plans.select("conv", F.when(F.col("conv") != "null", F.col("conv").cast("long")).alias("conv_id"), F.array_join("letters", "").alias("audit"))
    found = names.join(whole.select("conv", "cost", "illegal"), "conv").join(faults, "conv").join(steps, "conv", "left").na.fill(0, ["gaps"])
    return found, turns


def turns_hash(turns: DataFrame) -> DataFrame:
    """conv, sha: the SHA-256 of `role:text` of a conversation's turns, with line breaks between. A running hash in the order of the segments, so no conversation is held whole."""

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, sha, ahead = None, hashlib.sha256(), b""
        for f in frames:
            out = []
            for name, some in zip(f["conv"], f["turns"], strict=True):
                if name != conv:
                    if conv is not None:
                        out.append((conv, sha.hexdigest()))
                    conv, sha, ahead = name, hashlib.sha256(), b""
                for t in some:
                    sha.update(ahead + f"{t['role']}:{t['text']}".encode())
                    ahead = b"\n"
            yield pd.DataFrame(out, columns=["conv", "sha"])
        if conv is not None:
            yield pd.DataFrame([(conv, sha.hexdigest())], columns=["conv", "sha"])

    return turns.repartition("conv").sortWithinPartitions("conv", "segment").mapInPandas(hashed, "conv string, sha string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with the faults that operator 13 is tried on, by a hash of conv_id and turn: some are dropped, emptied, cut short, repeated or given to the user."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    some = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))), F.lit(20)).alias("hit")).where("hit > 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    return some.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def op13_run_length_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    found, turns = repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", key_text(F.col("conv_id")))
    out = every.join(found.drop("conv_id"), "conv", "left").join(turns_hash(turns), "conv", "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))


def _put(x: str, cost: str, letter: str, line: str | None) -> str:
    """SQL: a way x (cost in 8 digits, letters, a character below all letters, lines) with an edit more."""
    cut = f"instr({x}, chr(1))"
    return f"lpad((substr({x}, 1, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({x}, 9, {cut} - 9) || '{letter}' || substr({x}, {cut})" + (f" || chr(10) || {line}" if line else "")


#: The least string is the cheapest way, and of those the one of least letters: one way to each state, row by row.
SQL = rf"""
WITH RECURSIVE tbl AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
h AS (SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM src, tbl),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN hit = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE hit > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k FROM d),
q AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS cut, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS later, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY k) AS ahead FROM o),
f AS (SELECT *, CASE WHEN cut = '' THEN 'blank' WHEN later THEN 'duplicate' WHEN right(cut, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM q),
way AS (SELECT conv_id, 0::BIGINT AS k, '00000000' || chr(1) AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, NULL::VARCHAR AS s3 FROM f GROUP BY conv_id
  UNION ALL SELECT conv_id, k, {_put("m0", "4", "D", None)}, least({_put("m1", "4", "D", None)}, CASE WHEN NOT must AND i = 's' THEN {_put("m0", "more", "K", "line")} END),
    least({_put("m2", "4", "D", None)}, CASE WHEN NOT must AND i = 'u' THEN {_put("mu", "more", "K", "line")} END, CASE WHEN NOT must THEN {_put("mu", "more + 3", "R", "'user:' || text")} END),
    least({_put("m3", "4", "D", None)}, CASE WHEN NOT must AND i = 'a' THEN {_put("m2", "more", "K", "line")} END, CASE WHEN NOT must THEN {_put("m2", "more + 3", "R", "'assistant:' || text")} END)
  FROM (SELECT *, least(m0, m1, m3) AS mu FROM (SELECT *, least(s3, {_put("m2", "3", "I", "'assistant:'")}) AS m3 FROM (SELECT *, s0 AS m0, s1 AS m1, least(s2, {_put("sx", "3", "I", "'user:'")}) AS m2 FROM (
    SELECT w.s0, w.s1, w.s2, w.s3, least(w.s0, w.s1, w.s3) AS sx, f.conv_id, f.k, f.text, f.fault IN ('blank', 'duplicate') AS must, f.role[1:1] AS i, f.role || ':' || f.text AS line, CASE WHEN f.fault = 'truncated' THEN 3 ELSE 0 END AS more
    FROM way w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.k = w.k + 1))))),
best AS (SELECT conv_id, least(s0, s3, {_put("s2", "3", "I", "'assistant:'")}, {_put("s1", "6", "II", "'user:' || chr(10) || 'assistant:'")}) AS x FROM way QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
c AS (SELECT conv_id, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE ahead || role[1:1] NOT IN ('su', 'ua', 'au')) AS illegal, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(substr(x, 1, 8)::BIGINT, 0) AS cost, coalesce(substr(x, 9, instr(x, chr(1)) - 9), '') AS audit, sha256(coalesce(substr(x, instr(x, chr(1)) + 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
