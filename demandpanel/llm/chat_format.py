"""Conversations as budgeted training windows, with DataFrame functions only.

Prefix sums of turn tokens place every turn in a quantum of the new-token budget;
the turns of a quantum are a window, a turn longer than the quantum is one alone.
A window opens with the conversation's system turn, repeats the turns just before
it that fit into the history budget, and trains on its new assistant turns only.
Prefix sums are taken in blocks of turns and shifted by the blocks' totals, and
repeated turns meet their windows by (conversation, quantum), so a long
conversation is never gathered; a window is bounded by the budget.

A turn is START role MIDDLE text END. Control strings inside roles and texts are
escaped: backslashes are doubled, then one is put after the first character of
each control string, so that a run of odd length marks an escape.

Defined results: null roles and texts are empty; turns that share a number are
ordered by role and text; null turn numbers come first; rows with a null conv_id
are one conversation; a system turn beyond its reserve, and a turn beyond its
quantum, stay whole and make a longer window; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

START, MIDDLE, END = "<|turn|>", "<|says|>", "<|done|>"
#: Strings that no text may hold unescaped; none begins with another.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Tokens of a window, of these for repeated history, and for the system turn.
BUDGET, HISTORY, RESERVE = 1024, 192, 192
#: Tokens a turn takes beside its text, and bytes of text in a token.
PER_TURN, BYTES = 4, 4
#: Turn numbers in one block of the prefix sums.
BLOCK = 1024
SALTS = 16


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    out = text
    for control in CONTROL:
        out = F.replace(out, F.lit(f"{control[0]}\\{control[1:]}"), F.lit(control))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def quantum(budget: int = BUDGET, history: int = HISTORY, reserve: int = RESERVE) -> int:
    """Half of what is left for new turns: a window's turns start within one quantum and end within the next."""
    return max(1, (budget - history - reserve) // 2)


def _ordered(rows: DataFrame) -> DataFrame:
    """Turns with their place and the tokens before them, by blocks."""
    turns = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    inner = Window.partitionBy("conv", "block").orderBy("turn", "role", "text")
    part = turns.withColumns({"inside": F.sum("tokens").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "rank": F.row_number().over(inner)})
    outer = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv", "block").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).select(
        F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("t").over(outer), F.lit(0)).alias("before"),
        F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("ranks"))
    joined = part.join(totals, part["conv"].eqNullSafe(totals["c"]) & part["block"].eqNullSafe(totals["b"]))
    return joined.select("conv", "role", "text", "tokens", (F.col("ranks") + F.col("rank") - 1).alias("pos"),
                         (F.col("before") + F.col("inside") - F.col("tokens")).alias("begin"), (F.col("before") + F.col("inside")).alias("until"))


def windows(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, reserve: int = RESERVE) -> DataFrame:
    """(conv_id, window, n_repeated, text, loss): loss is an array of (start, length) in code points of text."""
    size = quantum(budget, history, reserve)
    turns = _ordered(rows.select(
        F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        (F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / BYTES) + PER_TURN).alias("tokens")))
    turns = turns.withColumn("window", 2 * F.floor(F.col("begin") / size) + (F.col("tokens") > size).cast("long"))
    piece = F.concat(F.lit(START), escaped(F.col("role")), F.lit(MIDDLE), escaped(F.col("text")), F.lit(END))
    turns = turns.withColumns({"piece": piece, "head": F.length(escaped(F.col("role"))) + len(START) + len(MIDDLE)})
    opening = (F.col("pos") == 0) & (F.col("role") == "system")

    made = turns.groupBy("conv", "window").agg(F.min("begin").alias("opens"), F.min("pos").alias("first"))
    near = made.select(F.col("conv").alias("c"), F.col("window").alias("w"), "opens", F.floor(F.col("opens") / size).alias("q"))
    past = turns.filter(~opening & (F.col("tokens") <= history)).withColumn(
        "quantum", F.explode(F.sequence(F.floor(F.col("until") / size), F.floor((F.col("begin") + history) / size))))
    again = past.join(near, past["conv"].eqNullSafe(near["c"]) & (past["quantum"] == near["q"])).filter(
        (F.col("opens") >= F.col("until")) & (F.col("opens") - F.col("begin") <= history))

    system = turns.filter(opening).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    later = made.filter("first > 0").select(F.col("conv").alias("c"), F.col("window").alias("w"), F.pmod("window", F.lit(SALTS)).alias("s"))
    kept = system.join(later, system["conv"].eqNullSafe(later["c"]) & (system["salt"] == later["s"]))

    own = ["pos", "role", "piece", "head"]
    segments = turns.select("conv", "window", *own, F.lit(True).alias("new")).unionByName(
        again.select("conv", F.col("w").alias("window"), *own, F.lit(False).alias("new"))).unionByName(
        kept.select("conv", F.col("w").alias("window"), *own, F.lit(False).alias("new")))
    parts = F.array_sort(F.collect_list(F.struct("pos", "new", "role", "piece", "head")))
    none = F.array().cast("array<struct<start:int,length:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(so_far: Column, part: Column) -> Column:
        span = F.struct((so_far["at"] + part["head"]).alias("start"), (F.length(part["piece"]) - part["head"] - len(END)).alias("length"))
        trained = part["new"] & (part["role"] == "assistant")
        return F.struct((so_far["at"] + F.length(part["piece"])).alias("at"),
                        F.when(trained, F.concat(so_far["spans"], F.array(span))).otherwise(so_far["spans"]).alias("spans"))

    return segments.groupBy("conv", "window").agg(parts.alias("parts")).select(
        F.col("conv").alias("conv_id"), "window", F.size(F.filter("parts", lambda p: ~p["new"])).alias("n_repeated"),
        F.array_join(F.col("parts.piece"), "").alias("text"), F.aggregate("parts", start, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One digest row a conversation, taken from the windows alone.

    The digest of a conversation needs its whole text in one row; only this report
    gathers it, ``windows`` does not.
    """
    pieces = F.split("text", r"\Q" + END + r"\E", -1)
    fresh = F.slice(pieces, F.col("n_repeated") + 1, F.size(pieces) - 1 - F.col("n_repeated"))

    def plain(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(START) + 1)), r"\Q" + MIDDLE + r"\E", -1)
        return F.concat(unescaped(halves[0]), F.lit("\n"), unescaped(halves[1]), F.lit("\n"))

    lost = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    each = formatted.select("conv_id", "window", F.size(fresh).cast("long").alias("n"), F.length("text").cast("long").alias("chars"),
                            F.array_join(F.transform(fresh, plain), "").alias("said"), F.array_join(lost, "").alias("trained"))
    ordered = F.array_sort(F.collect_list(F.struct("window", "said", "trained")))
    whole = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), ordered.alias("o")).select(
        "conv_id", "n_turns", "formatted_chars", F.array_join(F.col("o.said"), "").alias("said"), F.array_join(F.col("o.trained"), "").alias("trained"))
    return whole.select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
                        F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars")


def _sql_escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


def digest_sql(rows: str) -> str:
    """The same digests from the turns themselves, for ``rows``: a relation (conv_id, turn, role, text)."""
    size = quantum()
    return f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {rows}),
    k AS (SELECT *, (strlen(text) + {BYTES - 1}) // {BYTES} + {PER_TURN} AS tokens,
          {len(START) + len(MIDDLE) + len(END)} + length({_sql_escaped('role')}) + length({_sql_escaped('text')}) AS chars FROM t),
    o AS (SELECT *, row_number() OVER w - 1 AS pos, CAST(sum(tokens) OVER w AS BIGINT) AS until_ FROM k
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
    p AS (SELECT *, until_ - tokens AS begin_, 2 * ((until_ - tokens) // {size}) + CAST(tokens > {size} AS BIGINT) AS win FROM o),
    m AS (SELECT conv_id, win, min(begin_) AS opens, min(pos) AS first_ FROM p GROUP BY ALL),
    again AS (SELECT p.conv_id, sum(p.chars) AS chars FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.opens >= p.until_ AND m.opens - p.begin_ <= {HISTORY}
              WHERE NOT (pos = 0 AND role = 'system') GROUP BY 1),
    kept AS (SELECT p.conv_id, sum(p.chars) AS chars FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND m.first_ > 0 WHERE pos = 0 AND role = 'system' GROUP BY 1),
    d AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos) AS said,
          coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '') AS trained, sum(chars) AS chars FROM p GROUP BY 1)
    SELECT d.conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256,
           CAST(d.chars + coalesce(again.chars, 0) + coalesce(kept.chars, 0) AS BIGINT) AS formatted_chars
    FROM d LEFT JOIN again ON d.conv_id IS NOT DISTINCT FROM again.conv_id LEFT JOIN kept ON d.conv_id IS NOT DISTINCT FROM kept.conv_id"""
