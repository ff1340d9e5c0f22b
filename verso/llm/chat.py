"""Chat formatting into budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut each conversation into turn-aligned spans. A
window shows the system turn, then as much of the preceding history as the
history budget allows, then its span; only the assistant texts of the span are
targets, so a repeated turn is never trained on twice.

Template: ``<s>role newline text</s>`` for each turn. Control strings inside
roles and texts are broken by an escape mark, reversibly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verso.llm.common import let, table

OPEN, CLOSE = "<s>", "</s>"
#: Strings with a meaning in this or another chat template.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|")
#: The escape mark; followed by 0 it stands for itself, by 1 for nothing, by 2 for a newline in a role.
MARK = "\x1b"
#: Tokens that the template itself takes of each turn.
TURN = 3


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(MARK), F.lit(MARK + "0"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + MARK + "1" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK + "1"), F.lit("")), F.lit(MARK + "0"), F.lit(MARK))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(MARK + "2"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(MARK + "2"), F.lit("\n")))


def count_tokens(text: Column) -> Column:
    """Words and single signs; a stand-in for a tokenizer that stays in the engine."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}])"), F.lit(1))).cast("long")


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """``conv_id, turn, role, text`` to windows ``conv_id, window, n_context, tokens, formatted, mask``.

    A window holds at most ``budget`` tokens unless one turn alone with the
    system turn exceeds it; no turn is cut or left out. ``n_context`` turns at
    its start repeat earlier ones. ``mask`` lists ``(start, length)`` of the
    target texts in code points of ``formatted``. Null text and null role count
    as empty; equal turn numbers are ordered by role and text; a null conv_id
    is a conversation of its own; an empty table gives no windows.
    """
    row = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    row = row.withColumns({"role_out": escape_role(F.col("role")), "text_out": escape(F.col("text"))})
    row = row.withColumn("tokens", count_tokens(F.concat("role", F.lit(" "), "text")) + TURN)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    row = row.withColumn("n", F.row_number().over(order)).withColumn("system", (F.col("n") == 1) & (F.col("role") == "system"))
    row = row.withColumn("end", F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    conv = row.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "system", "role_out", "text_out", "tokens", "end"))).alias("all"))
    conv = conv.withColumns({"head": F.filter("all", lambda t: t["system"]), "body": F.filter("all", lambda t: ~t["system"])})
    conv = conv.withColumn("room", F.lit(budget) - F.coalesce(F.get("head", F.lit(0))["tokens"], F.lit(0)))

    def step(state: Column, t: Column, room: Column) -> Column:
        fits = t["end"] - state["from"] <= room - F.when(F.size(state["cuts"]) > 1, F.lit(history)).otherwise(F.lit(0))
        opens = (F.size(state["cuts"]) == 0) | (~fits & state["filled"])
        return F.struct(
            F.when(opens, t["end"] - t["tokens"]).otherwise(state["from"]).alias("from"),
            F.lit(True).alias("filled"),
            F.when(opens, F.concat(state["cuts"], F.array(state["i"]))).otherwise(state["cuts"]).alias("cuts"),
            (state["i"] + 1).alias("i"),
        )

    start = F.struct(F.lit(0).cast("long").alias("from"), F.lit(False).alias("filled"), F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("i"))
    cuts = F.aggregate("body", start, lambda s, t: step(s, t, F.col("room")), lambda s: s["cuts"])
    # a conversation of a system turn alone is one window without a span
    conv = conv.withColumn("cuts", cuts).withColumn("cuts", F.when(F.size("cuts") == 0, F.array(F.lit(0))).otherwise(F.col("cuts")))

    def window(cut: Column, i: Column) -> Column:
        size = F.coalesce(F.get("cuts", i + 1), F.size("body")) - cut
        span = F.slice("body", cut + 1, size)
        begin = F.get("body", cut)["end"] - F.get("body", cut)["tokens"]
        spent = F.coalesce(F.get("body", cut + size - 1)["end"] - begin, F.lit(0).cast("long"))
        left = F.least(F.lit(history).cast("long"), F.col("room") - spent)
        many = F.least(cut, F.lit(history // TURN + 1))  # no more turns can fit, as each has TURN tokens at least
        past = F.filter(F.slice("body", cut - many + 1, many), lambda t: begin - (t["end"] - t["tokens"]) <= left)
        return F.struct(i.alias("window"), past.alias("past"), span.alias("span"))

    one = conv.select("conv_id", "head", F.explode(F.transform("cuts", window)).alias("w")).select("conv_id", "head", "w.*")
    shown = F.concat("head", "past", "span")
    one = one.withColumn("n_context", F.when(F.col("window") == 0, F.lit(0)).otherwise(F.size("head")) + F.size("past"))
    one = one.withColumn("shown", shown).withColumn("line", F.transform("shown", lambda t: F.concat(F.lit(OPEN), t["role_out"], F.lit("\n"), t["text_out"], F.lit(CLOSE))))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))

    def place(state: Column, t: Column, i: Column) -> Column:
        at = state["at"] + len(OPEN) + F.length(t["role_out"]) + 1
        target = (t["role_out"] == "assistant") & (i >= F.col("n_context"))
        spot = F.array(F.struct(at.alias("start"), F.length(t["text_out"]).alias("length")))
        return F.struct((at + F.length(t["text_out"]) + len(CLOSE)).alias("at"), F.when(target, F.concat(state["mask"], spot)).otherwise(state["mask"]).alias("mask"))

    numbered = F.transform("shown", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    mask = F.aggregate(numbered, begin, lambda s, x: place(s, x["t"], x["i"]), lambda s: s["mask"])
    tokens = F.aggregate("shown", F.lit(0).cast("long"), lambda a, t: a + t["tokens"])
    return one.select("conv_id", "window", "n_context", tokens.alias("tokens"), F.array_join("line", "").alias("formatted"), mask.alias("mask"))


def read_windows(windows: DataFrame) -> DataFrame:
    """Conversations read back from their windows: ``conv_id, n_turns, turns, loss, formatted_chars``.

    ``turns`` has every turn once as role and text, ``loss`` the unescaped
    text under the masks, both in order. Only the formatted strings, masks and
    counts of repeated turns are used.
    """
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    own = F.slice(pieces, F.col("n_context") + 1, F.greatest(F.size(pieces) - F.col("n_context"), F.lit(0)))

    def parse(piece: Column) -> Column:
        return let(F.instr(piece, F.lit("\n")), lambda at: F.struct(unescape_role(F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)).alias("role"), unescape(F.substring(piece, at + 1, F.length(piece))).alias("text")))

    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substring(F.col("formatted"), m["start"] + 1, m["length"]))), "")
    part = windows.select("conv_id", "window", F.transform(own, parse).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = part.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    return whole.select("conv_id", F.flatten(F.transform("parts", lambda p: p["turns"])).alias("turns"), F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"), "formatted_chars")


def op8_chat(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation as read back from its windows; nulls, ties, repeated rows, long texts and empty tables as in ``format_windows``."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    back = read_windows(format_windows(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss"), 256).alias("loss_sha256"), "formatted_chars"
    )
