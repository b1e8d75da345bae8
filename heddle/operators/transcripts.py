"""Replays recorded agent transcripts: how each one ended, after how many steps, and whether its answer is grounded in what it had seen.

A transcript is a run of turns. Turns of the assistant are replies, one step each; the turns before the first reply are the task, and those between a reply and the
next one answer it. A reply with a code block was run: what answers it is an observation. Nothing is run here; a call of FINAL that stands in the first
block counts as made. The rules of the recorded loop:

    code without FINAL              goes on
    code, FINAL of a variable       ends: final_called
    code, FINAL of a literal        ends: final_called, if the literal is in the task or an observation up to this step; else a nudge
    prose, FINAL of a literal       ends: final_in_prose, if it is not empty and in the task or an earlier observation; else a nudge
    prose, FINAL_VAR                ends: final_var_in_prose
    other prose                     a nudge
    more nudges than allowed        ends: gave_up_no_code for other prose, else ungrounded_final
    no reply left                   ends: max_steps

The state is two running sums over a transcript's narrow rows, so it is a window, not a loop; texts are looked at where they are read. Only a
transcript's first literals can matter - each one ends it or is a nudge - so no more than allowed + 1 of them meet its observations. Turns without
a transcript's id belong to none and are left out; a null role or text is empty, a null turn number comes first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The code fence, the two calls and the names of the ends. A literal is sought from the first opening alone: what closes a later one closes that
#: one too, so no text is scanned once for each opening.
CODE = r"(?s)```(?:python|repl|py)?[ \t]*\n?(.*?)```"
QUOTE = "(?:\"\"\"|'''|\"|')"
FINAL_LITERAL = rf"(?s)\A(?>.*?FINAL\(\s*+(?=[\"'])){QUOTE}(.*?){QUOTE}\s*\)"
FINAL_VARIABLE = r"FINAL_VAR\(\s*[\"'](\w+)[\"']\s*\)"
FINAL_CALL = r"\bFINAL(?:_VAR)?\("


def _trim(x: Column) -> Column:
    return F.btrim(x, F.lit(" \t\n\x0b\f\r"))


def steps(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """by, turn (its number), step (0 for the task, else the reply that it is or answers), reply (boolean), kind, answer, blocks and text of each turn."""
    within = Window.partitionBy(by).orderBy(F.col(order).asc_nulls_first())
    said = F.coalesce(F.col(text), F.lit(""))
    rows = turns.where(F.col(by).isNotNull()).select(by, F.col(order).alias("turn"), (F.coalesce(F.col(role), F.lit("")) == "assistant").alias("reply"), said.alias("text"))
    rows = rows.withColumn("blocks", F.when(F.col("reply"), F.regexp_extract_all("text", F.lit(CODE), F.lit(1))).otherwise(F.array().cast("array<string>")))
    code = F.get("blocks", F.lit(0))
    ran = F.size("blocks") > 0
    rows = rows.withColumns({"literal": F.get(F.regexp_extract_all(F.when(ran, code).otherwise(F.col("text")), F.lit(FINAL_LITERAL), F.lit(1)), F.lit(0)), "code": code})
    kind = F.when(~F.col("reply"), "turn").when(ran & F.col("literal").isNotNull(), "code_literal").when(ran & F.col("code").rlike(FINAL_CALL), "code_final").when(ran, "code")
    kind = kind.when(F.col("literal").isNotNull(), "prose_literal").when(F.col("text").rlike(FINAL_VARIABLE), "prose_variable").otherwise("prose")
    rows = rows.withColumn("kind", kind)
    answer = F.when(F.col("kind") == "code_literal", F.col("literal")).when(F.col("kind") == "prose_literal", _trim(F.col("literal"))).when(F.col("kind") == "prose", _trim(F.col("text")))
    rows = rows.select(by, "turn", "reply", "kind", answer.alias("answer"), F.size("blocks").alias("blocks"), "text")
    return rows.withColumn("step", F.sum(F.col("reply").cast("int")).over(within))


def replay(turns: DataFrame, by: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", nudges: int = 2, max_steps: int | None = None) -> DataFrame:
    """One row for each transcript: by, end, steps (replies up to the end), code_steps, nudges, ignored_blocks (those after a reply's first), observed (characters of
    the observations up to the end), answer and grounded (of an answer that is a literal). A transcript without a reply ends after no step at max_steps."""
    rows = steps(turns, by, order, role, text)
    if max_steps is not None:
        rows = rows.where(F.col("step") <= max_steps)
    replies = rows.where("reply").drop("text", "reply")
    literal = F.col("kind").isin("code_literal", "prose_literal")
    first = Window.partitionBy(by).orderBy("step")
    asked = replies.where(literal).withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= nudges + 1).select(by, "step", "kind", "answer")
    ran = F.max(F.col("kind").startswith("code")).over(Window.partitionBy(by, "step"))  # no union of parts: where both lie by transcript, Spark 4.1 counts its partitions wrong
    seen = rows.withColumn("ran", ran).where(~F.col("reply") & ((F.col("step") == 0) | F.col("ran"))).select(by, F.col("step").alias("at"), "text")
    within = (F.col("at") < F.col("step")) | ((F.col("at") == F.col("step")) & (F.col("kind") == "code_literal"))
    found = asked.join(seen, by).where(within & F.contains("text", "answer") & ((F.col("answer") != "") | (F.col("kind") == "code_literal"))).select(by, "step").distinct()
    marked = replies.join(found.withColumn("found", F.lit(True)), [by, "step"], "left").withColumn("found", F.coalesce("found", F.lit(False)) | ((F.col("kind") == "code_literal") & (F.col("answer") == "")))
    nudge = (F.col("kind") == "prose") | (literal & ~F.col("found"))
    run = Window.partitionBy(by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumns({"nudges": F.sum(nudge.cast("int")).over(run), "code_steps": F.sum(F.col("kind").startswith("code").cast("int")).over(run), "ignored": F.sum(F.greatest(F.col("blocks") - 1, F.lit(0))).over(run)})
    end = (
        F.when(nudge & (F.col("nudges") > nudges), F.when(F.col("kind") == "prose", "gave_up_no_code").otherwise("ungrounded_final"))
        .when(nudge, None)
        .when(F.col("kind").isin("code_literal", "code_final"), "final_called")
        .when(F.col("kind") == "prose_literal", "final_in_prose")
        .when(F.col("kind") == "prose_variable", "final_var_in_prose")
    )
    marked = marked.withColumn("end", end)
    columns = ["end", "nudges", "code_steps", "ignored", "kind", "answer", "found"]
    closing = F.coalesce(F.min(F.when(F.col("end").isNotNull(), F.struct("step", *columns))), F.max(F.struct("step", *columns)))  # the first end, or else the last reply
    ends = marked.groupBy(by).agg(closing.alias("e"))
    every = rows.select(by).distinct().join(ends, by, "left").withColumn("steps", F.coalesce("e.step", F.lit(0)))
    lengths = seen.where("at > 0").select(by, "at", F.length("text").alias("chars")).join(every.select(by, "steps"), by).where("at <= steps").groupBy(by).agg(F.sum("chars").alias("observed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    ended = F.col("e.end").isNotNull() & (F.col("e.end") != "ungrounded_final")
    return every.join(lengths, by, "left").select(
        by,
        F.coalesce("e.end", F.lit("max_steps")).alias("end"),
        F.col("steps").cast("long").alias("steps"),
        zero("e.code_steps").alias("code_steps"),
        zero("e.nudges").alias("nudges"),
        zero("e.ignored").alias("ignored_blocks"),
        zero("observed").alias("observed"),
        F.when(ended, F.col("e.answer")).alias("answer"),
        F.when(ended & F.col("e.kind").isin("code_literal", "prose_literal"), F.col("e.found")).alias("grounded"),
    )
