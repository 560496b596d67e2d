"""Chat formatting with a grammar that reads back what it wrote.

    text := turn*          turn := "[INST]" role "[/INST]" words "</s>"

Control strings inside roles and words get a backslash after their first character, backslashes are doubled before
that. A conversation is rendered plainly first and parsed again; where the parse differs from the source, the escaped
form is taken, which is parsed and compared too; a form that still differs is an error.

Rows are ordered by turn (nulls first), then role and text. Null roles and texts are empty. Repeated rows are turns of
their own. A null conv_id is one conversation. Columns beyond conv_id, turn, role, text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MID, END = "[INST]", "[/INST]", "</s>"
CONTROL = (END, OPEN, MID)
PROBE = "</s>[INST] ok [/INST]"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    for s in CONTROL:
        c = F.replace(c, F.lit(s[0] + "\\" + s[1:]), F.lit(s))
    return F.replace(c, F.lit("\\\\"), F.lit("\\"))


def render(turns: Column, change) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), change(t["role"]), F.lit(MID), change(t["text"]), F.lit(END))), "")


def parse(text: Column) -> Column:
    """Turns (role, text) and where the text of each stands in the formatted string (start, size in code points)."""
    parts = F.filter(F.split(text, END, -1), lambda x, i: x != "")

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substring(part, len(OPEN) + 1, 2**31 - 1), MID, 1)
        words = F.substring(part, F.length(role) + len(OPEN) + len(MID) + 1, F.length(part))
        return F.struct(unescape(role).alias("role"), unescape(words).alias("text"))

    return F.transform(parts, turn)


def spans(formatted: Column) -> Column:
    """(start, size) of each turn's text in the formatted string, in code points from 1."""
    parts = F.filter(F.split(formatted, END, -1), lambda x, i: x != "")
    place = F.transform(parts, lambda p: F.struct(F.length(p).cast("long").alias("all"), F.instr(p, MID).cast("long").alias("mid")))
    none = F.expr("cast(array() as array<struct<start:bigint,size:bigint>>)")
    step = lambda acc, p: F.struct(
        (acc["at"] + p["all"] + len(END)).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + p["mid"] + len(MID)).alias("start"), (p["all"] - p["mid"] - len(MID) + 1).alias("size")))).alias("out"),
    )
    return F.aggregate(place, F.struct(F.lit(0).cast("long").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (parsed back) and loss (start and size of each assistant text in formatted)."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    source = whole.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    plain = source.withColumn("plain", render(F.col("source"), lambda c: c)).withColumn("fits", parse(F.col("plain")) == F.col("source"))
    made = plain.select("conv_id", "source", F.when(F.col("fits"), F.col("plain")).otherwise(render(F.col("source"), escape)).alias("formatted"))
    read = made.withColumn("turns", parse(F.col("formatted")))
    read = read.withColumn("turns", F.when(F.col("turns") == F.col("source"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation could not be read back"))))
    loss = F.transform(F.filter(F.arrays_zip(F.col("turns").alias("turn"), spans(F.col("formatted")).alias("span")), lambda x: x["turn"]["role"] == "assistant"), lambda x: x["span"])
    return read.select("conv_id", "formatted", "turns", loss.alias("loss"))


def report(chats: DataFrame) -> DataFrame:
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int"), s["size"].cast("int")))), "")
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose two texts are made of control strings."""
    spark = conversations.sparkSession
    probe = spark.sql(f"SELECT CAST(-1 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, '{PROBE}' text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)
