"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is trainable. A turn
is written as `<|im_start|>role`, a line end, the text and `<|im_end|>` with a line end. Inside texts and roles a backslash is
doubled and `<|` becomes `<\\|`, so no control string of the template can occur there; in roles a line end becomes `\\n`.
`read_back` undoes this exactly.

A conversation that does not end with an assistant turn gets one last example with nothing trainable, so its output holds all turns.

Edge cases: null texts and roles are empty; turns are ordered by turn, then role, then text, so ties and repeated rows have one
order; a null conversation id is a conversation; an empty table gives no rows; other columns are ignored. Example k holds k turns,
so the output of a conversation grows with the square of its turns: that is the expansion itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
END_PATTERN = r"<\|im_end\|>\n"


def escape(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(s: Column) -> Column:
    return F.regexp_replace(s, r"\\([\\|])", "$1")


def escape_role(s: Column) -> Column:
    return F.replace(escape(s), F.lit("\n"), F.lit("\\n"))


def unescape_role(s: Column) -> Column:
    part = lambda p: F.replace(F.replace(p, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(s, r"\\\\", -1), part), "\\")


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, n_turns, formatted, loss_start, loss_end, last): loss bounds are code points of formatted, end exclusive;
    an example without a trainable reply has both at the end."""
    clean = lambda c: F.coalesce(c, F.lit(""))
    turn = F.struct("turn", clean(F.col("role")).alias("role"), clean(F.col("text")).alias("text"))
    conv = conversations.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    line = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(END))
    n = F.size("turns")
    target = lambda i: (F.element_at("turns", i)["role"] == "assistant") | (i == n)
    conv = conv.select("conv_id", F.transform("turns", line).alias("lines"), F.transform("turns", lambda t: t["role"] == "assistant").alias("reply"), F.filter(F.sequence(F.lit(1), n), target).alias("at"), n.alias("n"))
    ex = conv.select("conv_id", "lines", "reply", "n", F.posexplode("at").alias("example", "k"))
    ex = ex.select("conv_id", "example", F.col("k").alias("n_turns"), F.array_join(F.slice("lines", 1, F.col("k")), "").alias("formatted"), F.element_at("lines", F.col("k")).alias("line"), F.element_at("reply", F.col("k")).alias("reply"), (F.col("k") == F.col("n")).alias("last"))
    length = F.length("formatted")
    start = length - F.length("line") + F.locate("\n", F.col("line"))
    return ex.select("conv_id", "example", "n_turns", "formatted", F.when(F.col("reply"), start).otherwise(length).cast("long").alias("loss_start"), F.when(F.col("reply"), length - len(END)).otherwise(length).cast("long").alias("loss_end"), "last")


def turns_of(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    lines = F.filter(F.split(formatted, END_PATTERN, -1), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.length(p))
    role = lambda p: F.substring_index(p, "\n", 1)
    read = lambda p: F.struct(unescape_role(role(body(p))).alias("role"), unescape(F.substring(body(p), F.length(role(body(p))) + 2, F.length(p))).alias("text"))
    return F.transform(lines, read)


def loss_text() -> Column:
    """The trainable text of an example, unescaped."""
    return unescape(F.substring(F.col("formatted"), (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, turns, loss, formatted_chars): the turns of a conversation, from its last example, and all trainable text in order."""
    e = examples.select("conv_id", "example", F.when(F.col("last"), turns_of(F.col("formatted"))).alias("turns"), loss_text().alias("loss"), F.length("formatted").cast("long").alias("chars"))
    g = e.groupBy("conv_id").agg(F.first("turns", ignorenulls=True).alias("turns"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("parts"), F.sum("chars").alias("formatted_chars"))
    return g.select("conv_id", "turns", F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"), "formatted_chars")
