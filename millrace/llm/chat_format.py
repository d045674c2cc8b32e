"""Chat formatting from an event log.

Events are (conv_id, turn, seq, kind, role, text). A `message` event opens a message at its turn;
the later events of that turn, up to its next message, change it: `delta` appends its text, `edit`
replaces the text, `regenerate` empties it (or starts it anew with its own text) so that the deltas
after it build the new answer. Only events from a message's last replacing event on matter, so they
are all that is gathered: a running maximum finds that event and the rest are dropped before any
conversation is put together.

Rendering: each message is `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. In roles and texts `&` becomes
`&amp;` and `<|` becomes `&lt;|` (in roles a line feed also becomes `&#10;`), so control strings
stand only where the template put them and unescaping gives the text back. `loss` marks the spans of
trained text by (start, length) in code points: the escaped texts of the assistant's messages.

Defined results: null text is empty, a null role is empty, null kinds count as `message`; changes
before any message open a message of their own. Messages are ordered by turn, then by the seq of
their opening; equal seqs by kind, role and text. Repeated events are applied as often as they
occur. Null conv_id is a conversation of its own. Extra columns are ignored. A conversation is one
output row, so the text of one conversation has to fit in one task, like any row of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def _role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, turn, opened, rank, role, text): the final messages."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), role.alias("role"), text.alias("text"))
    w = Window.partitionBy("conv_id", "turn").orderBy("seq", F.col("kind") != "message", "kind", "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("at", F.row_number().over(w)).withColumn("msg", F.count_if(F.col("kind") == "message").over(so_far))
    of = Window.partitionBy("conv_id", "turn", "msg")
    e = e.withColumn("last", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(of)).withColumn("first", F.min("at").over(of))
    e = e.where((F.col("at") >= F.coalesce("last", F.lit(0))) | (F.col("at") == F.col("first")))
    used = F.col("at") >= F.coalesce("last", F.lit(0))
    parts = F.array_sort(F.collect_list(F.when(used, F.struct("at", "text"))))
    folded = e.groupBy("conv_id", "turn", "msg").agg(
        F.min("seq").alias("opened"), F.min(F.struct("at", "role"))["role"].alias("role"), F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text")
    )
    return folded.select("conv_id", "turn", "opened", F.col("msg").alias("rank"), "role", "text")


def render(final: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss): one row for each conversation of messages()."""
    rows = final.select("conv_id", "turn", "opened", "rank", (F.col("role") == trained).alias("loss"), F.concat(F.lit(START), _role(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    w = Window.partitionBy("conv_id").orderBy("turn", "opened", "rank")
    size = F.length("head") + F.length("body") + len(END)
    rows = rows.select(
        "conv_id", F.row_number().over(w).alias("n"), F.concat("head", "body", F.lit(END)).alias("block"),
        F.when(F.col("loss"), F.struct((F.sum(size.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END)).alias("start"), F.length("body").cast("long").alias("length"))).alias("span"),
    )
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "block", "span"))).alias("b"))
    return got.select(
        "conv_id", F.concat_ws("", F.transform("b", lambda x: x["block"])).alias("formatted"),
        F.transform(F.filter("b", lambda x: x["span"].isNotNull()), lambda x: x["span"]).alias("loss"),
    )


def format_chats(events: DataFrame, trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss) from an event log."""
    return render(messages(events), trained)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, trained, formatted, loss): messages (role, text), and the texts under the loss mask, from the
    formatted text and mask of each conversation alone.

    Blocks become rows, a running sum says where each ends, and sorted among them by their ends the mask's spans each
    stand before the block whose body they cover: linear in the text but for the sort, whatever the number of turns.
    """
    empty = F.lit(None).cast("string")
    no_loss = F.lit(None).cast(formatted.schema["loss"].dataType)

    def row(kind: int, text: Column, size: Column, end: Column, loss: Column = no_loss) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("text"), size.cast("long").alias("size"), end.cast("long").alias("end"), loss.alias("loss"))

    none = F.lit(None).cast("long")
    blocks = F.transform(F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda b: b != ""), lambda b: row(2, b, F.length(b) + len(END), none))
    spans = F.transform("loss", lambda s: row(1, empty, s["length"], s["start"] + s["length"] + len(END)))
    whole = F.array(row(0, F.col("formatted"), none, none, F.col("loss")))
    rows = formatted.select("conv_id", F.posexplode(F.concat(whole, spans, blocks)).alias("pos", "r")).select("conv_id", "pos", "r.*")
    of = Window.partitionBy("conv_id")
    rows = rows.withColumn("end", F.coalesce("end", F.sum(F.when(F.col("kind") == 2, F.col("size"))).over(of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))))
    before = of.orderBy("end", "kind", "pos")
    covered = (F.lag("kind").over(before) == 1) & (F.lag("end").over(before) == F.col("end"))
    rows = rows.withColumn("under", F.when(covered, F.lag("size").over(before)))
    block = F.col("kind") == 2
    body = F.substr("text", F.locate("\n", "text") + F.lit(1))
    role = unescape(F.replace(F.substring_index(F.substr("text", F.lit(len(START) + 1)), "\n", 1), F.lit("&#10;"), F.lit("\n")))
    rows = rows.where(F.col("kind") != 1).select(
        "conv_id", "pos", F.when(~block, F.struct("text", "loss")).alias("whole"),
        F.when(block, F.struct(role.alias("role"), unescape(body).alias("text"), F.when(F.col("under").isNotNull(), unescape(F.right(body, F.col("under").cast("int")))).alias("trained"))).alias("turn"),
    )
    # the whole text stands in the list's first row only: an aggregate of its own would copy it at every row
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "turn", "whole"))).alias("t"))
    got = got.select("conv_id", F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: x["turn"]).alias("t"), F.get("t", F.lit(0))["whole"].alias("whole"))
    return got.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.transform(F.filter("t", lambda x: x["trained"].isNotNull()), lambda x: x["trained"]).alias("trained"), F.col("whole.text").alias("formatted"), F.col("whole.loss").alias("loss"),
    )
