"""Operator 2: chats rebuilt from an event log and rendered with a reversible template. DataFrame functions only.

The log has one row per event: conversation, sequence number, turn, kind, role, text.

* `delta` appends its text to the message of its turn.
* `edit` replaces the message of its turn by its text; `regenerate` empties it. Both end what was said before: every
  earlier event of the same or a later turn no longer counts.

Messages are put together per block of `BLOCK` turns, so that a conversation of any length is spread over tasks; what an
earlier block has cut off reaches the later ones as one number per block. A rendered part holds one block.

Null text is empty, a null role is an empty role, a null turn comes before all others, a null conversation is one
conversation, a null kind is a delta. Rows of one turn with the same `msg` are one message, in order of sequence, then
text. An empty log gives no rows; extra columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64
TURN, END = "<|turn|>", "<|end|>\n"
LOSS_ROLE = "assistant"
FIRST = -(2**62)

#: What stands for a control character inside a text; `&` first when escaping, last when reading back.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;")]
LINE = ("\n", "&NewLine;")


def escape(text: Column, role: bool = False) -> Column:
    """No template's control string survives: none can be written without `<` or `[`."""
    for plain, safe in ESCAPES + [LINE] * role:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, role: bool = False) -> Column:
    for plain, safe in reversed(ESCAPES + [LINE] * role):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, block, turn, msg, role, text): the final message of each turn that was not cut off."""
    turn = F.coalesce("turn", F.lit(FIRST)).cast("long")
    log = events.select(
        "conv_id", turn.alias("turn"), F.floor(turn / BLOCK).alias("block"), F.coalesce("msg", F.lit(0)).alias("msg"),
        F.coalesce("seq", F.lit(FIRST)).cast("long").alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), "role", "text")
    cuts = F.col("kind").isin("edit", "regenerate")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (log.groupBy("conv_id", "block").agg(F.max(F.when(cuts, F.col("seq"))).alias("seq"))
               .withColumn("seq", F.max("seq").over(before)).where("seq is not null")
               .select("conv_id", F.lit(FIRST - 1).alias("turn"), "block", F.lit(0).alias("msg"), "seq",
                       F.lit("carried").alias("kind"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    so_far = Window.partitionBy("conv_id", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    cut_at = F.max(F.when(cuts | (F.col("kind") == "carried"), F.col("seq"))).over(so_far)
    alive = (log.unionByName(carried).withColumn("cut_at", cut_at)
             .where((F.col("kind") != "carried") & (F.col("cut_at").isNull() | (F.col("seq") >= F.col("cut_at")))))
    pieces = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))))
    return alive.groupBy("conv_id", "block", "turn", "msg").agg(
        F.coalesce(F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))), F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, block, formatted, loss): loss has start and length, in code points, of what a model is trained on."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "msg", "role", "text")))
    head = lambda m: F.concat(F.lit(TURN), escape(m["role"], role=True), F.lit("\n"))
    pieces = F.transform("turns", lambda m: F.struct(
        (m["role"] == LOSS_ROLE).alias("loss"), head(m).alias("head"), escape(m["text"]).alias("body")))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    spans = F.transform("pieces", lambda p, i: F.struct(
        p["loss"].alias("loss"),
        (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(p["head"])).alias("start"),
        F.length(p["body"]).alias("length")))
    return (messages.groupBy("conv_id", "block").agg(turns.alias("turns"))
            .select("conv_id", "block", pieces.alias("pieces"))
            .withColumn("sizes", F.transform("pieces", size))
            .select("conv_id", "block",
                    F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"),
                    F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"])).alias("loss")))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, block, turns array of role and text, loss_texts array): parsed from `formatted` and `loss` alone."""
    marked = F.filter(F.split("formatted", r"<\|turn\|>"), lambda p, i: i > 0)
    role = lambda p: F.substring_index(p, "\n", 1)
    body = lambda p: F.substring(p, F.length(role(p)) + 2, F.length(p) - F.length(role(p)) - 1 - len(END))
    return rendered.select(
        "conv_id", "block", "formatted",
        F.transform(marked, lambda p: F.struct(unescape(role(p), role=True).alias("role"), unescape(body(p)).alias("text"))).alias("turns"),
        F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss_texts"))


def digests(read: DataFrame) -> DataFrame:
    """Counts and digests per conversation of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", "block", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
                        said.alias("said"), F.array_join("loss_texts", "").alias("loss"))
    whole = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", c))), lambda x: x[c]), "")
    return (parts.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), whole("said").alias("said"), whole("loss").alias("loss"),
        F.sum("chars").cast("long").alias("formatted_chars"))
        .select("conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A log in which every row of a table of turns is one message; equal turns keep apart, by role and text."""
    turn = F.coalesce("turn", F.lit(FIRST)).cast("long")
    ties = Window.partitionBy("conv_id", F.floor(turn / BLOCK), turn).orderBy("role", "text")
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.row_number().over(ties).alias("msg"),
                                F.lit("delta").alias("kind"), "role", "text")
