"""Chat formatting: a log of conversation events folded into final messages and rendered with a loss mask.

Events have conv_id, message (order of the message in its conversation), seq, kind, role and text:
  message     the whole text of a message          delta       text that is appended
  edit        a new whole text                     regenerate  what was streamed so far is void
Defined results: null text is empty, null role is empty; a message whose last restart is a regenerate
without deltas is empty; ties in seq are taken by kind, role and text; an empty log gives no rows; a null
conv_id is a conversation of its own; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyledger.llm.text import table

# The template's marks; after escaping, a text holds neither.
TURN, END = "<|im_start|>", "<|im_end|>\n"
_RESTARTS = ("message", "edit", "regenerate")


def escape(text: Column) -> Column:
    """A text without control strings: the backslash becomes \\b, then <| becomes <\\p."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("<\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\p"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text. A log dealt out by conversation is not shuffled again.

    Per message the events since its last restart are joined in order of seq; the role is the last given.
    """
    logs = events.groupBy("conv_id", "message")
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    sorted_log = logs.agg(F.sort_array(F.collect_list(event)).alias("log"))
    restart = F.transform("log.kind", lambda k: F.coalesce(k.isin(*_RESTARTS), F.lit(False)))
    last = F.greatest(F.size("log") - F.array_position(F.reverse(restart), True) + 1, F.lit(1)).cast("int")
    start = F.when(F.array_contains(restart, True), last).otherwise(F.lit(1))
    since = F.slice("log", start, F.greatest(F.size("log") - start + 1, F.lit(0)))
    roles = F.filter(F.col("log.role"), lambda r: r.isNotNull())
    return sorted_log.select(
        "conv_id",
        "message",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        F.array_join(
            F.transform(since, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), ""
        ).alias("text"),
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: formatted text and loss_mask.

    loss_mask lists, for each message of the learned role in order, its turn, the code point where its turn's block
    begins, and start and length of its escaped text. The messages of a conversation meet because the result is one text.
    """
    head = F.concat(F.lit(TURN), _escape_role(F.col("role")), F.lit("\n"))
    block = F.struct(
        F.col("message"),
        F.concat(head, escape(F.col("text")), F.lit(END)).alias("block"),
        F.length(head).alias("lead"),
        F.length(escape(F.col("text"))).alias("length"),
        (F.col("role") == learn).alias("learned"),
    )
    sized = messages.select("conv_id", block.alias("b"))
    # A running sum over the conversation gives each block its place.
    before = Window.partitionBy("conv_id").orderBy("b.message").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("at", F.coalesce(F.sum(F.length("b.block")).over(before), F.lit(0)))
    rows = F.sort_array(F.collect_list(F.struct("b.message", "b.block", "at", "b.lead", "b.length", "b.learned")))
    listed = placed.groupBy("conv_id").agg(rows.alias("rows"))
    spans = F.expr(
        "transform(filter(transform(rows, (r, k) -> struct(k AS turn, r.at AS block, r.at + r.lead AS start, r.length AS length,"
        " r.learned AS learned)), s -> s.learned), s -> struct(s.turn, s.block, s.start, s.length))"
    )
    return listed.select("conv_id", F.array_join("rows.block", "").alias("formatted"), spans.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text) and learned (texts under the loss mask), from a rendering alone."""
    parts = F.expr(r"slice(split(formatted, '<\\|im_start\\|>'), 2, 2147483647)")
    cut = formatted.withColumn("_parts", parts)
    body = f"left(p, length(p) - {len(END)})"
    turns = F.transform(
        F.expr(f"transform(_parts, p -> {body})"),
        lambda p: F.struct(
            _unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 2, F.length(p))).alias("text"),
        ),
    )
    # Every span is cut out of its own turn, so that long conversations stay linear.
    learned = F.transform(
        F.expr(
            f"transform(loss_mask, s -> substring(get(_parts, s.turn), int(s.start - s.block) - {len(TURN)} + 1, s.length))"
        ),
        unescape,
    )
    return cut.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))


def message_events(conversations: DataFrame, piece: int = 200) -> DataFrame:
    """Rows by turn as the log of a streaming chat: a message's first piece opens it, deltas of `piece` characters follow.

    Rows that share a turn stay messages of their own, ordered by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order))
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    spread = rows.select("conv_id", "message", "role", F.posexplode_outer(pieces).alias("seq", "text"))
    seq = F.coalesce("seq", F.lit(0))
    kind = F.when(seq == 0, F.lit("message")).otherwise(F.lit("delta"))
    return spread.select("conv_id", "message", seq.alias("seq"), kind.alias("kind"), "role", "text")


def format_conversations(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Events to rendered conversations, with one shuffle."""
    return render(fold_events(events.repartition("conv_id")), learn)


def op10_chat_formatting(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "<|im_end|><|im_start|>assistant ok"
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    probe = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(both).alias("text"))
    # The log is dealt out by conversation already.
    back = read_back(render(fold_events(message_events(conversations.unionByName(probe)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.array_join("learned", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(under).cast("bigint").alias("loss_chars"),
        F.sha2(under, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
