"""Chat formatting with a grammar round trip, in DataFrame expressions only.

    conversation = turn*
    turn         = "<turn:v>" role "\\n" text "</turn>"  |  "<turn:e>" ESC(role) "\\n" ESC(text) "</turn>"

The control strings are ``<turn:`` and ``</turn>``. ESC writes a backslash as ``\\b``, ``<`` as
``\\l`` and, in a role, a line break as ``\\n``; since every backslash is then followed by one of
these letters it is undone without doubt. A conversation is rendered with every turn verbatim (v),
parsed again and compared with its source; if they differ, the turns that hold control strings are
escaped (e); if they still differ, all turns are; and if even that text isn't parsed back identically,
the query fails rather than pass it on. The parser refuses a verbatim turn that holds a control string,
so no text can open or close a turn.

Defined results: a null or empty role or text is an empty string. Turns go by ``turn`` (null first), then
role, then text, so ties and repeated rows have one order and each is kept. A row with a null conv_id
belongs with no other: it is a conversation of one turn, and no task gathers such rows. An empty table
gives an empty result. Only conv_id, turn, role and text are read, so other columns may have any name.
One conversation is one value of the result and is put together in one task, very long texts included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

OPEN_VERBATIM, OPEN_ESCAPED, CLOSE, CONTROL = "<turn:v>", "<turn:e>", "</turn>", "<turn:"
TRAINED_ROLE = "assistant"


def _lit_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column, role: bool = False) -> Column:
    out = _lit_replace(_lit_replace(c, "\\", "\\b"), "<", "\\l")
    return _lit_replace(out, "\n", "\\n") if role else out


def unescape(c: Column) -> Column:
    return _lit_replace(_lit_replace(_lit_replace(c, "\\l", "<"), "\\n", "\n"), "\\b", "\\")


def _conflicts(role: Column, text: Column) -> Column:
    holds = lambda c: F.contains(c, F.lit(CONTROL)) | F.contains(c, F.lit(CLOSE))
    return holds(text) | holds(role) | F.contains(role, F.lit("\n"))


def verbatim(t: Column) -> Column:
    return F.concat(F.lit(OPEN_VERBATIM), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))


def escaped(t: Column) -> Column:
    return F.concat(F.lit(OPEN_ESCAPED), escape(t["role"], True), F.lit("\n"), escape(t["text"]), F.lit(CLOSE))


def where_needed(t: Column) -> Column:
    return F.when(_conflicts(t["role"], t["text"]), escaped(t)).otherwise(verbatim(t))


def render(turns: Column, how) -> Column:
    return F.array_join(F.transform(turns, how), "")


def _parse_turn(piece: Column) -> Column:
    body = F.substr(piece, F.lit(len(OPEN_VERBATIM) + 1))
    cut = F.instr(body, "\n")
    role, text = F.substr(body, F.lit(1), cut - 1), F.substr(body, cut + 1)
    plain = F.struct(role.alias("role"), text.alias("text"))
    undone = F.struct(unescape(role).alias("role"), unescape(text).alias("text"))
    return (
        F.when(cut == 0, F.lit(None))
        .when(F.startswith(piece, F.lit(OPEN_VERBATIM)) & ~F.contains(body, F.lit(CONTROL)), plain)
        .when(F.startswith(piece, F.lit(OPEN_ESCAPED)) & ~F.contains(body, F.lit("<")), undone)
    )


def _pieces(formatted: Column) -> Column:
    """What stands before each closing mark; text behind the last one makes the parse fail."""
    parts = F.split(formatted, CLOSE, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted text; an element is null where it isn't a turn."""
    return F.transform(_pieces(formatted), _parse_turn)


def loss_mask(formatted: Column) -> Column:
    """Runs of characters of a formatted text, in order, each inside the loss mask or not."""

    def runs(piece: Column) -> Column:
        turn = _parse_turn(piece)
        head = F.char_length(piece) - F.char_length(F.substring_index(piece, "\n", 1)) - 1
        before = F.char_length(piece) - head
        run = lambda n, on: F.struct(n.cast("int").alias("chars"), on.alias("loss"))
        return F.array(run(before, F.lit(False)), run(head, turn["role"] == TRAINED_ROLE), run(F.lit(len(CLOSE)), F.lit(False)))

    return F.flatten(F.transform(_pieces(formatted), runs))


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id and its turns in order."""
    own = rows.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"),
    )
    ordered = own.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    ordered = ordered.unionByName(own.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escape_level (0 none, 1 where needed, 2 all), loss_mask."""
    own = conversations_of(rows).withColumn("plain", render(F.col("turns"), verbatim))
    own = own.withColumn("level", F.when(parse(F.col("plain")) == F.col("turns"), 0))
    own = own.withColumn("partly", F.when(F.col("level").isNull(), render(F.col("turns"), where_needed)))
    own = own.withColumn("level", F.coalesce("level", F.when(parse(F.col("partly")) == F.col("turns"), 1)))
    own = own.withColumn("whole", F.when(F.col("level").isNull(), render(F.col("turns"), escaped)))
    lost = F.raise_error("a conversation can't be parsed back from its escaped form").cast("int")
    own = own.withColumn("level", F.coalesce("level", F.when(parse(F.col("whole")) == F.col("turns"), 2).otherwise(lost)))
    formatted = F.when(F.col("level") == 0, F.col("plain")).when(F.col("level") == 1, F.col("partly")).otherwise(F.col("whole"))
    return own.select("conv_id", formatted.alias("formatted"), F.col("level").alias("escape_level")).withColumn("loss_mask", loss_mask(F.col("formatted")))


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of what parsing the formatted texts gives back."""
    own = formatted.withColumn("read", parse(F.col("formatted")))
    own = own.withColumn("trained", F.array_join(F.transform(F.filter("read", lambda t: t["role"] == TRAINED_ROLE), lambda t: t["text"]), ""))
    every = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return own.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(every, 256).alias("turns_sha256"),
        F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "escape_level",
    )
