"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

Log events: (conv_id, seq, turn, kind, role, text). `open` starts a turn with a role; `delta` appends to it; `regen`
throws its text away and starts anew; `edit` replaces its text. Events are partitioned by conversation and turn and
sorted by sequence; the last open, regen or edit of a turn is its base and the later deltas are appended to its text.
Turns are then put in order by conversation and rendered.

Template: `<|turn|>role\\ntext<|end|>\\n` per turn. In roles and texts every `\\`, `<` and `[` is written `\\\\`, `\\l`
and `\\k` (roles: line feeds as `\\n` too), so no control string of this template or of the common ones (`<|...|>`,
`</s>`, `[INST]`) can stand in a text, and reading back is exact. The loss mask is the list of (start, length) in code
points of the assistants' texts, with their place in bytes. Offsets are running sums over the turns and spans are read by
bytes, so a conversation takes time in proportion to its length.

Defined results: null texts and roles are empty; null turns come first; events of a turn with equal seq are ordered by
kind and text; rows with a null conversation id form one conversation; repeated rows are turns of their own in
events_of(); an empty log gives no rows; other columns are not read. A conversation is one output row, so its size is
the memory bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescape(text: Column) -> Column:
    plain = lambda x: F.replace(F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("[")), F.lit("\\n"), F.lit("\n"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), plain), "\\")


def events_of(conversations: DataFrame, piece: int = 256) -> DataFrame:
    """A log whose reconstruction is the given rows, not in order of sequence.

    Each turn is opened and a draft streamed; then every other turn is regenerated and streamed anew in pieces, and the
    others are edited to their first piece, after which the rest is streamed.
    """
    rows = conversations.select("conv_id", F.col("turn").alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "role", "text")))
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).cast("long").alias("seq"), kind.alias("kind"), role.alias("role"), text.alias("text"))
    none, edits = F.lit(None).cast("string"), F.col("turn") % 2 == 0
    kind = lambda name: F.lit(name)
    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    base = event(2, F.when(edits, "edit").otherwise("regen"), none, F.when(edits, F.coalesce(F.get("pieces", F.lit(0)), F.lit(""))))
    head = F.array(event(0, kind("open"), F.col("role"), none), event(1, kind("delta"), none, F.left("text", F.lit(16))), base)
    deltas = F.filter(F.transform("pieces", lambda x, i: F.struct((i + 3).cast("long").alias("seq"), kind("delta").alias("kind"), none.alias("role"), x.alias("text"))), lambda e: ~edits | (e["seq"] > 3))
    log = rows.withColumn("pieces", pieces).select("conv_id", "turn", F.explode(F.reverse(F.concat(head, deltas))).alias("e"))
    return log.select("conv_id", (F.col("turn").cast("long") * (1 << 32) + F.col("e.seq")).alias("seq"), "turn", "e.kind", "e.role", "e.text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text): the final messages of a log."""
    base = F.col("kind").isin("open", "regen", "edit")
    order = F.struct("seq", "kind", "text")
    folded = events.select("conv_id", "turn", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id", "turn").agg(
        F.max(F.when(base, order)).alias("base"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"),
        F.collect_list(F.when(F.col("kind") == "delta", F.struct("seq", "text"))).alias("deltas"),
    )
    since = F.coalesce(F.col("base.seq"), F.lit(-(1 << 62)))
    kept = F.transform(F.array_sort(F.filter("deltas", lambda d: d["seq"] >= since)), lambda d: d["text"])
    text = F.concat(F.coalesce("base.text", F.lit("")), F.array_join(kept, ""))
    return folded.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rows (conv_id, formatted, loss): the rendered conversation and the spans that a loss is taken on.

    A span is (start, length) in code points and (first_byte, bytes) in UTF-8, so that reading one takes its own length.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n"))
    shown = messages.select("conv_id", "turn", F.concat(F.lit(TURN), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("loss"))
    ordered = Window.partitionBy("conv_id").orderBy("turn", "head", "body").rowsBetween(Window.unboundedPreceding, 0)

    def before(size) -> Column:
        """Where a body starts: all turns up to it, without it and its end."""
        return (F.sum(size("head") + size("body") + len(END)).over(ordered) - size("body") - len(END)).cast("long")

    chars, octets = (lambda c: F.length(c).cast("long")), (lambda c: F.octet_length(c).cast("long"))
    placed = shown.select("*", before(chars).alias("start"), chars("body").alias("length"), before(octets).alias("first_byte"), octets("body").alias("bytes"))
    turns = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "first_byte", "bytes", "loss", "head", "body"))).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(*[t[c].alias(c) for c in ("start", "length", "first_byte", "bytes")]))
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns, array of (role, text), of a rendered conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda p: p != "")

    def read(part: Column) -> Column:
        cut = F.instr(part, "\n")
        body = F.substring(part, cut + 1, F.length(part) - cut - len(END))
        return F.struct(unescape(F.substring(part, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, read)


def loss_text(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    whole = lambda raw: F.transform(loss, lambda s: unescape(F.substring(raw, s["first_byte"].cast("int") + 1, s["bytes"].cast("int")).cast("string")))
    return F.array_join(F.transform(F.array(formatted.cast("binary")), whole)[0], "")


def format_digests(conversations: DataFrame) -> DataFrame:
    """Digests, read back from the output, of the conversations' rendering."""
    out = render(reconstruct(events_of(conversations)))
    read = out.select("conv_id", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("under"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("under").cast("long").alias("loss_chars"), F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"), "formatted_chars"
    )
