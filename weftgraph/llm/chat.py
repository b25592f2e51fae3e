"""Chat logs as events: final messages are folded from streamed deltas, edits and regenerations, then rendered for training.

DataFrame functions only. A log is dealt by message first, where its deltas are joined, and then by conversation, where
messages are put in order and rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Marks of the template. Texts have no "<" once escaped, so no text can hold one of them.
OPEN, BODY, CLOSE = "<turn ", ">\n", "</turn>\n"

#: Codes for what would be read as a mark, the code's own backslash first.
TEXT_CODES = (("\\", "\\b"), ("<", "\\l"))
ROLE_CODES = (*TEXT_CODES, (">", "\\g"), ("\n", "\\n"))

#: Kinds of events. Those that begin or replace a text; the rest (delta) adds to it.
START, DELTA, EDIT, REGENERATE = "start", "delta", "edit", "regenerate"


def escaped(text: Column, codes: tuple[tuple[str, str], ...] = TEXT_CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes: tuple[tuple[str, str], ...] = TEXT_CODES) -> Column:
    """The text before escaped(): each backslash has its letter after it, so codes cannot overlap."""
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _let(value: Column, use) -> Column:
    """use(value), with value computed once however often use has it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def final_messages(events: DataFrame, conv: str = "conv_id", message: str = "message") -> DataFrame:
    """(conv, message, role, text) of the messages that stand at the end of a log.

    events has conv, message (of any type that can be ordered; messages stand in its order), seq (likewise; the order of
    events in a conversation), kind, role and text. start begins a message and names its role, delta adds text, edit replaces
    the text so far, and regenerate discards it together with all later messages that began before. Only what follows a
    message's last start, edit or regenerate counts. Events before a message's first start are ignored, as are unknown kinds;
    null texts are empty, null roles are empty; a null conversation is a conversation, a null message the first of it.
    Events that tie in seq count in the order of kind and text. Deltas of a message meet in one row, as its text does.
    """
    kind, seq, text = F.col("kind"), F.col("seq"), F.coalesce("text", F.lit(""))
    begins = kind.isin(START, REGENERATE)
    per_message = events.where(kind.isin(START, DELTA, EDIT, REGENERATE)).groupBy(F.col(conv).alias("conv"), F.col(message).alias("message")).agg(
        F.count_if(begins).alias("__starts"),
        F.max(F.when(begins, F.struct(seq.alias("seq"), kind.alias("kind")))).alias("__began"),
        F.max(F.when(kind != DELTA, F.struct(seq.alias("seq"), kind.alias("kind"), text.alias("text")))).alias("__base"),
        F.max(F.when(kind == REGENERATE, F.struct(seq.alias("seq")))).alias("__cut"),
        F.max_by("role", F.when((kind == START), F.struct(seq.alias("seq"), F.coalesce("role", F.lit("")).alias("role")))).alias("role"),
        F.collect_list(F.when(kind == DELTA, F.struct(seq.alias("seq"), kind.alias("kind"), text.alias("text")))).alias("__deltas"),
    ).where("__starts > 0")
    earlier = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    standing = per_message.withColumn("__void", F.max("__cut").over(earlier)).where(F.coalesce(F.col("__began.seq") > F.col("__void.seq"), F.lit(True)))
    after = F.filter("__deltas", lambda d: d["seq"] > F.col("__base.seq"))
    body = F.concat(F.when(F.col("__base.kind") != REGENERATE, F.col("__base.text")).otherwise(F.lit("")), F.array_join(F.transform(F.array_sort(after), lambda d: d["text"]), ""))
    return standing.select("conv", "message", F.coalesce("role", F.lit("")).alias("role"), body.alias("text"))


def format_conversations(events: DataFrame, conv: str = "conv_id", message: str = "message", learn: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): each conversation of a log as one training text.

    loss_spans are (begin, size) in bytes of the UTF-8 text, in order: the escaped texts of the role `learn`. A conversation
    is one row, so its text has to fit into a row; what is dealt by it before is one row a message. read_turns() and
    read_loss() give back what was put in. A log without messages gives no rows, as does an empty one; other columns
    are not read.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role"), ROLE_CODES), F.lit(BODY))
    turns = final_messages(events, conv, message).select("conv", "message", "role", head.alias("__head"), escaped(F.col("text")).alias("__body"))
    size = F.octet_length("__head") + F.octet_length("__body") + len(CLOSE)
    before = Window.partitionBy("conv").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)) + F.octet_length("__head")
    rendered = turns.select("conv", F.struct("message", begin.alias("begin"), F.octet_length("__body").cast("long").alias("size"), (F.col("role") == learn).alias("learn"), F.concat("__head", "__body", F.lit(CLOSE)).alias("part")).alias("turn"))
    whole = rendered.groupBy("conv").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["begin"].alias("begin"), t["size"].alias("size")))
    return whole.select(F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.part", "").alias("formatted"), spans.alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, from its marks."""
    parts = F.split(formatted, CLOSE)
    turns = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, BODY, 1)
        role = unescaped(F.substr(head, F.lit(len(OPEN) + 1)), ROLE_CODES)
        return F.struct(role.alias("role"), unescaped(F.substr(part, F.length(head) + len(BODY) + 1)).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, one after another."""
    cut = lambda raw: F.transform(spans, lambda s: F.decode(F.substring(raw, s["begin"].cast("int") + 1, s["size"].cast("int")), "UTF-8"))
    return unescaped(F.array_join(_let(formatted.cast("binary"), cut), ""))


def as_events(rows: DataFrame, chunk: int = 200) -> DataFrame:
    """A log that ends in the rows (conv_id, turn, role, text), as a client would have sent it.

    Texts are streamed in deltas of `chunk` code points. Assistants' messages are regenerated after their first delta, others
    begin with a draft that an edit replaces up to the second delta. Messages are ordered by turn, then role and text;
    equal rows stay apart by their place in the table.
    """
    text = F.coalesce("text", F.lit(""))
    row = rows.select(
        "conv_id",
        F.struct("turn", "role", F.sha2(text.cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("row")).alias("message"),
        "role",
        F.regexp_extract_all(text, F.lit(r"[\s\S]{1,%d}" % chunk), F.lit(0)).alias("__chunks"),
    )
    event = lambda at, kind, own: F.struct(at.alias("at"), F.lit(kind).alias("kind"), own.alias("text"))
    none, first = F.lit(""), F.coalesce(F.get("__chunks", F.lit(0)), F.lit(""))
    deltas = lambda since: F.transform(F.slice("__chunks", since + 1, F.greatest(F.size("__chunks") - since, F.lit(0))), lambda x, i: event(i + 3, DELTA, x))
    begun = F.array(event(F.lit(0), START, none), event(F.lit(1), DELTA, F.reverse(first)))
    made = F.when(F.col("role") == "assistant", F.concat(begun, F.array(event(F.lit(2), REGENERATE, none)), deltas(0))).otherwise(F.concat(begun, F.array(event(F.lit(2), EDIT, first)), deltas(1)))
    rows = row.select("conv_id", "message", "role", F.explode(made).alias("__e"))
    return rows.select("conv_id", "message", F.struct("message", F.col("__e.at")).alias("seq"), "__e.kind", "role", "__e.text")
