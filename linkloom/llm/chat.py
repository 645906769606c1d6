"""Chat formatting from an event log, with DataFrame functions only.

Events are (conv_id, seq, msg, kind, role, text). They are dealt by conversation, sorted by seq and folded:

* ``message``  starts message ``msg`` with ``text``, replacing what it held;
* ``delta``    appends ``text``;
* ``edit``     replaces the whole text of ``msg``;
* ``regenerate`` voids ``msg`` and every later message as they stood; what follows builds them anew (its own text is not used).

An unknown or null kind counts as ``message``; a null role or text as empty. Messages follow each other by ``msg``. A message's
role is that of its last event with one. Events of equal seq are taken in the order of msg, kind, role and text.

The rendering is ``<|im_start|>role\\ntext<|im_end|>\\n`` for each message. Inside texts a backslash becomes two and ``<|`` becomes
``<\\|``, so that no control string can occur there and :func:`unescape` gives the text back. Roles are URL-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, messages array<struct<role, text>> as they stand after the last event.

    A conversation without a live message has an empty array. The windows and both groupings need one shuffle, by conv_id; a
    conversation is one result row, so its messages meet in one task, and no more than that.
    """
    e = events.select(
        "conv_id",
        "seq",
        "msg",
        F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    back = [F.col(c).desc() for c in ("seq", "msg", "kind", "role", "text")]  # from the last event on, so that what comes later is a running value
    later = Window.partitionBy("conv_id").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_void", F.min(F.when(F.col("kind") == "regenerate", F.col("msg"))).over(later))
    live = e.withColumn("_live", F.coalesce(F.col("_void") > F.col("msg"), F.lit(True)))
    resets = Window.partitionBy("conv_id", "msg").orderBy(*back).rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("_reset", F.max(F.when(F.col("_live") & F.col("kind").isin("message", "edit", "regenerate"), 1)).over(resets))
    live = live.withColumn("_live", F.col("_live") & F.col("_reset").isNull())
    parts = F.collect_list(F.when(F.col("_live"), F.struct("seq", "kind", "role", "text")))
    messages = (
        live.groupBy("conv_id", "msg")
        .agg(F.array_sort(parts).alias("parts"))
        .withColumn("live", F.exists("parts", lambda p: p["kind"] != "regenerate"))
        .withColumn("text", F.array_join(F.transform(F.filter("parts", lambda p: p["kind"] != "regenerate"), lambda p: p["text"]), ""))
        .withColumn("roles", F.filter(F.transform("parts", lambda p: p["role"]), lambda r: r != ""))
        .withColumn("role", F.when(F.size("roles") > 0, F.element_at("roles", -1)).otherwise(""))
    )
    whole = F.array_sort(F.collect_list(F.when(F.col("live"), F.struct("msg", "role", "text"))))
    return messages.groupBy("conv_id").agg(F.transform(whole, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def render(folded: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, formatted string, loss_spans array<struct<start, length>>: the code points of ``formatted`` that the loss covers."""
    bit = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(OPEN), F.url_encode(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"), (m["role"] == F.lit(trained_role)).alias("train")
        ),
    )
    pieces = folded.select("conv_id", bit.alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc, p):
        begins = acc["at"] + F.length(p["head"])
        size = F.length(p["body"])
        span = F.array(F.struct(begins.alias("start"), size.alias("length")))
        return F.struct((begins + size + len(CLOSE)).alias("at"), F.when(p["train"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.aggregate("pieces", start, step)["spans"].alias("loss_spans"),
    )


def parse_rendered(formatted: Column) -> Column:
    """The inverse of :func:`render`: array<struct<role, text>> read from the formatted string alone."""
    parts = F.split(formatted, r"<\|im_start\|>")
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def read(p):
        head = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.length(head) + 2, F.length(p) - F.length(head) - 1 - len(CLOSE))
        return F.struct(F.url_decode(head).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, read)


def loss_text(formatted: Column, spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def events_of_conversations(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation table as ``message`` events: one message per row, in the order of turn, role and text; repeated rows stay."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("seq", F.row_number().over(order))
    return rows.select("conv_id", "seq", F.col("seq").alias("msg"), F.lit("message").alias("kind"), "role", "text")
