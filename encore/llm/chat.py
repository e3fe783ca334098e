"""Chat formatting: conversations as marked-up text with a loss mask, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values of the template.
START, END, BETWEEN, NEWLINE = "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|im_nl|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    """Text without any control string: a backslash is doubled, ``<|`` becomes ``<\\|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The text that :func:`escape` got."""
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss): one row per conversation.

    Turns are sorted by number, then role and text, so ties and repeated rows have
    a fixed order and all stay; null roles and texts are empty, a null turn comes
    first, rows with a null conversation are one conversation. Neighbouring turns of
    the same role become one message, whose texts stand between separators, so
    reading back returns every turn. ``loss`` lists (start, length) in code points
    of ``formatted`` for each assistant text, without any marker. Columns other than
    the four are not read. A conversation becomes one value, as its reader needs it,
    and so has to fit into a row.
    """
    one = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = rows.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(one)).alias("t"))
    n = F.size("t")
    # A message begins where the role differs from the turn before.
    begins = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", i - 2)["role"]),
    )
    turns = turns.withColumn("b", begins)
    messages = F.transform(
        "b",
        lambda lo, k: F.struct(
            F.get("t", lo - 1)["role"].alias("role"),
            F.transform(
                F.slice("t", lo, F.coalesce(F.get("b", k + 1), n + 1) - lo), lambda x: escape(x["text"])
            ).alias("texts"),
        ),
    )
    turns = turns.select(F.col(conv), messages.alias("m"))
    body = F.transform(
        "m",
        lambda m: F.concat(
            F.lit(START), _role(m["role"]), F.lit("\n"), F.array_join(m["texts"], BETWEEN), F.lit(END + "\n")
        ),
    )
    # Lengths of what stands between two assistant texts, and of these texts.
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def add(state: Column, m: Column) -> Column:
        head = state["at"] + len(START) + 1 + F.char_length(_role(m["role"]))

        def text_at(s: Column, x: Column) -> Column:
            span = F.struct(s["at"].alias("start"), F.char_length(x).cast("long").alias("length"))
            return F.struct(
                (s["at"] + F.char_length(x) + len(BETWEEN)).cast("long").alias("at"),
                F.when(m["role"] == LEARNED, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"),
            )

        begun = F.struct(head.cast("long").alias("at"), state["spans"].alias("spans"))
        done = F.aggregate(m["texts"], begun, text_at)
        return F.struct((done["at"] - len(BETWEEN) + len(END) + 1).cast("long").alias("at"), done["spans"].alias("spans"))

    return turns.select(
        F.col(conv),
        F.array_join(body, "").alias("formatted"),
        F.aggregate("m", nothing, add)["spans"].alias("loss"),
    )


def read_back(formatted: str | Column) -> Column:
    """array<struct<role, text>>: the turns that a formatted conversation holds."""
    text = F.col(formatted) if isinstance(formatted, str) else formatted
    blocks = F.filter(F.split(text, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        inner = F.substring_index(block, END, 1)
        role = F.substring_index(inner, "\n", 1)
        texts = F.split(F.substr(inner, F.char_length(role) + 2), r"<\|im_sep\|>", -1)
        name = unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))
        return F.transform(texts, lambda x: F.struct(name.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: str, loss: str) -> Column:
    """All text under the loss mask, unescaped, one piece after the other."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
