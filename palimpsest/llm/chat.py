"""Chat formatting, relational: Spark expressions only.

Turns of a conversation are collected as structs and sorted by (turn, role, text); neighbours of one role
merge into a block; blocks are concatenated:

    user       [INST] text [/INST]
    assistant  <s> text </s>
    system     <<SYS>> text <</SYS>>
    other      [ROLE] role [TURN] text [/ROLE]

with ` [TURN] ` between the texts of a block and a line end between blocks.  Inside texts (and other roles' names)
each control string gets a backslash after its opening bracket, one more if it has some: a reversible mark that
leaves all other text as it is.

Loss spans are the (begin, end) places, in code points of the formatted string, of each assistant text.

Defined results: a null text is empty; a null role is the role ''; null turns come first; rows that tie or repeat are all
kept, in the order of the sort; extra columns are ignored.  A conversation is one row of output, so it is gathered in
one task: the size of a conversation is the bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: role -> (opening, closing).
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[/ROLE]")
BETWEEN = " [TURN] "
_REST = r"(/?s>|/?INST\]|/?ROLE\]|TURN\]|</?SYS>>)"
ESCAPE = (r"(<|\[)(\\*)" + _REST, r"$1$2\\$3")
UNESCAPE = (r"(<|\[)\\(\\*)" + _REST, "$1$2$3")
BLOCK = r"(?s)(\[INST\]|<s>|<<SYS>>|\[ROLE\]) (.*?) (\[/INST\]|</s>|<</SYS>>|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPE[0]), F.lit(ESCAPE[1]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(UNESCAPE[0]), F.lit(UNESCAPE[1]))


def _mark(role: Column, side: int) -> Column:
    out = F.lit(OTHER[side])
    for name, marks in MARKS.items():
        out = F.when(role == name, marks[side]).otherwise(out)
    return out


def format_chats(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, formatted, loss_spans): one shuffle, on the conversation."""
    rows = turns.select(
        F.col(conversation).alias("__id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    sorted_turns = rows.groupBy("__id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # a block begins where the role differs from the one before
    starts = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    located = sorted_turns.withColumn("starts", starts)
    blocks = F.transform(
        F.col("starts"),
        lambda s, k: F.struct(
            F.element_at("turns", s)["role"].alias("role"),
            F.transform(
                F.slice("turns", s, F.coalesce(F.get("starts", k + 1), F.size("turns") + 1) - s),
                lambda t: escape(t["text"]),
            ).alias("texts"),
        ),
    )
    # pieces in order, each with whether it bears loss
    def pieces(block: Column, k: Column) -> Column:
        known = block["role"].isin(*MARKS)
        head = F.concat(F.when(k > 0, "\n").otherwise(""), _mark(block["role"], 0), F.lit(" "), F.when(known, F.lit("")).otherwise(F.concat(escape(block["role"]), F.lit(BETWEEN))))
        inner = F.flatten(
            F.transform(
                block["texts"],
                lambda text, j: F.array(
                    F.struct(F.when(j > 0, BETWEEN).otherwise("").alias("piece"), F.lit(False).alias("loss")),
                    F.struct(text.alias("piece"), (block["role"] == "assistant").alias("loss")),
                ),
            )
        )
        tail = F.concat(F.lit(" "), _mark(block["role"], 1))
        return F.concat(F.array(F.struct(head.alias("piece"), F.lit(False).alias("loss"))), inner, F.array(F.struct(tail.alias("piece"), F.lit(False).alias("loss"))))

    flat = located.withColumn("blocks", blocks).select("__id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    spans = F.aggregate(
        "pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["piece"])).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("begin"), (acc["at"] + F.length(p["piece"])).alias("end")))))
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return flat.select(F.col("__id").alias(conversation), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_chats(chats: DataFrame, keep: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """keep columns, turns (role, text), loss_text: read back from formatted strings and loss spans."""
    blocks = F.transform(
        F.regexp_extract_all("formatted", F.lit(BLOCK), F.lit(0)),
        lambda b: F.struct(F.regexp_extract(b, BLOCK, 1).alias("mark"), F.split(F.regexp_extract(b, BLOCK, 2), r" \[TURN\] ").alias("texts")),
    )

    def turns(block: Column) -> Column:
        other = block["mark"] == OTHER[0]
        role = unescape(F.get(block["texts"], F.lit(0)))
        for name, marks in MARKS.items():
            role = F.when(block["mark"] == marks[0], name).otherwise(role)
        texts = F.when(other, F.slice(block["texts"], F.lit(2), F.size(block["texts"]))).otherwise(block["texts"])
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["begin"] + 1, s["end"] - s["begin"]))), "")
    return chats.select(*keep, F.flatten(F.transform(blocks, turns)).alias("turns"), loss.alias("loss_text"))
