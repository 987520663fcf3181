"""Chat formatting with a grammar round trip, in DataFrame expressions only.

A conversation is written turn by turn:

    conversation := turn ("\\n" turn)*
    turn         := header text end
    header       := "### " name ": "
    end          := "</turn>"

``name`` is the role where it is a plain word, else ``=`` and its UTF-8 bytes in
hexadecimal. The parser is deterministic: it cuts the text at every control
string (header or end), wherever it stands, and accepts only header, text, end
in turn with nothing between turns. Every turn is first written as it is and
read again; where what is read is not what was written, because its text
holds a control string or something that reads like an escaped one, the
control strings in it are escaped, until it is. The joined conversation
is read once more and compared with its source; a difference is an error.

Escaping puts one backslash after the first character of a control string and
of whatever has only backslashes there (``<\\/turn>`` becomes ``<\\\\/turn>``);
reading takes one away. So no escaped text holds a control string, each escaped
text is read back exactly, and what ends or starts with backslashes needs no care.

``mask`` names the stretches that count for the loss: the text of every turn
of ``loss_role``, without header and end, as turn number (from 0) and places
[start, end) in code points of ``formatted``.

Defined results: a null text or role is empty; rows without a conversation
id form one conversation without id; rows are ordered by turn (those without
one first), then role and text, so ties and repeated rows have one
order; an empty table gives an empty result; other columns are ignored. A
conversation becomes one text, so one row holds it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings.
NAME = "[0-9A-Za-z_]+|=[0-9A-F]*"
CONTROL = rf"### (?:{NAME}): |</turn>\n?"
END = "</turn>"


def escaped(text: Column) -> Column:
    """One backslash more in every control string and in what reads like an escaped one."""
    text = F.regexp_replace(text, rf"#(\\*)## ({NAME}): ", r"#\\$1## $2: ")
    return F.regexp_replace(text, r"<(\\*)/turn>", r"<\\$1/turn>")


def unescaped(text: Column) -> Column:
    text = F.regexp_replace(text, rf"#\\(\\*)## ({NAME}): ", r"#$1## $2: ")
    return F.regexp_replace(text, r"<\\(\\*)/turn>", r"<$1/turn>")


def header(role: Column) -> Column:
    plain = role.rlike(r"^[0-9A-Za-z_]+\z")
    return F.concat(F.lit("### "), F.when(plain, role).otherwise(F.concat(F.lit("="), F.hex(role))), F.lit(": "))


def written(role: Column, text: Column, quoted: Column) -> Column:
    """A turn as it stands in the formatted text."""
    return F.concat(header(role), F.when(quoted, escaped(text)).otherwise(text), F.lit(END))


def _role(token: Column) -> Column:
    name = F.regexp_extract(token, rf"^### ({NAME}): ", 1)
    return F.when(name.startswith("="), F.decode(F.unhex(F.substr(name, F.lit(2))), "UTF-8")).otherwise(name)


def parsed(formatted: Column) -> Column:
    """Turns (role, written text, text) that the grammar finds; null if the text is none of its conversations."""
    cut = F.struct(F.regexp_extract_all(formatted, F.lit(CONTROL), 0).alias("marks"), F.split(formatted, CONTROL, -1).alias("parts"))

    def turns(c: Column) -> Column:
        n = F.floor(F.size(c["marks"]) / 2).cast("int")
        numbers = F.sequence(F.lit(0), n - 1)
        fits = ((F.size(c["marks"]) % 2 == 0) & (n > 0) & F.forall(F.when(n > 0, numbers), lambda k: (
            F.get(c["marks"], k * 2).startswith("### ") & F.get(c["marks"], k * 2 + 1).startswith(END)
            & (F.get(c["parts"], k * 2) == "") & (F.get(c["marks"], k * 2 + 1).endswith("\n") == (k < n - 1))))
            & (F.get(c["parts"], n * 2) == ""))
        return F.when(fits, F.transform(numbers, lambda k: F.struct(
            _role(F.get(c["marks"], k * 2)).alias("role"), F.get(c["parts"], k * 2 + 1).alias("body"),
            unescaped(F.get(c["parts"], k * 2 + 1)).alias("text"))))

    # bound once by a lambda, so that the text is cut once
    return F.get(F.transform(F.array(cut), turns), F.lit(0))


def _read_alone(role: Column, text: Column, quoted: Column) -> Column:
    """The turn, written and read by itself, is what it was."""
    found = parsed(written(role, text, quoted))
    return F.coalesce((F.size(found) == 1) & (F.get(found, F.lit(0))["role"] == role) & (F.get(found, F.lit(0))["text"] == text), F.lit(False))


def format_chats(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 loss_role: str = "assistant") -> DataFrame:
    """Per conversation: conv_id, formatted, mask (turn, start, end) and read: its turns (role, body, text) as parsed from ``formatted``."""
    turns = rows.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
                        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    who, what, quoted = F.col("role"), F.col("text"), F.col("quoted")
    turns = turns.withColumn("quoted", ~_read_alone(who, what, F.lit(False)))
    turns = turns.withColumn("quoted", F.when(~quoted | _read_alone(who, what, F.lit(True)), quoted).otherwise(
        F.raise_error(F.lit("a turn is not read back as it was written"))))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length(written(who, what, quoted)).cast("long")
    head = F.length(header(who)).cast("long")
    turns = turns.withColumns({"size": size, "head": head})
    turns = turns.withColumns({"end": F.sum(F.col("size") + 1).over(order) - 1 - len(END), "n": F.count("*").over(order)})
    start = F.col("end") - F.col("size") + F.col("head") + len(END)
    one = F.struct("n", "role", "text", "quoted", start.alias("start"), "end")
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    whole = whole.withColumn("formatted", F.array_join(F.transform(
        "turns", lambda t: written(t["role"], t["text"], t["quoted"])), "\n"))
    whole = whole.withColumn("read", parsed(F.col("formatted")))
    same = F.transform("read", lambda t: F.struct(t["role"], t["text"])) == F.transform(
        "turns", lambda t: F.struct(t["role"], t["text"]))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(
        (t["n"] - 1).cast("int").alias("turn"), t["start"].alias("start"), t["end"].alias("end")))
    return whole.select(
        "conv_id", F.when(F.coalesce(same, F.lit(False)), F.col("formatted")).otherwise(
            F.raise_error(F.lit("a conversation is not read back as it was written"))).alias("formatted"), mask.alias("mask"), "read")


def masked_text(read: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, in order; each stretch must be as long as the turn's text."""
    def stretch(m: Column) -> Column:
        found = F.get(read, m["turn"])
        return F.when(F.length(found["body"]) == m["end"] - m["start"], found["text"]).otherwise(
            F.raise_error(F.lit("the mask does not lie on a turn's text")))
    return F.array_join(F.transform(mask, stretch), "")
