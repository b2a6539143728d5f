"""Chat formatting (native) by event-sourced reconstruction.

The log of a conversation is partitioned by conversation, sorted by sequence and folded:
`message` starts a turn's text, `delta` appends to it, `edit` replaces it and `regenerate` empties
it; the last two also withdraw every event that a later turn has got so far.  What is left is
rendered as `<|im_start|>role\\ntext<|im_end|>\\n` per turn, with a loss mask over the texts of
assistant turns.  Control strings inside roles and texts are escaped reversibly.

Defined cases
* null text or role: empty; null conversation id: a conversation of its own.
* Events of one sequence number are folded in the order of turn, event and text; repeated rows
  are repeated events.  An empty log gives no conversations; extra columns are not read.
* A conversation's result is one string, so its turns meet in one task by nature; they are sorted
  by Spark (which spills) and joined in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table

#: The control strings that must not occur inside a text, and their escapes.
CONTROL = (("&", "&0;"), ("<|", "&1;"), ("<s>", "&2;"), ("</s>", "&3;"), ("[INST]", "&4;"), ("[/INST]", "&5;"), ("<<SYS>>", "&6;"), ("<</SYS>>", "&7;"))
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    """`&` first: then every `&` of the result opens an escape, which makes it reversible."""
    for plain, code in CONTROL:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(CONTROL):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) from events (conv_id, seq, turn, event, role, text)."""
    conv = Window.partitionBy("conv_id")
    order = conv.orderBy("seq", "turn", "event", "text")
    rewinds = F.col("event").isin("edit", "regenerate")
    resets = F.col("event").isin("message", "edit", "regenerate")
    e = events.select("conv_id", "seq", "turn", F.coalesce("event", F.lit("message")).alias("event"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.withColumn("at", F.row_number().over(order))
    per_turn = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("reset_at", F.max(F.when(resets, F.col("at"))).over(per_turn))
    e = e.withColumn("rewound_at", F.max(F.when(rewinds, F.col("at"))).over(conv.orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    # A rewind of the own turn is a reset, so only an earlier turn's can come after it.
    left = e.where((F.col("at") >= F.coalesce("reset_at", F.lit(0))) & (F.col("at") >= F.coalesce("rewound_at", F.lit(0))))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("at", F.when(F.col("event") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text")))), lambda x: x["text"])
    return left.groupBy("conv_id", "turn").agg(F.min_by("role", "at").alias("role"), F.concat_ws("", texts).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the string of a conversation and the byte spans [start, end) that count for the loss."""
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&8;")), F.lit("\n"))
    m = messages.select("conv_id", "turn", F.col("role") == "assistant", head, escape(F.col("text"))).toDF("conv_id", "turn", "scored", "head", "body")
    m = m.withColumn("piece", F.concat("head", "body", F.lit(END)))
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("start", F.coalesce(F.sum(F.octet_length("piece")).over(upto), F.lit(0)) + F.octet_length("head"))
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.octet_length("body")).alias("end"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "piece")))
    loss = F.sort_array(F.collect_list(F.when(F.col("scored"), span)))
    return m.groupBy("conv_id").agg(F.concat_ws("", F.transform(turns, lambda x: x["piece"])).alias("formatted"), loss.alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string: the inverse of render."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        name = unescape(F.replace(F.replace(head, F.lit(START)), F.lit("&8;"), F.lit("\n")))
        body = F.substr(piece, F.length(head) + 2)
        return F.struct(name.alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """The unescaped text under the loss mask."""
    cut = lambda b: F.transform(loss, lambda s: unescape(F.substr(b, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")))
    return F.concat_ws("", let(formatted.cast("binary"), cut))


def as_events(conversations: DataFrame) -> DataFrame:
    """A stored conversation as a log of whole messages; rows that repeat a turn number each stay a turn."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select("conv_id", F.row_number().over(order).alias("turn"), "role", "text")
    return c.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("event"), "role", "text")


def op7_chat(spark, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    own = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{odd}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    r = render(fold(as_events(rows))).withColumn("turns", parse(F.col("formatted"))).withColumn("scored", masked(F.col("formatted"), F.col("loss")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("scored").cast("long").alias("loss_chars"),
        F.sha2("scored", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "{}"
for _plain, _code in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_plain}', '{_code}')"
OP7_SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, '{START}' || replace({_ESCAPED.format('role')}, chr(10), '&8;') || chr(10) || {_ESCAPED.format('text')} || '<|im_end|>' || chr(10) AS piece FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(length(piece)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

QUERIES = {"op7_chat": op7_chat}
SQL = {"op7_chat": OP7_SQL}
