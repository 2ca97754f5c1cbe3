"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn's content is an ordered array of parts, each text, image, audio or document. A visitor, one
expression over the array, flattens it: text parts give their text, others a numbered placeholder
``<|image:1|>`` that is repeated nowhere in texts, since control strings inside texts are escaped.
Attachment references and the tokens that each placeholder expands to are recorded beside it.

Template of a turn: ``<|turn|>role <|body|> content <|end|>`` and a line feed. Inside roles and
texts a control string (those of this template and of common public templates) gets one backslash
more before it than it had; removing one restores the text exactly. The spaces before
``<|body|>`` and ``<|end|>`` keep a text's own last backslash apart from the template's marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.common import table

#: Control strings that may not appear bare in a formatted text.
CONTROL = r"(?:</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z0-9_:]+\|>)"
TURN, BODY, END = "<|turn|>", " <|body|> ", " <|end|>\n"
MASKED_ROLE = "assistant"
#: Tokens that an attachment of each kind expands to, for one unit (tile, second, page).
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}

PART_TYPE = "struct<type:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({CONTROL})", "$1$2")


def text_part(text: Column) -> Column:
    """A text as an array of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(1).alias("units")))


def visit_parts(parts: Column) -> Column:
    """Flatten an array of parts: struct(content, attachments, expanded_tokens).

    Null arrays and null parts count as none; a null text is empty; an attachment's null or
    negative units count as 1; an unknown type is treated as a document.
    """
    kept = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull())
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    kind = lambda p: F.when(p["type"].isin(*UNIT_TOKENS), p["type"]).otherwise("document")
    tokens = lambda p: (F.greatest(F.coalesce(p["units"], F.lit(1)), F.lit(1)) * F.coalesce(*[F.when(kind(p) == k, F.lit(n)) for k, n in UNIT_TOKENS.items()])).cast("long")
    shown = lambda p, n: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit(":"), n.cast("string"), F.lit("|>")))
    # Attachments are numbered by their place among the attachments alone, which is found once for all of them.
    places = F.filter(F.transform(kept, lambda p, i: F.when(~is_text(p), i)), lambda i: i.isNotNull())
    attachments = F.transform(places, lambda i, n: F.struct((n + 1).alias("number"), kind(kept[i]).alias("type"), kept[i]["ref"].alias("ref"), tokens(kept[i]).alias("tokens")))
    # The stretch of texts before each attachment, the attachment, and the texts after the last one.
    bounds = F.concat(places, F.array(F.size(kept)))
    before = lambda n: F.when(n == 0, F.lit(0)).otherwise(F.try_element_at(places, n) + 1)
    stretch = lambda end, n: F.array_join(F.transform(F.slice(kept, before(n) + 1, end - before(n)), lambda p: shown(p, F.lit(0))), "")
    pieces = F.transform(bounds, lambda end, n: F.concat(stretch(end, n), F.when(n < F.size(places), shown(F.try_element_at(kept, end + 1), n + 1)).otherwise("")))
    # One text part, the common case, needs no joining of pieces.
    content = F.when((F.size(kept) == 1) & is_text(kept[0]), escape(F.coalesce(kept[0]["text"], F.lit("")))).otherwise(F.array_join(pieces, ""))
    return F.struct(content.alias("content"), attachments.alias("attachments"), F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row for each conversation: id, n_turns, formatted, loss_mask, loss_spans, attachments, expanded_tokens.

    ``loss_mask`` has a boolean for each turn, true where its content is trained on, and
    ``loss_spans`` the same as code point ranges of ``formatted``. Null text or role: empty. Turns
    with equal numbers come in order of role and text (that of the text parts, as it was before
    escapes, then of the content), null numbers first; rows with a null id form
    one conversation. Repeated rows are repeated turns. An empty table gives no rows.
    """
    content = visit_parts(F.col(parts_col) if parts_col else text_part(F.col(text_col)))
    plain = F.array_join(F.transform(F.filter(F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>")), lambda p: p.isNotNull() & (F.coalesce(p["type"], F.lit("text")) == "text")), lambda p: F.coalesce(p["text"], F.lit(""))), "") if parts_col else F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), plain.alias("plain"), content.alias("v"))
    rows = rows.select("conv_id", "turn", "role", "plain", F.col("v.content").alias("content"), F.col("v.attachments").alias("attachments"), F.col("v.expanded_tokens").alias("tokens"))
    # Where each turn begins in its conversation: a running sum, which a window takes in one pass however long the conversation.
    size = F.length(_head(F.col("role"))) + F.length("content") + len(END)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "plain", "content", "attachments")
    start = F.coalesce(F.sum(size).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    placed = rows.select("conv_id", F.struct(start.alias("start"), "role", "content", "attachments", "tokens").alias("t"))
    chats = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    body = lambda t: t["start"] + F.length(_head(t["role"]))
    return chats.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(_head(t["role"]), t["content"], F.lit(END))), "").alias("formatted"),
        F.transform("ts", lambda t: t["role"] == MASKED_ROLE).alias("loss_mask"),
        F.transform(F.filter("ts", lambda t: t["role"] == MASKED_ROLE), lambda t: F.struct(body(t).alias("start"), (body(t) + F.length(t["content"])).alias("end"))).alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("ts", F.lit(0).cast("long"), lambda a, t: a + t["tokens"]).alias("expanded_tokens"),
    )


def _head(role: Column) -> Column:
    return F.concat(F.lit(TURN), escape(role), F.lit(BODY))


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text: array of struct(role, text), exactly as they were."""
    pieces = F.filter(F.split(formatted, rf"(?<!\\){_quoted(TURN)}"), lambda _, i: i > 0)
    split = lambda s: F.split(s, _quoted(BODY), 2)
    return F.transform(pieces, lambda s: F.struct(unescape(split(s)[0]).alias("role"), unescape(F.regexp_replace(split(s)[1], rf"{_quoted(END)}\z", "")).alias("text")))


def _quoted(s: str) -> str:
    return s.replace("|", r"\|").replace("\n", r"\n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, then read back from the formatted text."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    trap = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    chats = format_chats(turns.unionByName(probe)).withColumn("back", read_back(F.col("formatted")))
    # The mask is applied to the formatted text itself: its spans, cut out and unescaped.
    trained = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return chats.withColumn("trained", trained).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(regexp_replace(role, '(\\*)((?:</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z0-9_:]+\|>))', '\1\\\2', 'g'))
    + length(regexp_replace(text, '(\\*)((?:</?s>|\[/?INST\]|<</?SYS>>|<\|[A-Za-z0-9_:]+\|>))', '\1\\\2', 'g')) + 27 AS n
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
