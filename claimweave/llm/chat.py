"""Chat formatting by prefix-target expansion.

A conversation becomes one formatted string; every assistant turn becomes an
example: that string up to the end of the reply, of which only the reply is
trainable. An example is held as (prefix_end, loss_start, loss_end), offsets into the
string, so a long conversation costs what its text costs, not its square; ``expand``
makes the examples' own texts.

A turn is ``<s>role\\n`` + opening + text + closing + ``</s>``. Control strings inside
roles and texts get a backslash after their first character (one more, if there
are some), which is undone in reading back. A role's own line feeds and
backslashes are written as ``\\n`` and ``\\\\``.

Defined cases: null texts and roles are empty; turns are in order of turn, then role,
then text, so repeated turn numbers and repeated rows are kept in a fixed order; rows
with a null conv_id are one conversation; null turns come first; one without an
assistant turn has no examples; only the role ``assistant``, written so, is a target.
The turns of a conversation meet in one task, as its string must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The control strings of the template.
CONTROL = r"(/?s>|/?INST\]|<?/?SYS>>)"
FIRST = r"([<\[])"
OPENING = {"user": "[INST] ", "system": "<<SYS>> "}
CLOSING = {"user": " [/INST]", "system": " <</SYS>>"}
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, FIRST + r"(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, FIRST + r"\\(\\*)" + CONTROL, r"$1$2$3")


def _around(role: Column, marks: dict[str, str]) -> Column:
    out = F.lit("")
    for name, mark in marks.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    feeds = F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return F.replace(feeds, F.lit("\\\\"), F.lit("\\"))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col``, formatted and examples (turn_no, prefix_end, loss_start, loss_end), one row a conversation."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    one = rows.select(F.col(id_col).alias("id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    turns = one.groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def parts(t):
        return F.struct(
            F.concat(F.lit("<s>"), _role_out(t["role"]), F.lit("\n"), _around(t["role"], OPENING)).alias("head"),
            escape(t["text"]).alias("body"),
            F.concat(_around(t["role"], CLOSING), F.lit("</s>")).alias("tail"),
            (t["role"] == "assistant").alias("target"),
        )

    made = turns.select("id", F.transform("turns", parts).alias("p"))
    size = lambda p: F.char_length(p["head"]) + F.char_length(p["body"]) + F.char_length(p["tail"])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<turn_no:int,prefix_end:int,loss_start:int,loss_end:int>>").alias("found"), F.lit(0).alias("n"))
    walked = F.aggregate(
        "p", start,
        lambda acc, p: F.struct(
            (acc["at"] + size(p)).alias("at"),
            F.when(p["target"], F.concat(acc["found"], F.array(F.struct(
                acc["n"].alias("turn_no"), (acc["at"] + size(p)).alias("prefix_end"),
                (acc["at"] + F.char_length(p["head"])).alias("loss_start"), (acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"])).alias("loss_end"),
            )))).otherwise(acc["found"]).alias("found"),
            (acc["n"] + 1).alias("n"),
        ),
        lambda acc: acc["found"],
    )
    joined = F.array_join(F.transform("p", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return made.select(F.col("id").alias(id_col), joined.alias("formatted"), walked.alias("examples"))


def expand(formatted: DataFrame) -> DataFrame:
    """One row an example: its text (context and reply) and the span of the reply in it."""
    others = [c for c in formatted.columns if c not in ("formatted", "examples")]
    rows = formatted.select(*others, "formatted", F.explode("examples").alias("e"))
    return rows.select(*others, "e.turn_no", F.substring(F.col("formatted"), F.lit(1), F.col("e.prefix_end")).alias("text"), "e.loss_start", "e.loss_end")


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""
    pieces = F.split(formatted, F.lit("</s>"), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p):
        at = F.instr(p, "\n")
        role = _role_in(F.substring(p, F.lit(4), at - 4))
        body = F.substring(p, at + 1, F.char_length(p))
        skip, drop = F.char_length(_around(role, OPENING)), F.char_length(_around(role, CLOSING))
        return F.struct(role.alias("role"), unescape(F.substring(body, skip + 1, F.char_length(body) - skip - drop)).alias("text"))

    return F.transform(pieces, turn)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader of the output finds: turns from the strings; replies and lengths from each example's own text."""
    reply = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    examples = expand(formatted).select(F.col(id_col).alias("_id"), F.struct("turn_no", reply.alias("reply")).alias("r"), F.char_length("text").cast("long").alias("n"))
    found = examples.groupBy("_id").agg(F.sort_array(F.collect_list("r")).alias("replies"), F.sum("n").alias("n"))
    read = formatted.select(id_col, read_turns(F.col("formatted")).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    turns = read.select(id_col, F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"))
    loss = F.coalesce(F.array_join(F.transform("replies", lambda r: r["reply"]), ""), F.lit(""))
    both = turns.join(found, F.col(id_col).eqNullSafe(F.col("_id")), "left").withColumn("loss", loss)
    return both.select(
        id_col, "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.coalesce("n", F.lit(0).cast("long")).alias("formatted_chars"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(PLANTED, "conv_id bigint, turn bigint, role string, text string")
    return digests(format_conversations(rows.unionByName(planted)))


_ESC = r"""regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2\3', 'g')"""
OP9_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (
  SELECT *, 3 + length({_ESC.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")}) + 1 + length({_ESC.format("text")}) + 4
    + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 ELSE 0 END AS n FROM c),
e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
