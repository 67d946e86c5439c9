"""Chat formatting as a relational plan of Spark expressions.

Turns are collected per conversation and sorted, adjacent turns of one role are merged, and the
pieces are concatenated. The template marks where a turn begins and ends, and inside a merged turn
where the next part begins; control strings inside texts and roles are escaped with a backslash, so that
everything can be read back from the output. The loss mask is kept as segments: the formatted
text is their concatenation, and those that are to be learnt are flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "<|turn|>"
BODY = "<|body|>"
PART = "<|part|>"
END = "<|end|>\n"
LEARNT_ROLE = "assistant"
#: Strings that templates read as control, and what stands for them inside texts.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Backslashes doubled, and a backslash after the first character of every control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return text


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, segments, formatted): one row per conversation.

    Rows of a conversation go by turn, then role, then text; a null turn comes first. Null texts and
    roles count as empty, rows with a null conv_id are one conversation. Repeated rows are repeated
    turns. segments is an array of (text, loss), formatted their concatenation. An empty table gives an
    empty result; further columns are ignored.
    """
    kept = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_ = kept.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def pieces(t: Column, i: Column) -> Column:
        """Of one turn: what opens it or its part, its text, and what closes it."""
        turns = F.col("turns")
        opens = (i == 0) | (F.get(turns, i - 1)["role"] != t["role"])
        closes = (i == F.size(turns) - 1) | (F.get(turns, i + 1)["role"] != t["role"])
        head = F.when(opens, F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))).otherwise(F.lit(PART))
        segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            segment(head, F.lit(False)),
            segment(escape(t["text"]), t["role"] == LEARNT_ROLE),
            segment(F.when(closes, F.lit(END)).otherwise(F.lit("")), F.lit(False)),
        )

    cut = sorted_.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return cut.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column) -> Column:
    """Array of (role, text): the turns of a formatted text, one for each part."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.element_at(F.split(block, r"<\|body\|>"), 1)
        body = F.element_at(F.split(block, r"<\|body\|>"), 2)
        parts = F.split(F.substring(body, F.lit(1), F.char_length(body) - len(END)), r"<\|part\|>")
        return F.transform(parts, lambda p: F.struct(unescape(role).alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def learnt_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def _escaped(column: str) -> str:
    inner = f"replace({column}, '\\', '\\\\')"
    for control in CONTROLS:
        inner = f"replace({inner}, '{control}', '{control[0]}\\{control[1:]}')"
    return inner


#: The digest columns straight from the rows, in DuckDB's SQL.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(role) OVER w IS NOT DISTINCT FROM role AS merged FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = '{LEARNT_ROLE}'), '') AS learnt,
    sum(length({_escaped('text')}) + CASE WHEN merged THEN {len(PART)}
      ELSE {len(TURN + BODY + END)} + length({_escaped('role')}) END) AS formatted_chars
  FROM p GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
  sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
