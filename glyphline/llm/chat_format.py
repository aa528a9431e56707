"""Chat formatting: turns to one marked text per conversation, reversibly, in Spark expressions only."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import hex_sha256, let

# The template's marks
START, SEP, NEXT, END = "<|start|>", "<|sep|>", "<|next|>", "<|end|>"
# Control strings of this and of other templates, escaped inside texts and roles
CONTROL = (START, SEP, NEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLES = ("assistant",)

# a control string's first character, backslashes, and the rest: escaping adds a backslash, reading takes one off. Both patterns begin
# with the character that is looked for, and only texts that contain it meet them: trying a pattern at every place is the costly part
_RESTS = {c: r"\\*(?:" + "|".join(re.escape(s[1:]) for s in CONTROL if s[0] == c) + ")" for c in sorted({s[0] for s in CONTROL})}
_BARE = "|".join(f"{re.escape(c)}(?={rest})" for c, rest in _RESTS.items())
_ESCAPED = r"\\(?:" + "|".join(rf"(?<={re.escape(c)}\\)(?={rest})" for c, rest in _RESTS.items()) + ")"


def escape(text: Column) -> Column:
    """The text with a backslash more after the first character of every control string, so that none is left.

    A control string that has backslashes there already gets one more too, which makes it reversible.
    """
    may = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in _RESTS])
    return F.when(may, F.regexp_replace(text, _BARE, r"$0\\")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, _ESCAPED, "")).otherwise(text)


def _quote(mark: str) -> str:
    return "\\Q" + mark + "\\E"


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, segments) for every conversation.

    Turns are collected as structs and sorted by turn, role and text; neighbours of one role become one block;
    a block is START role SEP text (NEXT text)… END. ``segments`` cuts ``formatted`` into
    (text, loss): loss marks exactly the texts of LOSS_ROLES, without any mark. One shuffle, with rows of a conversation
    collected before it; work on a conversation is linear in its turns.

    Null text or role: empty. Null turn: first. Repeated rows: turns of their own. A null conversation id is a
    conversation. An empty table gives an empty result. Further columns are ignored.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    heads = F.filter(
        F.transform("turns", lambda t, i: F.when((i == 0) | (F.get("turns", i - 1)["role"] != t["role"]), i)), lambda i: i.isNotNull()
    )
    chats = chats.withColumn("heads", heads)
    blocks = F.transform(
        "heads",
        lambda h, k: F.struct(
            F.get("turns", h)["role"].alias("role"), F.slice("turns", h + 1, F.coalesce(F.get("heads", k + 1), F.size("turns")) - h).alias("turns")
        ),
    )
    mark = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))

    def segments(b: Column) -> Column:
        loss = b["role"].isin(*LOSS_ROLES)
        said = lambda t: F.struct(escape(t["text"]).alias("text"), loss.alias("loss"))
        inner = F.transform(b["turns"], lambda t, i: F.when(i == 0, F.array(said(t))).otherwise(F.array(mark(F.lit(NEXT)), said(t))))
        return F.concat(F.array(mark(F.concat(F.lit(START), escape(b["role"]), F.lit(SEP)))), F.flatten(inner), F.array(mark(F.lit(END))))

    chats = chats.select("conv", F.flatten(F.transform(blocks, segments)).alias("segments"))
    return chats.select(F.col("conv").alias(conv), F.array_join("segments.text", "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted conversation was made from."""

    def turns(block: Column) -> Column:
        def said(parts: Column) -> Column:
            role = unescape(F.substring(parts[0], len(START) + 1, 1 << 30))
            return let(role, lambda r: F.transform(F.split(parts[1], _quote(NEXT), -1), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

        return let(F.split(block, _quote(SEP), -1), said)

    blocks = F.split(formatted, _quote(END), -1)
    return let(blocks, lambda b: F.flatten(F.transform(F.slice(b, 1, F.size(b) - 1), turns)))


def digests(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the output tells about each conversation: turns, and text under the loss mask, as read back from it."""
    told = chats.select(
        conv,
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return told.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        hex_sha256(lines).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hex_sha256(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns plus conversation -7, whose two texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").union(probe)


_SQL_ESCAPE = "regexp_replace({0}, '(<|\\[)(\\\\*\\|(?:start|sep|next|end|im_start|im_end|endoftext)\\|>|\\\\*/?s>|\\\\*/?INST\\]|\\\\*</?SYS>>)', '\\1\\\\\\2', 'g')"

SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
n AS (SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w = role, false) AS goes_on FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_SQL_ESCAPE.format('text')}) + CASE WHEN goes_on THEN {len(NEXT)} ELSE length({_SQL_ESCAPE.format('role')}) + {len(START + SEP + END)} END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id"""
