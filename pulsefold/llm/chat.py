"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import chunked


@dataclass(frozen=True)
class Template:
    """How a conversation is written: `turn` role `text` text `end` for each turn.

    The three marks begin with `mark`, which never stands in an escaped role or text: there each backslash is
    doubled and a backslash parts the two characters of `mark`. So the marks can be found again and the
    contents restored.
    """

    mark: str = "<|"
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "<|end|>"
    #: From state and role to the next state.
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    #: The state in which the machine goes on after a role that has no move; "lost" for all others.
    resume: dict[str, str] = field(default_factory=lambda: {"system": "system", "user": "user", "assistant": "assistant"})
    #: States in which a conversation may end, and states whose texts are learnt.
    ends: tuple[str, ...] = ("assistant",)
    loss_states: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(template.mark), F.lit(f"{template.mark[0]}\\{template.mark[1:]}"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


#: Turns whose states are written in one string; strings of all turns would be copied for each of them.
STRETCH = 256


def _letters(template: Template) -> dict[str, str]:
    return {s: chr(ord("a") + i) for i, s in enumerate(["lost", "start", *sorted({*template.moves.values(), *template.resume.values()} - {"lost", "start"})])}


def _trace(turns: Column, template: Template) -> Column:
    """The state after each turn as an array of letters, upper case where the turn had no move.

    Turns are folded stretch by stretch, and only the last state goes from one to the next.
    """
    letter = _letters(template)
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) if d else F.create_map().cast("map<string,string>")
    moves = pairs({f"{letter[state]}{role}": letter[to] for (state, role), to in template.moves.items()})
    resume = pairs({role: letter[state].upper() for role, state in template.resume.items()})

    def step(trace: Column, turn: Column) -> Column:
        before = F.lower(F.right(trace, F.lit(1)))
        return F.concat(trace, F.coalesce(F.try_element_at(moves, F.concat(before, turn["role"])), F.try_element_at(resume, turn["role"]), F.lit(letter["lost"].upper())))

    def stretch(s: Column, part: Column) -> Column:
        one = F.transform(F.array(F.aggregate(part, s["last"], step)), lambda t: F.struct(F.right(t, F.lit(1)).alias("last"), F.array_append(s["out"], F.substring(t, F.lit(2), F.lit(STRETCH))).alias("out")))
        return F.get(one, F.lit(0))

    start = F.struct(F.lit(letter["start"]).alias("last"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(chunked(turns, STRETCH), start, stretch, lambda s: F.flatten(F.transform(s["out"], lambda t: F.filter(F.split(t, ""), lambda c: c != ""))))


def format_chats(
    df: DataFrame,
    template: Template = TEMPLATE,
    conv_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """One row per conversation: the key, formatted, segments, valid, bad_turn.

    formatted is the whole text; segments is the same text cut into array<struct<text, loss>>, loss true for the
    texts of turns that bring the machine to one of the template's loss states. valid says if the machine has a move
    for every role and stops in an end state; bad_turn is the index of the first turn that has none (null if all have).
    An invalid conversation is formatted all the same: after a turn without a move the machine resumes by its role.

    A null role or text counts as empty; rows are ordered by turn (null first), then role, then text, so ties
    and repeated rows have one order. Rows with a null key form one conversation. An empty table gives an empty
    one; other columns are left out. Texts of any length stay whole: a conversation is one row of the result.
    """
    turn = F.struct(F.col(turn_column).alias("turn"), F.coalesce(F.col(role_column), F.lit("")).alias("role"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    turns = df.groupBy(F.col(conv_column)).agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    name = F.create_map(*[F.lit(x) for s, c in _letters(template).items() for x in (c, s)])
    traced = turns.withColumn("__letters", _trace(F.col("__turns"), template))
    traced = traced.withColumn("__states", F.transform("__letters", lambda c: F.element_at(name, F.lower(c)))).withColumn("__moved", F.transform("__letters", lambda c: c == F.lower(c)))
    no = F.lit(False)
    segment = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    segments = F.flatten(
        F.zip_with(
            "__turns",
            "__states",
            lambda t, state: F.array(
                segment(F.concat(F.lit(template.turn), escaped(t["role"], template), F.lit(template.text)), no),
                segment(escaped(t["text"], template), state.isin(*template.loss_states)),
                segment(F.lit(template.end), no),
            ),
        )
    )
    bad = F.array_position("__moved", F.lit(False)) - 1
    return traced.withColumn("segments", segments).select(
        conv_column,
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        ((bad < 0) & F.element_at("__states", -1).isin(*template.ends)).alias("valid"),
        F.when(bad >= 0, bad.cast("int")).alias("bad_turn"),
    )


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns array<struct<role, text>> that a formatted conversation holds."""
    pieces = F.filter(F.split(formatted, re.escape(template.end), -1), lambda x: x != "")
    role = lambda x: F.substring_index(x, template.text, 1)
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescaped(F.regexp_replace(role(x), "^" + re.escape(template.turn), "")).alias("role"),
            unescaped(F.substring_index(x, template.text, -1)).alias("text"),
        ),
    )


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         replace(replace(coalesce(role, ''), '\', '\\'), '<|', '<\|') AS r, replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|') AS x FROM c),
p AS (SELECT *, row_number() OVER o AS k, CASE WHEN row_number() OVER o = 1 THEN 'start' ELSE lag(role) OVER o END AS before FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
q AS (SELECT *, (before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) AS moved FROM p)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(r) + length(x) + 23) AS BIGINT) AS formatted_chars,
       bool_and(moved) AND arg_max(role, k) = 'assistant' AS valid, CAST(min(k) FILTER (WHERE NOT moved) - 1 AS INTEGER) AS bad_turn
FROM q GROUP BY conv_id
"""
