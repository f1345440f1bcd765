"""Chat formatting: a declarative template, a state machine over roles, loss flags per segment.

DataFrame functions only.  A conversation becomes one row with the list of its segments; joined,
the segments are the formatted text, and ``parse`` reads turns and loss text back from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code strings a text may hold after escaping; each begins with a backslash and none with another's beginning.
BACKSLASH, MARK, END, LINE = r"\0", r"\3", r"\e", r"\n"


@dataclass(frozen=True)
class Template:
    """What a turn looks like, who is learned from, and which role may follow which.

    A turn is ``head + role + colon + text + end``.  ``moves`` gives the next state of
    ``state|role``; a conversation is valid if no move is missing and it ends in ``final``.
    """

    head: str = "### "
    colon: str = ":\n"
    end: str = "</turn>\n"
    mark: str = "###"
    stop: str = "</turn>"
    learned: tuple[str, ...] = ("assistant",)
    start: str = "start"
    final: tuple[str, ...] = ("assistant",)
    moves: dict[str, str] = field(
        default_factory=lambda: {
            "start|system": "system",
            "start|user": "user",
            "system|user": "user",
            "user|assistant": "assistant",
            "assistant|user": "user",
        }
    )


CHAT = Template()


def escape(text: Column, t: Template = CHAT) -> Column:
    """No control string is left inside; ``unescape`` gives the text back exactly."""
    text = F.replace(text, F.lit("\\"), F.lit(BACKSLASH))
    text = F.replace(text, F.lit(t.mark), F.lit(MARK))
    return F.replace(text, F.lit(t.stop), F.lit(END))


def unescape(text: Column, t: Template = CHAT) -> Column:
    text = F.replace(text, F.lit(END), F.lit(t.stop))
    text = F.replace(text, F.lit(MARK), F.lit(t.mark))
    return F.replace(text, F.lit(BACKSLASH), F.lit("\\"))


def _role_out(role: Column, t: Template) -> Column:
    return F.replace(escape(role, t), F.lit("\n"), F.lit(LINE))


def _role_in(role: Column, t: Template) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")), t)


def _final_state(roles: Column, t: Template) -> Column:
    moves = F.create_map(*[F.lit(x) for move in t.moves.items() for x in move])
    return F.aggregate(
        roles, F.lit(t.start), lambda state, role: F.coalesce(moves[F.concat(state, F.lit("|"), role)], F.lit("invalid"))
    )


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", t: Template = CHAT
) -> DataFrame:
    """One row per conversation: ``conv_id``, ``valid``, ``segments``.

    ``segments`` is an array of (text, loss); loss marks the text of learned roles, without marks
    and end.  Rows go by turn (null first), ties by role and text.  Null text and null role are
    empty; an unknown role makes the conversation invalid, and it is formatted all the same.  Other
    columns are left out.  A conversation is one row of the result, so it must fit one task.
    """
    said = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(said)).alias("said"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("said", lambda x: F.array(
        part(F.concat(F.lit(t.head), _role_out(x["role"], t), F.lit(t.colon)), F.lit(False)),
        part(escape(x["text"], t), x["role"].isin(*t.learned)),
        part(F.lit(t.end), F.lit(False)),
    )))
    state = _final_state(F.transform("said", lambda x: x["role"]), t)
    return chats.select("conv_id", state.isin(*t.final).alias("valid"), segments.alias("segments"))


def parse(chats: DataFrame, t: Template = CHAT) -> DataFrame:
    """Read back: ``conv_id``, ``valid``, ``formatted``, ``turns`` of (role, text), ``loss_text``.

    Turns come from the formatted text alone, the learned text from the loss flags.
    """
    formatted = F.concat_ws("", F.transform("segments", lambda s: s["text"]))
    pieces = F.split(F.col("formatted"), F.lit(rf"\Q{t.end}\E"), -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    ends = lambda piece: F.instr(piece, t.colon)
    read = F.transform(pieces, lambda p: F.struct(
        _role_in(F.substring(p, F.lit(len(t.head) + 1), ends(p) - 1 - len(t.head)), t).alias("role"),
        unescape(F.substring(p, ends(p) + len(t.colon), F.length(p)), t).alias("text"),
    ))
    learned = F.filter("segments", lambda s: s["loss"])
    loss = F.concat_ws("", F.transform(learned, lambda s: unescape(s["text"], t)))
    return chats.withColumn("formatted", formatted).select(
        "conv_id", "valid", "formatted", read.alias("turns"), loss.alias("loss_text")
    )
