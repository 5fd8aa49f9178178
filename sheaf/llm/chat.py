"""Chat formatting: a template is a black box; what each turn takes up is found by rendering prefixes."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


# The template of the query ----------------------------------------------------------------


def escape(text: str) -> str:
    r"""No ``<|`` is left: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def chat_markup(turns: list[Turn]) -> str:
    """Marks every turn; line ends in a role are escaped too, for the first one ends the role."""
    return "".join([START + escape(role).replace("\n", "\\n") + "\n" + escape(text) + END + "\n" for role, text in turns])


def read_markup(formatted: str) -> list[Turn]:
    """The turns that ``chat_markup`` wrote; anything else in between is an error."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


# Black-box rendering ----------------------------------------------------------------------


class Rewrites(ValueError):
    """The template changes what it wrote for earlier turns."""

    def __init__(self, turn: int, at: int):
        super().__init__(f"rendering turn {turn} changes the output at character {at}")
        self.turn, self.at = turn, at


def spans(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The output, and for each turn where it starts and ends and where its text does, in code points.

    Successive prefixes are rendered, and each output must start with the one before it: the rest is the
    turn's. The same prefix with a single mark as the turn's text tells what stands before and after
    the text. Takes two outputs per turn, so the time is quadratic in the turns of a conversation.
    """
    before, found = template([]), []
    for k, (role, text) in enumerate(turns):
        out = template(turns[: k + 1])
        if not out.startswith(before):
            raise Rewrites(k, len(os.path.commonprefix([before, out])))
        mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in role and c not in before[-1:])
        probe = template([*turns[:k], (role, mark)])
        if not probe.startswith(before):
            raise Rewrites(k, len(os.path.commonprefix([before, probe])))
        head = probe.find(mark, len(before))
        if head < 0 or probe.find(mark, head + 1) >= 0:
            raise ValueError(f"turn {k}: the template does not show its text once")
        tail = len(probe) - head - 1
        if out[:head] != probe[:head] or out[len(out) - tail :] != probe[len(probe) - tail :]:
            raise ValueError(f"turn {k}: what surrounds the text depends on it")
        found.append((len(before), len(out), head, len(out) - tail))
        before = out
    return before, found


# Spark ------------------------------------------------------------------------------------

FORMATTED = "formatted string, n_turns bigint, spans array<struct<start:bigint,stop:bigint,loss:boolean>>, rewrites_at int"


def format_conversations(
    rows: DataFrame,
    template: Template = chat_markup,
    learn_roles: tuple[str, ...] = ("assistant",),
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per conversation: ``<conv>, formatted, n_turns, spans, rewrites_at``.

    Turns go by ``turn`` (null first), ties by role and text; repeated rows are turns of their own. Null roles and
    texts are empty. ``spans`` are the places of the texts in code points; ``loss`` marks those to learn. A template
    that rewrites history gives no spans and ``rewrites_at`` is the number of the turn that showed it,
    otherwise null. Rows without conversation id are one conversation. A conversation is one string and so
    is held by one task. No rows give no rows; other columns are ignored.
    """

    def empty(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    turn = F.struct(F.col(turn_col).alias("turn"), empty(role_col).alias("role"), empty(text_col).alias("text"))
    talks = rows.groupBy(F.col(conv_col).alias("_conv")).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    talks = talks.select("_conv", F.col("_turns.role").alias("_roles"), F.col("_turns.text").alias("_texts"))
    made = T._parse_datatype_string(FORMATTED)
    schema = T.StructType([talks.schema["_conv"], *made.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for b in batches:
            out = []
            for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = list(zip(roles, texts))
                try:
                    text, found = spans(template, turns)
                    places = [{"start": x[2], "stop": x[3], "loss": r in learn_roles} for x, r in zip(found, roles)]
                    out.append((text, len(turns), places, None))
                except Rewrites as e:
                    out.append((template(turns), len(turns), None, e.turn))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=schema.names)

    return talks.mapInArrow(run, schema).withColumnRenamed("_conv", conv_col)


def conversation_digests(formatted: DataFrame, conv_col: str = "conv_id", reader: Callable[[str], list[Turn]] = read_markup) -> DataFrame:
    """What the formatted text says when it is read back: ``<conv>, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    sent = formatted.select(F.col(conv_col).alias("_conv"), "formatted", "spans")
    made = T._parse_datatype_string("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    schema = T.StructType([sent.schema["_conv"], *made.fields])

    def run(batches):
        for b in batches:
            out = []
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                turns = reader(text)
                told = "".join([f"{role}\n{said}\n" for role, said in turns])
                loss = "".join([unescape(text[s["start"] : s["stop"]]) for s in places or () if s["loss"]])
                out.append((len(turns), _sha(told), len(loss), _sha(loss), len(text)))
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return sent.mapInArrow(run, schema).withColumnRenamed("_conv", conv_col)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
