"""Chat formatting by prefix-target expansion: every assistant turn becomes a training example of its own.

An example is the conversation's formatted text up to and including one reply, and only that reply is
trainable. All examples of a conversation are prefixes of one text, so that text is kept once, a row per
turn, and an example is a row with its place in it: the work stays in proportion to the input however long
a conversation is. :func:`example_texts` writes the prefixes out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitscore.llm.shared import ship

#: The strings that mark turns.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one after the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def format_turns(turns: DataFrame) -> DataFrame:
    """Per turn its formatted ``segment`` and, for a reply, where its trainable text lies in it.

    A user turn is ``[INST] text [/INST]``, a reply ``<s>text</s>`` of which the text is trained, any
    other role ``[ROLE]role[/ROLE]text[/ROLE]``. Null texts and roles are empty.
    """
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    segment = (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[/ROLE]"), text, F.lit("[/ROLE]")))
    )
    return turns.select("conv_id", "turn", role.alias("role"), segment.alias("segment"))


def expand(turns: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, turn, segment, start`` (its place in the conversation's formatted text,
    in characters) and, for a reply, its example: ``example`` (its number, from 0), ``prefix_end``, ``loss_start``
    and ``loss_end``.

    Example k is the conversation's formatted text up to ``prefix_end``, all turns before the reply and the reply; only the characters from ``loss_start`` to
    ``loss_end`` are trained, the reply without its marks. Turns are ordered by ``turn``, then role and
    text; repeated turns stay. A null ``conv_id`` is a conversation of its own. A conversation without a
    reply has no example. An empty table gives no rows. Columns other than ``conv_id, turn, role, text``
    are not read. A task streams its conversations turn by turn and never holds one whole.
    """
    kinds = dict(turns.dtypes)
    rows = format_turns(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    ship(turns.sparkSession)
    names = ["conv_id", "turn", "segment", "start", "example", "prefix_end", "loss_start", "loss_end"]

    def run(batches):
        current, begun, at, example = None, False, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for conv, role, segment in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if not begun or conv != current:
                    current, begun, at, example = conv, True, 0, 0
                if role == "assistant":
                    end = at + len(segment)
                    out.append((at, example, end, at + len("<s>"), end - len("</s>")))
                    example += 1
                else:
                    out.append((at, None, None, None, None))
                at += len(segment)
            made = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *made], names)

    schema = (
        f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, segment string, start bigint, example bigint, "
        "prefix_end bigint, loss_start bigint, loss_end bigint"
    )
    return rows.mapInArrow(run, schema)


def example_texts(expanded: DataFrame) -> DataFrame:
    """The examples written out: ``conv_id, example, text, loss_start, loss_end``. Grows with the square of
    a conversation's length, as the examples do."""
    replies = expanded.where("example IS NOT NULL").select("conv_id", "example", "loss_start", "loss_end")
    parts = expanded.select(F.col("conv_id").alias("_conv"), F.col("start"), "segment")
    both = replies.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("start") < F.col("loss_end")))
    grouped = both.groupBy("conv_id", "example", "loss_start", "loss_end").agg(
        F.array_sort(F.collect_list(F.struct("start", "segment"))).alias("_parts")
    )
    text = F.array_join(F.col("_parts.segment"), "")
    return grouped.select("conv_id", "example", text.alias("text"), "loss_start", "loss_end")


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if segment.startswith("[INST] "):
        return "user", unescape(segment[len("[INST] ") : -len(" [/INST]")])
    if segment.startswith("<s>"):
        return "assistant", unescape(segment[len("<s>") : -len("</s>")])
    role, text, _ = segment[len("[ROLE]") :].split("[/ROLE]")
    return unescape(role), unescape(text)


def _reply_of(example, at: int, segment: str, n_replies: int) -> str:
    """The trained text of an example, after a check of its bounds against the text read so far: its prefix
    holds all turns before and ends with this reply, and its mask leaves this reply and nothing else."""
    number, prefix_end, a, b = example
    inside = segment[a - at : b - at]
    if number != n_replies or prefix_end != at + len(segment) or f"<s>{inside}</s>" != segment:
        raise ValueError(f"example {number} does not end with its reply at {at}")
    return unescape(inside)


def read_back(expanded: DataFrame, streamed: bool = False) -> DataFrame:
    """Per conversation, from its formatted text alone: ``n_turns``, ``turns_sha256`` (role, newline, text,
    newline per turn), ``loss_chars`` and ``loss_sha256`` (all text under the loss masks, unescaped) and
    ``formatted_chars``. Streams like :func:`expand`.

    What is trained is read from the examples, one after the other. Each is checked first: one whose prefix
    does not end with its reply, or whose mask is not exactly that reply, is an error, as is a reply without an
    example. ``streamed`` says that the rows come straight from :func:`expand`, so that they need no shuffle.
    """
    kind = dict(expanded.dtypes)["conv_id"]
    rows = expanded.select("conv_id", "start", "turn", "segment", "example", "prefix_end", "loss_start", "loss_end")
    if not streamed:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    ship(expanded.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        state = None

        def close():
            conv, n, turns, chars, loss, size, _ = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def made(done):
            kinds = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            conv_type, done = batch.schema.field(0).type, []
            for conv, start, segment, *example in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5, 6, 7)), strict=True):
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append(close())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = parse(segment)
                if start != state[5] or (role == "assistant") != (example[0] is not None):
                    raise ValueError(f"turn at {start} is out of place or not in the right examples")
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if example[0] is not None:
                    reply = _reply_of(example, start, segment, state[6])
                    state[3] += len(reply)
                    state[4].update(reply.encode())
                    state[6] += 1
                state[5] += len(segment)
            if done:
                yield made(done)
        if state is not None:
            yield made([close()])

    schema = (
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )
    return rows.mapInArrow(run, schema)
