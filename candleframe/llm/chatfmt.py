"""Chat formatting: a declarative template, a finite-state machine over roles, loss flags.

A template names for each role the control strings before and after the text and whether
the text is learned (loss). The machine's state is the role of the turn before; a turn is in
order if the template allows its role in that state. Each turn becomes segments of text with
a loss flag each. Control strings inside texts are escaped with a backslash, and backslashes
are doubled, so that a reader gets every role and text back exactly.

Rows of a conversation are sorted by turn (ties by role, then text; nulls first) within one
partition and streamed through it: memory does not grow with a conversation, however long.

Defined results: null texts and roles count as empty; a role without an entry is written
with its name; conversations with turns out of order are formatted whole and marked, never
dropped; a null conversation id is a conversation of its own; repeated rows are turns like
any others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Template:
    """``roles``: role -> (before, after, loss). ``other``: before, between name and text, after."""

    roles: dict[str, tuple[str, str, bool]]
    other: tuple[str, str, str]
    follows: dict[str, tuple[str, ...]]  # state (the role before, or "start") -> roles allowed next
    controls: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        marks = [m for before, after, _ in self.roles.values() for m in (before, after)] + list(self.other)
        found = [re.match(r"[<\[][^<\[\\\s]*[>\]]", m.strip(" ")) for m in marks]
        if any(f is None or f.group() != m.strip(" ") for f, m in zip(found, marks, strict=True)):
            raise ValueError("each mark must be one control string in <> or [], with spaces around it at most")
        object.__setattr__(self, "controls", tuple(sorted({m.strip(" ") for m in marks}, key=len, reverse=True)))

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls)))


DEFAULT = Template(
    roles={"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s>", "</s>", True)},
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
    follows={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def escape(text: str, controls: re.Pattern) -> str:
    return controls.sub(r"\\\g<0>", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def segments(role: str, text: str, template: Template, controls: re.Pattern) -> list[tuple[str, bool]]:
    """One turn as (text, loss) pairs."""
    if role in template.roles:
        before, after, loss = template.roles[role]
        return [(before, False), (escape(text, controls), loss), (after, False)]
    before, between, after = template.other
    return [(before + escape(role, controls) + between, False), (escape(text, controls), False), (after, False)]


def read_back(formatted: str, template: Template) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted string; the inverse of joining its segments."""
    scan = re.compile(r"\\.|" + template.pattern().pattern, re.DOTALL)
    by_start = {v[0].strip(" "): (r, v) for r, v in template.roles.items()}
    marks = (m for m in scan.finditer(formatted) if m.group()[0] != "\\")
    for opening in marks:
        if opening.group() in by_start:
            role, (before, after, _) = by_start[opening.group()]
            start = opening.start() + len(before)
        else:
            between, after = next(marks), template.other[2]
            role, start = unescape(formatted[opening.end() : between.start()]), between.end()
        closing = next(marks)
        lead = len(after) - len(after.lstrip(" "))
        yield role, unescape(formatted[start : closing.start() - lead])


SEGMENTS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("loss", T.BooleanType())]))
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = DEFAULT) -> DataFrame:
    """One row for each turn, in order within partitions: conv, turn, in_order, segments."""
    kind = df.schema[conv].dataType
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    schema = T.StructType([T.StructField("conv", kind), T.StructField("turn", df.schema[turn].dataType), T.StructField("in_order", T.BooleanType()), T.StructField("segments", SEGMENTS)])

    def run(batches):
        controls, now, state = template.pattern(), (), "start"
        for batch in batches:
            good, out = [], []
            for c, r, t in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                c, r, t = (c.as_py(),), r.as_py(), t.as_py()
                if c != now:
                    now, state = c, "start"
                good.append(r in template.follows.get(state, ()))
                out.append([{"text": s, "loss": loss} for s, loss in segments(r, t, template, controls)])
                state = r
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_()), pa.array(out, _SEGMENTS)], names=schema.names)

    return rows.mapInArrow(run, schema)


def digests(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """One row for each conversation, read back from ``format_turns``' output in its own order.

    A SHA-256 runs over the bytes in order, so a conversation is read by one task, turn by
    turn, with one running hash; nothing of it is gathered.
    """
    kind = formatted.schema["conv"].dataType
    schema = T.StructType(
        [T.StructField("conv_id", kind)]
        + [T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()), ("valid", T.BooleanType()))]
    )

    def run(batches):
        def done(now, s):
            return {"conv_id": now, "n_turns": s[0], "turns_sha256": s[1].hexdigest(), "loss_chars": s[2], "loss_sha256": s[3].hexdigest(), "formatted_chars": s[4], "valid": s[5]}

        state, now = None, ()
        shape = None
        for batch in batches:
            shape = pa.schema([pa.field("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
            out = []
            for c, good, segs in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or c != now:
                    if state is not None:
                        out.append(done(now, state))
                    now, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                whole = "".join(s["text"] for s in segs)
                for role, text in read_back(whole, template):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learned = "".join(unescape(s["text"]) for s in segs if s["loss"])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(whole)
                state[5] &= good
            yield pa.RecordBatch.from_pylist(out, schema=shape)
        if state is not None:
            yield pa.RecordBatch.from_pylist([done(now, state)], schema=shape)

    return formatted.mapInArrow(run, schema)
