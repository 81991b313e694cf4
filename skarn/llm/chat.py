"""Chat formatting from a declarative template, native.

A template names, for each role, the markers around a turn and whether its text is under the loss
mask; other roles are written by name.  Its control strings are escaped inside texts (and
names): backslashes are doubled and one is put after the first character wherever a control string
begins, so no control string is left; ``unescape`` reverses that exactly.  No marker has a proper
suffix that begins another, so none can form across the edge of a text either.

A finite-state machine over roles checks the turn order of each conversation (``valid``, and the
first turn that breaks it).  The output has the formatted text and its segments, each with a loss
flag.

Defined cases: turns are ordered by turn number, then role and text (ties and repeated rows are all
kept); null text and a null role count as empty; an empty table gives an empty result; other columns
are ignored.  A conversation is one row of the result, so it has to fit into one row (2 GB).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Role:
    opens: str
    closes: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    roles: dict[str, Role] = field(default_factory=lambda: {
        "system": Role("<<SYS>>", "<</SYS>>"),
        "user": Role("[INST]", "[/INST]"),
        "assistant": Role("<s>", "</s>", loss=True),
    })
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    # state -> role -> next state; a conversation may end in any state of ``final``
    transitions: dict[str, dict[str, str]] = field(default_factory=lambda: {
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    })
    final: tuple[str, ...] = ("answered",)

    @property
    def controls(self) -> list[str]:
        return [x for r in self.roles.values() for x in (r.opens, r.closes)] + list(self.other)


LLAMA = Template()
_CONTROL_CLASS = re.compile(r"([\\^$.|?*+()\[\]{}<>/-])")


def _quoted(x: str) -> str:
    return _CONTROL_CLASS.sub(r"\\\1", x)


def escape(text: Column, template: Template = LLAMA) -> Column:
    begins = "(?=" + "|".join(map(_quoted, template.controls)) + ")(.)"
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, begins, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _by_role(role: Column, template: Template, known, other: Column) -> Column:
    out = None
    for name, r in template.roles.items():
        out = (F if out is None else out).when(role == name, known(r))
    return out.otherwise(other)


def segments_of(turn: Column, template: Template) -> Column:
    """Opening marker, text, closing marker of one turn, with their loss flags."""
    no = F.lit(False)
    opens = _by_role(turn["role"], template, lambda r: F.lit(r.opens), F.concat(F.lit(template.other[0]), escape(turn["role"], template), F.lit(template.other[1])))
    closes = _by_role(turn["role"], template, lambda r: F.lit(r.closes), F.lit(template.other[2]))
    loss = _by_role(turn["role"], template, lambda r: F.lit(r.loss), no)
    part = lambda text, flag: F.struct(text.alias("text"), flag.alias("loss"))
    return F.array(part(opens, no), part(escape(turn["text"], template), loss), part(closes, no))


def order_check(roles: Column, template: Template) -> Column:
    """Struct (state, place): the state after the last turn, "error" once a turn has no transition,
    and the place from 1 of the turn that broke the order (0 if none)."""
    moves = {f"{s} {r}": n for s, by in template.transitions.items() for r, n in by.items()}
    table = F.create_map(*[F.lit(x) for kv in moves.items() for x in kv])
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("place"), F.lit(0).alias("at"))

    def step(acc: Column, role: Column) -> Column:
        to = F.coalesce(F.element_at(table, F.concat(acc["state"], F.lit(" "), role)), F.lit("error"))
        broke = (to == "error") & (acc["place"] == 0)
        return F.struct(to.alias("state"), F.when(broke, acc["at"] + 1).otherwise(acc["place"]).alias("place"), (acc["at"] + 1).alias("at"))

    return F.aggregate(roles, start, step)


def format_conversations(turns: DataFrame, template: Template = LLAMA, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, n_turns, valid, broken_at, segments (text, loss) and formatted."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    gathered = turns.groupBy(F.col(conv_id).cast("bigint").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    checked = gathered.withColumn("order", order_check(F.transform("turns", lambda t: t["role"]), template))
    laid = checked.withColumn("segments", F.flatten(F.transform("turns", lambda t: segments_of(t, template))))
    return laid.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.col("order.state").isin(*template.final).alias("valid"),
        F.col("order.place").alias("broken_at"),
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
    )


def read_back(formatted: Column, template: Template = LLAMA) -> Column:
    """The turns (role, text) of a formatted conversation."""
    q = _quoted
    a, b, c = map(q, template.other)
    shapes = [f"{q(r.opens)}.*?{q(r.closes)}" for r in template.roles.values()] + [f"{a}.*?{b}.*?{c}"]
    turns = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(shapes)), F.lit(0))

    def parse(x: Column) -> Column:
        role = text = None
        for name, r in template.roles.items():
            here = F.startswith(x, F.lit(r.opens))
            inner = F.substring(x, F.lit(len(r.opens) + 1), F.length(x) - len(r.opens) - len(r.closes))
            role = (F if role is None else role).when(here, F.lit(name))
            text = (F if text is None else text).when(here, inner)
        first, middle, last = template.other
        split = F.locate(middle, x)
        role = role.otherwise(unescape(F.substring(x, F.lit(len(first) + 1), split - len(first) - 1)))
        text = text.otherwise(F.substring(x, split + len(middle), F.length(x) - split - len(middle) - len(last) + 1))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(turns, parse)


def digests(formatted: DataFrame, template: Template = LLAMA) -> DataFrame:
    """What is read back from ``formatted`` and its segments."""
    whole = F.array_join(F.flatten(F.transform("read", lambda t: F.array(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    read = formatted.withColumn("read", read_back(F.col("formatted"), template)).withColumn("loss_text", loss)
    return read.select(
        "conv_id",
        F.size("read").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
        "broken_at",
    )
