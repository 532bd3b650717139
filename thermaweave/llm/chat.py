"""Chat formatting: a finite-state machine over roles, and text segments with loss flags.

A declarative :class:`Template` names each role's opening and closing marks, the roles whose texts are
learnt, and which role may follow which. Turns of a conversation are read in order; each gives three
segments (mark, text, mark) with a loss flag each, and a flag when the machine does not allow its role there. Control strings
inside texts are escaped, and :meth:`Template.read` takes a formatted conversation apart again, exactly.

Conversations are dealt by id and streamed in the order of turns, so a conversation of any length passes
through in batches; its digest has to be computed in order, which is the one thing that stays in one task.

Defined cases: a NULL text is empty; a role that the template does not name (or NULL, taken as the empty name) is
written between general marks with its name, never learnt and never allowed by the machine; turns of one number are ordered by
role and text, NULLs first; repeated rows are repeated turns; NULL ids form one conversation; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


@dataclass(frozen=True)
class Template:
    """Marks per role, learnt roles, allowed successions ('' stands for the start)."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")})
    other: tuple[str, str, str] = ("<<ROLE>>", "<</ROLE>>", "<<END>>")
    learnt: frozenset[str] = frozenset({"assistant"})
    allowed: dict[str, frozenset[str]] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    escape: str = "\\"

    def __post_init__(self):
        controls = self.controls
        if len(set(controls)) < len(controls) or not all(controls) or len(controls) > 26:
            raise ValueError("marks need distinct control strings, 26 at most")
        for c in controls:
            if self.escape in c or c[0].islower():
                raise ValueError(f"{c!r} holds the escape sign or starts with a code letter")
            for d in controls:
                if any(d.startswith(c[k:]) for k in range(1, len(c))) or (c != d and c in d):
                    raise ValueError(f"the end of {c!r} can be taken for the start of {d!r}")

    @property
    def controls(self) -> list[str]:
        return [m.strip() for pair in self.marks.values() for m in pair] + [m.strip() for m in self.other]

    def hide(self, text: str) -> str:
        """The text with control strings as codes: the escape sign and a letter; the sign itself is doubled."""
        text = text.replace(self.escape, self.escape * 2)
        for k, c in enumerate(self.controls):
            text = text.replace(c, self.escape + chr(97 + k))
        return text

    def show(self, text: str) -> str:
        """The inverse of :meth:`hide`."""
        if self.escape not in text:
            return text
        controls, sign = self.controls, self.escape
        return re.sub(re.escape(sign) + "(.)", lambda m: sign if m[1] == sign else controls[ord(m[1]) - 97], text)

    def segments(self, role: str | None, text: str | None) -> list[tuple[str, bool]]:
        """A turn as (text, loss) parts."""
        hidden = self.hide(text or "")
        if role in self.marks:
            opening, closing = self.marks[role]
            return [(opening, False), (hidden, role in self.learnt), (closing, False)]
        a, b, c = self.other
        return [(a + self.hide(role or "") + b, False), (hidden, False), (c, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a formatted conversation."""
        turns, at = [], 0
        while at < len(formatted):
            for role, (opening, closing) in self.marks.items():
                if formatted.startswith(opening, at):
                    start = at + len(opening)
                    break
            else:
                a, b, closing = self.other
                if not formatted.startswith(a, at):
                    raise ValueError(f"no mark at {at}")
                mid = formatted.index(b, at)
                role, start = self.show(formatted[at + len(a) : mid]), mid + len(b)
            end = formatted.index(closing, start)
            turns.append((role, self.show(formatted[start:end])))
            at = end + len(closing)
        return turns


def turns(conversations: DataFrame, template: Template | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted turns in order: id, position, role, allowed, segments (array of text and loss)."""
    template = template or Template()
    rows_ = conversations.select(F.col(id_col).alias("_id"), F.col(turn_col).alias("_turn"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"))
    ordered = rows_.repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text")
    state: list = [object(), 0, ""]  # conversation, position, role before

    def rows(batch):
        made: dict[str, list] = {c: [] for c in ("_id", "position", "role", "allowed", "segments")}
        for key, role, text in zip(batch["_id"], batch["_role"], batch["_text"]):
            if key != state[0]:
                state[:] = [key, 0, ""]
            segments = [{"text": t, "loss": loss} for t, loss in template.segments(role, text)]
            for c, v in zip(made, (key, state[1], role, role in template.allowed.get(state[2], ()), segments)):
                made[c].append(v)
            state[1:] = [state[1] + 1, role]
        return made

    kind = conversations.schema[id_col].dataType.simpleString()
    made = map_batches(ordered, rows, f"_id {kind}, position bigint, role string, allowed boolean, segments array<struct<text: string, loss: boolean>>")
    return made.withColumnRenamed("_id", id_col)


def digests(formatted: DataFrame, template: Template | None = None, id_col: str = "conv_id") -> DataFrame:
    """What is read back from :func:`turns` (streamed in its order), a row for each conversation."""
    template = template or Template()
    names = ("_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_violations")
    now: list = []

    def close(made):
        if now:
            key, n, whole, loss_n, loss, chars, bad = now
            for c, v in zip(made, (key, n, whole.hexdigest(), loss_n, loss.hexdigest(), chars, bad)):
                made[c].append(v)

    def rows(batch):
        made: dict[str, list] = {c: [] for c in names}
        for key, allowed, segments in zip(batch["_id"], batch["allowed"], batch["segments"]):
            if not now or key != now[0]:
                close(made)
                now[:] = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            written = "".join(s["text"] for s in segments)
            for role, text in template.read(written):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            learnt = "".join(template.show(s["text"]) for s in segments if s["loss"])
            now[3] += len(learnt)
            now[4].update(learnt.encode("utf-8", "surrogatepass"))
            now[5] += len(written)
            now[6] += not allowed
        return made

    def flush():
        made: dict[str, list] = {c: [] for c in names}
        close(made)
        return made

    kind = formatted.schema[id_col].dataType.simpleString()
    made = map_batches(formatted.select(F.col(id_col).alias("_id"), "allowed", "segments"), rows, f"_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_violations bigint", flush)
    return made.withColumnRenamed("_id", id_col)
