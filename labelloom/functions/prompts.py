"""Prompt texts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.wording import CHAT, LABEL_NAMES, LONG, SYSTEM, UNKNOWN_NAME, Wording


def label_lines(names: Mapping[int, str] = LABEL_NAMES, wording: Wording = LONG) -> str:
    """The class list of a prompt, one line per class."""
    lines = []
    for label in sorted(names):
        line = wording.normal_line if label == wording.normal_label else wording.fault_line
        lines.append(line.format(label=label, name=names[label]))
    return "\n".join(lines)


def opening(names: Mapping[int, str] = LABEL_NAMES, wording: Wording = LONG) -> str:
    """The text before the code, with the class list in it."""
    return wording.before.replace("{labels}", label_lines(names, wording))


def prompt(
    code: Column,
    label: Column | None = None,
    wording: Wording = LONG,
    names: Mapping[int, str] = LABEL_NAMES,
    max_length: int | None = None,
) -> Column:
    """Prompt for a code cell; with ``label`` the training form that ends in the answer.

    The code is taken whole, unless the wording takes only its beginning or
    ``max_length`` bounds the prompt's code points. It is the code that gives
    way then, never the answer cue, without which a model has nothing to answer.
    """
    before = opening(names, wording)
    if wording.max_code_chars is not None:
        code = F.substring(code, 1, wording.max_code_chars)
    if max_length is not None:
        answer = 0 if label is None else 1 + len(str(max(names)))
        room = max_length - len(before) - len(wording.after) - answer
        if room < 0:
            raise ValueError(f"the wording alone is longer than {max_length}")
        code = F.substring(code, 1, room)
    parts = [F.lit(before), code, F.lit(wording.after)]
    if label is not None:
        parts += [F.lit(" "), label.cast("string")]
    return F.concat(*parts)


def chat_prompt(
    code: Column,
    system: Wording = SYSTEM,
    wording: Wording = CHAT,
    names: Mapping[int, str] = LABEL_NAMES,
) -> Column:
    """System part, code and answer cue as one text."""
    return F.concat(F.lit(opening(names, system)), prompt(code, None, wording, names))


def chat_messages(
    code: Column,
    label: Column | None = None,
    system: Wording = SYSTEM,
    names: Mapping[int, str] = LABEL_NAMES,
) -> Column:
    """The same conversation as an array of (role, content) for chat-format exports."""
    turns = [("system", F.lit(opening(names, system))), ("user", code)]
    if label is not None:
        turns.append(("assistant", label.cast("string")))
    return F.array(
        *[F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns]
    )


def label_name(
    label: Column,
    names: Mapping[int, str] = LABEL_NAMES,
    default: str = UNKNOWN_NAME,
    strict: bool = False,
) -> Column:
    """Class name of a label; unknown labels get ``default`` or, if strict, raise.

    The names are a Python mapping, so the lookup is a literal map and needs no join.
    """
    pairs = [F.lit(part) for pair in sorted(names.items()) for part in pair]
    name = F.try_element_at(F.create_map(*pairs), label.cast("int"))
    if strict:
        message = F.concat(F.lit("label without a name: "), label.cast("string"))
        missing = F.raise_error(message).cast("string")
    else:
        missing = F.lit(default)
    return F.when(label.isNotNull(), F.coalesce(name, missing))
