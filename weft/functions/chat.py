"""Chat formatting expressions (P14-P18): ChatML histories, turn/response
interleaving, instruction and reasoning conversations.

All built from array higher-order functions on a row: no explode/re-collect
round trip and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.functions.text import py_strip

# ChatML markers.
IM_START, IM_END = "<|im_start|>", "<|im_end|>"
EMPTY_THINK = "<think> </think>\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def chatml_block(role: str, content: Column) -> Column:
    return F.concat(F.lit(f"{IM_START}{role}\n"), content, F.lit(f"{IM_END}\n"))


def chatml_prompt(turns, reference, n, variant: str = "generated",
                  add_think: bool = True) -> Column:
    """History of turns ``0..n-1`` with their answers, then user turn ``n``.

    ``variant='generated'`` adds the assistant header; ``add_think=False`` adds
    an empty reasoning block.  ``n`` is 0-based.
    """
    pairs = F.arrays_zip(_c(turns).alias("t"), _c(reference).alias("r"))
    hist = F.array_join(F.transform(
        F.slice(pairs, F.lit(1), _c(n)),
        lambda x: F.concat(chatml_block("user", x["t"]), chatml_block("assistant", x["r"]))), "")
    out = F.concat(hist, chatml_block("user", F.element_at(_c(turns), _c(n) + 1)))
    if variant == "generated":
        out = F.concat(out, F.lit(f"{IM_START}assistant\n"))
    if not add_think:
        out = F.concat(out, F.lit(EMPTY_THINK))
    return out


def message(role, content) -> Column:
    return F.struct(F.lit(role).alias("role") if isinstance(role, str) else role.alias("role"),
                    _c(content).alias("content"))


def interleave(turns, responses) -> Column:
    """user/assistant pairs for every answered turn, then the next open
    user turn (if any)."""
    t, r = _c(turns), _c(responses)
    k = F.least(F.size(t), F.size(r))
    answered = F.flatten(F.transform(
        F.slice(F.arrays_zip(t.alias("t"), r.alias("r")), F.lit(1), k),
        lambda x: F.array(message("user", x["t"]), message("assistant", x["r"]))))
    nxt = F.when(k < F.size(t), F.array(message("user", F.element_at(t, k + 1)))) \
           .otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    return F.concat(answered, nxt)


def instruction_conversation(instruction, inp, output) -> tuple[Column, Column]:
    """prompt = [system: instruction, user: input]; completion = stripped output."""
    prompt = F.array(message("system", instruction), message("user", inp))
    completion = F.array(message("assistant", py_strip(output)))
    return prompt, completion


def reasoning_conversation(system_prompt: str, problem, reasoning, solution):
    """assistant = ``reasoning</think><answer>solution</answer>`` (both stripped)."""
    prompt = F.array(message("system", F.lit(system_prompt)), message("user", problem))
    content = F.concat(py_strip(reasoning), F.lit("</think><answer>"), py_strip(solution),
                       F.lit("</answer>"))
    return prompt, F.array(message("assistant", content))


def render_messages(msgs) -> Column:
    """``role: content`` lines (a stable text form for hashing/export)."""
    return F.array_join(F.transform(_c(msgs), lambda m: F.concat(m["role"], F.lit(": "),
                                                                  m["content"])), "\n")
