"""Prompt templates and conversation rendering as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TASK = "Below is an instruction that describes a task"
_RESPOND = "Write a response that appropriately completes the request."
_CHAT = "A chat between a curious user and an artificial intelligence assistant. " + "The assistant gives helpful, detailed, " + "and polite answers to the user's questions."
_START, _END = "<|im_start|>", "<|im_end|>"
_HELP = f"{_START}system\nYou are a helpful assistant.{_END}\n{_START}user\n"

#: Per style: before the instruction (with and without input), before the input, the response's opening, what closes an output.
STYLES: dict[str, tuple[str, str, str, str, str]] = {
    "alpaca": (f"{_TASK}, paired with an input that provides further context. {_RESPOND}\n\n### Instruction:\n", f"{_TASK}. {_RESPOND}\n\n### Instruction:\n", "\n\n### Input:\n", "\n\n### Response:\n", ""),
    "chatml": (_HELP, _HELP, "\n", f"{_END}\n{_START}assistant\n", _END),
    "vicuna": (f"{_CHAT}\n\nUSER: ", f"{_CHAT}\n\nUSER: ", "\n", "\nASSISTANT: ", ""),
}
RESPONSE_SPLIT = {"alpaca": "### Response:", "chatml": "<|im_start|>assistant", "vicuna": "ASSISTANT:", "completion": "### Response:"}


def _some(col: Column | None) -> Column:
    return F.lit(False) if col is None else F.coalesce(col != "", F.lit(False))


def build_prompt(style: str, instruction: Column, input: Column | None = None, output: Column | None = None) -> Column:
    """A prompt; an empty or null input or output is absent, a null instruction is spelt ``None``."""
    said = F.coalesce(instruction, F.lit("None"))
    given, answer = (F.lit("") if c is None else F.coalesce(c, F.lit("")) for c in (input, output))
    if style == "completion":
        return F.concat(said, F.when(_some(input), F.concat(F.lit(" "), given)).otherwise(""), F.when(_some(output), F.concat(F.lit(" "), answer)).otherwise(""))
    with_input, without, before, opening, close = STYLES[style]
    prompt = F.when(_some(input), F.concat(F.lit(with_input), said, F.lit(before), given, F.lit(opening))).otherwise(F.concat(F.lit(without), said, F.lit(opening)))
    return F.concat(prompt, F.when(_some(output), F.concat(answer, F.lit(close))).otherwise(""))


def get_response(style: str, text: Column) -> Column:
    """What follows the last opening of a response in a rendered text; the whole text if there is none."""
    return F.substring_index(text, RESPONSE_SPLIT[style], -1)


#: Chat templates: before all messages, then per message before the role, after it, and after the content; after all.
TEMPLATES: dict[str, tuple[str, str, str, str, str]] = {
    "chatml": ("", "<|im_start|>", "\n", "<|im_end|>\n", ""),
    "llama3": ("<|begin_of_text|>", "<|start_header_id|>", "<|end_header_id|>\n\n", "<|eot_id|>", ""),
    "phi3": ("", "<|", "|>\n", "<|end|>\n", "<|endoftext|>"),
    "plain": ("", "", ": ", "\n", ""),
}


def template_of(given: str | dict) -> tuple[str, str, str, str, str]:
    """A template by name, or from its parts: start, before_role, after_role, after_content, end."""
    if isinstance(given, dict):
        return tuple(given.get(k, "") for k in ("start", "before_role", "after_role", "after_content", "end"))
    if given not in TEMPLATES:
        raise ValueError(f"no chat template is named {given}; there are {', '.join(TEMPLATES)}")
    return TEMPLATES[given]


def chat_text(messages: Column, template: tuple[str, str, str, str, str] = TEMPLATES["chatml"]) -> Column:
    """[(role, content)] rendered by a template."""
    start, before, after, close, end = map(F.lit, template)
    turn = lambda m: F.concat(before, m["role"], after, F.coalesce(m["content"], F.lit("")), close)
    return F.concat(start, F.array_join(F.transform(messages, turn), ""), end)


def conversation_text(messages: Column) -> Column:
    """Human/Assistant turns; a system message goes before all said so far; other roles are left out."""

    def step(said: Column, m: Column) -> Column:
        content = F.coalesce(m["content"], F.lit(""))
        role = F.coalesce(m["role"], F.lit("user"))
        turn = lambda who: F.concat(F.lit(f"{who}: "), content, F.lit("\n\n"))
        return F.when(role == "user", F.concat(said, turn("Human"))).when(role == "assistant", F.concat(said, turn("Assistant"))).when(role == "system", F.concat(turn("System"), said)).otherwise(said)

    return F.regexp_replace(F.aggregate(messages, F.lit(""), step), r"^\s+|\s+$", "")
