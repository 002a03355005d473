"""Judge prompts from pairs, as column expressions over literal template rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions.text import WHITESPACE, Tokens, count_words, token_count

NULL_TURN = "null"


@dataclass(frozen=True)
class Template:
    """One template row.

    `joint` puts both answers of a turn side by side; otherwise A's whole
    conversation comes first, then `separator`, then B's, and each side is
    cut to half of the limit on its own.
    """

    name: str
    joint: bool
    head: str
    tail: str
    instruction: str
    suffix: str
    user_label: str
    a_label: str
    b_label: str
    separator: str = ""

    def side_limit(self, max_length: int) -> int:
        return max_length if self.joint else max_length // 2


@dataclass(frozen=True)
class ChatMarkup:
    """How a chat model marks whose turn it is."""

    opening: str
    closing: str
    system: str
    user: str
    assistant: str

    def message(self, role: str, text: str) -> str:
        return self.opening.format(role=role) + text + self.closing


# Head, tail, separator, labels and answer opener are what a judge model is trained on.
# The instruction is wording of our own.
JOINT = Template(
    name="joint",
    joint=True,
    head="<|The Start of Conversation between a User and two Assistants|>",
    tail="<|The End of Conversation between a User and two Assistants|>\n",
    instruction=(
        "Compare the two assistants' answers to the user below and say which is better."
        ' Answer "[[A]]", "[[B]]", or "[[C]]" for a tie.'
    ),
    suffix="verdict is: [[",
    user_label="User",
    a_label="Assistant A",
    b_label="Assistant B",
)
SPLIT = Template(
    name="split",
    joint=False,
    head="<|The Start of Assistant A’s Conversation with User|>",
    separator=(
        "<|The End of Assistant A’s Conversation with User|>\n\n"
        "<|The Start of Assistant B’s Conversation with User|>"
    ),
    tail="<|The End of Assistant B’s Conversation with User|>\n",
    instruction=JOINT.instruction,
    suffix=JOINT.suffix,
    user_label="User",
    a_label="Assistant A",
    b_label="Assistant B",
)
LOCALIZED = Template(
    name="localized",
    joint=True,
    head="<|对话开始|>",
    tail="<|对话结束|>\n",
    instruction='比较两位助手的回答,指出哪一个更好。回答"[[A]]"、"[[B]]",或"[[C]]"表示平局。',
    suffix="最终判决: [[",
    user_label="用户",
    a_label="助手 A",
    b_label="助手 B",
)
MARKUP = ChatMarkup(
    opening="<|{role}|>\n", closing="<|end|>\n", system="system", user="user", assistant="assistant"
)


def _block(label: str, text: Column) -> Column:
    return F.concat(F.lit(f"\n### {label}:\n"), F.coalesce(text, F.lit(NULL_TURN)), F.lit("\n"))


def _turns_text(lists: list[Column], labels: list[str]) -> Column:
    """Blocks of every turn, as far as the shortest list goes."""
    # arrays_zip would pad the shorter lists with nulls, which read as null turns.
    turns = F.least(*[F.size(one) for one in lists]) if len(lists) > 1 else F.size(lists[0])
    cut = [F.slice(one, F.lit(1), turns) for one in lists]
    names = [f"t{i}" for i in range(len(lists))]
    zipped = F.arrays_zip(*[one.alias(name) for one, name in zip(cut, names)])
    blocks = F.transform(
        zipped,
        lambda turn: F.concat(*[_block(label, turn[name]) for label, name in zip(labels, names)]),
    )
    return F.array_join(blocks, "")


def bodies(template: Template, prompt: Column, response_a: Column, response_b: Column) -> list[Column]:
    """The conversation without head, tail and separator: one text, or one per side. Cutting is done on these."""
    if template.joint:
        labels = [template.user_label, template.a_label, template.b_label]
        return [_turns_text([prompt, response_a, response_b], labels)]
    # Both sides stop at the shortest of all three lists.
    turns = F.least(F.size(prompt), F.size(response_a), F.size(response_b))
    first = F.slice(prompt, F.lit(1), turns)
    return [
        _turns_text([first, F.slice(answer, F.lit(1), turns)], [template.user_label, label])
        for answer, label in ((response_a, template.a_label), (response_b, template.b_label))
    ]


def literals_around(template: Template) -> list[str]:
    """What stands before, between and after the bodies."""
    return [template.head, template.tail] if template.joint else [template.head, template.separator, template.tail]


def render(
    template: Template,
    prompt: Column,
    response_a: Column,
    response_b: Column,
    max_length: int | None = None,
    tokens: Tokens = WHITESPACE,
) -> Column:
    """The conversation text. Cutting comes before head and tail are put on."""
    parts = bodies(template, prompt, response_a, response_b)
    if max_length is not None:
        parts = [tokens.cut(one, template.side_limit(max_length)) for one in parts]
    first, *rest = (F.lit(one) for one in literals_around(template))
    return F.concat(first, *[column for pair in zip(parts, rest) for column in pair])


def chat_frame(template: Template, system_role: bool, markup: ChatMarkup = MARKUP) -> list[str]:
    """What stands before and after the conversation: instruction, and the judge's opened answer."""
    before = template.instruction + "\n"
    if system_role:
        before = (
            markup.message(markup.system, template.instruction)
            + markup.opening.format(role=markup.user)
        )
    else:
        before = markup.opening.format(role=markup.user) + before
    after = markup.closing + markup.opening.format(role=markup.assistant) + template.suffix
    return [before, after]


def wrap_chat(
    template: Template, conversation: Column, system_role: bool, markup: ChatMarkup = MARKUP
) -> Column:
    """The conversation as a chat that the judge model is to answer."""
    before, after = chat_frame(template, system_role, markup)
    return F.concat(F.lit(before), conversation, F.lit(after))


def judge_text(
    template: Template,
    prompt: Column,
    response_a: Column,
    response_b: Column,
    max_length: int | None = None,
    system_role: bool = False,
    markup: ChatMarkup = MARKUP,
    tokens: Tokens = WHITESPACE,
) -> Column:
    """Rendered and wrapped: the text a judge model reads."""
    conversation = render(template, prompt, response_a, response_b, max_length, tokens)
    return wrap_chat(template, conversation, system_role, markup)


def turn_tokens(turns: Column, upto: Column) -> Column:
    """Tokens of the first `upto` turns; a null turn is read as one word."""
    return F.aggregate(
        F.slice(turns, F.lit(1), upto),
        F.lit(0),
        lambda total, turn: total + token_count(F.coalesce(turn, F.lit(NULL_TURN))),
    )


def judged_length(
    template: Template,
    turns: Column,
    prompt_tokens: Column,
    a_tokens: Column,
    b_tokens: Column,
    max_length: int | None = None,
    system_role: bool = False,
    markup: ChatMarkup = MARKUP,
) -> Column:
    """Whitespace token count of `judge_text`, worked out from the counts of its turns.

    Blocks begin and end with a line break, so their tokens add up. Only a cut
    may glue the last word of a side to the literal after it. Thus one count of
    each turn serves every template and mirror, and no text is put together.
    """
    before, after = chat_frame(template, system_role, markup)
    user, label_a, label_b = (
        count_words(f"\n### {label}:\n")
        for label in (template.user_label, template.a_label, template.b_label)
    )
    if template.joint:
        literals = [before + template.head, template.tail + after]
        sides = [
            turns * (user + label_a + label_b) + prompt_tokens + a_tokens + b_tokens
        ]
    else:
        literals = [before + template.head, template.separator, template.tail + after]
        sides = [
            turns * (user + label_a) + prompt_tokens + a_tokens,
            turns * (user + label_b) + prompt_tokens + b_tokens,
        ]
    limit = None if max_length is None else template.side_limit(max_length)
    empty = count_words("".join(literals))

    def around(ends: list[str]) -> int:
        """Tokens of the literals alone, with one-word sides that end so."""
        parts = [literals[0]]
        for end, literal in zip(ends, literals[1:]):
            parts += ["\nword" + end, literal]
        return count_words("".join(parts)) - len(ends)

    whole = ["\n"] * len(sides)
    fixed = around(whole)
    length = F.lit(fixed)
    for number, tokens in enumerate(sides):
        if limit is None:
            length = length + tokens
            continue
        glued = around(whole[:number] + [""] + whole[number + 1 :]) - fixed
        length = length + F.when(tokens > limit, limit + glued).otherwise(tokens)
    bare = F.lit(limit == 0) | (turns == 0)
    return F.when(bare, empty).otherwise(length).cast("int")
