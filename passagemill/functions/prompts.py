"""Document rendering, prompt templates, chat markup and token counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

from passagemill import fixed_values as fv
from passagemill.functions.text import col

QUERY_FIRST = "query_first"
QUERY_LAST = "query_last"
OPEN_CONTEXT = "open_context"
QUERY_ONLY = "query_only"
# Body of each layout, as pieces around {query} and {context}.
LAYOUTS = {
    QUERY_FIRST: "{word}: {query}\nDocuments:\n{context}\nAnswer:",
    QUERY_LAST: "Documents:\n{context}\n{word}: {query}\nAnswer:",
    OPEN_CONTEXT: "{word}: {query}\nDocuments:\n",
    QUERY_ONLY: "{word}: {query}\nAnswer:",
}


@dataclass(frozen=True)
class Template:
    """A prompt form; `chat_model` puts it into that model's turn markup."""

    instruction: str
    layout: str = QUERY_FIRST
    query_word: str = "Question"
    chat_model: str | None = None

    def text(self) -> str:
        """The whole form with {query} and {context} left open."""
        body = LAYOUTS[self.layout].replace("{word}", self.query_word)
        form = f"{self.instruction}\n{body}"
        if self.chat_model is None:
            return form
        wrapper = chat_wrapper(self.chat_model)
        return wrapper["head"] + form + wrapper["tail"]

    def answer_prefix(self) -> str:
        if self.chat_model is None:
            return fv.ANSWER_MARKER
        return chat_wrapper(self.chat_model)["answer_prefix"]


TEMPLATES = {
    "answer": Template(fv.INSTRUCTION_ANSWER),
    "query_only": Template(fv.INSTRUCTION_QUERY_ONLY, QUERY_ONLY),
    "select_ids": Template(fv.INSTRUCTION_SELECT, OPEN_CONTEXT),
    "answer_training": Template(fv.INSTRUCTION_ALWAYS_ANSWER, OPEN_CONTEXT),
    "answer_always": Template(fv.INSTRUCTION_ALWAYS_ANSWER),
    "answer_with_proof": Template(fv.INSTRUCTION_PROOF),
}


def chat_wrapper(model: str) -> dict[str, str]:
    if model not in fv.CHAT_WRAPPERS:
        raise ValueError(f"no chat template for model {model!r}")
    return fv.CHAT_WRAPPERS[model]


def fill(template: Template, query: Column | str, context: Column | None = None) -> Column:
    """The finished prompt text."""
    pieces: list[Column] = []
    for i, part in enumerate(template.text().split("{query}")):
        if i:
            pieces.append(col(query))
        before, *after = part.split("{context}")
        pieces.append(F.lit(before))
        for tail in after:
            pieces += [context, F.lit(tail)]
    return F.concat(*pieces)


def content_hash(title: Column | str, text: Column | str) -> Column:
    """SHA-256 of title and text; the title is left out when it is empty."""
    title, text = col(title), col(text)
    return F.sha2(F.when(title == "", text).otherwise(F.concat(title, F.lit(" "), text)), 256)


def render_document(label: Column, title: Column, text: Column) -> Column:
    before_label, before_title, before_text = (F.lit(x) for x in fv.DOCUMENT_MARKS)
    return F.concat(before_label, label.cast("string"), before_title, title, before_text, text)


def render_context(docs: Column | str) -> Column:
    """Lines `Document [id](Title: t) text` of an array of document structs."""
    return F.array_join(F.transform(
        col(docs), lambda d: render_document(d["doc_id"], d["title"], d["text"])), "\n")


def render_context_aliased(docs: Column | str) -> Column:
    """Same with `Id_n` by list position instead of the real id."""
    return F.array_join(F.transform(
        col(docs),
        lambda d, i: render_document(
            F.concat(F.lit(fv.ALIAS_PREFIX), i + 1), d["title"], d["text"]),
    ), "\n")


def token_len(prompt: Column | str) -> Column:
    """Default token count: words and single other non-space characters."""
    return F.regexp_count(col(prompt), F.lit(r"\w+|[^\w\s]"))


def model_token_len(load_tokenizer: Callable[[], Callable[[str], list]]) -> Callable[[Column], Column]:
    """Token count by a model tokenizer, loaded once per task and fed Arrow batches."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize = load_tokenizer()
        for batch in batches:
            yield batch.map(lambda text: len(tokenize(text)))

    return count


def swap_instruction(prompt: Column | str, old: str, new: str) -> Column:
    return F.replace(col(prompt), F.lit(old), F.lit(new))


def messages(instruction: str | Column, user: Column, assistant: Column | None = None) -> Column:
    """Chat turns as an array of (role, content); the assistant turn is for training."""
    system = F.lit(instruction) if isinstance(instruction, str) else instruction
    turns = [("system", system), ("user", user)]
    if assistant is not None:
        turns.append(("assistant", assistant))
    return F.array(*[
        F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in turns
    ])


def render_chat(chat: Column) -> Column:
    """Chat markup text of the turns."""
    return F.array_join(F.transform(chat, lambda m: F.concat(
        F.lit(fv.TURN_START), m["role"], F.lit("\n"), m["content"], F.lit(fv.TURN_END))), "")
