"""Distributed batch generation and the pipelines around it.

A generator is either a `Column -> Column` function from prompt text to generated text,
or a `Model`: a user's text model, loaded once per task and fed whole Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T

from passagemill import fixed_values as fv
from passagemill.functions import match as M, prompts as P, selection as S
from passagemill.functions.text import let
from passagemill.session import stored

# Executors need not have this package installed: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])


@dataclass(frozen=True)
class Model:
    """`load` returns a function from a list of prompts to the list of their texts."""

    load: Callable[[], Callable[[list[str]], list[str]]]


Generator = Callable[[Column], Column] | Model


def _replies(model: Callable[[list[str]], list[str]], prompts: list[str]) -> list[str]:
    """Model texts; blank prompts get an empty text and never reach the model."""
    asked = [p for p in prompts if p and p.strip()]
    found = list(model(asked)) if asked else []
    if len(found) != len(asked):
        raise ValueError(f"the model gave {len(found)} texts for {len(asked)} prompts")
    texts = iter(found)
    return [next(texts) if p and p.strip() else "" for p in prompts]


WINDOW_BYTES = 8 << 20  # of prompts that are held as Python strings at a time


def _row_windows(batches: Iterator[pa.RecordBatch], rows: int | None, prompt: str) -> Iterator[pa.RecordBatch]:
    """Runs of `rows` rows, or else of as many as stay within WINDOW_BYTES, one at least."""
    for batch in batches:
        held = pc.fill_null(pc.binary_length(batch.column(prompt)), 0).to_numpy(zero_copy_only=False)
        ends, start = np.concatenate(([0], np.cumsum(held, dtype=np.int64))), 0
        while start < batch.num_rows:
            stop = start + rows if rows else max(
                start + 1, int(np.searchsorted(ends, ends[start] + WINDOW_BYTES, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def _token_windows(
    batches: Iterator[pa.RecordBatch], budget: int, rows: int | None,
) -> Iterator[pa.RecordBatch]:
    """Runs of rows with ascending `_tokens` whose number times the longest is within budget."""
    open_: list[pa.RecordBatch] = []
    held = 0  # rows in open_
    for batch in batches:
        start = 0
        for i, n in enumerate(batch.column("_tokens").to_pylist()):
            if held + i - start and ((held + i - start + 1) * n > budget or held + i - start == rows):
                yield pa.concat_batches([*open_, batch.slice(start, i - start)])
                open_, held, start = [], 0, i
        open_.append(batch.slice(start))
        held += batch.num_rows - start
    if held:
        yield pa.concat_batches(open_)


def replies(
    asked: DataFrame, model: Model, prompt: str = "prompt", out: str = "generated_text",
    batch_size: int | None = None, token_budget: int | None = None, count_tokens=P.token_len,
    keep_prompt: bool = False,
) -> DataFrame:
    """The rows of `asked` with the model's text in place of the prompt, lazily.

    Every column of `asked` passes through the model's tasks: give keys and prompts only.
    The model gets at most `batch_size` prompts at once (default: an Arrow batch, in runs of
    WINDOW_BYTES).

    With `token_budget` each task sorts its rows by length and gives the model runs of
    prompts whose number times the longest one is within the budget, so that little of a
    padded batch is padding; a longer prompt is a batch of its own. Rows without an answer
    to give (null or blank prompts) count as one token.
    """
    kept = [f for f in asked.schema.fields if keep_prompt or f.name != prompt]
    names = [f.name for f in kept]
    load = model.load

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = load()
        windows = _row_windows(batches, batch_size, prompt) if token_budget is None else _token_windows(
            batches, token_budget, batch_size)
        for part in windows:
            found = pa.array(_replies(answer, part.column(prompt).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], found], [*names, out])

    if token_budget is not None:
        tokens = F.greatest(F.coalesce(count_tokens(F.col(prompt)), F.lit(1)), F.lit(1))
        asked = asked.withColumn("_tokens", tokens.cast("long")).sortWithinPartitions("_tokens")
    return asked.mapInArrow(run, T.StructType(kept + [T.StructField(out, T.StringType())]))


def batch_generate(
    prompts: DataFrame, generate: Generator, prompt: str = "prompt",
    out: str = "generated_text", partitions: int | None = None, batch_size: int | None = None,
    token_budget: int | None = None, store=None, keys: list[str] | None = None,
) -> DataFrame:
    """Adds the generated text; `partitions` evens out slow prompts by row count.

    For a model the rows go through the model's tasks and are written once with their
    replies, so that neither a second use nor a lost executor calls the model again, and no
    row is shuffled to meet its reply. Where `keys` names all columns that are wanted beside
    the text, only they go along with the prompts. With a `store`
    (replies.ReplyStore) only prompts that it does not know are asked, each once, and all
    replies are kept there for later runs.
    """
    if not isinstance(generate, Model):
        spread = prompts.repartition(partitions) if partitions else prompts
        replied = spread.withColumn(out, F.when(
            F.trim(prompt) == "", F.lit("")).otherwise(generate(F.col(prompt))))
        return replied.select(*keys, out) if keys is not None else replied
    if keys is not None:
        prompts = prompts.select(*keys, prompt)
    if store is not None:
        rows = stored(prompts, "prompts")
        store.ask(rows, generate, prompt, batch_size=batch_size, token_budget=token_budget)
        replied = store.attach(rows, prompt, out, None if keys is None or prompt in keys else keys)
        return replied.select(*keys, out) if keys is not None else replied
    asked = prompts.drop(out).repartition(partitions) if partitions else prompts.drop(out)
    return stored(replies(
        asked, generate, prompt, out, batch_size, token_budget, keep_prompt=keys is None or prompt in keys), "replies")


def selection_run(
    contexts: DataFrame, generate: Generator,
    drop_instruction: str = fv.INSTRUCTION_ALWAYS_ANSWER,
    select_instruction: str = fv.INSTRUCTION_SELECT_ALIASES,
    rebuild_instruction: str = fv.INSTRUCTION_ALWAYS_ANSWER,
    style: S.RebuildStyle = S.TURN_STYLE, **batching,
) -> DataFrame:
    """Ask a selector which documents to keep, then rebuild the prompt from them.

    Needs prompt, query, docs and document_indices; adds selector_prompt,
    selector_text and selected_ids_raw, and replaces prompt. An empty prompt gives an
    empty selector text. `batching` goes to batch_generate, like a store of replies.
    """
    stripped = P.swap_instruction("prompt", drop_instruction, "")
    chat = P.render_chat(P.messages(
        select_instruction, S.alias_prompt(stripped, "document_indices")))
    asked = contexts.withColumn("selector_prompt", F.when(
        F.trim("prompt") == "", F.lit("")).otherwise(chat))
    names = asked.columns
    if isinstance(generate, Model):  # the prompt is replaced below: it need not be kept till then
        asked = asked.drop("prompt")
    answered = batch_generate(asked, generate, "selector_prompt", "selector_text", **batching)
    decoded = answered.withColumn(
        "selected_ids_raw", S.decode_selection("selector_text", "document_indices"))
    return decoded.withColumn("prompt", S.rebuild_prompt(
        "query", S.documents_as_parsed("docs"), "selected_ids_raw", rebuild_instruction, style),
    ).select(*names, *[c for c in ("selector_text", "selected_ids_raw") if c not in names])


def selected_docs(docs: Column | str = "docs", raw: Column | str = "selected_ids_raw") -> Column:
    """The structured documents of a selection, in selected order."""
    docs = F.col(docs) if isinstance(docs, str) else docs
    found = F.transform(S.split_ids(raw), lambda i: F.get(
        F.filter(docs, lambda d: d["doc_id"].cast("string") == i), F.lit(0)))
    return F.filter(found, lambda d: d.isNotNull())


def selection_then_answer(
    contexts: DataFrame, select: Generator, answer: Generator,
    answer_batching: dict | None = None, **options,
) -> DataFrame:
    """Selection run followed by the answering generator and answer extraction.

    `answer_batching` goes to the second batch_generate, as `options` do to the first.
    """
    options.setdefault("rebuild_instruction", fv.INSTRUCTION_ANSWER)
    chosen = selection_run(contexts, select, **options)
    replied = batch_generate(chosen, answer, **(answer_batching or {}))
    return replied.withColumn(
        "generated_answer", M.extract_answer("generated_text", fv.ADAPTER_ANSWER_MARKER))


def reanswer_run(
    old_run: DataFrame, answer: Generator,
    old: str = fv.INSTRUCTION_ALWAYS_ANSWER, new: str = fv.INSTRUCTION_ANSWER,
    prefix: str = fv.ADAPTER_ANSWER_MARKER, **batching,
) -> DataFrame:
    """Answer the prompts of an old run again under a new instruction."""
    swapped = old_run.withColumn("prompt", P.swap_instruction("prompt", old, new))
    return batch_generate(swapped, answer, **batching).withColumn(
        "generated_answer", M.extract_answer("generated_text", prefix))


def without_special_tokens(prompt: Column) -> Column:
    """Prompt text as a decoder returns it, without turn marks."""
    # one alternative behind a common opening is tried at "<" alone
    return let(prompt, lambda p: F.regexp_replace(p, "<(?:start|end)_of_turn>", ""))
