"""Document selections: aliases, decoding of model text, and prompt rebuilding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from passagemill import fixed_values as fv
from passagemill.functions.text import col, let, strip

_SPACES = fv.WHITESPACE.replace(" ", r"\x20")


def _alias(position: Column) -> Column:
    return F.concat(F.lit(fv.ALIAS_PREFIX), position.cast("string"))


def _positions(ids: Column) -> Column:
    """1..n, or an empty array for an empty list."""
    return F.transform(ids, lambda _, i: i + 1)


def alias_map(ids: Column | str) -> Column:
    """Map Id_n -> document id by list position."""
    ids = col(ids)
    return F.map_from_arrays(F.transform(_positions(ids), _alias), ids)


def alias_prompt(prompt: Column | str, ids: Column | str) -> Column:
    """Replace every `[id]` by `[Id_n]`; a repeated id takes its last position."""
    ids = col(ids)
    return F.aggregate(
        F.reverse(_positions(ids)), col(prompt),
        lambda text, i: F.replace(
            text,
            F.concat(F.lit("["), F.get(ids, i - 1).cast("string"), F.lit("]")),
            F.concat(F.lit("["), _alias(i), F.lit("]"))),
    )


def _id_of_alias(alias: Column, ids: Column) -> Column:
    """Document id as text for Id_n, null for anything else."""
    number = F.regexp_extract(alias, f"^{fv.ALIAS_PREFIX}([1-9][0-9]*)$", 1)
    # null, like no number, where it is more than the list (or an int) holds
    place = number.try_cast("int")
    place = F.when(place <= F.size(ids), place)
    found = F.get(ids, place - 1)
    later = F.slice(ids, place + 1, F.size(ids))
    return F.when(~F.array_contains(later, found), found.cast("string"))


def decode_selection(
    generated: Column | str, ids: Column | str, comma_only: bool = False, missing: str = fv.NO_DOCS
) -> Column:
    """Comma-joined document ids from model text; unknown aliases become `Unknown(x)`.

    Reads from the first assistant marker to the end marker. `missing` is the result
    when there is no assistant marker at all.
    """
    generated, ids = col(generated), col(ids)
    at = F.instr(generated, fv.ASSISTANT_MARKER)
    tail = F.substring(generated, at + len(fv.ASSISTANT_MARKER), F.length(generated))
    reply = strip(F.substring_index(tail, fv.END_MARKER, 1))
    separator = "," if comma_only else f"[,{_SPACES}]+"
    parts = F.filter(F.transform(F.split(reply, separator), strip), lambda p: p != "")
    decoded = F.transform(parts, lambda p: F.coalesce(
        _id_of_alias(p, ids), F.concat(F.lit("Unknown("), p, F.lit(")"))))
    return F.when(at > 0, F.array_join(decoded, ",")).otherwise(F.lit(missing))


def split_ids(raw: Column | str) -> Column:
    """Trimmed non-empty comma parts."""
    return F.filter(F.transform(F.split(col(raw), ","), strip), lambda p: p != "")


def valid_id_count(raw: Column | str) -> Column:
    """Strict count: trimmed parts that are not `Unknown(...)`; sentinels count 0."""
    raw = col(raw)
    known = F.filter(split_ids(raw), lambda p: ~p.rlike(r"^Unknown\([^\n]*\)"))
    return F.when(raw.isin(fv.NO_DOCS, fv.UNKNOWN_EMPTY), F.lit(0)).otherwise(F.size(known))


def valid_id_count_loose(raw: Column | str) -> Column:
    """Loose count: only `Unknown(Id_n)` parts are dropped, so "" counts as one."""
    return F.size(F.filter(
        F.split(col(raw), ","), lambda p: ~p.rlike(r"^Unknown\(Id_[0-9]+\)")))


def order_changed(raw: Column | str, ids: Column | str) -> Column:
    """Selected ids, without unknown ones, differ from the retrieved list."""
    kept = F.filter(F.split(col(raw), ","), lambda p: ~F.startswith(F.lower(p), F.lit("unknown")))
    return kept != F.transform(col(ids), lambda i: i.cast("string"))


# --- prompts as text ---------------------------------------------------------
# Patterns of a rendered prompt.
_DOCUMENT_BLOCK = r"(?sdU)(Document \[\d+\]\(.*?\)\s.*?)(?=Document \[\d+\]|$)"
_DOCUMENT_ID = r"Document \[(\d+)\]"
_DOCUMENT_BODY = r"(?sdU)^Document \[\d+\]\(.*?\)\s(.*)"
_QUESTION = r"(?sdU)Question:\s*(.*?)(?=Document|$)"
_TURN_CHANGE = r"(?U)<end_of_turn>\s*<start_of_turn>model"
_ANSWER_CUE = r"(?U)Answer:\s*"


def parse_question(prompt: Column | str) -> Column:
    prompt = col(prompt)
    found = strip(F.regexp_extract(prompt, _QUESTION, 1))
    return F.when(F.contains(prompt, F.lit("Question:")), found).otherwise(
        F.lit(fv.QUERY_NOT_FOUND))


def parse_documents(prompt: Column | str) -> Column:
    """Document blocks of a prompt as array<struct<doc_id, block, body>>.

    When an id occurs twice the later block wins.
    """
    blocks = F.regexp_extract_all(col(prompt), F.lit(_DOCUMENT_BLOCK), F.lit(1))
    entries = F.transform(blocks, lambda b: F.struct(
        F.regexp_extract(b, _DOCUMENT_ID, 1).alias("doc_id"),
        strip(b).alias("block"),
        strip(F.regexp_extract(b, _DOCUMENT_BODY, 1)).alias("body"),
    ))
    return let(entries, lambda all_: F.filter(all_, lambda e, i: ~F.exists(
        F.slice(all_, i + 2, F.size(all_)), lambda later: later["doc_id"] == e["doc_id"])))


def documents_as_parsed(docs: Column | str) -> Column:
    """The same structs from document columns kept by context assembly, no parsing needed."""
    from passagemill.functions.prompts import render_document

    return F.transform(col(docs), lambda d: F.struct(
        d["doc_id"].cast("string").alias("doc_id"),
        strip(render_document(d["doc_id"], d["title"], d["text"])).alias("block"),
        strip(d["text"]).alias("body"),
    ))


@dataclass(frozen=True)
class RebuildStyle:
    """How a rebuilt prompt is framed; `empty` of None gives null without documents."""

    head: str
    tail: str
    empty: str | None
    drop_turn_marks: bool
    newline_at_end: bool


# Frames of rebuilt prompts.
TURN_STYLE = RebuildStyle(
    "<start_of_turn>user\n", "\n<end_of_turn>\n<start_of_turn>model",
    "\n<end_of_turn>\n<start_of_turn>model", True, True)
PLAIN_STYLE = RebuildStyle("", "\nAnswer:", "\nAnswer:\n", False, True)
PLAIN_OR_NULL_STYLE = RebuildStyle("", "\nAnswer:", None, False, False)


def rebuild_prompt(
    question: Column | str, docs: Column | str, raw: Column | str,
    instruction: str = fv.INSTRUCTION_ALWAYS_ANSWER, style: RebuildStyle = TURN_STYLE,
) -> Column:
    """Prompt with only the selected known documents, in selected order."""
    docs = col(docs)

    def replaced(text: Column, sign: str, pattern: str, new: str) -> Column:
        """Regular expressions run only over texts with the literal each match begins with."""
        return let(text, lambda t: F.when(
            F.contains(t, F.lit(sign)), F.regexp_replace(t, pattern, new)).otherwise(t))

    def clean(block: Column) -> Column:
        if style.drop_turn_marks:
            block = replaced(block, "<end_of_turn>", _TURN_CHANGE, "")
        return replaced(block, "Answer:", _ANSWER_CUE, "")

    # bound once: an expression of documents would be built anew for every selected id
    blocks = let(docs, lambda all_: F.transform(split_ids(raw), lambda i: F.get(
        F.filter(all_, lambda d: d["doc_id"] == i), F.lit(0))["block"]))
    kept = F.filter(blocks, lambda b: b.isNotNull())
    opening = F.concat(F.lit(f"{style.head}{instruction}\nQuestion: "), col(question))

    def framed(chosen: Column) -> Column:
        full = F.concat(
            opening, F.lit("\nDocuments:\n"),
            F.array_join(F.transform(chosen, clean), "\n"), F.lit(style.tail))
        full = strip(replaced(full, "\n\n", "\n+", "\n"))
        if style.newline_at_end:
            full = F.concat(full, F.lit("\n"))
        empty = F.lit(None) if style.empty is None else F.concat(opening, F.lit(style.empty))
        return F.when(F.size(chosen) == 0, empty).otherwise(full)

    return let(kept, framed)


# --- selection audit ----------------------------------------------------------
def _body_of(docs: Column, doc_id: Column) -> Column:
    return F.lower(F.get(F.filter(docs, lambda d: d["doc_id"] == doc_id), F.lit(0))["body"])


def ids_with_answer(docs: Column | str, ids: Column | str, answers: Column | str) -> Column:
    """Ids, in list order, whose body holds any lower-cased answer; each once."""
    docs, answers = col(docs), col(answers)
    return F.filter(
        F.transform(col(ids), lambda i: i.cast("string")),
        lambda i: F.coalesce(let(_body_of(docs, i), lambda body: F.exists(
            answers, lambda a: F.contains(body, F.lower(a)))), F.lit(False)))


def answer_hits(docs: Column | str, raw: Column | str, answers: Column | str) -> Column:
    """(doc_id, answer) once per selected id and matching answer, in order."""
    docs, answers = col(docs), col(answers)
    return F.flatten(F.transform(split_ids(raw), lambda i: let(
        _body_of(docs, i), lambda body: F.transform(
            F.filter(answers, lambda a: F.coalesce(F.contains(body, F.lower(a)), F.lit(False))),
            lambda a: F.struct(i.alias("doc_id"), a.alias("answer"))))))


def _found_in(docs: Column, found: Column, doc_id: Column) -> Column:
    """What was found in the first document with that id; null without such a document."""
    at = F.array_position(F.transform(docs, lambda d: d["doc_id"].cast("string")), doc_id)
    return F.when(at > 0, F.get(found, (at - 1).cast("int")))


def ids_found(docs: Column | str, ids: Column | str, found: Column | str) -> Column:
    """The same as `ids_with_answer`, where `found` has for each document the positions of the
    answers in its body."""
    docs, found = col(docs), col(found)
    return F.filter(
        F.transform(col(ids), lambda i: i.cast("string")),
        lambda i: F.coalesce(F.size(_found_in(docs, found, i)) > 0, F.lit(False)))


def hits_found(docs: Column | str, raw: Column | str, answers: Column | str, found: Column | str) -> Column:
    """The same as `answer_hits` by what was found."""
    docs, answers, found = col(docs), col(answers), col(found)
    return F.flatten(F.transform(split_ids(raw), lambda i: F.transform(
        F.coalesce(_found_in(docs, found, i), F.array().cast("array<int>")),
        lambda k: F.struct(i.alias("doc_id"), F.get(answers, k).alias("answer")))))
