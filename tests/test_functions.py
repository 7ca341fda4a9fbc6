"""Column functions on literals."""

import math

import pytest
from pyspark.sql import functions as F

from passagemill import fixed_values as fv
from passagemill.functions import match as M, prompts as P, selection as S, text as T
from passagemill.functions.bleu import bleu_max


def test_norm_text(evaluate):
    pairs = {
        "a‐b—c−d": "a-b-c-d",
        "“hi” ‘x’ `y´ ՚z": "\"hi\" 'x' 'y' 'z",
        "5′ 6″ 7‴ 8⁗ 9‵‶‷": "5' 6'' 7''' 8'''' 9''''''",
        "wait… a . . . b": "wait... a ... b",
        "a⁄b∼c～d": "a/b~c~d",
        "x\u0001y­z\u0010w": "xyz\u0010w",
        "p\u000bq\u000cr\u0085s\tt\nu": "p q r s\tt\nu",
        "+＋⁺": "+＋⁺",
    }
    assert evaluate([(k,) for k in pairs], "x STRING", T.norm_text("x")) == list(pairs.values())


def test_norm_answer(evaluate):
    pairs = {
        "The  Cat's (a) hat!": "cat s hat",
        "An apple \u001cand THE end": "apple and end",
        "theatre a-b": "theatre b",
        "the": "",
        "«the» éa café": "« » éa café",
        "": "",
        "soft­hyphen ″x…": "softhyphen x",
    }
    rows = [(k,) for k in pairs]
    assert evaluate(rows, "x STRING", T.norm_answer("x")) == list(pairs.values())
    assert evaluate([("The A a Cat",)], "x STRING", T.norm_answer("x", False)) == ["The A Cat"]


def test_norm_answer_is_the_composition_of_its_steps(evaluate):
    rows = [("The “Cat”… a . . . b″\u0003 an-the ­ x\u0085y `z´",)]
    steps = T.squeeze(T.strip_articles(T.strip_punct(T.norm_text(F.lower("x")))))
    assert evaluate(rows, "x STRING", T.norm_answer("x")) == evaluate(rows, "x STRING", steps)


def test_first_words(evaluate):
    rows = [(" one\ttwo  three\nfour ",), ("one",), ("",)]
    assert evaluate(rows, "x STRING", T.raw_words_at(F.col("x"), 2, 2)) == ["two three", "", ""]


def test_answer_match(evaluate):
    rows = [
        ("It was the Eiffel Tower.", ["eiffel tower"]), ("anything", ["the"]),
        ("anything", []), ("anything", None), ("anything", [None]), ("paris", ["london", "Paris!"]),
        ("no", ["yes"]),
    ]
    assert evaluate(rows, "p STRING, a ARRAY<STRING>", M.answer_match("p", "a")) == [
        True, True, False, False, False, True, False]


def test_answer_in_text_keeps_the_asymmetry(evaluate):
    rows = [
        ("the big-cat sat", ["Big Cat"]), ("The BIG cat", ["the big cat"]),
        ("The BIG cat", ["The BIG cat?"]), ("raw, text", ["raw, text"]), ("x", []), ("x", ["the"]),
    ]
    got = evaluate(rows, "t STRING, a ARRAY<STRING>", M.answer_in_text("t", "a"))
    # lower-cased answers are looked up in text that keeps its case and its articles
    assert got == [True, False, True, True, False, True]


def test_abstention(evaluate):
    rows = [(p.swapcase(),) for p in fv.ABSTENTION_PHRASES] + [("I know",), (None,)]
    assert evaluate(rows, "x STRING", M.abstains("x")) == [True] * 16 + [False, False]
    strict = [("NO-RES",), ("ok\nNO-RES",), ("no direct answer",), ("(NO RES)",)]
    assert evaluate(strict, "x STRING", M.abstains_strict("x")) == [True, False, False, True]


def test_answers_and_proofs_in_generated_text(evaluate):
    rows = [("q",), ("q Answer: one ",), ("Answer: one\nAnswer:two",)]
    assert evaluate(rows, "x STRING", M.extract_answer("x")) == [None, "one", "one\nAnswer:two"]
    assert evaluate(rows, "x STRING", M.extract_answer("x", occurrence=2)) == [None, None, "two"]
    proofs = [("x Proof:\n a b\nc Proof: d",), ("none",)]
    assert evaluate(proofs, "x STRING", M.proof_of("x")) == ["a b", "NO-PROOF"]
    marked = [("Q Documents: The Cat", ["cat"]), ("The Cat", ["cat"]), ("documents:", [""])]
    assert evaluate(marked, "p STRING, a ARRAY<STRING>", M.answer_after_marker("p", "a")) == [
        True, False, False]
    stops = [("a\nHuman: b",), ("a<|endoftext|>b\n",), ("a",), ("\nQuestion: x",)]
    assert evaluate(stops, "x STRING", M.cut_at_stop("x")) == ["a", "a", "a", ""]


@pytest.mark.parametrize("hyp, refs, score", [
    ("a b c", ["a b c"], 0.562341), ("a", ["a"], 0.177828), ("a b", ["a b c d"], 0.116334),
    ("b a a a", ["a a"], 0.169904), ("x", ["a b c"], 0.0), ("", ["a"], 0.0),
    ("a b c d", ["x", "a b c d"], 1.0), ("a", [], None),
])
def test_bleu(evaluate, hyp, refs, score):
    got = evaluate([(hyp, refs)], "h STRING, r ARRAY<STRING>", bleu_max("h", "r"))[0]
    assert got is None if score is None else math.isclose(got, score, abs_tol=1e-6)


def test_templates(evaluate):
    rows = [("q?", "D")]
    form = P.Template("I", P.QUERY_LAST)
    got = evaluate(rows, "q STRING, c STRING", P.fill(form, "q", F.col("c")))
    assert got == ["I\nDocuments:\nD\nQuestion: q?\nAnswer:"]
    chat = P.Template("I", chat_model="google/gemma-2-2b-it")
    assert evaluate(rows, "q STRING, c STRING", P.fill(chat, "q", F.col("c"))) == [
        "<start_of_turn>user\nI\nQuestion: q?\nDocuments:\nD\nAnswer:<end_of_turn>\n"
        "<start_of_turn>model"]
    assert chat.answer_prefix() == "Answer:\nmodel"
    with pytest.raises(ValueError):
        P.Template("I", chat_model="unknown").text()


def test_model_token_len(spark):
    count = P.model_token_len(lambda: (lambda text: text.split("-")))
    frame = spark.createDataFrame([("a-b-c",), ("x",)], "t STRING")
    assert sorted(r[0] for r in frame.select(count(F.col("t"))).collect()) == [1, 3]


def test_content_hash_leaves_out_an_empty_title(evaluate):
    rows = [("", "ab"), ("a", "b")]
    got = evaluate(rows, "t STRING, x STRING", P.content_hash("t", "x"))
    want = evaluate([("ab",), ("a b",)], "x STRING", F.sha2("x", 256))
    assert got == want


def test_alias_and_decode_are_inverse(evaluate):
    schema = "p STRING, ids ARRAY<BIGINT>"
    rows = [("[7] and [12] and [99]", [7, 12]), ("[5]", [5, 5]), ("x", [])]
    assert evaluate(rows, schema, S.alias_prompt("p", "ids")) == [
        "[Id_1] and [Id_2] and [99]", "[Id_2]", "x"]
    start, end = "<|im_start|>assistant", "<|im_end|>"
    replies = [
        (f"u {start}\n Id_2,Id_1 {end} Id_1", [7, 12]), (f"{start} Id_3 NO_DOCS", [7]),
        ("no marker", [7]), (f"{start}\n{end}", [7]), (f"{start} Id_1, Id_2", [5, 5]),
        (f"{start} Id_0, Id_01, id_1", [5]),
    ]
    assert evaluate(replies, schema, S.decode_selection("p", "ids")) == [
        "12,7", "Unknown(Id_3),Unknown(NO_DOCS)", "NO_DOCS", "", "Unknown(Id_1),5",
        "Unknown(Id_0),Unknown(Id_01),Unknown(id_1)"]
    comma = S.decode_selection("p", "ids", comma_only=True, missing=fv.NOTHING_FOUND)
    assert evaluate(replies[:3], schema, comma) == [
        "12,7", "Unknown(Id_3 NO_DOCS)", "Nessuna risposta trovata"]


def test_the_two_id_counts_differ(evaluate):
    raws = ["", "NO_DOCS", "Unknown()", "Unknown(NO_DOCS)", "Unknown(Id_9)", "12, 7", " , 3",
            "4,Unknown(x),Unknown(Id_2)", "5,5"]
    rows = [(r,) for r in raws]
    assert evaluate(rows, "r STRING", S.valid_id_count("r")) == [0, 0, 0, 0, 0, 2, 1, 1, 2]
    assert evaluate(rows, "r STRING", S.valid_id_count_loose("r")) == [1, 1, 1, 1, 0, 2, 2, 2, 2]


def test_order_changed(evaluate):
    rows = [("1,2", [1, 2]), ("2,1", [1, 2]), ("1,unknown(x),2", [1, 2]), ("1", [1, 2])]
    assert evaluate(rows, "r STRING, i ARRAY<BIGINT>", S.order_changed("r", "i")) == [
        False, True, False, True]


_PROMPT = ("I\nQuestion: who?\nDocuments:\nDocument [1](Title: a) one (x) y\n"
           "Document [22](Title: b) two\nDocument [1](Title: c) three\nAnswer:")


def test_prompt_parsing(evaluate):
    assert evaluate([(_PROMPT,), ("none",)], "p STRING", S.parse_question("p")) == [
        "who?\n".strip(), "Query non trovata"]
    parsed = evaluate([(_PROMPT,)], "p STRING", S.parse_documents("p"))[0]
    assert [(d.doc_id, d.body) for d in parsed] == [("22", "two"), ("1", "three\nAnswer:")]


def test_prompt_rebuild(evaluate):
    def rebuilt(raw, **options):
        column = S.rebuild_prompt(S.parse_question("p"), S.parse_documents("p"), "r", **options)
        return evaluate([(_PROMPT, raw)], "p STRING, r STRING", column)[0]

    assert rebuilt("1, 5,22", instruction="J") == (
        "<start_of_turn>user\nJ\nQuestion: who?\nDocuments:\nDocument [1](Title: c) three\n"
        "Document [22](Title: b) two\n<end_of_turn>\n<start_of_turn>model\n")
    assert rebuilt("NO_DOCS", instruction="J") == (
        "<start_of_turn>user\nJ\nQuestion: who?\n<end_of_turn>\n<start_of_turn>model")
    plain = dict(instruction="J", style=S.PLAIN_STYLE)
    assert rebuilt("22", **plain) == (
        "J\nQuestion: who?\nDocuments:\nDocument [22](Title: b) two\nAnswer:\n")
    assert rebuilt("", **plain) == "J\nQuestion: who?\nAnswer:\n"
    assert rebuilt("", instruction="J", style=S.PLAIN_OR_NULL_STYLE) is None


def test_chat_markup(evaluate):
    column = P.render_chat(P.messages("sys", F.col("u"), F.col("a")))
    assert evaluate([("hi", "Id_1")], "u STRING, a STRING", column) == [
        "<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nhi<|im_end|>\n"
        "<|im_start|>assistant\nId_1<|im_end|>\n"]


def test_selection_audit_hits(evaluate):
    docs = [("1", "", "Big Cat"), ("2", "", "dog"), ("3", "", "cat and dog")]
    schema = "docs ARRAY<STRUCT<doc_id: STRING, block: STRING, body: STRING>>, r STRING, " \
             "i ARRAY<BIGINT>, a ARRAY<STRING>"
    row = [(docs, "3,9,2", [2, 1, 3], ["CAT", "Dog"])]
    assert evaluate(row, schema, S.ids_with_answer("docs", "i", "a")) == [["2", "1", "3"]]
    hits = evaluate(row, schema, S.answer_hits("docs", "r", "a"))[0]
    assert [tuple(h) for h in hits] == [("3", "CAT"), ("3", "Dog"), ("2", "Dog")]
