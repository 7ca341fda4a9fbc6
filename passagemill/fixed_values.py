"""Values that must stay exactly as they are for results to be right.

Nothing in this module is logic: character tables, phrases, prompt wording,
markers, patterns and quota shares only.
"""

# --- Fixed values: unicode clean-up tables --------------------------------
# Control characters that are deleted. U+0010 and U+001C..U+001F are not in
# the list on purpose; tab, newline and carriage return stay as they are.
DELETED_CONTROLS = (
    "\u0001\u0002\u0003\u0004\u0005\u0006\u0007\u0008\u000e\u000f\u0011"
    "\u0012\u0013\u0014\u0015\u0016\u0017\u0018\u0019\u001a\u001b"
)
SOFT_HYPHEN = "\u00ad"
SPACE_LIKE = "\u000b\u000c\u0085"  # vertical tab, form feed, next line
HYPHENS = "‐‑⁃‒–—―"
MINUSES = "−－⁻"
DOUBLE_QUOTES = "“”„‟"
SINGLE_QUOTES = "‘’‚‛"
APOSTROPHES = "՚Ꞌꞌ＇"
ACCENTS = "`´"
SINGLE_PRIMES = "′‵"
DOUBLE_PRIMES = "″‶"
TRIPLE_PRIMES = "‴‷"
QUADRUPLE_PRIMES = "⁗"
ELLIPSIS = "…"
SLASHES = "⁄∕"
TILDES = "˜⁓∼∽∿〜～"
SPACED_DOTS = " . . . "
CLOSED_DOTS = " ... "

# What counts as whitespace, and the ASCII punctuation set.
WHITESPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ARTICLES = ("a", "an", "the")

# --- Fixed values: abstention ----------------------------------------------
ABSTENTION_PHRASES = (
    "NO-RES",
    "any of the provided document",
    "any of the document",
    "None of the provided document",
    "None of the document",
    "No res",
    "NO RESULT FOUND",
    "NO RESPONSE",
    "NO-RESPONSE",
    "No answer found",
    "do not know the answer",
    "don't know the answer",
    "do not provide information",
    "does not provide any information",
    "no direct answer",
    "not explicitly stated in the given document",
)
STRICT_ABSTENTION = "NO-RES"
ABSTAIN_TOKEN = "NO-RESPONSE"

# --- Fixed values: markers and sentinels ------------------------------------
ANSWER_MARKER = "Answer:"
ANSWER_CUE = "\nAnswer:"
ADAPTER_ANSWER_MARKER = "\n\nmodel"
PROOF_MARKER = "Proof:"
NO_PROOF = "NO-PROOF"
NO_DOCS = "NO_DOCS"
NOTHING_FOUND = "Nessuna risposta trovata"
QUERY_NOT_FOUND = "Query non trovata"
UNKNOWN_EMPTY = "Unknown()"
DOCUMENTS_MARKER = "documents:"
ALIAS_PREFIX = "Id_"
ASSISTANT_MARKER = "<|im_start|>assistant"
END_MARKER = "<|im_end|>"
DEFAULT_EXAMPLE_ID = "id"
NO_GOLD = -1
STOP_STRINGS = ("\nHuman:", "\n```\n", "\nQuestion:", "<|endoftext|>", "\n")

# --- Fixed values: instructions ---------------------------------------------
INSTRUCTION_QUERY_ONLY = (
    "You are given a question and you must respond based on your internal "
    "knowledge. You must always provide an answer."
)
INSTRUCTION_ANSWER = (
    "You are given a question and you must respond based on the provided "
    "documents. Respond directly without providing any premise or explanation. "
    "If none of the documents contain the answer, please respond with "
    "NO-RESPONSE. Do not try to respond based on your own knowledge."
)
INSTRUCTION_ALWAYS_ANSWER = (
    "You are given a question and you must respond based on the provided "
    "documents. You must always provide an answer."
)
INSTRUCTION_SELECT = (
    "Output only the document IDs relevant to the query. "
    "Use this format: [ID1, ID2, ...]."
)
INSTRUCTION_SELECT_ALIASES = (
    "Output only the IDs of the documents relevant to the query. Use this "
    "format: [Id_1, Id_2, ...]. If there is no relevant document, output NO_DOCS."
)
INSTRUCTION_PROOF = (
    "You are given a question and you must respond based on the provided "
    "documents. You must always provide an answer. If none of the documents "
    "contain the answer, respond with NO-RES. In addition, you must report the "
    "portion of the document (Proof) containing the answer.\nSTART example\n"
    "Document [20970787](Title: Ancient Egyptian technology) Evidence indicates "
    "that Egyptians made use of potter 's wheels in the manufacturing of pottery "
    "from as early as the 4th Dynasty . Chariots , however , are only believed to "
    "have been introduced by the invasion of the Hyksos in the Second Intermediate "
    "period ; during the New Kingdom era , chariotry became central to Egypt 's "
    "military .\nQuestion: when was the potter's wheel first used in egypt\n"
    "Answer: 4th Dynasty\nProof: Evidence indicates that Egyptians made use of "
    "potter 's wheels in the manufacturing of pottery from as early as the 4th "
    "Dynasty .\nEND example\n"
)

# --- Fixed values: chat wrappers --------------------------------------------
CHAT_WRAPPERS = {
    "google/gemma-2-2b-it": {
        "head": "<start_of_turn>user\n",
        "tail": "<end_of_turn>\n<start_of_turn>model",
        "answer_prefix": "Answer:\nmodel",
    },
}

# --- Fixed values: rendering of documents, training rows and chat turns -----------
DOCUMENT_MARKS = ("Document [", "](Title: ", ") ")
TRAINING_QUESTION = "Question: "
TRAINING_DOCUMENTS = "\nDocuments:"
SAMPLE_OPENING = f"Task Instruction: {INSTRUCTION_SELECT}\nQuestion:"
TURN_START = "<|im_start|>"
TURN_END = "<|im_end|>\n"

# --- Fixed values: quota shares ----------------------------------------------
# Shares of each selection-size group (none / one / several documents).
GROUP_SHARES = {
    "case_1_single_doc": 0.07,
    "case_2_multiple_docs": 0.4,
    "case_3_no_docs": 0.1,
    "case_4_multi_doc_unchanged": 0.35,
    "case_5_reranking": 0.5,
    "case_6_single_doc_unchanged": 0.05,
}
# Shares of the whole input.
GLOBAL_SHARES = {
    "case_1_single_doc": 0.1,
    "case_2_multiple_docs": 0.2,
    "case_3_no_docs": 0.1,
    "case_4_less_docs": 0.4,
    "case_5_reranking": 0.2,
}
