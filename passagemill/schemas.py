"""Explicit schemas of the tables the engine reads."""

CORPUS_JSON = "title STRING, text STRING"
CORPUS = "full_corpus_idx BIGINT, title STRING, text STRING"
ID_MAP = "full_corpus_idx BIGINT, subset_idx BIGINT"
EXAMPLES_JSON = (
    "example_id STRING, query STRING, question STRING, answers ARRAY<STRING>, "
    "idx_gold_in_corpus STRING"
)
SEARCH_RESULTS = "example_pos BIGINT, doc_ids ARRAY<BIGINT>, scores ARRAY<DOUBLE>"
TRAINING_LOG = "log_history ARRAY<STRUCT<step: BIGINT, loss: DOUBLE>>"
TRACE = (
    "ARRAY<STRUCT<candidate_documents: ARRAY<BIGINT>, generated_answer: STRING, "
    "is_correct: BOOLEAN, bleu_score: DOUBLE>>"
)
