"""The registered queries as plain SQL, for checking results in another engine.

Derived tables are common table expressions; `query(...)` pulls in the ones it names.
"""

from __future__ import annotations

from passagemill import fixed_values as fv
from passagemill.plans.fixtures import K, NEIGHBOURS


def s(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


# --- scalar expressions ---------------------------------------------------------
_BLANKS = s(" " * len(fv.WHITESPACE))
_PUNCT_AND_SPACE = fv.PUNCTUATION + fv.WHITESPACE


def one_space(x: str) -> str:
    return f"trim(regexp_replace({x}, '  +', ' ', 'g'), ' ')"


def squeeze(x: str) -> str:
    return one_space(f"translate({x}, {s(fv.WHITESPACE)}, {_BLANKS})")


def squash(x: str) -> str:
    return one_space(f"translate({x}, {s(_PUNCT_AND_SPACE)}, {s(' ' * len(_PUNCT_AND_SPACE))})")


def strip(x: str) -> str:
    return f"trim({x}, {s(fv.WHITESPACE)})"


def norm_text(x: str) -> str:
    """One step for each character class; classes do not overlap."""
    apostrophes = fv.SINGLE_QUOTES + fv.APOSTROPHES + fv.ACCENTS + fv.SINGLE_PRIMES
    out = f"translate({x}, {s(fv.DELETED_CONTROLS + fv.SOFT_HYPHEN)}, '')"
    for chars, new in (
            (fv.SPACE_LIKE, " "), (fv.HYPHENS, "-"), (fv.MINUSES, "-"), (fv.DOUBLE_QUOTES, '"'),
            (apostrophes, "'"), (fv.SLASHES, "/"), (fv.TILDES, "~")):
        out = f"translate({out}, {s(chars)}, {s(new * len(chars))})"
    for chars, new in (
            (fv.DOUBLE_PRIMES, "''"), (fv.TRIPLE_PRIMES, "'''"),
            (fv.QUADRUPLE_PRIMES, "''''"), (fv.ELLIPSIS, "...")):
        for char in chars:
            out = f"replace({out}, {s(char)}, {s(new)})"
    return f"replace({out}, {s(fv.SPACED_DOTS)}, {s(fv.CLOSED_DOTS)})"


def norm_answer(x: str, lowercase: bool = True) -> str:
    base = norm_text(f"lower({x})" if lowercase else x)
    words = f"string_split({squash(base)}, ' ')"
    return (f"array_to_string(list_filter({words}, lambda w: w NOT IN "
            f"({', '.join(s(a) for a in fv.ARTICLES)})), ' ')")


def has_any(haystack: str, answers: str, needle: str = "a") -> str:
    """True when some element of `answers`, as `needle` of a, is in the haystack."""
    return (f"coalesce(len(list_filter({answers}, lambda a: "
            f"contains({haystack}, {needle}))) > 0, false)")


def answer_match(pred: str, answers: str) -> str:
    return has_any(norm_answer(pred), answers, norm_answer("a"))


def answer_in_text(text: str, answers: str) -> str:
    plain = squash(text)
    return (f"({has_any(text, answers)} OR {has_any(plain, answers, norm_answer('a'))} "
            f"OR {has_any(plain, answers, norm_answer('a', False))})")


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def abstains(x: str) -> str:
    tests = " OR ".join(f"contains(lower({x}), {s(p.lower())})" for p in fv.ABSTENTION_PHRASES)
    return f"coalesce({tests}, false)"


def abstains_strict(x: str) -> str:
    return answer_in_text(first_line(x), f"[{s(fv.STRICT_ABSTENTION)}]")


def proof_of(x: str) -> str:
    marker = s(fv.PROOF_MARKER)
    tail = strip(f"substr({x}, strpos({x}, {marker}) + {len(fv.PROOF_MARKER)})")
    return (f"CASE WHEN contains({x}, {marker}) THEN {first_line(tail)} "
            f"ELSE {s(fv.NO_PROOF)} END")


def after(x: str, marker: str) -> str:
    """Text after the first marker, null without one."""
    return (f"CASE WHEN contains({x}, {s(marker)}) THEN "
            f"substr({x}, strpos({x}, {s(marker)}) + {len(marker)}) END")


def stable_hash(x: str, seed: int) -> str:
    return f"('0x' || substr(md5('{seed}:' || {x}), 1, 15))::BIGINT"


def words_at(x: str, start: int, count: int) -> str:
    skip = f"(?:[^ ]+ ){{{start - 1}}}" if start > 1 else ""
    return f"regexp_extract({x}, '^{skip}([^ ]+(?: [^ ]+){{0,{count - 1}}})', 1)"


def content(title: str, text: str) -> str:
    return f"CASE WHEN {title} = '' THEN {text} ELSE {title} || ' ' || {text} END"


def document(label: str, title: str, text: str) -> str:
    return f"'Document [' || {label} || '](Title: ' || {title} || ') ' || {text}"


def render(docs: str) -> str:
    return (f"array_to_string(list_transform({docs}, lambda d: "
            f"{document('d.doc_id', 'd.title', 'd.text')}), chr(10))")


def render_aliased(docs: str) -> str:
    label = f"'{fv.ALIAS_PREFIX}' || i"
    return (f"array_to_string(list_transform({docs}, lambda d, i: "
            f"{document(label, 'd.title', 'd.text')}), chr(10))")


def prompt(instruction: str, query: str, context: str | None = None) -> str:
    """Prompt with the question first; without a context only the question."""
    documents = "" if context is None else f" || chr(10) || 'Documents:' || chr(10) || {context}"
    return (f"{s(instruction)} || chr(10) || 'Question: ' || {query}{documents} "
            f"|| chr(10) || 'Answer:'")


def prompt_query_last(instruction: str, query: str, context: str) -> str:
    return (f"{s(instruction)} || chr(10) || 'Documents:' || chr(10) || {context} || chr(10) "
            f"|| 'Question: ' || {query} || chr(10) || 'Answer:'")


def prompt_open(instruction: str, query: str) -> str:
    """Up to the place where the documents begin."""
    return f"{s(instruction)} || chr(10) || 'Question: ' || {query} || chr(10) || 'Documents:' || chr(10)"


def in_turns(text: str) -> str:
    return ("'<start_of_turn>user' || chr(10) || " + text
            + " || '<end_of_turn>' || chr(10) || '<start_of_turn>model'")


def token_len(x: str) -> str:
    return (f"len(regexp_extract_all({x}, "
            r"'[0-9A-Za-z_]+|[^0-9A-Za-z_ \t\n\r\f\x0b]'))")


def ids_text(x: str, sep: str = ",") -> str:
    return f"array_to_string({x}, '{sep}')"


def bleu(hyp: str, ref: str) -> str:
    """Score of one pair of token lists."""
    def grams(words: str, n: int) -> str:
        return (f"list_transform(generate_series(1, len({words}) - {n - 1}), "
                f"lambda i: array_to_string({words}[i : i + {n - 1}], ' '))")

    logs, first = [], ""
    for n in range(1, 5):
        h, r = grams(hyp, n), grams(ref, n)
        shared = (f"coalesce(list_sum(list_transform(list_distinct({r}), lambda g: least("
                  f"len(list_filter({h}, lambda x: x = g)), "
                  f"len(list_filter({r}, lambda x: x = g))))), 0)")
        first = first or shared
        logs.append(f"ln((CASE WHEN {shared} = 0 THEN 0.1 ELSE {shared}::DOUBLE END) / "
                    f"greatest(len({hyp}) - {n - 1}, 1))")
    penalty = (f"(CASE WHEN len({hyp}) > len({ref}) THEN 0.0 "
               f"ELSE 1.0 - len({ref})::DOUBLE / greatest(len({hyp}), 1) END)")
    return (f"CASE WHEN {first} = 0 THEN 0.0 ELSE exp({penalty} + ({' + '.join(logs)}) / 4) END")


def tokens(x: str) -> str:
    return f"list_filter(string_split({squeeze(x)}, ' '), lambda t: t <> '')"


def bleu_max(hyp: str, answers: str) -> str:
    return (f"list_max(list_transform({answers}, lambda a: "
            f"{bleu(tokens(hyp), tokens('a'))}))")


def bleu_by_ngram_counts(source: str) -> str:
    """line_bleu and answer_bleu of (doc_id, line, short, refs) by joining n-gram counts.

    Its cost is linear in the text, so it suits long lines.
    """
    def counts(table: str, key: str) -> str:
        parts = " UNION ALL ".join(
            f"SELECT doc_id, {key}, {n} AS n, unnest(list_transform(generate_series(1, "
            f"len(toks) - {n - 1}), lambda i: array_to_string(toks[i : i + {n - 1}], ' '))) AS g "
            f"FROM {table}" for n in range(1, 5))
        return f"SELECT doc_id, {key}, n, g, count(*) AS c FROM ({parts}) GROUP BY ALL"

    return f"""
    SELECT doc_id, round(max(score) FILTER (kind = 'line'), 6) AS line_bleu,
      round(max(score) FILTER (kind = 'short'), 6) AS answer_bleu
    FROM (
      WITH src AS MATERIALIZED ({source}),
      hyps AS MATERIALIZED (
        SELECT doc_id, 'line' AS kind, {tokens('line')} AS toks FROM src
        UNION ALL SELECT doc_id, 'short', {tokens('short')} FROM src),
      refs AS MATERIALIZED (
        SELECT doc_id, nr, {tokens('ref')} AS toks FROM (
          SELECT doc_id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS nr FROM src)),
      shared AS (
        SELECT h.doc_id, h.kind, r.nr, r.n, sum(least(h.c, r.c)) AS num
        FROM ({counts('hyps', 'kind')}) h JOIN ({counts('refs', 'nr')}) r
          ON h.doc_id = r.doc_id AND h.n = r.n AND h.g = r.g
        GROUP BY ALL)
      SELECT p.doc_id, p.kind, CASE WHEN min(coalesce(s.num, 0)) FILTER (p.n = 1) = 0 THEN 0.0
        ELSE exp(min(CASE WHEN hl > rl THEN 0.0 ELSE 1.0 - rl::DOUBLE / greatest(hl, 1) END)
          + sum(ln((CASE WHEN coalesce(s.num, 0) = 0 THEN 0.1 ELSE s.num::DOUBLE END)
            / greatest(hl - p.n + 1, 1))) / 4) END AS score
      FROM (SELECT h.doc_id, h.kind, r.nr, o.n, len(h.toks) AS hl, len(r.toks) AS rl
            FROM hyps h JOIN refs r USING (doc_id), unnest([1, 2, 3, 4]) AS o(n)) p
      LEFT JOIN shared s USING (doc_id, kind, nr, n)
      GROUP BY p.doc_id, p.kind, p.nr)
    GROUP BY doc_id"""


def percent(hits: str, total: str) -> str:
    return (f"coalesce(round(round(count(*) FILTER ({hits}) / nullif({total}, 0)::DOUBLE, 4) "
            f"* 100, 6), 0.0)")


def toy_answer(docs: str) -> str:
    holders = f"list_filter({docs}, lambda d: contains(d.text, query))"
    hit = f"{holders}[1].text"
    tail = f"trim(substr({hit}, strpos({hit}, query) + length(query)), ' ')"
    count = f"CASE WHEN example_pos % 2 = 0 THEN greatest(3, 9 - 2 * len({docs})) ELSE 5 END"
    last = words_at(f"{docs}[-1].text", 1, 6)
    abstain = s(fv.ABSTAIN_TOKEN)
    return f"""coalesce(CASE
      WHEN len({docs}) = 0 THEN CASE WHEN example_pos % 7 = 3
        THEN answers[1] || ' indeed' ELSE {abstain} END
      WHEN example_pos % 11 = 4 THEN {last}
      WHEN len({holders}) > 0 THEN array_to_string(
        (string_split({words_at(tail, 1, 7)}, ' '))[1 : {count}], ' ')
      WHEN example_pos % 5 = 0 THEN {abstain}
      WHEN example_pos % 7 = 3 THEN answers[1] || ' perhaps'
      ELSE {last} END, {abstain})"""


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '\\n+', chr(10), 'g')")


def rebuilt(instruction: str, query: str, picked: str, turn: bool = True) -> str:
    """Rebuilt prompt from the list of picked document structs."""
    head, tail, empty = (
        ("<start_of_turn>user\n", "\n<end_of_turn>\n<start_of_turn>model",
         "\n<end_of_turn>\n<start_of_turn>model") if turn
        else ("", "\nAnswer:", "\nAnswer:\n"))
    opening = f"{s(head + instruction + chr(10) + 'Question: ')} || {query}"
    block = strip(document("d.doc_id", "d.title", "d.text"))
    if turn:
        block = f"regexp_replace({block}, '<end_of_turn>\\s*<start_of_turn>model', '', 'g')"
    block = f"regexp_replace({block}, 'Answer:\\s*', '', 'g')"
    docs = f"array_to_string(list_transform({picked}, lambda d: {block}), chr(10))"
    full = f"{opening} || chr(10) || 'Documents:' || chr(10) || {docs} || {s(tail)}"
    return (f"CASE WHEN len({picked}) = 0 THEN {opening} || {s(empty)} "
            f"ELSE {collapse(full)} || chr(10) END")


def decoded(reply: str, ids: str, comma_only: bool = False) -> str:
    """Comma-joined ids of a selector reply."""
    blank = fv.WHITESPACE.replace(" ", r"\x20")
    parts = (f"string_split({reply}, ',')" if comma_only
             else f"string_split_regex({reply}, {s('[,' + blank + ']+')})")
    parts = (f"list_filter(list_transform({parts}, lambda p: {strip('p')}), lambda p: p <> '')")
    number = f"nullif(regexp_extract(p, '^{fv.ALIAS_PREFIX}([1-9][0-9]*)$', 1), '')::INT"
    return (f"array_to_string(list_transform({parts}, lambda p: coalesce("
            f"({ids}[{number}])::VARCHAR, 'Unknown(' || p || ')')), ',')")


def split_ids(raw: str) -> str:
    return (f"list_filter(list_transform(string_split({raw}, ','), lambda p: {strip('p')}), "
            f"lambda p: p <> '')")


def valid_ids(raw: str) -> str:
    known = (f"list_filter({split_ids(raw)}, lambda p: "
             f"NOT regexp_matches(p, '^Unknown\\([^\\n]*\\)'))")
    return (f"CASE WHEN {raw} IN ({s(fv.NO_DOCS)}, {s(fv.UNKNOWN_EMPTY)}) THEN 0 "
            f"ELSE len({known}) END::INT")


def valid_ids_loose(raw: str) -> str:
    return (f"len(list_filter(string_split({raw}, ','), lambda p: "
            f"NOT regexp_matches(p, '^Unknown\\(Id_[0-9]+\\)')))::INT")


def after_marker(prompt: str, answers: str) -> str:
    tail = after(f"lower({prompt})", fv.DOCUMENTS_MARKER)
    return f"(coalesce({tail} <> '', false) AND {has_any(tail, answers, 'lower(a)')})"


def chat(instruction: str, user: str, assistant: str | None = None) -> str:
    turns = [("system", s(instruction)), ("user", user)]
    if assistant is not None:
        turns.append(("assistant", assistant))
    return " || ".join(
        f"'<|im_start|>{role}' || chr(10) || {text} || '<|im_end|>' || chr(10)"
        for role, text in turns)


# --- derived tables -----------------------------------------------------------------
_BASE = "[" + ", ".join(str(n) for n in NEIGHBOURS) + "]"
_SELECTOR_REPLY = (
    "array_to_string(list_reverse(list_filter(list_transform(document_indices, lambda d, i: "
    f"CASE WHEN d % 3 <> 0 THEN '{fv.ALIAS_PREFIX}' || i END), lambda a: a IS NOT NULL)), ', ')"
    " || CASE WHEN example_pos % 6 = 0 THEN ' Id_9' ELSE '' END"
)


def context_cte(k: int, ids: str, instruction: str) -> str:
    """Contexts from an id-list expression over examples and search_results."""
    return f"""
    SELECT e.example_pos, e.example_id, e.query, e.answers, e.gold_document_idx, c.docs,
      list_transform(c.docs, lambda d: d.doc_id) AS document_indices,
      {prompt(instruction, 'e.query', render('c.docs'))} AS prompt
    FROM (SELECT * REPLACE ({norm_text('query')} AS query) FROM examples) e
    JOIN (
      SELECT example_pos, coalesce(list(struct_pack(doc_id := doc_id, title := title,
        text := text) ORDER BY pos) FILTER (doc_id IS NOT NULL AND nth <= {k}), []) AS docs
      FROM (
        SELECT *, sum(CASE WHEN copy = 1 AND doc_id IS NOT NULL THEN 1 ELSE 0 END)
          OVER (PARTITION BY example_pos ORDER BY pos) AS nth
        FROM (
          SELECT l.example_pos, l.pos, d.full_corpus_idx AS doc_id, d.title, d.text,
            row_number() OVER (PARTITION BY l.example_pos, d.doc_hash ORDER BY l.pos) AS copy
          FROM (
            SELECT example_pos, unnest(ids) AS hit, generate_subscripts(ids, 1) AS pos
            FROM (SELECT e.example_pos, {ids} AS ids FROM examples e
                  LEFT JOIN search_results r USING (example_pos))
          ) l LEFT JOIN hashed_corpus d ON d.full_corpus_idx = l.hit
        )
      ) WHERE copy = 1 GROUP BY example_pos
    ) c USING (example_pos)"""


_TOP = f"list_reverse(r.doc_ids[1:{K}])"

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "docs": (f"""
    SELECT doc_id, coalesce(lang, '') AS title, coalesce(text, '') AS text, source,
      {squeeze("coalesce(text, '')")} AS sq FROM documents""", ()),
    "corpus": ("SELECT doc_id AS full_corpus_idx, title, sq AS text FROM docs", ("docs",)),
    "hashed_corpus": (
        f"SELECT *, sha256({content('title', 'text')}) AS doc_hash FROM corpus", ("corpus",)),
    "examples": (f"""
    SELECT doc_id AS example_pos, 'q' || doc_id AS example_id,
      {words_at('sq', 1, 8)} AS query,
      list_filter([{words_at('sq', 9, 3)}, {words_at('sq', 12, 2)}], lambda a: a <> '') AS answers,
      CASE WHEN doc_id % 5 <> 0 THEN doc_id ELSE -1 END AS gold_document_idx
    FROM docs""", ("docs",)),
    "search_results": (f"""
    SELECT example_pos, CASE WHEN first_copy = example_pos THEN block
      ELSE [first_copy] || list_filter(block, lambda i: i <> first_copy) END AS doc_ids
    FROM (
      SELECT full_corpus_idx AS example_pos,
        min(full_corpus_idx) OVER (PARTITION BY doc_hash) AS first_copy,
        list_transform({_BASE}[(full_corpus_idx // 8) % 8 + 1 : 8]
          || {_BASE}[1 : (full_corpus_idx // 8) % 8], lambda n: xor(full_corpus_idx, n)) AS block
      FROM (SELECT doc_id AS full_corpus_idx, sha256({content('title', 'text')}) AS doc_hash
            FROM docs))""", ("docs",)),
    "contexts": (context_cte(K, _TOP, fv.INSTRUCTION_ANSWER), ("examples", "search_results", "hashed_corpus")),
    "contexts_always": (
        context_cte(K, _TOP, fv.INSTRUCTION_ALWAYS_ANSWER), ("examples", "search_results", "hashed_corpus")),
    "retrieved": (f"""
    SELECT *, {strip(after('generated_text', fv.ANSWER_MARKER))} AS generated_full FROM (
      SELECT *, prompt || ' ' || {toy_answer('docs')} || chr(10) || 'Question: next'
        AS generated_text FROM contexts)""", ("contexts",)),
    "only_query": (f"""
    SELECT *, {strip(after('generated_text', fv.ANSWER_MARKER))} AS generated_full FROM (
      SELECT *, prompt || ' ' || {toy_answer('docs')} AS generated_text FROM (
        SELECT * REPLACE ({norm_text('query')} AS query),
          {prompt(fv.INSTRUCTION_QUERY_ONLY, norm_text('query'))} AS prompt,
          []::STRUCT(doc_id BIGINT, title VARCHAR, text VARCHAR)[] AS docs FROM examples))""",
                   ("examples",)),
    "selector": (f"""
    SELECT *, CASE WHEN example_pos % 13 = 5 THEN NULL
      WHEN reply = '' THEN '{fv.NO_DOCS}' ELSE reply END AS selector_reply
    FROM (SELECT *, {_SELECTOR_REPLY} AS reply FROM contexts_always)""", ("contexts_always",)),
    "selection": (f"""
    SELECT *, list_filter(list_transform({split_ids('selected_ids_raw')}, lambda p:
        list_filter(docs, lambda d: d.doc_id::VARCHAR = p)[1]), lambda d: d IS NOT NULL) AS picked
    FROM (SELECT *, coalesce({decoded('selector_reply', 'document_indices')}, '{fv.NO_DOCS}')
      AS selected_ids_raw FROM selector)""", ("selector",)),
    "selected": (f"""
    SELECT * REPLACE ({rebuilt(fv.INSTRUCTION_ANSWER, 'query', 'picked')} AS prompt),
      {strip(toy_answer('picked'))} AS generated_full FROM selection""", ("selection",)),
}


def _scored(source: str) -> str:
    return f"""
    SELECT *, (ans_in_documents AND ans_match_after_norm)
        OR (NOT ans_in_documents AND is_no_res) AS is_correct FROM (
      SELECT *, {answer_match('generated_answer', 'answers')} AS ans_match_after_norm,
        coalesce(list_contains(document_indices, gold_document_idx), false) AS gold_in_retrieved,
        {answer_in_text('prompt', 'answers')} AS ans_in_documents,
        {abstains('generated_answer')} AS is_no_res
      FROM (SELECT *, {first_line('generated_full')} AS generated_answer FROM {source}))"""


CTES["scored_retrieved"] = (_scored("retrieved"), ("retrieved",))
CTES["scored_selected"] = (_scored("selected"), ("selected",))


def _silver_round(previous: str) -> str:
    """One greedy round over the state table `previous`."""
    judged = f"""
      SELECT *, {answer_match('answer', 'answers')} AS ok, {bleu_max('answer', 'answers')} AS score
      FROM (SELECT *, {first_line(toy_answer('used'))} AS answer FROM (
        SELECT st.*, u.n, docs[u.n].doc_id AS cand,
          list_transform(silver, lambda i: list_filter(docs, lambda d: d.doc_id = i)[1])
            || [docs[u.n]] AS used
        FROM {previous} st, unnest(generate_series(1, len(docs))) AS u(n)
        WHERE active AND NOT list_contains(silver, docs[u.n].doc_id)))"""
    return f"""
    SELECT example_pos, example_id, query, answers, docs, document_indices,
      CASE WHEN grows THEN list_append(silver, best_doc) ELSE silver END AS silver,
      silver_ok OR grows AS silver_ok,
      CASE WHEN grows THEN best_score ELSE silver_score END AS silver_score,
      best_doc, best_ok, best_score, grows AS active, trace
    FROM (
      SELECT * , coalesce(active AND best_ok AND best_doc IS NOT NULL
        AND NOT list_contains(silver, best_doc)
        AND (NOT silver_ok OR best_score > silver_score), false) AS grows
      FROM (
        SELECT p.* REPLACE (
            CASE WHEN better THEN top.cand ELSE best_doc END AS best_doc,
            CASE WHEN better THEN top.score ELSE best_score END AS best_score,
            best_ok OR better AS best_ok, p.trace || coalesce(done, []) AS trace)
        FROM (SELECT p.*, r.top, r.done,
                coalesce(r.top IS NOT NULL AND (NOT best_ok OR r.top.score > best_score), false)
                  AS better
              FROM {previous} p LEFT JOIN (
                SELECT example_pos,
                  arg_min(struct_pack(score := score, cand := cand), (-score, n))
                    FILTER (ok) AS top,
                  list(struct_pack(docs := list_append(silver, cand), answer := answer, ok := ok,
                    score := score) ORDER BY n) AS done
                FROM ({judged}) GROUP BY example_pos) r USING (example_pos)) p))"""


CTES["silver_0"] = (f"""
    SELECT example_pos, example_id, query, answers, docs, document_indices, []::BIGINT[] AS silver,
      ok AS silver_ok, CASE WHEN ok THEN score ELSE 0.0 END AS silver_score,
      NULL::BIGINT AS best_doc, ok AS best_ok,
      CASE WHEN ok THEN score ELSE 0.0 END AS best_score, true AS active,
      [struct_pack(docs := []::BIGINT[], answer := answer, ok := ok, score := score)] AS trace
    FROM (SELECT *, {answer_match('answer', 'answers')} AS ok,
            {bleu_max('answer', 'answers')} AS score
          FROM (SELECT *, {first_line(toy_answer('docs[1:0]'))} AS answer FROM contexts))""",
                    ("contexts",))
for _r in range(1, K + 1):
    CTES[f"silver_{_r}"] = (_silver_round(f"silver_{_r - 1}"), (f"silver_{_r - 1}",))
_RIGHT = "list_filter(trace, lambda t: t.ok)"
CTES["silver"] = (f"""
    SELECT *, len({_RIGHT}) > 0 AS are_answer, silver AS selected_documents,
      len(silver)::INT AS number_documents_selected,
      CASE WHEN len(silver) = 0 AND len({_RIGHT}) > 0 THEN {_RIGHT}[1].answer
        ELSE list_filter({_RIGHT}, lambda t: t.score > 0 AND t.score =
          list_max(list_transform({_RIGHT}, lambda x: x.score)))[1].answer END AS generated_answer
    FROM silver_{K}""", (f"silver_{K}",))


def query(sql: str, *tables: str) -> str:
    """SQL with the derived tables it needs in front."""
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in CTES[name][1]:
            add(needed)
        ordered.append(name)

    for table in tables:
        add(table)
    if not ordered:
        return sql
    parts = ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][0]})" for name in ordered)
    return f"WITH {parts}\n{sql}"
