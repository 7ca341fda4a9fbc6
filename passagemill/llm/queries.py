"""The operators over whole tables, with the columns that the checks read."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from passagemill.llm import (
    bisectors, decontaminate, fingerprints, language, line_dedup, lm_score, mtree, orchard, packing,
    quality, secret_scan, sequences, simhash,
)
from passagemill.llm.common import column, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@register("op1_fingerprints")
def op1(spark, sf):
    return fingerprints.compare_neighbours(table(spark, sf, "documents"))


@register("op2_decontaminate")
def op2(spark, sf):
    return decontaminate.find(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@register("op3_secrets")
def op3(spark, sf):
    kinds = [r.kind for r in secret_scan.RULES]
    base = [r.kind for r in secret_scan.BASE]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, spans in zip(column(batch, "doc_id").to_pylist(), column(batch, "spans").to_pylist()):
                ordered = sorted(spans, key=lambda s: (s["start"], kinds.index(s["kind"])))
                told = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in ordered]
                own = ",".join(t for k, t in told if k in base)
                rows.append((doc, *(sum(k == b for k, _ in told) for b in base),
                             hashlib.sha256(own.encode()).hexdigest(), ",".join(t for _, t in told)))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[k] for r in rows], pa.int64() if k < 4 else pa.string()) for k in range(6)],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return secret_scan.scan(table(spark, sf, "documents")).mapInArrow(
        digest, "doc_id LONG, n_assign LONG, n_access LONG, n_hex LONG, base_sha256 STRING, spans STRING")


@register("op4_language")
def op4(spark, sf):
    docs = table(spark, sf, "documents")
    return language.identify(docs, language.train(docs))


@register("op5_packing")
def op5(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents"))


@register("op6_lm_score")
def op6(spark, sf):
    docs = table(spark, sf, "documents")
    good = lm_score.mark_ids(table(spark, sf, "labels").where("quality = 1"))
    return lm_score.score(docs, lm_score.train(docs, good), counted=good)


@register("op7_simhash")
def op7(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register("op8_quality")
def op8(spark, sf):
    docs = table(spark, sf, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf, "labels")))


@register("op9_sequences")
def op9(spark, sf):
    return sequences.read_documents(spark, sequences.write_sequences(table(spark, sf, "documents")))


@register("op10_line_dedup", r"""
    WITH lines AS (
      SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
      FROM documents),
    keyed AS (
      SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
    repeated AS (
      SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10
      GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
    marked AS (
      SELECT keyed.*, repeated.k IS NOT NULL AND doc_id <> keeper AS gone
      FROM keyed LEFT JOIN repeated ON keyed.k = repeated.k)
    SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""")
def op10(spark, sf):
    docs = table(spark, sf, "documents")
    return line_dedup.drop_report(docs, line_dedup.build_shards(docs))


def _rounds(steps: list[str]) -> str:
    return ",\n".join(steps)


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds of k-means, one after the other; floor division written for negative sums."""
    steps = ["""
    vectors AS MATERIALIZED (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
    c0 AS MATERIALIZED (
      SELECT (row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1)::INT AS c, v FROM vectors
      QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
      SELECT vec_id, x.v AS v, unnest(min(struct_pack(
        d := list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c := c)))
      FROM vectors x, c{i} c GROUP BY vec_id, x.v)""")
        if i < rounds:
            steps.append(f"""
    s{i} AS (
      SELECT c, pos, (s - ((s % n) + n) % n) // n AS x FROM (
        SELECT c, pos, sum(x)::BIGINT AS s, count(*) AS n FROM (
          SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY c, pos)),
    c{i + 1} AS MATERIALIZED (
      SELECT c{i}.c AS c, coalesce(m.v, c{i}.v) AS v FROM c{i}
      LEFT JOIN (SELECT c, list(x ORDER BY pos) AS v FROM s{i} GROUP BY c) m ON m.c = c{i}.c)""")
    return f"""
    WITH {_rounds(steps)}
    SELECT vec_id, a{rounds}.c AS cluster, d::BIGINT AS distance,
      (sum(d) OVER (PARTITION BY a{rounds}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
      sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} ON a{rounds}.c = c{rounds}.c"""


@register("op11_clusters", _cluster_sql())
def op11(spark, sf):
    return bisectors.cluster_report(table(spark, sf, "embeddings"))


def _codes_sql(parts: int = 16, size: int = 64, rounds: int = 2) -> str:
    steps = ["""
    vectors AS MATERIALIZED (
      SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
    parts AS MATERIALIZED (
      SELECT vec_id, label, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x
      FROM vectors, range({parts}) r(p)),
    b0 AS MATERIALIZED (
      SELECT p, e, x AS y FROM parts JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM vectors QUALIFY e < {size}) f
      ON f.vec_id = parts.vec_id)"""]
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (
      SELECT vec_id, label, x.p AS p, x, unnest(min(struct_pack(
        d := list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2]))), e := e)))
      FROM parts x JOIN b{i} b ON b.p = x.p GROUP BY vec_id, label, x.p, x)""")
        if i < rounds:
            steps.append(f"""
    s{i} AS (
      SELECT p, e, pos, (s - ((s % n) + n) % n) // n AS z FROM (
        SELECT p, e, pos, sum(z)::BIGINT AS s, count(*) AS n FROM (
          SELECT p, e, unnest(x) AS z, generate_subscripts(x, 1) AS pos FROM a{i}) GROUP BY p, e, pos)),
    b{i + 1} AS MATERIALIZED (
      SELECT b{i}.p AS p, b{i}.e AS e, coalesce(m.y, b{i}.y) AS y FROM b{i}
      LEFT JOIN (SELECT p, e, list(z ORDER BY pos) AS y FROM s{i} GROUP BY p, e) m ON m.p = b{i}.p AND m.e = b{i}.e)""")
    return f"""
    WITH {_rounds(steps)},
    coded AS (
      SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error
      FROM a{rounds} GROUP BY vec_id, label)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
      (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
    FROM coded"""


@register("op12_codes", _codes_sql())
def op12(spark, sf):
    return orchard.compress(table(spark, sf, "embeddings"))


@register("op13_top_k", """
    WITH vectors AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT q.vec_id AS query_id,
      (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id))::INT AS rank,
      x.vec_id AS vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
    FROM vectors q JOIN vectors x ON q.vec_id <> x.vec_id
    WHERE q.vec_id % 20 = 0
    QUALIFY rank <= 20""")
def op13(spark, sf):
    return mtree.top_k(table(spark, sf, "embeddings"))
