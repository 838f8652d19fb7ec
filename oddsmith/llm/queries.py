"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NEAR_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w
          ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS x FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  both_of AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
           GROUP BY 1, 2),
  links AS (SELECT a, b FROM both_of JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
            WHERE 100 * k >= 80 * (na.n + nb.n - k)),
  ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reach(a, b) AS (SELECT a, b FROM ways UNION SELECT r.a, w.b FROM reach r JOIN ways w ON r.b = w.a),
  least AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)"""


@query("op8_minhash_near_dedup", _NEAR_SQL)
def op8(spark, sf_dir):
    from oddsmith.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


_REPEATED_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
  p AS (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM d),
  w AS (SELECT doc_id, i, CASE WHEN 2 * i + 98 <= len(h) THEN md5(substr(h, 2 * i - 1, 100)) END AS s,
               substr(h, 2 * i - 1, 2) AS b FROM p),
  m AS (SELECT *, CASE WHEN s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id THEN i END AS gone FROM w),
  r AS (SELECT doc_id, i, b, coalesce(max(gone) OVER (PARTITION BY doc_id ORDER BY i) > i - 50, FALSE) AS removed FROM m),
  e AS (SELECT *, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY i), FALSE) AS begins FROM r),
  g AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (begins) AS n_spans,
               string_agg(b, '' ORDER BY i) FILTER (NOT removed) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""


@query("op10_suffix_array_dedup", _REPEATED_SQL)
def op10(spark, sf_dir):
    from oddsmith.llm.suffix_dedup import remove_repeated_bytes

    found = remove_repeated_bytes(table(spark, sf_dir, "documents"), length=50)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op1_compact_window_dedup")
def op1(spark, sf_dir):
    from oddsmith.llm.substring_dedup import repeated_passages

    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_repeated", "spans", F.sha2("kept", 256).alias("kept_sha256"))


def _scored(scores: DataFrame, divisor: int, held: int) -> DataFrame:
    from oddsmith.llm.labelled import remainder

    return scores.select(
        "doc_id",
        F.coalesce(remainder("doc_id", divisor) == held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op2_toxicity")
def op2(spark, sf_dir):
    from oddsmith.llm.labelled import remainder
    from oddsmith.llm.toxicity import toxicity_scores

    documents = table(spark, sf_dir, "documents")
    scores = toxicity_scores(documents, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return _scored(scores, 4, 2)


@query("op9_quality_factorisation_machine")
def op9(spark, sf_dir):
    from oddsmith.llm.labelled import remainder
    from oddsmith.llm.quality import quality_scores

    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    scores = quality_scores(documents, labels, remainder("doc_id", 5) != 0, metadata=F.col("n_chars"))
    return _scored(scores, 5, 0)


@query("op3_language_ppm")
def op3(spark, sf_dir):
    from oddsmith.llm.labelled import remainder
    from oddsmith.llm.language import predict_language

    found = predict_language(table(spark, sf_dir, "documents"), remainder("doc_id", 4) != 2)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary(name: str = VOCABULARY) -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a file of the installed public tokenizers."""
    import public_tokenizers

    from oddsmith.llm.bpe import load_ranks

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


@query("op4_byte_bpe")
def op4(spark, sf_dir):
    from oddsmith.llm.bpe import decode, encode

    ranks, pattern = vocabulary()
    found = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_mix_to_target_weights")
def op5(spark, sf_dir):
    from oddsmith.llm.mixing import mix_to_targets

    return mix_to_targets(table(spark, sf_dir, "documents"))


_TOP_SQL = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank
    FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


@query("op6_exact_top_k", _TOP_SQL)
def op6(spark, sf_dir):
    from oddsmith.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


@query("op7_scaled_sketch_fingerprint")
def op7(spark, sf_dir):
    from oddsmith.llm.fingerprint import fingerprints_beside_edits

    found = fingerprints_beside_edits(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("sketch", " ").alias("fingerprint"),
        F.array_join("edited_sketch", " ").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def _codes_sql() -> str:
    """Two rounds and the last assignment, one after another, by full search."""
    steps = []
    for step in range(3):
        steps.append(f"""far{step} AS (SELECT v.rid, v.part, e.entry, CAST(sum((v.x - e.x) * (v.x - e.x)) AS BIGINT) AS far
    FROM v JOIN books{step} e USING (part, pos) GROUP BY ALL),
  held{step} AS (SELECT rid, part, entry, far FROM far{step}
    QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY far, entry) = 1)""")
        if step < 2:
            steps.append(f"""sums{step} AS (SELECT part, entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
    FROM v JOIN held{step} USING (rid, part) GROUP BY ALL),
  books{step + 1} AS (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x) AS x
    FROM books{step} LEFT JOIN sums{step} USING (part, entry, pos))""")
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  r AS (SELECT *, row_number() OVER (ORDER BY vec_id, x) AS rid, len(x) // 16 AS width FROM k),
  u AS (SELECT rid, width, unnest(x) AS x, unnest(range(len(x))) AS i FROM r),
  v AS (SELECT rid, i // width AS part, i % width AS pos, x FROM u),
  books0 AS (SELECT part, rid - 1 AS entry, pos, x FROM v WHERE rid <= 64),
  {", ".join(steps)},
  coded AS (SELECT rid, string_agg(lpad(to_hex(entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error
    FROM held2 GROUP BY rid)
SELECT vec_id, label, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM books2) AS codebooks_sha256
FROM coded JOIN r USING (rid)"""


@query("op12_vector_codes", _codes_sql())
def op12(spark, sf_dir):
    from oddsmith.llm.vector_codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


_DIVERGENCE_SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
  t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
  kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
  c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN (SELECT lang, term FROM kept) USING (lang, term) GROUP BY ALL),
  v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
  g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n
    FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
  p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
           1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5)) // (g.n + 5 * v.v) AS p,
           1 + (CAST(1000000000 AS HUGEINT) * (kept.n + 5)) // (v.n + 5 * v.v) AS q
    FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
  pair AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
  told AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
  ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM told)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50"""


@query("op13_source_divergence", _DIVERGENCE_SQL)
def op13(spark, sf_dir):
    from oddsmith.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


@query("op11_personal_data")
def op11(spark, sf_dir):
    from oddsmith.llm.personal_data import personal_data

    return personal_data(table(spark, sf_dir, "documents"))
