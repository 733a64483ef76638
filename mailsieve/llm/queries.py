"""The queries opN_<name> over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsieve.llm import ann, bpe, chat, codes, collisions, fim, packing, html_text, jaccard_join, katz, language_id, mixing, quality
from mailsieve.llm.frames import fold, read


def tokenizer_path() -> str:
    """The public byte-level vocabulary's file, present on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A conversation whose texts hold a template's control strings.
CONTROL = r"\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], turns.schema)
    return chat.digest(chat.format_turns(turns.unionByName(control)))


def op2_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    return quality.classify(docs, read(spark, sf, "labels")).drop("text")


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(role) + length(text) + 14
    + length(regexp_replace(role || text, '[^\\<#:]', '', 'g')) AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, false AS rewrites
FROM sized GROUP BY conv_id
"""


def op7_katz_scoring(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return katz.score(docs.withColumn("held_out", fold(F.col("doc_id")) == 1))


def op8_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    planned = mixing.plan_mix(read(spark, sf, "documents"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return planned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken)


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), filled AS (  -- the fullest sources first: each is at its limit if the share left would pass it
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 1.0 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
    sum(weight) OVER (ORDER BY source_size * 1.0 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM sources
), shares AS (
  SELECT *, (total - below)::DOUBLE / free::DOUBLE AS share FROM filled
), level AS (
  SELECT max(share) FILTER (WHERE share * weight <= 3 * source_size) AS share FROM shares
), targets AS (
  SELECT source, source_size, least(weight * level.share, (3 * source_size)::DOUBLE) AS target FROM sources, level
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS wanted FROM targets
), ranked AS (
  SELECT d.doc_id, d.size, p.source, p.source_size, p.target, floor(wanted)::BIGINT AS whole,
    wanted - floor(wanted) AS p, target - floor(wanted) * source_size AS rest,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
), pareto AS (
  SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM ranked
), cut AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM pareto
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  ((whole + CASE WHEN q IS NOT NULL AND upto - size / 2.0 <= rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM cut
"""


def op3_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return collisions.near_duplicates(read(spark, sf, "embeddings"))


def op4_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(read(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.join(read(spark, sf, "documents").select("doc_id", "text"))


def op6_bpe_encoding(spark: SparkSession, sf: str) -> DataFrame:
    path = tokenizer_path()
    encoded = bpe.encode(read(spark, sf, "documents"), path)
    return bpe.decode(encoded, path).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    found = html_text.extract(read(spark, sf, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(language_id.training_rows(F.col("doc_id"))))
    found = language_id.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return fim.transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"
    )


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), c AS (
  SELECT doc_id, t, length(t)::BIGINT AS n,
    ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), s AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c
), p AS (
  SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM s
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN lo END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE WHEN form = 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


def op11_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, book = codes.compress(read(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    return coded.select(
        "vec_id", "code", "error", F.col("group_error").alias("label_error"),
        F.lit(codes.digest(book)).alias("codebooks_sha256"),
    )


def _op11_sql(rounds: int = codes.ROUNDS) -> str:
    """Integer k-means of four part positions, its rounds unrolled."""
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS (
  SELECT x.rid, x.part, c.entry, sum((x.val - c.val) * (x.val - c.val)) AS d
  FROM comps x JOIN c{r} c ON x.part = c.part AND x.pos = c.pos GROUP BY x.rid, x.part, c.entry
  QUALIFY row_number() OVER (PARTITION BY x.rid, x.part ORDER BY d, c.entry) = 1
), m{r} AS (
  SELECT a.part, a.entry, x.pos, sum(x.val) AS s, count(*) AS n
  FROM a{r} a JOIN comps x ON a.rid = x.rid AND a.part = x.part GROUP BY ALL
), c{r + 1} AS (
  SELECT c.part, c.entry, c.pos,
    coalesce(((m.s - (((m.s % m.n) + m.n) % m.n)) // m.n)::BIGINT, c.val) AS val
  FROM c{r} c LEFT JOIN m{r} m ON c.part = m.part AND c.entry = m.entry AND c.pos = m.pos
)""")
    body = ",\n".join(steps)
    return f"""
WITH kept0 AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), width AS (
  SELECT len(q) AS d FROM kept0 ORDER BY vec_id NULLS LAST, q LIMIT 1
), kept AS (
  SELECT row_number() OVER () AS rid, * FROM kept0 WHERE len(q) = (SELECT d FROM width)
), comps AS (
  SELECT rid, i // ((SELECT d FROM width) // 4) AS part, i % ((SELECT d FROM width) // 4) AS pos, q[i + 1] AS val
  FROM kept CROSS JOIN range(0, (SELECT d FROM width)) t(i)
), seeds AS (
  SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, q) - 1 AS entry FROM kept QUALIFY entry < 256
), c0 AS (
  SELECT x.part, s.entry, x.pos, x.val FROM comps x JOIN seeds s ON x.rid = s.rid
),
{body},
fin AS (
  SELECT x.rid, x.part, c.entry, sum((x.val - c.val) * (x.val - c.val)) AS d
  FROM comps x JOIN c{rounds} c ON x.part = c.part AND x.pos = c.pos GROUP BY x.rid, x.part, c.entry
  QUALIFY row_number() OVER (PARTITION BY x.rid, x.part ORDER BY d, c.entry) = 1
), coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM fin GROUP BY rid
), book AS (
  SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM c{rounds}
)
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, b.codebooks_sha256
FROM kept k JOIN coded c ON k.rid = c.rid CROSS JOIN book b
"""


OP11_SQL = _op11_sql()


def op13_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(packing.pieces(read(spark, sf, "documents"), tokenizer_path()))


QUERIES = {f.__name__: f for f in (op1_chat_formatting, op2_quality_classifier, op3_embedding_near_dedup, op4_nearest_neighbours, op5_jaccard_join, op6_bpe_encoding, op7_katz_scoring, op8_source_mixing, op9_html_extraction, op10_language_id, op11_vector_codes, op12_fill_in_middle, op13_best_fit_packing)}
SQL = {"op1_chat_formatting": OP1_SQL, "op8_source_mixing": OP8_SQL, "op11_vector_codes": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
