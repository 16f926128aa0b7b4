"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import exact_dedup, interaction, jaccard, language, line_dedup, mixing, neighbours, packing, pitman_yor, secrets, suffix_dedup, topk, whitening
from pairloom.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op1_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


@query
def op2_pitman_yor(spark, sf_dir):
    return pitman_yor.score(documents(spark, sf_dir))


@query
def op3_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ","
    )


@query
def op4_secret_scan(spark, sf_dir):
    found = secrets.scan(documents(spark, sf_dir))
    base = [rule.kind for rule in secrets.BASE_RULES]
    kept = F.filter("secrets", lambda s: s["kind"].isin(base))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(F.encode(_joined(kept), "utf-8"), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


@query
def op5_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir)).drop("spans")


@query
def op6_line_dedup(spark, sf_dir):
    done = line_dedup.line_dedup(documents(spark, sf_dir), lines=True)
    lengths = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return done.select(
        "doc_id", "n_chars",
        lengths.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"),
        F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"], s["keep_id"])), ",").alias("spans"),
    )


@query
def op7_collision_neighbours(spark, sf_dir):
    found = neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id")


ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5
         THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
         WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), link AS MATERIALIZED (
  SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * o >= 80 * (p.n + q.n - o)
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.other
)
SELECT documents.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""


@query
def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


ORACLES["op8_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body)
"""


@query
def op9_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out()))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "row.doc_id", language.held_out_of("row.doc_id").alias("held_out"), "lang_pred", "score", "rejected"
    )


@query
def op10_mixing(spark, sf_dir):
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "size", "source_size", F.round("target", 6).alias("target"),
        (F.col("size") * F.col("times")).alias("taken"),
    )


# the sources capped at three times their size are those with the smallest size per weight
ORACLES["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER before, 0) AS cut_before,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free_before,
         row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k
  FROM s WINDOW before AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT min_by((total - cut_before) / free_before, k) AS level FROM r
  WHERE 3 * source_size > w * (total - cut_before) / free_before
), t AS (
  SELECT source, source_size, least(3 * source_size, w * coalesce(level, 1e300)) AS target FROM r, l
), m AS (
  SELECT d.*, source_size, target,
         CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END AS whole,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
       (size * (whole + CASE WHEN size > 0 AND (before + size <= target - whole * source_size
         OR (before <= target - whole * source_size AND 2 * (target - whole * source_size - before) > size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM m
"""


@query
def op11_exact_topk(spark, sf_dir):
    found = topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id")


ORACLES["op11_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op12_whitening(spark, sf_dir):
    done = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=8)
    return done.withColumnRenamed("id", "vec_id")


@query
def op13_filter_interaction(spark, sf_dir):
    return interaction.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


# plays every order out on the counts of failure sets, without potentials
ORACLES["op13_filter_interaction"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         CASE WHEN len(words) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask
), x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (
  SELECT a.letter || b.letter || c.letter || e.letter || g.letter AS filter_order, [a.bit, b.bit, c.bit, e.bit, g.bit] AS bits
  FROM x a JOIN x b ON b.bit <> a.bit JOIN x c ON c.bit NOT IN (a.bit, b.bit)
  JOIN x e ON e.bit NOT IN (a.bit, b.bit, c.bit) JOIN x g ON g.bit NOT IN (a.bit, b.bit, c.bit, e.bit)
), s AS (
  SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::INT - bits[step] AS earlier
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)
), r AS (
  SELECT part, filter_order, step, bit,
         sum(CASE WHEN mask & (earlier + bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & earlier > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & earlier = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m, s GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""
