"""Registered queries of the package and the SQL they are checked against, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeframe.llm import automata, context_trees, decontamination, fingerprints, jaccard, language, mixing, native, re_pair, sharding, spelling, suffix_groups, toxicity, turn_repair
from gaugeframe.llm.storage import parts_of, stored
from gaugeframe.llm.tables import table
from gaugeframe.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Rows kept out of training: crc32 of the doc_id's digits leaves `rest` on division by `parts`."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)) == rest


def with_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with `_quality`: 2 where labelled good, 0.5 where labelled bad, 1 without a label."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("_label"))
    weight = F.when(F.col("_label") > 0, 2.0).when(F.col("_label") <= 0, 0.5).otherwise(1.0)
    return documents.join(known, "doc_id", "left").withColumn("_quality", weight).drop("_label")


MIX_SQL = r"""
WITH sized AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '[^\x20\x09-\x0D]+')) AS size,
    CASE WHEN l.q > 0 THEN 2.0 WHEN l.q <= 0 THEN 0.5 ELSE 1.0 END AS w,
    (('0x' || substr(md5('4|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id)),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
weighted AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS sw FROM per),
levels AS (
  SELECT *, row_number() OVER o AS pos,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2.0::DOUBLE) OVER (ORDER BY source_size * 2.0::DOUBLE / sw, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(sw) OVER (ORDER BY source_size * 2.0::DOUBLE / sw, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / sw, rank)),
cut AS (SELECT pos AS cut_at, level AS cut_level FROM levels WHERE level * sw <= source_size * 2.0::DOUBLE ORDER BY pos LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN cut_at IS NULL OR pos < cut_at THEN source_size * 2.0::DOUBLE ELSE cut_level * sw END AS target
  FROM levels LEFT JOIN cut ON true),
summed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS epochs,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY -ln(s.u) / s.w, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + least(greatest(floor(target - epochs * source_size) - before, 0), size))::BIGINT AS taken
FROM summed"""


@query("op4_mixing", MIX_SQL)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # words are counted before the join, so no text is shuffled, and once for all that the mixture does with the sizes
    slim = table(spark, sf_dir, "documents").select("doc_id", "source", native.n_words(F.col("text")).alias("_size"))
    slim = stored(with_quality(slim, table(spark, sf_dir, "labels")), "sizes")
    return mixing.mix(slim, F.col("_size"), F.col("_quality"), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = native.utf8(F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return sharding.two_pass_shuffle(rows, ["doc_id", "text_crc32"], 24, F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edited(table(spark, sf_dir, "documents"), native.words, 4 * parts_of(spark))


@query("op1_jaccard_join")
def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"))


@query("op2_suffix_groups")
def op2_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_groups.remove_repeated_bytes(table(spark, sf_dir, "documents"))


@query("op3_suffix_automata")
def op3_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.remove_repeated_words(table(spark, sf_dir, "documents")).drop("n_spans")


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("node")


@query("op10_context_trees")
def op10_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_trees.score_texts(table(spark, sf_dir, "documents"), lambda doc_id: held_out(doc_id, 7, 2))


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(F.col("doc_id"), 4, 2), F.lit(False))
    model = language.fit(documents, ~out)
    return language.identify(documents.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    out = F.coalesce(held_out(F.col("doc_id"), 3, 1), F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    training = documents.filter(~out).select("doc_id", "text", F.xxhash64("text").alias("hash"))
    model = toxicity.fit(training.join(labels, "doc_id"), hashed="hash")
    return toxicity.score(documents.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.misspelt_words(table(spark, sf_dir, "documents"))
    return spelling.variants(spelling.common(words))


@query("op12_token_files")
def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-ids")
    re_pair.write_ids(table(spark, sf_dir, "documents"), path, re_pair.public_model(), end=2)
    return re_pair.document_digests(spark, path)


@query("op13_turn_repair")
def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turn_repair.damaged(table(spark, sf_dir, "conversations"))
    return turn_repair.repair(rows, F.col("dropped")).summary
