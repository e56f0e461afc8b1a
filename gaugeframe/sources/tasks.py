"""Task tables: reading, rules, benchmark shapes and selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.draws import digest
from gaugeframe.functions.text import strip

# Allowed names in a task record.
DOMAINS = ("code_generation", "bug_repair", "code_summarization", "executable_code_generation")
DIFFICULTIES = ("easy", "medium", "hard")
TASK_ID_PATTERN = "^[a-z][a-z0-9_-]*$"

TASK_SCHEMA = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("input", T.StringType()),
        T.StructField("expected_output", T.StringType()),
        T.StructField("tests", T.ArrayType(T.StringType())),
        T.StructField("language", T.StringType()),
        T.StructField("source_benchmark", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("difficulty", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("_corrupt", T.StringType()),
    ]
)


def not_blank(items: Column) -> Column:
    """Trimmed entries without the blank ones."""
    return F.filter(F.transform(items, strip), lambda x: x != "")


def rule_errors() -> Column:
    """Names of the rules a parsed record breaks."""
    blank = {c: strip(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("input", "language")}
    checks = [
        F.when(~F.coalesce(F.col("task_id").rlike(TASK_ID_PATTERN), F.lit(False)), "task_id"),
        F.when(~F.coalesce(F.col("domain").isin(*DOMAINS), F.lit(False)), "domain"),
        F.when(blank["input"], "input"),
        F.when(blank["language"], "language"),
        F.when(F.col("source_benchmark").isNull(), "source_benchmark"),
        F.when(F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(*DIFFICULTIES), "difficulty"),
    ]
    return F.array_compact(F.array(*checks))


def parse_task_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Raw JSON lines to records with an ``errors`` array; blank lines are skipped.

    Other columns of ``lines`` (a line number, a file name) are kept.
    """
    keep = [c for c in lines.columns if c != text]
    line = strip(F.col(text))
    parsed = F.from_json(
        line, TASK_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    )
    rows = lines.filter(line != "").select(*keep, line.alias("_line"), parsed.alias("_t")).select(*keep, "_line", "_t.*")
    looks_object = F.col("_line").startswith("{")
    errors = (
        F.when(~looks_object & F.try_parse_json("_line").isNotNull(), F.array(F.lit("not_object")))
        .when(F.col("_corrupt").isNotNull() | ~looks_object, F.array(F.lit("invalid_json")))
        .otherwise(rule_errors())
    )
    return rows.withColumn("errors", errors).withColumns(
        {
            "language": F.lower(strip(F.col("language"))),
            "tags": F.coalesce(not_blank(F.col("tags")), F.array().cast("array<string>")),
            "tests": F.when(F.size(not_blank(F.col("tests"))) > 0, not_blank(F.col("tests"))),
        }
    ).drop("_corrupt")


def read_tasks(
    spark: SparkSession, path: str, strict: bool = True, limit: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(good records, quarantined lines with their errors). Strict mode raises on the first bad line."""
    rows = parse_task_lines(spark.read.text(path))
    bad = rows.filter(F.size("errors") > 0).select("_line", "errors")
    if strict:
        first = bad.limit(1).take(1)
        if first:
            raise ValueError(f"invalid task line ({', '.join(first[0].errors)}): {first[0]._line[:200]}")
    good = rows.filter(F.size("errors") == 0).drop("errors", "_line")
    return (good if limit is None else good.orderBy("task_id").limit(limit)), bad


def task_quality(df: DataFrame, expected_domain: str | None = None) -> DataFrame:
    """(task_id, issue, n): ids held by several records and records of another domain."""
    counted = df.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(
        F.col("domain") != expected_domain if expected_domain else F.lit(False)
    ).alias("other"))
    issues = F.array(
        F.struct(F.lit("duplicate_task_id").alias("issue"), F.when(F.col("n") > 1, F.col("n")).alias("n")),
        F.struct(F.lit("domain_mismatch").alias("issue"), F.when(F.col("other") > 0, F.col("other")).alias("n")),
    )
    return counted.select("task_id", F.explode(issues).alias("i")).select("task_id", "i.*").filter("n IS NOT NULL")


def slug(original: Column, prefix: str = "he-") -> Column:
    """Lower-case id of letters, digits, '_' and '-' that starts with a letter."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(original), "[^a-z0-9_-]", "-"), "-+", "-")
    cleaned = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(cleaned.rlike("^[a-z]"), cleaned).otherwise(F.concat(F.lit(prefix), cleaned))


def normalize_humaneval(raw: DataFrame, version: str) -> DataFrame:
    """Raw rows (task_id, prompt, canonical_solution, test, entry_point) to task records."""
    return raw.select(
        slug(F.col("task_id")).alias("task_id"),
        F.lit("executable_code_generation").alias("domain"),
        F.col("prompt").alias("input"),
        F.coalesce(F.col("canonical_solution"), F.lit("")).alias("expected_output"),
        F.array("test").alias("tests"),
        F.lit("python").alias("language"),
        F.lit(f"humaneval-plus:{version}").alias("source_benchmark"),
        F.array(F.lit("humaneval-plus"), F.lit("python"), F.lit("function-completion")).alias("tags"),
        F.lit(None).cast("string").alias("difficulty"),
        F.create_map(
            F.lit("harness"), F.lit("humaneval"), F.lit("original_id"), F.col("task_id"),
            F.lit("entry_point"), F.col("entry_point"), F.lit("dataset_version"), F.lit(version),
            F.lit("test_block"), F.col("test"),
        ).alias("extra"),
    )


def _first_present(df: DataFrame, names: tuple[str, ...], default: Column) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found, default)


def normalize_mbpp(raw: DataFrame, version: str, split: str = "test") -> DataFrame:
    """The second raw shape; rows without an id, text or tests are dropped, other splits too."""
    empty = F.lit("")
    text = strip(_first_present(raw, ("text", "prompt"), empty))
    code = strip(_first_present(raw, ("code", "canonical_solution"), empty))
    no_tests = F.array().cast("array<string>")
    lists = [F.when(F.size(F.col(c)) > 0, F.col(c)) for c in ("test_list", "tests") if c in raw.columns]
    tests = not_blank(F.coalesce(*lists, no_tests))
    level = F.lower(_first_present(raw, ("difficulty",), F.lit(None).cast("string")))
    challenge = F.to_json(F.col("challenge_test_list")) if "challenge_test_list" in raw.columns else F.lit("[]")
    rows = raw.filter(F.col("task_id").isNotNull())
    if split != "all" and "partition" in raw.columns:
        rows = rows.filter(F.col("partition").isNull() | (F.col("partition") == split))
    return rows.filter((text != "") & (F.size(tests) > 0)).select(
        F.format_string("mbpp-%04d", F.col("task_id").cast("int")).alias("task_id"),
        F.lit("executable_code_generation").alias("domain"),
        text.alias("input"),
        code.alias("expected_output"),
        tests.alias("tests"),
        F.lit("python").alias("language"),
        F.lit(f"mbpp:{version}").alias("source_benchmark"),
        F.array(F.lit("mbpp"), F.lit("python"), F.lit("program-synthesis")).alias("tags"),
        F.when(level.isin(*DIFFICULTIES), level).alias("difficulty"),
        F.create_map(
            F.lit("harness"), F.lit("mbpp"), F.lit("original_id"), F.col("task_id").cast("string"),
            F.lit("dataset_version"), F.lit(version), F.lit("challenge_test_list"), challenge,
        ).alias("extra"),
    )


def select_tasks(
    tasks: DataFrame, task_id: str | None = None, limit: int | None = None, order: tuple[str, ...] = ("task_id",)
) -> DataFrame:
    """Keep one id, then the first ``limit`` in the declared order."""
    kept = tasks if task_id is None else tasks.filter(F.col("task_id") == task_id)
    return kept if limit is None else kept.orderBy(*order).limit(limit)


def task_ids(tasks: DataFrame) -> DataFrame:
    """Distinct ids in order."""
    return tasks.select("task_id").distinct().orderBy("task_id")


def sample_task_subset(tasks: DataFrame, size: int, seed: int) -> DataFrame:
    """``size`` distinct ids without replacement by md5 order (all when size reaches their number), sorted."""
    ids = tasks.select("task_id").distinct()
    return ids.orderBy(digest(F.lit(seed), F.col("task_id")), "task_id").limit(size).orderBy("task_id")
