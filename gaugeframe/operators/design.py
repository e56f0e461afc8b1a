"""Design grid, cell identity and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.draws import digest

CELL_KEYS = ("model_id", "task_id", "prompt_variant_id", "temperature", "run_index")


def expand_design(
    models: DataFrame,
    temperatures: DataFrame,
    tasks: DataFrame,
    prompts: DataFrame | None = None,
    n_runs: int = 1,
    shuffle_seed: int | None = None,
) -> DataFrame:
    """The full factorial design: every model x temperature x prompt x task x run.

    The product is the operator's result, so its size is the design's. Each dimension table carries
    its own ``position``; ``cell_order`` sorts run, model, temperature, prompt, task, or is a seeded
    digest when a shuffle seed is given. Without prompts there is one, 'default' with '{input}'.
    """
    spark = tasks.sparkSession
    if prompts is None:
        prompts = spark.createDataFrame([("default", "{input}", 0)], "prompt_variant_id string, template string, position int")

    def placed(df: DataFrame, name: str) -> DataFrame:
        return df.withColumnRenamed("position", name)

    grid = (
        placed(tasks, "_k")
        .join(placed(models, "_m"))
        .join(placed(temperatures, "_t"))
        .join(placed(prompts, "_p"))
        .withColumn("run_index", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    )
    if shuffle_seed is None:
        order = F.format_string("%09d|%09d|%09d|%09d|%09d", "run_index", "_m", "_t", "_p", "_k")
    else:
        order = digest(F.lit(shuffle_seed), *[F.col(c) for c in CELL_KEYS])
    return grid.withColumn("cell_order", order).drop("_k", "_m", "_t", "_p")


def with_cell_id(df: DataFrame, random_seed: int = 42) -> DataFrame:
    """Add ``seed`` = random_seed + run_index and ``cell_id``, the sha256 of the cell's key."""
    seeded = df.withColumn("seed", F.col("run_index").cast("bigint") + F.lit(random_seed))
    key = F.concat_ws(
        "|", "model_id", "task_id", "prompt_variant_id", F.format_string("%.6f", F.col("temperature")),
        F.col("run_index").cast("string"), F.col("seed").cast("string"),
    )
    return seeded.withColumn("cell_id", F.sha2(key, 256))


PLACEHOLDER = r"^\{\w+\}$"
# a placeholder, a run of other text, or a lone brace
TEMPLATE_PARTS = r"(\{\w+\}|[^{]+|\{)"


def _bare(part: Column) -> Column:
    return F.regexp_replace(part, r"^\{|\}$", "")


def render_prompts(tasks: DataFrame, prompts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rendered, errors) for every task and prompt.

    ``{input}`` and ``{question}`` stand for the task input, a prompt's ``variables`` map overrides
    both. The template is cut once and filled part by part, so substituted text is never read as a
    template again. Prompts with an unknown name go to errors with the names.
    """
    parts = F.regexp_extract_all(F.col("template"), F.lit(TEMPLATE_PARTS), F.lit(1))
    names = F.transform(F.filter(parts, lambda p: p.rlike(PLACEHOLDER)), _bare)
    variables = F.col("variables") if "variables" in prompts.columns else F.create_map().cast("map<string,string>")
    variables = F.coalesce(variables, F.create_map().cast("map<string,string>"))
    known = F.array_union(F.array(F.lit("input"), F.lit("question")), F.map_keys(variables))
    unknown = F.array_except(names, known)
    cut = prompts.select(
        "prompt_variant_id", parts.alias("_parts"), variables.alias("_vars"), F.array_sort(unknown).alias("unknown")
    )
    errors = cut.filter(F.size("unknown") > 0).select("prompt_variant_id", "unknown")

    def fill(part: Column) -> Column:
        value = F.coalesce(F.element_at("_vars", _bare(part)), F.col("input"))
        return F.when(part.rlike(PLACEHOLDER), value).otherwise(part)

    good = cut.filter(F.size("unknown") == 0)
    rendered = tasks.join(good).select(
        "task_id", "prompt_variant_id", F.array_join(F.transform("_parts", fill), "").alias("rendered_prompt")
    )
    return rendered, errors


def with_prompt_hash(rendered: DataFrame) -> DataFrame:
    """Add the sha256 of the rendered prompt."""
    return rendered.withColumn("rendered_prompt_hash", F.sha2("rendered_prompt", 256))


def expected_cells(design: DataFrame, rendered: DataFrame, random_seed: int = 42) -> DataFrame:
    """Fully specified expected cells: the design with cell ids, seeds and prompt hashes."""
    hashes = with_prompt_hash(rendered).select("task_id", "prompt_variant_id", "rendered_prompt_hash")
    return with_cell_id(design, random_seed).join(hashes, ["task_id", "prompt_variant_id"])


def design_axes(df: DataFrame) -> DataFrame:
    """Levels per axis and their product (at least one prompt)."""
    axes = {"model_id": "models", "temperature": "temperatures", "prompt_variant_id": "prompts", "task_id": "tasks", "run_index": "runs"}
    counts = df.agg(*[F.countDistinct(c).alias(n) for c, n in axes.items()])
    counts = counts.withColumn("prompts", F.greatest("prompts", F.lit(1)))
    product = F.lit(1)
    for n in axes.values():
        product = product * F.col(n)
    return counts.withColumn("total_cells", product.cast("bigint"))


def design_fingerprint(df: DataFrame, experiment_id: str, config_hash: str) -> DataFrame:
    """One sha256 for a design, whatever its row order.

    Cell hashes are hashed per prefix (65,536 buckets), then the sorted bucket hashes once more, so
    no task holds more than its bucket.
    """
    buckets = (
        df.select(F.col("cell_id").alias("h"))
        .groupBy(F.substring("h", 1, 4).alias("b"))
        .agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), "|"), 256).alias("bh"), F.count(F.lit(1)).alias("c"))
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "bh"))), lambda s: s["bh"]), "|")
    return buckets.agg(
        F.sha2(F.concat_ws("|", F.lit(experiment_id), F.lit(config_hash), joined), 256).alias("fingerprint"),
        F.sum("c").alias("n_cells"),
    )


def design_diff(subset: DataFrame, full: DataFrame) -> DataFrame:
    """Task sets of two designs, one row per finding: (finding, task_id, n)."""
    # one shuffle by task id answers every comparison
    marked = subset.select("task_id", F.lit(1).alias("s"), F.lit(0).alias("f")).unionByName(
        full.select("task_id", F.lit(0).alias("s"), F.lit(1).alias("f"))
    )
    counts = marked.groupBy("task_id").agg(F.sum("s").alias("s"), F.sum("f").alias("f"))

    def finding(name: str, when: Column, n: Column) -> Column:
        return F.struct(F.lit(name).alias("finding"), F.when(when, n).alias("n"))

    listed = F.array(
        finding("missing_in_subset", F.col("s") == 0, F.col("f")),
        finding("extra_in_subset", F.col("f") == 0, F.col("s")),
        finding("duplicate_in_full", F.col("f") > 1, F.col("f")),
        finding("duplicate_in_subset", F.col("s") > 1, F.col("s")),
    )
    return counts.select("task_id", F.explode(listed).alias("x")).select("x.finding", "task_id", "x.n").filter("n IS NOT NULL")


def design_diff_counts(diff: DataFrame, subset: DataFrame, full: DataFrame, expected_cells: int) -> DataFrame:
    """Totals of the comparison and whether the subset is contained and has the expected cells."""
    d = diff.agg(
        F.count_if(F.col("finding") == "missing_in_subset").alias("missing_tasks"),
        F.count_if(F.col("finding") == "extra_in_subset").alias("extra_tasks"),
        F.count_if(F.col("finding") == "duplicate_in_full").alias("duplicated_tasks"),
    )
    sizes = full.agg(F.count(F.lit(1)).alias("full_cells")).join(F.broadcast(subset.agg(F.count(F.lit(1)).alias("subset_cells"))))
    return d.join(F.broadcast(sizes)).select(
        "*", (F.col("extra_tasks") == 0).alias("contained"), (F.col("full_cells") == expected_cells).alias("cells_as_expected")
    )
