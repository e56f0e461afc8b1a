"""Queries over sources, design, log and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeframe.functions import text as X
from gaugeframe.operators import design as B
from gaugeframe.operators import log as C
from gaugeframe.operators import scoring as D
from gaugeframe.plans.registry import query
from gaugeframe.plans.views import cells, checkpoints, doc_tasks, expected, log, props_k, table, texts, utc
from gaugeframe.session import scratch_path
from gaugeframe.sources import frame as A
from gaugeframe.sources import results as R
from gaugeframe.sources import tasks as K
from gaugeframe.streaming import log as ST

SP = X.SPACE


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SP}+|{SP}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '{SP}+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(string_split(lower({norm(x)}), ' '), lambda t: t <> '')"


def code(x: str) -> str:
    w = strip(x)
    return strip(
        f"""CASE WHEN regexp_matches({w}, '{X.FENCED_PYTHON}') THEN regexp_extract({w}, '{X.FENCED_PYTHON}', 1)
        WHEN regexp_matches({w}, '{X.FENCED_ANY}') THEN regexp_extract({w}, '{X.FENCED_ANY}', 1)
        WHEN strpos({w}, 'def ') > 0 THEN substr({w}, strpos({w}, 'def ')) ELSE {w} END"""
    )


def ncode(x: str) -> str:
    lines = f"list_transform(string_split_regex({code(x)}, '{X.LINE_BREAK}'), lambda s: regexp_replace(s, '{SP}+$', ''))"
    joined = f"array_to_string({lines}, chr(10))"
    return f"regexp_replace(regexp_replace({joined}, '^\\n+|\\n+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"


def micros(name: str, alias: str):
    return F.unix_micros(name).alias(alias)


# ---- sources ----


@query("a1_read_results", "SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, props FROM events", exact=True)
def a1(spark, sf):
    df = R.read_results(spark, f"{sf.rstrip('/')}/events.parquet")
    return df.withColumn("ts", utc(df, "ts")).select("event_id", micros("ts", "ts_us"), "user_id", "event_type", "value", "props")


@query(
    "a2_write_results",
    """WITH f AS (SELECT unnest(['parquet', 'json', 'csv']) AS fmt)
SELECT fmt, cell_id, status, seq, epoch_us(executed_at) AS ts_us, latency_ms, prediction FROM log, f
UNION ALL SELECT fmt, cell_id, NULL, seq, NULL, NULL, prediction FROM texts, f""",
    exact=True,
)
def a2(spark, sf):
    flat = log(spark, sf).select("cell_id", "status", "seq", "executed_at", "latency_ms", "prediction").unionByName(
        texts(spark, sf).select("cell_id", "seq", "prediction"), allowMissingColumns=True
    )
    out = None
    for fmt in ("parquet", "json", "csv"):
        path = R.write_results(flat, scratch_path(spark, "results"), fmt)
        back = R.read_results(spark, path, flat.schema, fmt).withColumn("fmt", F.lit(fmt))
        out = back if out is None else out.unionByName(back)
    return out.select("fmt", "cell_id", "status", "seq", micros("executed_at", "ts_us"), "latency_ms", "prediction")


_KINDS = """CASE doc_id % 8 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'task_id' WHEN 2 THEN 'input' WHEN 3 THEN 'not_object'
    WHEN 4 THEN 'domain;language' WHEN 5 THEN 'difficulty' ELSE '' END"""


@query(
    "a3_read_tasks",
    f"""WITH e AS (SELECT *, {_KINDS} AS errors FROM documents WHERE doc_id % 8 <> 6)
SELECT doc_id, errors, CASE WHEN errors = '' THEN 'd-' || doc_id END AS task_id, CASE WHEN errors = '' THEN text END AS input,
       CASE WHEN errors = '' THEN 'python' END AS language, CASE WHEN errors = '' THEN 'a' END AS tags,
       CASE WHEN errors = '' THEN TRUE END AS no_tests FROM e""",
)
def a3(spark, sf):
    d, text = F.col("doc_id"), F.col("text")
    kind = d % 8
    record = F.to_json(
        F.struct(
            F.when(kind == 1, F.concat(F.lit("D-"), d)).otherwise(F.concat(F.lit("d-"), d)).alias("task_id"),
            F.when(kind == 4, "unknown").otherwise("bug_repair").alias("domain"),
            F.when(kind == 2, "  ").otherwise(text).alias("input"),
            text.alias("expected_output"),
            F.array(F.lit(" ")).alias("tests"),
            F.when(kind == 4, " ").otherwise("Python ").alias("language"),
            F.col("source").alias("source_benchmark"),
            F.array(F.lit(" a "), F.lit(" ")).alias("tags"),
            F.when(kind == 5, "extreme").alias("difficulty"),
            F.create_map(F.lit("lang"), F.col("lang")).alias("extra"),
        )
    )
    line = (
        F.when(kind == 0, F.expr("left(j, length(j) - 1)")).when(kind == 3, "[1, 2]").when(kind == 6, "   ").otherwise(F.col("j"))
    )
    lines = table(spark, sf, "documents").withColumn("j", record).select("doc_id", line.alias("value"))
    rows = K.parse_task_lines(lines)
    ok = F.size("errors") == 0
    return rows.select(
        "doc_id", F.array_join("errors", ";").alias("errors"), F.when(ok, F.col("task_id")).alias("task_id"),
        F.when(ok, F.col("input")).alias("input"), F.when(ok, F.col("language")).alias("language"),
        F.when(ok, F.array_join("tags", ",")).alias("tags"), F.when(ok, F.col("tests").isNull()).alias("no_tests"),
    )


@query(
    "a4_task_quality",
    """SELECT task_id, 'duplicate_task_id' AS issue, count(*) AS n FROM doc_tasks GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT task_id, 'domain_mismatch', count(*) FROM doc_tasks WHERE domain <> 'code_generation' GROUP BY 1""",
)
def a4(spark, sf):
    return K.task_quality(doc_tasks(spark, sf), "code_generation")


_RAW_ID = "CASE doc_id % 3 WHEN 0 THEN upper(source) || '/' || doc_id WHEN 1 THEN doc_id || ' ' || lang ELSE '__X.' || lang || '//' || doc_id || '/' END"
_SLUG = "regexp_replace(regexp_replace(regexp_replace(lower(rid), '[^a-z0-9_-]', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "a5_normalize_humaneval",
    f"""WITH r AS (SELECT *, {_RAW_ID} AS rid FROM documents), s AS (SELECT *, {_SLUG} AS sl FROM r)
SELECT CASE WHEN regexp_matches(sl, '^[a-z]') THEN sl ELSE 'he-' || sl END AS task_id, text AS input, '' AS expected_output, 1::INTEGER AS n_tests,
'humaneval-plus:v1' AS source_benchmark, rid AS original_id, lang AS entry_point, source AS test_block FROM s""",
)
def a5(spark, sf):
    d = F.col("doc_id")
    rid = (
        F.when(d % 3 == 0, F.concat(F.upper("source"), F.lit("/"), d))
        .when(d % 3 == 1, F.concat(d, F.lit(" "), "lang"))
        .otherwise(F.concat(F.lit("__X."), "lang", F.lit("//"), d, F.lit("/")))
    )
    raw = table(spark, sf, "documents").select(
        rid.alias("task_id"), F.col("text").alias("prompt"), F.lit(None).cast("string").alias("canonical_solution"),
        F.col("source").alias("test"), F.col("lang").alias("entry_point"),
    )
    return K.normalize_humaneval(raw, "v1").select(
        "task_id", "input", "expected_output", F.size("tests").alias("n_tests"), "source_benchmark",
        F.col("extra.original_id").alias("original_id"), F.col("extra.entry_point").alias("entry_point"),
        F.col("extra.test_block").alias("test_block"),
    )


@query(
    "a6_normalize_mbpp",
    f"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text END AS t, source AS p, lang,
   CASE WHEN doc_id % 5 = 0 THEN [' '] ELSE [' assert a ', '', text] END AS tl,
   CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'test' WHEN 2 THEN 'train' ELSE 'test' END AS part,
   CASE doc_id % 3 WHEN 0 THEN 'Easy' WHEN 1 THEN 'EXTREME' END AS dif FROM documents),
s AS (SELECT *, {strip('coalesce(t, p)')} AS input, list_filter(list_transform(tl, lambda x: {strip('x')}), lambda x: x <> '') AS tests FROM r
      WHERE part IS NULL OR part = 'test')
SELECT 'mbpp-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INTEGER), '0') AS task_id, input, lang AS expected_output,
CAST(len(tests) AS INTEGER) AS n_tests, tests[1] AS first_test, CASE WHEN lower(dif) = 'easy' THEN 'easy' END AS difficulty
FROM s WHERE input <> '' AND len(tests) > 0""",
)
def a6(spark, sf):
    d, text = F.col("doc_id"), F.col("text")
    raw = table(spark, sf, "documents").select(
        d.alias("task_id"), F.when(d % 2 == 0, text).alias("text"), F.col("source").alias("prompt"), F.col("lang").alias("code"),
        F.when(d % 5 == 0, F.array(F.lit(" "))).otherwise(F.array(F.lit(" assert a "), F.lit(""), text)).alias("test_list"),
        F.when(d % 4 == 0, None).when(d % 4 == 2, "train").otherwise("test").alias("partition"),
        F.when(d % 3 == 0, "Easy").when(d % 3 == 1, "EXTREME").alias("difficulty"),
    )
    return K.normalize_mbpp(raw, "v1").select(
        "task_id", "input", "expected_output", F.size("tests").alias("n_tests"), F.col("tests")[0].alias("first_test"), "difficulty"
    )


@query(
    "a7_prepare_results",
    """SELECT model_id AS model, task_id, 'default' AS prompt_id, 0::INTEGER AS run_id, temperature, 'pass_at_1' AS metric_name, pass_at_1 AS metric_value, seq FROM log
UNION ALL SELECT 'm' || (l_suppkey % 6), CAST(l_partkey AS VARCHAR), l_returnflag, l_linenumber, 0.0::DOUBLE, 'score', l_quantity, l_orderkey FROM lineitem""",
    "metric_value temperature",
)
def a7(spark, sf):
    order = ["model", "task_id", "prompt_id", "run_id", "temperature", "metric_name", "metric_value", "seq"]
    mapped = A.prepare_results(log(spark, sf), "pass_at_1").select(*order)
    aliased = table(spark, sf, "lineitem").select(
        F.concat(F.lit("m"), F.col("l_suppkey") % 6).alias("model_id"), F.col("l_partkey").cast("string").alias("task"),
        F.col("l_returnflag").alias("prompt_variant_id"), F.col("l_linenumber").alias("run_index"),
        F.col("l_quantity").alias("score"), F.col("l_orderkey").alias("seq"),
    )
    return mapped.union(A.prepare_results(aliased).select(*order))


_DONE = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY executed_at DESC, seq DESC) AS rn
   FROM log WHERE status = 'completed') WHERE rn = 1)"""


@query(
    "a8_analysis_frame",
    f"WITH {_DONE} SELECT cell_id, model_id AS model, task_id, CAST(seq % 5 AS BIGINT) AS run_id, 'pass_at_1' AS metric_name, pass_at_1 AS metric_value FROM d",
    "metric_value",
)
def a8(spark, sf):
    raw = log(spark, sf).withColumns({"run_id": F.lit("experiment-1"), "run_index": F.col("seq") % 5})
    out = A.analysis_frame(None, raw, strict=False, metric="pass_at_1")
    return out.select("cell_id", "model", "task_id", "run_id", "metric_name", "metric_value")


@query(
    "a9_build_statistical_dataset",
    f"WITH {_DONE} SELECT cell_id, model_id AS model, task_id, 'token_count' AS metric_name, token_count AS metric_value FROM d",
    "metric_value",
)
def a9(spark, sf):
    out = A.build_statistical_dataset(log(spark, sf), "token_count", scratch_path(spark, "stats"))
    return out.select("cell_id", "model", "task_id", "metric_name", "metric_value")


@query(
    "a10_primary_score",
    """SELECT event_id, CASE event_type WHEN 'click' THEN value WHEN 'error' THEN value / 2 WHEN 'view' THEN 7 ELSE 0 END AS accuracy FROM events""",
    "accuracy",
)
def a10(spark, sf):
    e, v = F.col("event_type"), F.col("value")
    scores = (
        F.when(e == "click", F.create_map(F.lit("accuracy"), v, F.lit("exact_match"), F.lit(1.0)))
        .when(e == "error", F.create_map(F.lit("aaa"), F.lit(1.0), F.lit("exact_match"), v / 2))
        .when(e == "view", F.create_map(F.lit("zz"), F.lit(8.0), F.lit("bb"), F.lit(7.0)))
    )
    df = table(spark, sf, "events").withColumn("scores", scores)
    return df.select("event_id", A.primary_score("accuracy").alias("accuracy"))


@query("a11_select_tasks", "SELECT task_id, seq, input FROM doc_tasks WHERE task_id = 'd-8' ORDER BY seq LIMIT 1")
def a11(spark, sf):
    return K.select_tasks(doc_tasks(spark, sf), "d-8", 1, ("seq",)).select("task_id", "seq", "input")


@query("a11_task_ids", "SELECT DISTINCT task_id FROM doc_tasks")
def a11i(spark, sf):
    return K.task_ids(doc_tasks(spark, sf))


@query(
    "a12_sample_task_subset",
    "SELECT task_id FROM (SELECT DISTINCT task_id FROM doc_tasks) ORDER BY md5(concat_ws('|', 7, task_id)), task_id LIMIT 50",
)
def a12(spark, sf):
    return K.sample_task_subset(doc_tasks(spark, sf), 50, 7)


# ---- design ----


def _design(spark, sf, shuffle_seed=None):
    li = table(spark, sf, "lineitem")
    m, k = F.col("l_suppkey") % 6, F.col("l_partkey") % 164
    models = li.select(F.concat(F.lit("m"), m).alias("model_id"), m.alias("position")).distinct()
    tasks = li.select(F.concat(F.lit("t"), k).alias("task_id"), k.alias("position")).distinct()
    prompts = li.select(F.col("l_returnflag").alias("prompt_variant_id"), F.ascii("l_returnflag").alias("position")).distinct()
    warm = F.col("l_linestatus") == "O"
    temps = li.select(F.when(warm, 0.2).otherwise(0.0).alias("temperature"), warm.cast("int").alias("position")).distinct()
    return B.expand_design(models, temps, tasks, prompts, 2, shuffle_seed)


_DESIGN = """design AS (SELECT 'm' || m AS model_id, 't' || k AS task_id, p AS prompt_variant_id, t AS temperature, CAST(r AS INTEGER) AS run_index,
   printf('%09d|%09d|%09d|%09d|%09d', r, m, CASE WHEN t > 0 THEN 1 ELSE 0 END, ascii(p), k) AS cell_order
   FROM (SELECT DISTINCT l_suppkey % 6 AS m FROM lineitem), (SELECT DISTINCT l_partkey % 164 AS k FROM lineitem),
        (SELECT DISTINCT l_returnflag AS p FROM lineitem),
        (SELECT DISTINCT CASE WHEN l_linestatus = 'O' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS t FROM lineitem), range(2) q(r)),
ids AS (SELECT *, CAST(42 + run_index AS BIGINT) AS seed,
   sha256(concat_ws('|', model_id, task_id, prompt_variant_id, printf('%.6f', temperature), run_index, 42 + run_index)) AS cell_id FROM design)"""


@query("b1_expand_design", f"WITH {_DESIGN} SELECT * FROM design", "temperature")
def b1(spark, sf):
    return _design(spark, sf)


@query(
    "b1_expand_design_shuffled",
    f"WITH {_DESIGN} SELECT model_id, task_id, prompt_variant_id, temperature, run_index, "
    "md5(concat_ws('|', 9, model_id, task_id, prompt_variant_id, CAST(temperature AS VARCHAR), run_index)) AS cell_order FROM design",
    "temperature",
)
def b1s(spark, sf):
    return _design(spark, sf, 9)


@query("b2_cell_id", f"WITH {_DESIGN} SELECT model_id, task_id, prompt_variant_id, temperature, run_index, seed, cell_id FROM ids", "temperature")
def b2(spark, sf):
    return B.with_cell_id(_design(spark, sf)).drop("cell_order")


PROMPTS = [
    ("plain", "{input}", {}),
    ("asked", "Q: {question}\nUse {style}. {", {"style": "{input} words"}),
    ("fixed", "{input}|{question}", {"question": "why?"}),
    ("broken", "{input} {who} {what}", {"what": "x"}),
]


def _prompts(spark):
    return spark.createDataFrame(PROMPTS, "prompt_variant_id string, template string, variables map<string,string>")


def _rendered(spark, sf):
    tasks = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("task_id"), F.col("text").alias("input"))
    return B.render_prompts(tasks, _prompts(spark))


_RENDER = """rd AS (SELECT CAST(doc_id AS VARCHAR) AS task_id, p AS prompt_variant_id, CASE p WHEN 'plain' THEN text
   WHEN 'asked' THEN 'Q: ' || text || chr(10) || 'Use {input} words. {' ELSE text || '|why?' END AS rendered_prompt
   FROM documents, (SELECT unnest(['plain', 'asked', 'fixed']) AS p))"""


@query("b3_render_prompts", f"WITH {_RENDER} SELECT * FROM rd")
def b3(spark, sf):
    return _rendered(spark, sf)[0]


@query("b4_prompt_hash", f"WITH {_RENDER} SELECT task_id, prompt_variant_id, sha256(rendered_prompt) AS rendered_prompt_hash FROM rd")
def b4(spark, sf):
    return B.with_prompt_hash(_rendered(spark, sf)[0]).drop("rendered_prompt")


@query(
    "b5_design_axes",
    """SELECT *, models * temperatures * prompts * tasks * runs AS total_cells FROM (SELECT count(DISTINCT model) AS models, count(DISTINCT temperature) AS temperatures,
    greatest(count(DISTINCT prompt_id), 1) AS prompts, count(DISTINCT task_id) AS tasks, count(DISTINCT run_id) AS runs FROM cells)""",
)
def b5(spark, sf):
    names = {"model": "model_id", "prompt_id": "prompt_variant_id", "run_id": "run_index"}
    return B.design_axes(cells(spark, sf).withColumnsRenamed(names))


@query(
    "b6_design_fingerprint",
    f"""WITH {_DESIGN}, b AS (SELECT substr(cell_id, 1, 4) AS b, sha256(string_agg(cell_id, '|' ORDER BY cell_id)) AS bh, count(*) AS c FROM ids GROUP BY 1)
SELECT sha256('exp-1|cfg|' || string_agg(bh, '|' ORDER BY b)) AS fingerprint, CAST(sum(c) AS BIGINT) AS n_cells FROM b""",
)
def b6(spark, sf):
    return B.design_fingerprint(B.with_cell_id(_design(spark, sf)), "exp-1", "cfg")


_B7 = """s AS (SELECT 't' || (o_orderkey % 2500) AS task_id FROM orders), f AS (SELECT 't' || p_partkey AS task_id FROM part UNION ALL SELECT 't' || s_suppkey FROM supplier)"""


def _b7(spark, sf):
    sub = table(spark, sf, "orders").select(F.concat(F.lit("t"), F.col("o_orderkey") % 2500).alias("task_id"))
    full = table(spark, sf, "part").select(F.concat(F.lit("t"), "p_partkey").alias("task_id")).unionByName(
        table(spark, sf, "supplier").select(F.concat(F.lit("t"), "s_suppkey").alias("task_id"))
    )
    return sub, full


_B7_DIFF = """diff AS (SELECT 'missing_in_subset' AS finding, task_id, count(*) AS n FROM f WHERE task_id NOT IN (SELECT task_id FROM s) GROUP BY 2
UNION ALL SELECT 'extra_in_subset', task_id, count(*) FROM s WHERE task_id NOT IN (SELECT task_id FROM f) GROUP BY 2
UNION ALL SELECT 'duplicate_in_full', task_id, count(*) FROM f GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'duplicate_in_subset', task_id, count(*) FROM s GROUP BY 2 HAVING count(*) > 1)"""


@query("b7_design_diff", f"WITH {_B7}, {_B7_DIFF} SELECT * FROM diff")
def b7(spark, sf):
    return B.design_diff(*_b7(spark, sf))


@query(
    "b7_design_diff_counts",
    f"""WITH {_B7}, {_B7_DIFF} SELECT count_if(finding = 'missing_in_subset')::BIGINT AS missing_tasks, count_if(finding = 'extra_in_subset')::BIGINT AS extra_tasks,
count_if(finding = 'duplicate_in_full')::BIGINT AS duplicated_tasks, (SELECT count(*) FROM f) AS full_cells, (SELECT count(*) FROM s) AS subset_cells,
count_if(finding = 'extra_in_subset') = 0 AS contained, (SELECT count(*) FROM f) = 2100 AS cells_as_expected FROM diff""",
)
def b7c(spark, sf):
    sub, full = _b7(spark, sf)
    return B.design_diff_counts(B.design_diff(sub, full), sub, full, 2100)


# ---- log ----

_LOGCOLS = "cell_id, model_id, task_id, status, error, seq, epoch_us(executed_at) AS ts_us, pass_at_1, token_count"
_LOGD = "pass_at_1 token_count"


def _flat(df):
    s = F.col("scores")
    return df.select(
        "cell_id", "model_id", "task_id", "status", "error", "seq", micros("executed_at", "ts_us"),
        s["pass_at_1"].alias("pass_at_1"), s["token_count"].alias("token_count"),
    )


@query("c1_completed_latest", f"WITH {_DONE} SELECT {_LOGCOLS} FROM d", _LOGD)
def c1(spark, sf):
    return _flat(C.completed_latest(log(spark, sf)))


@query("c2_latest_by_cell", f"SELECT {_LOGCOLS} FROM latest", _LOGD)
def c2(spark, sf):
    return _flat(C.latest_by_cell(log(spark, sf)))


@query("c3_terminal_counts", "SELECT status, count(*) AS cells FROM latest GROUP BY 1")
def c3(spark, sf):
    return C.terminal_counts(log(spark, sf))


@query("c4_duplicate_cells", "SELECT cell_id, count(*) AS n_rows FROM log GROUP BY 1 HAVING count(*) > 1")
def c4(spark, sf):
    return C.duplicate_cells(log(spark, sf))


_MISSING = "SELECT * FROM expected WHERE cell_id NOT IN (SELECT cell_id FROM checkpoints WHERE status = 'completed')"


@query("c5_missing_cells", _MISSING, "temperature")
def c5(spark, sf):
    return C.missing_cells(expected(spark, sf), checkpoints(spark, sf))


@query(
    "c6_unexpected_cells",
    "SELECT DISTINCT cell_id FROM (SELECT cell_id FROM log UNION SELECT cell_id FROM checkpoints) WHERE cell_id NOT IN (SELECT cell_id FROM expected)",
)
def c6(spark, sf):
    return C.unexpected_cells(expected(spark, sf), log(spark, sf), checkpoints(spark, sf))


_OBS = """obs AS (SELECT coalesce(l.cell_id, c.cell_id) AS cell_id, coalesce(c.status = 'completed', FALSE) AS checkpoint_completed,
   coalesce(c.status = 'failed', FALSE) AS checkpoint_failed, l.cell_id IS NOT NULL AS result_all,
   coalesce(l.status = 'completed', FALSE) AS result_completed, coalesce(l.status = 'failed', FALSE) AS result_failed
   FROM latest l FULL JOIN checkpoints c ON c.cell_id = l.cell_id)"""


@query("c7_observed_cells", f"WITH {_OBS} SELECT * FROM obs")
def c7(spark, sf):
    return C.observed_cells(log(spark, sf), checkpoints(spark, sf))


@query(
    "c8_coverage_counts",
    f"""WITH {_OBS} SELECT (SELECT count(*) FROM expected) AS expected_cells, count(*) FILTER (WHERE checkpoint_completed) AS checkpoint_completed_cells,
count(*) FILTER (WHERE checkpoint_failed) AS checkpoint_failed_cells, count(*) FILTER (WHERE result_all) AS result_cells,
count(*) FILTER (WHERE result_completed) AS result_completed_cells, count(*) FILTER (WHERE result_failed) AS result_failed_cells,
(SELECT count(*) FROM (SELECT cell_id FROM log GROUP BY 1 HAVING count(*) > 1)) AS duplicate_cell_ids,
(SELECT count(*) FROM ({_MISSING})) AS missing_cell_ids,
count(*) FILTER (WHERE cell_id NOT IN (SELECT cell_id FROM expected)) AS unexpected_cell_ids FROM obs""",
)
def c8(spark, sf):
    return C.coverage_counts(expected(spark, sf), log(spark, sf), checkpoints(spark, sf))


CUT = "2024-01-15 00:00:00"
_C9 = f"""wl AS ({_MISSING}),
bf AS (SELECT cell_id, arg_max(status, row(executed_at, seq)) AS b FROM log WHERE executed_at < TIMESTAMP '{CUT}' GROUP BY 1),
af AS (SELECT cell_id, arg_max(status, row(executed_at, seq)) AS a FROM log WHERE executed_at >= TIMESTAMP '{CUT}' GROUP BY 1),
au AS (SELECT wl.cell_id, CASE WHEN b = 'completed' THEN 'skip_already_completed' WHEN a = 'completed' THEN 'recovered'
   WHEN a IS NOT NULL THEN 'retry_failed' ELSE 'not_retried' END AS action FROM wl LEFT JOIN bf USING (cell_id) LEFT JOIN af USING (cell_id))"""


def _audit(spark, sf):
    work = C.missing_cells(expected(spark, sf), checkpoints(spark, sf))
    whole, cut = log(spark, sf), F.lit(f"{CUT}Z").cast("timestamp")
    return C.recovery_audit(work, whole.filter(F.col("executed_at") < cut), whole.filter(F.col("executed_at") >= cut))


@query("c9_recovery_audit", f"WITH {_C9} SELECT * FROM au")
def c9(spark, sf):
    return _audit(spark, sf)


@query(
    "c9_recovery_summary",
    f"""WITH {_C9} SELECT count(*) FILTER (WHERE action = 'recovered') AS recovered_cells, count(*) FILTER (WHERE action = 'skip_already_completed') AS skipped_cells,
count(*) FILTER (WHERE action = 'retry_failed') AS still_failed_cells, count(*) FILTER (WHERE action IN ('retry_failed', 'not_retried')) AS remaining_missing_cells FROM au""",
)
def c9s(spark, sf):
    return C.recovery_summary(_audit(spark, sf))


NOW = "2024-02-15 00:00:00"
_C10 = f"""WITH l AS (SELECT count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed FROM latest),
x AS (SELECT (SELECT count(*) FROM expected) AS expected, completed, failed,
   epoch_us(TIMESTAMP '{NOW}') / 1e6 - (SELECT epoch_us(min(executed_at)) FROM log) / 1e6 AS el FROM l)
SELECT expected, completed, failed, greatest(expected - completed - failed, 0) AS pending, 100.0 * completed / expected AS percent_complete,
el AS elapsed_seconds, completed / (el / 3600) AS cells_per_hour,
CASE WHEN expected - completed - failed > 0 THEN (expected - completed - failed) / (completed / el) END AS eta_seconds FROM x"""


@query("c10_experiment_status", _C10, "percent_complete elapsed_seconds cells_per_hour eta_seconds")
def c10(spark, sf):
    return C.experiment_status(expected(spark, sf), log(spark, sf), f"{NOW}Z")


@query("c11_model_distribution", "SELECT model_id AS model, count(*) AS n_rows FROM log GROUP BY 1")
def c11(spark, sf):
    return C.model_distribution(log(spark, sf))


@query(
    "c12_metric_mean",
    "SELECT 'long' AS layout, avg(metric_value) AS mean FROM cells UNION ALL SELECT 'wide', avg(pass_at_1) FROM log UNION ALL SELECT 'bare', avg(l_quantity) FROM lineitem",
    "mean",
)
def c12(spark, sf):
    wide = log(spark, sf).select(F.col("scores")["pass_at_1"].alias("pass_at_1"))
    bare = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("metric_value"))
    parts = {"long": cells(spark, sf), "wide": wide, "bare": bare}
    out = None
    for name, df in parts.items():
        one = C.metric_mean(df).select(F.lit(name).alias("layout"), "mean")
        out = one if out is None else out.unionByName(one)
    return out


@query("c13_failures", "SELECT cell_id, model_id, task_id, error, seq FROM log WHERE status = 'failed'")
def c13(spark, sf):
    return C.failures(log(spark, sf)).select("cell_id", "model_id", "task_id", "error", "seq")


_C14_ZERO = "'orphan_log_cells', 'cells_without_log', 'orphan_checkpoints', 'completed_without_stats', 'stats_without_completed', 'completed_without_evals', 'latest_failed'"
_C14 = f"""WITH done AS (SELECT DISTINCT cell_id FROM log WHERE status = 'completed'), cc AS (SELECT cell_id FROM checkpoints WHERE status = 'completed'),
st AS (SELECT cell_id FROM log WHERE status = 'completed' AND latency_ms > 20), ev AS (SELECT cell_id FROM log WHERE status = 'completed' AND prediction = 'click'),
ch AS (SELECT 'expected_cells' AS "check", count(*) AS value FROM expected
UNION ALL SELECT 'log_rows', count(*) FROM log UNION ALL SELECT 'unique_cells', count(DISTINCT cell_id) FROM log
UNION ALL SELECT 'duplicate_cells', count(*) FROM (SELECT cell_id FROM log GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'completed_rows', count(*) FROM log WHERE status = 'completed' UNION ALL SELECT 'failed_rows', count(*) FROM log WHERE status = 'failed'
UNION ALL SELECT 'orphan_log_cells', count(DISTINCT cell_id) FROM log WHERE cell_id NOT IN (SELECT cell_id FROM expected)
UNION ALL SELECT 'cells_without_log', count(*) FROM expected WHERE cell_id NOT IN (SELECT cell_id FROM log)
UNION ALL SELECT 'orphan_checkpoints', count(*) FROM cc WHERE cell_id NOT IN (SELECT cell_id FROM done)
UNION ALL SELECT 'completed_without_stats', count(*) FROM done WHERE cell_id NOT IN (SELECT cell_id FROM st)
UNION ALL SELECT 'stats_without_completed', count(DISTINCT cell_id) FROM st WHERE cell_id NOT IN (SELECT cell_id FROM done)
UNION ALL SELECT 'completed_without_evals', count(*) FROM done WHERE cell_id NOT IN (SELECT cell_id FROM ev)
UNION ALL SELECT 'latest_completed', count(*) FROM latest WHERE status = 'completed' UNION ALL SELECT 'latest_failed', count(*) FROM latest WHERE status = 'failed')
SELECT "check", value, "check" NOT IN ({_C14_ZERO}) OR value = 0 AS ok FROM ch
UNION ALL SELECT 'verdict', CAST(sum(value) AS BIGINT), sum(value) = 0 FROM ch WHERE "check" IN ({_C14_ZERO})"""


@query("c14_integrity_audit", _C14)
def c14(spark, sf):
    rows = log(spark, sf)
    done = rows.filter("status = 'completed'")
    return C.integrity_audit(
        expected(spark, sf), rows, checkpoints(spark, sf), done.filter("latency_ms > 20"), done.filter("prediction = 'click'")
    )


@query(
    "c15_table_fingerprint",
    """WITH r AS (SELECT md5(concat_ws('', coalesce(length(cell_id) || ':' || cell_id, 'N'), coalesce(length(status) || ':' || status, 'N'),
        coalesce(length(error) || ':' || error, 'N'), coalesce(length(CAST(seq AS VARCHAR)) || ':' || seq, 'N'))) AS h FROM log)
    SELECT sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || '-' || sum(('0x' || substr(h, 16, 15))::BIGINT)::VARCHAR AS fingerprint, count(*) AS n_rows FROM r""",
)
def c15(spark, sf):
    return C.table_fingerprint(log(spark, sf).select("cell_id", "status", "error", "seq"))


@query(
    "c16_sanity_checks",
    """WITH d AS (SELECT * FROM log WHERE status = 'completed')
SELECT 'predictions_non_empty' AS "check", bool_and(trim(prediction) <> '') AS ok FROM d UNION ALL SELECT 'temperature_as_requested', bool_and(temperature IN (0.2)) FROM d
UNION ALL SELECT 'metric_present', bool_and(pass_at_1 IS NOT NULL) FROM d UNION ALL SELECT 'outcome_varies', min(pass_at_1) < max(pass_at_1) FROM d""",
)
def c16(spark, sf):
    return C.sanity_checks(log(spark, sf), "pass_at_1", (0.2,))


@query(
    "c17_timing_breakdown",
    """WITH x AS (SELECT count(*) AS n_rows, sum(latency_ms) AS model_ms, sum(token_count) AS sandbox_ms, (epoch_us(max(executed_at)) - epoch_us(min(executed_at))) / 1e3 AS wall FROM log)
SELECT n_rows, model_ms, sandbox_ms, greatest(wall - model_ms - sandbox_ms, 0) AS io_ms, greatest(wall, model_ms + sandbox_ms) / n_rows * 39360 / 3.6e6 AS projected_hours FROM x""",
    "model_ms sandbox_ms io_ms projected_hours",
)
def c17(spark, sf):
    return C.timing_breakdown(log(spark, sf), 39360, "token_count")


@query(
    "c18_inspect",
    """WITH ev AS (SELECT cell_id, seq, model_id || seq AS expected_output, 'm_' || event AS metric_name, token_count AS metric_value
   FROM (SELECT *, prediction AS event FROM log) WHERE status = 'failed'),
one AS (SELECT cell_id, arg_min(expected_output, seq) AS eo FROM ev GROUP BY 1),
mx AS (SELECT cell_id, metric_name, max(metric_value) AS v FROM ev GROUP BY 1, 2)
SELECT l.cell_id, l.task_id, l.prompt_variant_id AS prompt_id, l.model_id AS model, l.prediction, l.seq, coalesce(eo, '') AS expected_output,
CASE WHEN eo IS NOT NULL THEN 'm_error' ELSE 'pass_at_1,token_count' END AS metric_names,
CASE WHEN eo IS NOT NULL THEN mx.v ELSE l.token_count END AS last_value
FROM log l LEFT JOIN one USING (cell_id) LEFT JOIN mx USING (cell_id) WHERE l.status = 'completed'""",
    "last_value",
)
def c18(spark, sf):
    rows = log(spark, sf)
    failed = rows.filter("status = 'failed'").select(
        "cell_id", "seq", F.concat("model_id", "seq").alias("expected_output"), F.concat(F.lit("m_"), "prediction").alias("metric_name"),
        F.col("scores")["token_count"].alias("v"),
    )
    # one value per cell and metric, as an evaluation table has
    best = failed.groupBy("cell_id", "metric_name").agg(
        F.max("v").alias("metric_value"), F.min_by("expected_output", "seq").alias("expected_output"), F.min("seq").alias("seq")
    )
    out = C.inspect(rows, best)
    names = F.array_sort(F.map_keys("metrics"))
    return out.select(
        "cell_id", "task_id", "prompt_id", "model", "prediction", "seq", "expected_output",
        F.array_join(names, ",").alias("metric_names"), F.element_at("metrics", F.element_at(names, -1)).alias("last_value"),
    )


_COST = """pr AS (SELECT 'm' || (s_suppkey % 6) AS model_id, CASE WHEN s_suppkey % 6 = 5 THEN NULL ELSE avg(s_acctbal) END AS ip,
   CASE WHEN s_suppkey % 6 >= 4 THEN NULL ELSE max(s_acctbal) END AS op FROM supplier GROUP BY s_suppkey % 6),
us AS (SELECT event_id, 'm' || (user_id % 6) AS model_id, CASE WHEN event_type IN ('click', 'error') THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS pt,
   CASE WHEN event_type = 'error' THEN NULL ELSE CAST(floor(value) AS INTEGER) END AS ct FROM events),
co AS (SELECT us.*, CASE WHEN (pt IS NOT NULL OR ct IS NOT NULL) AND (ip IS NOT NULL OR op IS NOT NULL)
   THEN (coalesce(pt, 0) * coalesce(ip, 0) + coalesce(ct, 0) * coalesce(op, 0)) / 1e6 END AS cost FROM us LEFT JOIN pr USING (model_id))"""


def _costed(spark, sf):
    s = F.col("s_suppkey") % 6
    pricing = (
        table(spark, sf, "supplier").groupBy(s.alias("s"))
        .agg(F.avg("s_acctbal").alias("a"), F.max("s_acctbal").alias("b"))
        .select(
            F.concat(F.lit("m"), "s").alias("model_id"), F.when(F.col("s") != 5, F.col("a")).alias("input_per_million"),
            F.when(F.col("s") < 4, F.col("b")).alias("output_per_million"),
        )
    )
    e = F.col("event_type")
    usage = table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("m"), F.col("user_id") % 6).alias("model_id"),
        F.when(~e.isin("click", "error"), props_k()).alias("prompt_tokens"),
        F.when(e != "error", F.floor("value").cast("int")).alias("completion_tokens"),
    )
    return C.usage_cost(usage, pricing)


@query("c19_usage_cost", f"WITH {_COST} SELECT event_id, model_id, cost AS estimated_cost FROM co", "estimated_cost")
def c19(spark, sf):
    return _costed(spark, sf).select("event_id", "model_id", "estimated_cost")


@query(
    "c19_usage_by_model",
    f"""WITH {_COST} SELECT model_id, count(*) AS n_calls, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS completion_tokens, sum(cost) AS estimated_cost FROM co GROUP BY 1""",
    "estimated_cost",
)
def c19m(spark, sf):
    return C.usage_by_model(_costed(spark, sf))


# ---- scoring ----


@query(
    "d1_normalize_text",
    f"SELECT cell_id, {norm('prediction')} AS normalized, CAST(len({tokens('prediction')}) AS INTEGER) AS n_tokens, array_to_string({tokens('prediction')}, '|') AS tokens FROM texts",
)
def d1(spark, sf):
    p = F.col("prediction")
    return texts(spark, sf).select(
        "cell_id", X.normalize_text(p).alias("normalized"), F.size(X.tokenize(p)).alias("n_tokens"), F.array_join(X.tokenize(p), "|").alias("tokens")
    )


@query("d2_extract_code", f"SELECT cell_id, {code('prediction')} AS code FROM texts")
def d2(spark, sf):
    return texts(spark, sf).select("cell_id", X.extract_code(F.col("prediction")).alias("code"))


@query("d3_normalize_code", f"SELECT cell_id, {ncode('prediction')} AS code FROM texts UNION ALL SELECT CAST(doc_id AS VARCHAR), {ncode('text')} FROM documents")
def d3(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("cell_id"), X.normalize_code(F.col("text")).alias("code"))
    return texts(spark, sf).select("cell_id", X.normalize_code(F.col("prediction")).alias("code")).unionByName(docs)


# a third of the references is the prediction itself with other spacing, so matches occur
_PAIRS = """pairs AS (SELECT cell_id, seq, task_id, model_id, prediction, CASE seq % 3 WHEN 0 THEN replace(prediction, ' ', '   ') || chr(10)
   WHEN 1 THEN substr(prediction, 4) ELSE expected_output END AS ref FROM texts)"""


def _pairs(spark, sf):
    t = F.col("seq") % 3
    ref = (
        F.when(t == 0, F.concat(F.replace("prediction", F.lit(" "), F.lit("   ")), F.lit("\n")))
        .when(t == 1, F.expr("substr(prediction, 4)"))
        .otherwise(F.col("expected_output"))
    )
    return texts(spark, sf).withColumn("ref", ref)


def _score(name, fn, sql):
    @query(name, f"WITH {_PAIRS} SELECT cell_id, CAST({sql} AS DOUBLE) AS score FROM pairs", "score")
    def run(spark, sf):
        return _pairs(spark, sf).select("cell_id", fn(F.col("prediction"), F.col("ref")).alias("score"))

    return run


_EXACT = f"CASE WHEN {norm('prediction')} = {norm('ref')} THEN 1 ELSE 0 END"
_CONTAINS = f"CASE WHEN {norm('ref')} <> '' AND contains({norm('prediction')}, {norm('ref')}) THEN 1 ELSE 0 END"
_NCODE = f"CASE WHEN {ncode('ref')} <> '' AND {ncode('prediction')} = {ncode('ref')} THEN 1 ELSE 0 END"
_TP, _TR = f"list_distinct({tokens('prediction')})", f"list_distinct({tokens('ref')})"
_F1 = f"CASE WHEN len(list_intersect({_TP}, {_TR})) > 0 THEN 2.0 * len(list_intersect({_TP}, {_TR})) / (len({_TP}) + len({_TR})) ELSE 0 END"

_score("d4_exact_match", X.exact_match, _EXACT)
_score("d5_contains_expected", X.contains_expected, _CONTAINS)
_score("d6_normalized_code_match", X.normalized_code_match, _NCODE)
_score("d11_token_f1", X.token_f1, _F1)


@query("d7_syntax_check", None)
def d7(spark, sf):
    return D.parse_rate(texts(spark, sf))


_TESTS = "[substr(prediction, 3, 20), 'no such text', expected_output]"


@query(
    "d8_test_pass_rate",
    f"""WITH b AS (SELECT cell_id, {norm("prediction || chr(10) || expected_output")} AS whole, {_TESTS} AS tests FROM texts)
SELECT cell_id, CAST(len(list_filter(tests, lambda t: contains(whole, {norm('t')}))) AS DOUBLE) / 3 AS score FROM b""",
    "score",
)
def d8(spark, sf):
    tests = F.array(F.substring("prediction", 3, 20), F.lit("no such text"), F.col("expected_output"))
    return texts(spark, sf).select("cell_id", X.test_pass_rate(F.col("prediction"), F.col("expected_output"), tests).alias("score"))


@query("d9_length", f"SELECT cell_id, CAST(len({tokens('prediction')}) AS INTEGER) AS word_count, CAST(length(prediction) AS INTEGER) AS char_count FROM texts")
def d9(spark, sf):
    p = F.col("prediction")
    return texts(spark, sf).select("cell_id", X.word_count(p).alias("word_count"), F.char_length(p).alias("char_count"))


@query(
    "d10_lexical_overlap",
    f"""WITH {_PAIRS}, x AS (SELECT cell_id, len({_TP}) AS p, len({_TR}) AS r, len(list_intersect({_TP}, {_TR})) AS c FROM pairs)
SELECT cell_id, CASE WHEN p > 0 AND r > 0 THEN c / p ELSE 0 END AS prec, CASE WHEN p > 0 AND r > 0 THEN c / r ELSE 0 END AS recall,
CASE WHEN c > 0 THEN 2.0 * c / (p + r) ELSE 0 END AS f1, c > 0 AND 2.0 * c / (p + r) >= 0.5 AS success FROM x""",
    "prec recall f1",
)
def d10(spark, sf):
    precision, recall, f1 = X.overlap(F.col("prediction"), F.col("ref"))
    return _pairs(spark, sf).select(
        "cell_id", precision.alias("prec"), recall.alias("recall"), f1.alias("f1"), (f1 >= 0.5).alias("success")
    )


@query(
    "d12_bug_removed",
    f"""WITH {_PAIRS} SELECT cell_id, CAST(CASE WHEN {norm('prediction')} = {norm('ref')} THEN 0 WHEN expected_output <> '' AND {norm('prediction')} = {norm('expected_output')} THEN 1
    WHEN {norm('prediction')} <> '' THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM pairs JOIN (SELECT cell_id, expected_output FROM texts) USING (cell_id)""",
    "score",
)
def d12(spark, sf):
    return _pairs(spark, sf).select("cell_id", X.bug_removed(F.col("prediction"), F.col("ref"), F.col("expected_output")).alias("score"))


@query("d13_token_count", f"SELECT cell_id, CAST(len({tokens(code('prediction'))}) AS INTEGER) AS n_tokens FROM texts")
def d13(spark, sf):
    return texts(spark, sf).select("cell_id", X.token_count(F.col("prediction")).alias("n_tokens"))


_EVAL_DOMAIN = "CASE CAST(task_id AS BIGINT) % 3 WHEN 0 THEN 'code_generation' WHEN 1 THEN 'code_summarization' ELSE 'executable_code_generation' END"
_EVAL = f"""tk AS (SELECT task_id, arg_min(expected_output, seq) AS ref, any_value({_EVAL_DOMAIN}) AS domain FROM texts GROUP BY 1),
ev AS (SELECT t.cell_id, t.model_id, t.task_id, tk.domain, t.prediction, tk.ref FROM texts t JOIN tk USING (task_id)),
m AS (SELECT cell_id, model_id, task_id, domain, 'exact_match' AS metric_name, CAST({_EXACT} AS DOUBLE) AS v FROM ev
UNION ALL SELECT cell_id, model_id, task_id, domain, 'contains_expected', {_CONTAINS} FROM ev
UNION ALL SELECT cell_id, model_id, task_id, domain, 'normalized_code_match', {_NCODE} FROM ev
UNION ALL SELECT cell_id, model_id, task_id, domain, 'length', len({tokens('prediction')}) FROM ev
UNION ALL SELECT cell_id, model_id, task_id, domain, 'lexical_overlap', {_F1} FROM ev
UNION ALL SELECT cell_id, model_id, task_id, domain, 'token_count', len({tokens(code('prediction'))}) FROM ev),
used AS (SELECT *, CASE metric_name WHEN 'length' THEN v > 0 WHEN 'lexical_overlap' THEN v >= 0.5 WHEN 'token_count' THEN TRUE ELSE v = 1 END AS metric_success FROM m
   WHERE CASE domain WHEN 'code_generation' THEN metric_name IN ('exact_match', 'normalized_code_match', 'contains_expected')
   WHEN 'code_summarization' THEN metric_name IN ('length', 'lexical_overlap') ELSE metric_name IN ('normalized_code_match', 'token_count') END)"""


def _evaluated(spark, sf):
    t = texts(spark, sf)
    d = F.col("task_id").cast("bigint") % 3
    domain = F.when(d == 0, "code_generation").when(d == 1, "code_summarization").otherwise("executable_code_generation")
    tasks = t.select("task_id", "seq", "expected_output", domain.alias("domain"))
    rows = t.drop("expected_output").withColumn("status", F.lit("completed"))
    return D.evaluate_results(rows, tasks)


@query(
    "d14_evaluate_results",
    f"WITH {_EVAL} SELECT cell_id, model_id, task_id, domain, metric_name, v AS metric_value, metric_success FROM used",
    "metric_value",
)
def d14(spark, sf):
    # syntax_check needs Python's parser, which SQL has not; it is checked in d7 and in the tests
    return _evaluated(spark, sf).filter("metric_name <> 'syntax_check'")


@query("d14_evaluate_results_all", None)
def d14a(spark, sf):
    return _evaluated(spark, sf)


@query(
    "d15_corpus_metric",
    f"""WITH {_PAIRS}, r AS (SELECT CAST({_EXACT} AS DOUBLE) AS e, CAST({_CONTAINS} AS DOUBLE) AS c, CAST(len({tokens('prediction')}) AS DOUBLE) AS l, CAST({_F1} AS DOUBLE) AS f FROM pairs)
SELECT 'accuracy' AS metric, avg(e) AS value, avg(e) = 1 AS success, count(*) AS n FROM r UNION ALL SELECT 'contains_expected', avg(c), avg(c) = 1, count(*) FROM r
UNION ALL SELECT 'length', avg(l), bool_and(l > 0), count(*) FROM r UNION ALL SELECT 'lexical_overlap', avg(f), avg(f) >= 0.5, count(*) FROM r""",
    "value",
)
def d15(spark, sf):
    df = _pairs(spark, sf).select("prediction", F.col("ref").alias("expected_output"))
    out = None
    for name in ("accuracy", "contains_expected", "length", "lexical_overlap"):
        one = D.corpus_metric(name, df)
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "d16_average_scores",
    """SELECT cell_id, avg(pass_at_1) AS pass_at_1, avg(token_count) AS token_count, arg_min(prediction, seq) AS prediction, sum(latency_ms) AS latency_ms,
    count(*) AS num_examples FROM log GROUP BY 1""",
    "pass_at_1 token_count latency_ms",
)
def d16(spark, sf):
    out = D.average_scores(log(spark, sf))
    s = F.col("scores")
    return out.select(
        "cell_id", s["pass_at_1"].alias("pass_at_1"), s["token_count"].alias("token_count"), "prediction", "latency_ms", "num_examples"
    )


@query(
    "d17_metric_means",
    """SELECT 'pass_at_1' AS metric, avg(pass_at_1) AS mean FROM log WHERE status = 'completed' UNION ALL SELECT 'token_count', avg(token_count) FROM log WHERE status = 'completed'""",
    "mean",
)
def d17(spark, sf):
    return D.metric_means(log(spark, sf))


_SAME_CODE = f"""same AS (SELECT prediction, '```py' || chr(10) || {code('prediction')} || chr(10) || '```' AS ref FROM texts)"""


@query(
    "d17_hidden_match_flag",
    f"WITH {_SAME_CODE}, r AS (SELECT avg({_EXACT}) AS e, avg({_NCODE}) AS n FROM same) SELECT e = 0 AND n > 0 AS only_normalized_matches FROM r",
)
def d17f(spark, sf):
    # the reference holds the same code in another fence
    p = F.col("prediction")
    r = F.concat(F.lit("```py\n"), X.extract_code(p), F.lit("\n```"))
    rows = texts(spark, sf).select(
        F.lit("completed").alias("status"),
        F.create_map(F.lit("exact_match"), X.exact_match(p, r), F.lit("normalized_code_match"), X.normalized_code_match(p, r)).alias("scores"),
    )
    return D.hidden_match_flag(D.metric_means(rows))


_D18 = f"""dg AS (SELECT model_id, count(*) AS n, avg({_EXACT}) AS mean_score, avg(CASE WHEN {norm('prediction')} = '' THEN 1 ELSE 0 END) AS empty_rate,
   avg(CASE WHEN contains(prediction, '```') THEN 1 ELSE 0 END) AS fence_rate FROM pairs GROUP BY 1)"""


def _diag(spark, sf):
    df = _pairs(spark, sf)
    return D.extraction_diagnostics(df.withColumn("score", X.exact_match(F.col("prediction"), F.col("ref"))))


@query("d18_extraction_diagnostics", f"WITH {_PAIRS}, {_D18} SELECT * FROM dg", "mean_score empty_rate fence_rate")
def d18(spark, sf):
    return _diag(spark, sf)


@query(
    "d19_compliant_panel",
    f"WITH {_PAIRS}, {_D18} SELECT cell_id, model_id FROM pairs WHERE model_id IN (SELECT model_id FROM dg WHERE fence_rate >= 0.5)",
)
def d19(spark, sf):
    return D.compliant_panel(texts(spark, sf), _diag(spark, sf), "fence_rate", 0.5).select("cell_id", "model_id")


# ---- streaming ----


def _arrive(spark, sf, newest_first: bool, start):
    """Hand the log to a stream in four steps by event time: a step's files are written, then one trigger takes them all.

    ``start`` begins a query over the log stream that it is given, which goes on from its checkpoint. Returns that stream.
    """
    rows = log(spark, sf).drop("scores")
    span = rows.agg(F.unix_micros(F.min("executed_at")).alias("lo"), F.unix_micros(F.max("executed_at")).alias("hi")).first()
    path = scratch_path(spark, "log-stream")
    steps = range(4)
    at = F.floor((F.unix_micros("executed_at") - span.lo) / (span.hi - span.lo + 1) * 4)
    for i in reversed(steps) if newest_first else steps:
        rows.filter(at == i).write.mode("append").parquet(path)
        stream = ST.read_log_stream(spark, path, rows.schema)
        _finish(start(stream))
    return stream


def _finish(query):
    query.awaitTermination()
    if query.exception():
        raise RuntimeError(str(query.exception()))


@query("s1_stream_latest", "SELECT cell_id, status, seq, epoch_us(executed_at) AS ts_us FROM latest")
def s1(spark, sf):
    out, state = scratch_path(spark, "latest"), scratch_path(spark, "state")
    stream = _arrive(spark, sf, True, lambda rows: ST.start_latest(rows, out, state, buckets=16).trigger(availableNow=True).start())
    return ST.read_latest(spark, out, ST.stream_latest(stream).schema).select("cell_id", "status", "seq", micros("executed_at", "ts_us"))


@query(
    "s2_stream_throughput",
    """WITH placed AS (SELECT cell_id, status, date_trunc('day', executed_at) AS day,
      lead(executed_at) OVER (PARTITION BY cell_id ORDER BY executed_at, seq) AS next_at,
      row_number() OVER (PARTITION BY cell_id, date_trunc('day', executed_at) ORDER BY executed_at DESC, seq DESC) AS age FROM log)
    SELECT epoch_us(day) AS window_us, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed
    FROM placed WHERE age = 1 AND (next_at IS NULL OR next_at >= day + INTERVAL 25 HOUR)
      AND day + INTERVAL 1 DAY <= (SELECT max(day) - INTERVAL 1 HOUR FROM placed) GROUP BY 1""",
)
def s2(spark, sf):
    out, state = scratch_path(spark, "throughput"), scratch_path(spark, "state")

    def start(rows):
        writer = ST.stream_throughput(rows).writeStream.outputMode("append").format("parquet").option("path", out)
        return writer.option("checkpointLocation", state).trigger(availableNow=True).start()

    _arrive(spark, sf, False, start)
    return spark.read.parquet(out).select(micros("window_start", "window_us"), "completed", "failed")


@query("s3_stream_status", _C10, "percent_complete elapsed_seconds cells_per_hour eta_seconds")
def s3(spark, sf):
    out, state = scratch_path(spark, "status"), scratch_path(spark, "state")
    _arrive(spark, sf, True, lambda rows: ST.start_status(rows, expected(spark, sf), f"{NOW}Z", out, state).trigger(availableNow=True).start())
    return ST.read_status(spark, out)
