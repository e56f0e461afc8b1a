"""Text and code comparison as column expressions."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Unicode white space, as code point ranges and as a pattern (Java's own class is ASCII only).
SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
SPACES = "".join(chr(c) for a, b in SPACE_RANGES for c in range(a, b + 1))
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
FENCED_PYTHON = rf"(?is)```python{SPACE}*\n(.*?)```"
FENCED_ANY = r"(?s)```[^\n]*\n(.*?)```"
DEF = "def "


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def normalize_text(text: Column) -> Column:
    """Collapse white space to single spaces and trim."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def split_normal(normal: Column) -> Column:
    """Lower-case tokens of normalised text."""
    return F.filter(F.split(F.lower(normal), " "), lambda t: t != "")


def tokenize(text: Column) -> Column:
    """Lower-case tokens; no token for blank text."""
    return split_normal(normalize_text(text))


def extract_code(text: Column) -> Column:
    """First python fence, else first fence, else from the first 'def ', else the text; trimmed."""

    def cut(whole: Column) -> Column:
        fenced = F.contains(whole, F.lit("```"))
        at = F.locate(DEF, whole)
        return strip(
            F.when(fenced & whole.rlike(FENCED_PYTHON), F.regexp_extract(whole, FENCED_PYTHON, 1))
            .when(fenced & whole.rlike(FENCED_ANY), F.regexp_extract(whole, FENCED_ANY, 1))
            .when(at > 0, F.substring(whole, at, F.length(whole)))
            .otherwise(whole)
        )

    return once(strip(text), cut)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def normalize_code(text: Column) -> Column:
    """Extracted code with right-trimmed lines, no blank head or tail and single blank lines."""
    return tidy_code(extract_code(text))


def tidy_code(code: Column) -> Column:
    lines = F.split(code, LINE_BREAK)
    joined = F.array_join(F.transform(lines, lambda x: F.rtrim(x, F.lit(SPACES))), "\n")
    return F.regexp_replace(F.regexp_replace(joined, "^\n+|\n+$", ""), "\n{3,}", "\n\n")


def score(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def exact_match(prediction: Column, reference: Column) -> Column:
    return score(normalize_text(prediction) == normalize_text(reference))


def contains_expected(prediction: Column, reference: Column) -> Column:
    wanted = normalize_text(reference)
    return score((wanted != "") & F.contains(normalize_text(prediction), wanted))


def normalized_code_match(prediction: Column, reference: Column) -> Column:
    return code_equal(extract_code(prediction), extract_code(reference))


def code_equal(code: Column, wanted: Column) -> Column:
    """1 when both pieces of extracted code are the same after tidying and there is any."""
    reference = tidy_code(wanted)
    return score((reference != "") & (tidy_code(code) == reference))


def test_pass_rate(prediction: Column, reference: Column, tests: Column) -> Column:
    """Share of tests whose text occurs in prediction + reference (nothing is executed)."""
    both = normalize_text(F.concat_ws("\n", prediction, F.coalesce(reference, F.lit(""))))
    hit = F.filter(tests, lambda t: F.contains(both, normalize_text(t)))
    return F.when(F.size(tests) > 0, F.size(hit) / F.size(tests)).otherwise(0.0)


def word_count(prediction: Column) -> Column:
    return F.size(tokenize(prediction))


def overlap(prediction: Column, reference: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1) over token sets; 0 where a side is empty or missing."""
    return token_overlap(tokenize(prediction), tokenize(reference))


def token_overlap(prediction: Column, reference: Column) -> tuple[Column, Column, Column]:
    def sizes(p: Column, r: Column) -> Column:
        return F.struct(F.size(p).alias("p"), F.size(r).alias("r"), F.size(F.array_intersect(p, r)).alias("c"))

    def scores(n: Column) -> Column:
        usable = (n["p"] > 0) & (n["r"] > 0)
        return F.struct(
            F.when(usable, n["c"] / n["p"]).otherwise(0.0).alias("precision"),
            F.when(usable, n["c"] / n["r"]).otherwise(0.0).alias("recall"),
            F.when(usable & (n["c"] > 0), 2.0 * n["c"] / (n["p"] + n["r"])).otherwise(0.0).alias("f1"),
        )

    # a missing side has no tokens
    empty = F.array().cast("array<string>")
    p, r = (F.array_distinct(F.coalesce(t, empty)) for t in (prediction, reference))
    both = once(F.struct(p.alias("p"), r.alias("r")), lambda t: once(sizes(t["p"], t["r"]), scores))
    return both["precision"], both["recall"], both["f1"]


def lexical_overlap(prediction: Column, reference: Column) -> Column:
    return overlap(prediction, reference)[2]


# The same set F1 goes by these names in the repair and summary scores ('rouge_l' is not ROUGE-L).
token_f1 = repair_f1 = rouge_l = lexical_overlap


def bug_removed(prediction: Column, buggy: Column, fixed: Column) -> Column:
    """0 when unchanged, 1 when equal to the fix, 0.5 for any other non-blank prediction."""
    p = normalize_text(prediction)
    return (
        F.when(p == normalize_text(buggy), 0.0)
        .when((fixed != "") & (p == normalize_text(fixed)), 1.0)
        .when(p != "", 0.5)
        .otherwise(0.0)
    )


def token_count(prediction: Column) -> Column:
    """White-space tokens of the extracted code, or of the text when nothing is extracted."""
    code = extract_code(prediction)
    return F.size(tokenize(F.when(code != "", code).otherwise(prediction)))


def parses(code: Column) -> Column:
    # nested, so it travels to the workers by value
    @F.pandas_udf(DoubleType())
    def parse(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> float:
            if not text or not text.strip():
                return 0.0
            try:
                ast.parse(text)
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                return 0.0
            return 1.0

        return texts.map(one).astype("float64")

    return parse(code)


def syntax_check(prediction: Column) -> Column:
    """1 when the extracted code parses as Python."""
    return parses(extract_code(prediction))
