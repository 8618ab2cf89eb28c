"""From question and SQL to a verdict: schema checks, scores and the decision order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriscope import constants as K
from veriscope.functions import intents as I
from veriscope.functions import text as X
from veriscope.operators.lookup import measured

_TABLE_REFERENCE = r"(?i)" + X.UNICODE + r"\b(?:FROM|JOIN)\s+([\w\.]+)(?:\s+\w+)?"
_COLUMN_REFERENCE = r"(?i)" + X.UNICODE + r"(\w+)\.(\w+)"


def schema_errors(
    queries: DataFrame, catalog: DataFrame, sql: str = "generated_sql", key: str = "query_id"
) -> DataFrame:
    """(key, error): tables and columns a statement names that the catalog lacks.

    Tables may be named with or without their schema. `a.b` is checked as a
    column only when `a` itself is a known table name. The catalog is flat:
    (schema_name, table_name, column_name).
    """
    tables = catalog.select("schema_name", "table_name").distinct()
    qualified = F.concat_ws(".", "schema_name", "table_name")
    known = measured(
        tables.select(qualified.alias("name")).union(tables.select("table_name")).distinct()
    )
    named = queries.select(
        key, F.explode(F.regexp_extract_all(sql, F.lit(_TABLE_REFERENCE), F.lit(1))).alias("name")
    )
    missing_tables = named.join(known, ["name"], "left_anti").select(
        key,
        F.concat(F.lit("Table '"), "name", F.lit("' does not exist in discovered schema")).alias("error"),
    )
    pairs = F.arrays_zip(
        F.regexp_extract_all(sql, F.lit(_COLUMN_REFERENCE), F.lit(1)).alias("t"),
        F.regexp_extract_all(sql, F.lit(_COLUMN_REFERENCE), F.lit(2)).alias("c"),
    )
    used = queries.select(key, F.explode(pairs).alias("p")).select(
        key, F.col("p.t").alias("table_name"), F.col("p.c").alias("column_name")
    )
    used = used.withColumn("name", F.concat_ws(".", "table_name", "column_name")).join(
        known, ["name"], "left_anti"
    )
    of_known = used.join(
        known.select(F.col("name").alias("table_name")), ["table_name"], "left_semi"
    )
    columns = measured(catalog.select("table_name", "column_name").distinct())
    missing_columns = of_known.join(columns, ["table_name", "column_name"], "left_anti").select(
        key,
        F.concat(
            F.lit("Column '"), "column_name", F.lit("' does not exist in table '"),
            "table_name", F.lit("'"),
        ).alias("error"),
    )
    return missing_tables.unionByName(missing_columns)


def structural(
    queries: DataFrame,
    catalog: DataFrame,
    sql: str = "generated_sql",
    engine_error: str = "engine_error_type",
    engine_failed: str = "engine_failed",
    key: str = "query_id",
) -> DataFrame:
    """Add structural_score, schema_error_count and requires_classification.

    What the engine reported comes in as columns: a failed statement scores 0,
    one with unknown names 0.5, a clean one 1.
    """
    counted = schema_errors(queries, catalog, sql, key).groupBy(key).agg(
        F.count("*").alias("schema_error_count")
    )
    joined = queries.join(counted, [key], "left").na.fill(0, ["schema_error_count"])
    return joined.withColumns(
        {
            "structural_score": F.when(F.col(engine_failed), 0.0)
            .when(F.col("schema_error_count") > 0, 0.5)
            .otherwise(1.0),
            "requires_classification": F.col(engine_failed)
            & F.coalesce(F.col(engine_error).isin(*K.CLASSIFIABLE_ERRORS), F.lit(False)),
        }
    )


def queries_a_table(sql: Column) -> Column:
    return F.contains(F.upper(sql), F.lit("FROM"))


def text_scores(
    queries: DataFrame,
    measures: Sequence[str],
    dimensions: Sequence[str],
    question: str = "query_text",
    sql: str = "generated_sql",
) -> DataFrame:
    """Add intent_score and pattern_score, with the intents they rest on."""
    # one projection per step, so each text is folded to one case and read once
    folded = queries.withColumns({"__q": F.lower(question), "__u": F.upper(sql)})
    read = folded.withColumns(
        {
            "requested_intents": I.requested(F.col("__q"), measures, dimensions),
            "performed_intents": I.performed(F.col("__u")),
        }
    )
    return read.withColumns(
        {
            "intent_score": I.intent_score(
                F.col("requested_intents"), F.col("performed_intents"), F.col("__u")
            ),
            "pattern_score": I.pattern_score(F.col("__u")),
        }
    ).drop("__q", "__u")


def column_roles(catalog: DataFrame) -> DataFrame:
    """Dimension or measure per catalog column, by its data type."""
    # fixed values: types of each role
    dimension = ("character varying", "varchar", "text", "character", "string")
    measure = ("integer", "numeric", "decimal", "real", "double precision", "bigint", "smallint",
               "int", "double", "float")
    kind = F.lower("data_type")
    return catalog.withColumn(
        "column_role",
        F.when(kind.isin(*dimension), "dimension").when(kind.isin(*measure), "measure"),
    )


def heuristic_score(structural_score: Column, intent_score: Column, pattern_score: Column) -> Column:
    return structural_score * 0.45 + intent_score * 0.30 + pattern_score * 0.25


def drift_veto(drift_quality: Column, structural_score: Column, intent_score: Column) -> Column:
    return (drift_quality < 0.1) & (structural_score < 0.5) & (intent_score < 0.3)


def verdict(score: Column) -> Column:
    return F.when(score >= K.PASS_THRESHOLD, "PASS").otherwise("FAIL")


def ground_truth_score(
    structural_score: Column, semantic: Column, judged: Column, result: Column
) -> Column:
    """Weighted score; a result score that is missing or exactly 0 does not take part."""
    without = 0.60 * structural_score + 0.10 * semantic + 0.30 * judged
    with_result = 0.40 * structural_score + 0.15 * semantic + 0.15 * judged + 0.30 * result
    return F.when(result.isNull() | (result == 0), without).otherwise(with_result)


def ground_truth_confidence(judge_confidence: Column, score: Column) -> Column:
    return (judge_confidence + score) / 2.0


def wrong_ground_truth(result: Column, judged: Column) -> Column:
    """The matched reference looks wrong, so the statement is judged on its own."""
    found = F.coalesce(result, F.lit(0.0))
    return ((found < 0.25) & (judged == 1.0)) | ((judged == 0.0) & (found < 0.3))


def result_path(has_expected: Column, semantic: Column) -> Column:
    """How the output is checked: expected_output, judge_only or compare_results."""
    return (
        F.when(has_expected & (semantic >= K.GT_USE_OUTPUT), "expected_output")
        .when(has_expected, "judge_only")
        .otherwise("compare_results")
    )


def evaluation_path(
    sql: Column,
    question: Column,
    cleaned: Column,
    structural_score: Column,
    requires_classification: Column,
    has_ground_truth: Column,
) -> Column:
    """Order in which an evaluation is decided."""
    return (
        F.when(X.is_non_data_reply(sql), "non_data_reply")
        .when(~X.is_business_question(question), "non_business")
        .when((structural_score > 0.0) & ~queries_a_table(cleaned), "no_from")
        .when(requires_classification, "classified_error")
        .when(structural_score == 0.0, "structural_fail")
        .when(has_ground_truth, "ground_truth")
        .otherwise("heuristic")
    )


def evaluate(scored: DataFrame) -> DataFrame:
    """Final score, result and confidence of each query.

    Expects generated_sql, query_text, cleaned_sql, structural_score,
    requires_classification, has_ground_truth, intent_score, pattern_score,
    drift_quality, semantic_score, judge_score, judge_confidence, result_score.
    """
    c = F.col
    path = evaluation_path(
        c("generated_sql"), c("query_text"), c("cleaned_sql"), c("structural_score"),
        c("requires_classification"), c("has_ground_truth"),
    )
    plain = heuristic_score(c("structural_score"), c("intent_score"), c("pattern_score"))
    vetoed = drift_veto(c("drift_quality"), c("structural_score"), c("intent_score"))
    by_reference = ground_truth_score(
        c("structural_score"), c("semantic_score"), c("judge_score"), c("result_score")
    )
    staged = scored.withColumns(
        {
            "eval_path": F.when(
                (path == "ground_truth") & wrong_ground_truth(c("result_score"), c("judge_score")),
                "heuristic_fallback",
            ).otherwise(path),
            "__own": F.when(vetoed, 0.0).otherwise(plain),
            "__reference": by_reference,
        }
    )
    on_its_own = c("eval_path").isin("heuristic", "heuristic_fallback")
    by_gt = c("eval_path") == "ground_truth"
    final = F.when(on_its_own, c("__own")).when(by_gt, c("__reference")).otherwise(0.0)
    confidence = (
        F.when(on_its_own, c("__own"))
        .when(by_gt, ground_truth_confidence(c("judge_confidence"), c("__reference")))
        .when(c("eval_path").isin("non_business", "no_from"), 1.0)
        .otherwise(0.0)
    )
    return staged.withColumns(
        {
            "final_score": final,
            "confidence": confidence,
            "result": F.when(on_its_own | by_gt, verdict(final)).otherwise("FAIL"),
        }
    ).drop("__own", "__reference")


def evaluation_data(df: DataFrame, steps: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Add evaluation_data: the steps and scores of an evaluation as JSON."""
    return df.withColumn(
        "evaluation_data",
        F.to_json(
            F.struct(
                *steps,
                F.struct(*scores).alias("scores"),
            )
        ),
    )


def unevaluated(queries: DataFrame, evaluations: DataFrame, key: str = "query_id") -> DataFrame:
    usable = queries.filter((F.col("status") == "success") & F.col("generated_sql").isNotNull())
    return usable.join(evaluations.select(key), [key], "left_anti")


def lacking_result_check(evaluations: DataFrame, n: int = 10) -> DataFrame:
    """Newest evaluations with a reference but without a result check."""
    no_check = F.get_json_object("evaluation_data", "$.steps.result_validation").isNull()
    return (
        evaluations.filter(F.col("ground_truth_sql").isNotNull() & no_check)
        .orderBy(F.col("created_at").desc(), "query_id")
        .limit(n)
    )


def parse_judgement(response: Column) -> Column:
    """Struct (verdict, confidence, reasoning) from `NAME: value` lines; the last line of a name wins."""
    lines = F.transform(F.split(X.strip(response), "\n", -1), X.strip)

    def last(name: str) -> Column:
        tagged = F.filter(lines, lambda l: l.startswith(f"{name}:"))
        value = X.strip(F.replace(F.try_element_at(tagged, F.lit(-1)), F.lit(f"{name}:"), F.lit("")))
        return value

    said = F.upper(last("VERDICT"))
    number = last("CONFIDENCE").try_cast("double")
    reason = X.non_empty(last("REASONING"))
    return F.struct(
        F.when(said.isin("PASS", "FAIL"), said).otherwise("FAIL").alias("verdict"),
        F.coalesce(number, F.lit(0.5)).alias("confidence"),
        F.coalesce(reason, response).alias("reasoning"),
    )


_QUERY_LIST = "array<struct<natural_language:string, sql:string, complexity:string>>"


def parse_query_list(responses: DataFrame, response: str, key: str) -> DataFrame:
    """(key, position, natural_language, sql, complexity) of the JSON lists in stored responses.

    Unreadable lists give no rows; entries without question or SQL are left out.
    """
    body = F.regexp_extract(response, r"(?s)(\[.*\])", 1)
    listed = responses.select(key, F.posexplode(F.from_json(body, _QUERY_LIST)).alias("position", "q"))
    return listed.select(key, "position", "q.*").filter(
        (F.col("natural_language") != "") & (F.col("sql") != "")
    )
