"""Serving-endpoint migration and table-migration checks as DataFrame jobs.

The control-plane calls of the reference (list / delete / create endpoints,
rename a table) are not made here; their observable facts arrive as columns
(``exists_in_workspace``, ``table_exists``, ``create_status``) and every
decision the reference takes on them is an expression. Every endpoint is
processed independently, so the whole list is one set-based job.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.timefn import as_of_lit

# --- fixed values (must equal the reference) -------------------------------
BLANK_TEXTS = ("", "None", "null")
MSG_NOT_PROCESSED = "Not processed"
MSG_GATEWAY_SKIP = "Skipped: AI Gateway already configured"
MSG_NOT_FOUND = "Endpoint not found"
MSG_DELETED = "Endpoint deleted successfully"
MSG_NO_TABLE_CFG = "No inference table configuration found"
MSG_INVALID_CFG = "Invalid auto_capture_config format"
MSG_INCOMPLETE_CFG = "Incomplete inference table configuration"
MSG_TABLE_MISSING = "Table does not exist"
MSG_RENAMED = "Table renamed successfully"
MSG_NO_NAME = "Endpoint name not found"
MSG_NO_ENTITIES = "No served entities found"
MSG_NO_CAPTURE = "Missing auto_capture_config"
MSG_CREATED = "Endpoint created successfully"
STATUS_SUCCESS, STATUS_FAILED = "SUCCESS", "FAILED"
PAYLOAD_SUFFIX, LEGACY_SUFFIX = "_payload", "_legacy"
REPORT_TIMEZONE = "Australia/Sydney"
REPORT_DATE_FORMAT = "dd-MM-yyyy HH:mm"
PROVIDER_WARNING = "Table is not a Delta table. Migration may have limitations."
NO_COLUMNS = "Table has no columns"
PREVIEW_COLUMNS = 5
NAMES_NOT_JSON = "Invalid JSON format"
NAMES_NOT_LIST = "Input must be a JSON list"
NAMES_EMPTY = "Endpoint list is empty"
REQUIRED_CONFIG_FIELDS = ("legacy_online_table", "online_store_name", "target_table")
TABLE_NAME_FIELDS = ("legacy_online_table", "target_table")
VALID_CAPACITIES = ("CU_1", "CU_2", "CU_4", "CU_8")
DEFAULT_CAPACITY = "CU_2"
# ---------------------------------------------------------------------------

SERVED_ENTITY_T = T.StructType([
    T.StructField("entity_name", T.StringType()),
    T.StructField("entity_version", T.StringType()),
    T.StructField("environment_vars", T.MapType(T.StringType(), T.StringType())),
    T.StructField("min_provisioned_throughput", T.LongType()),
    T.StructField("max_provisioned_throughput", T.LongType()),
    T.StructField("scale_to_zero_enabled", T.BooleanType()),
    T.StructField("workload_size", T.StringType()),
    T.StructField("workload_type", T.StringType()),
])
TAG_T = T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))


# ------------------------------------------------------------ scalar rules
def is_blank(c: Column) -> Column:
    """FLT10: null, or trimmed text in {"", "None", "null"} (case-sensitive)."""
    return c.isNull() | F.trim(c.cast("string")).isin(*BLANK_TEXTS)


def is_blank_json(c: Column) -> Column:
    """FLT10 for a column of JSON text: blank, or a falsy JSON value ({}, [], false, 0, "")."""
    bare = F.regexp_replace(c.cast("string"), r"\s+", "")
    return is_blank(c) | bare.isin("{}", "[]", "false", "0", "0.0", "-0", '""')


def capture_map(c: Column) -> Column:
    """auto_capture_config JSON text -> map (null when not a JSON object)."""
    return F.from_json(c, T.MapType(T.StringType(), T.StringType()))


def inference_table_name(acc: Column, parsed: Column | None = None) -> Column:
    """PRJ10: struct(old_table, new_table, message). ``parsed``: the map of ``acc`` if already parsed."""
    m = capture_map(acc) if parsed is None else parsed
    parts = [F.element_at(m, k) for k in ("catalog_name", "schema_name", "table_name_prefix")]
    complete = F.lit(True)
    for p in parts:
        complete = complete & p.isNotNull() & (p != F.lit(""))
    old = F.concat(F.concat_ws(".", *parts), F.lit(PAYLOAD_SUFFIX))
    def res(old_t, new_t, msg):
        return F.struct(old_t.cast("string").alias("old_table"), new_t.cast("string").alias("new_table"),
                        msg.cast("string").alias("message"))
    none = F.lit(None)
    return (F.when(is_blank_json(acc), res(none, none, F.lit(MSG_NO_TABLE_CFG)))
            .when(m.isNull(), res(none, none, F.lit(MSG_INVALID_CFG)))
            .when(~complete, res(none, none, F.lit(MSG_INCOMPLETE_CFG)))
            .otherwise(res(old, F.concat(old, F.lit(LEGACY_SUFFIX)), none)))


def quoted_table_name(name: Column) -> Column:
    """SNK6 / trap T9: quote each dotted part separately: `a`.`b`.`c`."""
    parts = F.split(name, "\\.")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.lit("`"), F.replace(p, F.lit("`"), F.lit("``")), F.lit("`"))), ".")


def served_entities(c: Column) -> Column:
    return F.from_json(c, T.ArrayType(SERVED_ENTITY_T))


def key_value_list(m: Column) -> Column:
    """SC18: map -> [{key, value}] without null values."""
    return F.transform(F.map_entries(F.map_filter(m, lambda k, v: v.isNotNull())),
                       lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def payload_reject_reason(cfg: DataFrame, ents: Column | None = None, acc: Column | None = None) -> Column:
    """PRJ9: first failing precondition of the create request (null when ok)."""
    ents = served_entities(F.col("served_entities")) if ents is None else ents
    acc = capture_map(F.col("auto_capture_config")) if acc is None else acc
    return (F.when(F.col("name").isNull() | (F.col("name") == ""), F.lit(MSG_NO_NAME))
            .when(ents.isNull() | (F.size(ents) <= 0), F.lit(MSG_NO_ENTITIES))
            .when(acc.isNull() | (F.size(acc) == 0), F.lit(MSG_NO_CAPTURE)))


def endpoint_payloads(cfg: DataFrame, keep=("seq",)) -> DataFrame:
    """PRJ8 + PRJ9 per endpoint row: reject reason, and the JSON create request when
    not rejected. The JSON columns are parsed once, in their own projection."""
    p = cfg.select(*keep, "name", "description", "route_optimized",
                   F.from_json(F.col("tags"), TAG_T).alias("_tags"),
                   capture_map(F.col("auto_capture_config")).alias("_acc"),
                   served_entities(F.col("served_entities")).alias("_ents"))
    reason = payload_reject_reason(p, F.col("_ents"), F.col("_acc"))
    body = endpoint_payload(p, F.col("_ents"), F.col("_acc"), F.col("_tags"))
    return p.select(*keep, reason.alias("reject_reason"), F.when(reason.isNull(), body).alias("payload"))


def endpoint_payload(cfg: DataFrame, ents: Column | None = None, acc: Column | None = None,
                     tags: Column | None = None) -> Column:
    """PRJ8: JSON create request. Null fields of the core request are kept;
    description / route_optimized / tags appear only when set."""
    ent = F.get(served_entities(F.col("served_entities")) if ents is None else ents, 0)
    acc = capture_map(F.col("auto_capture_config")) if acc is None else acc
    enabled = F.when(F.map_contains_key(acc, "enabled"), F.element_at(acc, "enabled").cast("boolean")) \
        .otherwise(F.lit(True))
    core = F.struct(
        F.col("name").alias("name"),
        F.struct(F.array(F.struct(
            ent["entity_name"].alias("entity_name"), ent["entity_version"].alias("entity_version"),
            key_value_list(F.coalesce(ent["environment_vars"], F.create_map().cast("map<string,string>"))).alias("environment_vars"),
            ent["min_provisioned_throughput"].alias("min_provisioned_throughput"),
            ent["max_provisioned_throughput"].alias("max_provisioned_throughput"),
            ent["scale_to_zero_enabled"].alias("scale_to_zero_enabled"),
            ent["workload_size"].alias("workload_size"), ent["workload_type"].alias("workload_type"),
        )).alias("served_entities")).alias("config"),
        F.struct(F.struct(
            F.element_at(acc, "catalog_name").alias("catalog_name"),
            F.element_at(acc, "schema_name").alias("schema_name"),
            F.element_at(acc, "table_name_prefix").alias("table_name_prefix"),
            enabled.alias("enabled"),
        ).alias("inference_table_config")).alias("ai_gateway"))
    tags = F.from_json(F.col("tags"), TAG_T) if tags is None else tags
    optional = F.struct(
        F.when(F.trim(F.col("description")) != "", F.col("description")).alias("description"),
        F.col("route_optimized").alias("route_optimized"),
        F.when(F.size(tags) > 0, tags).alias("tags"))
    core_json = F.to_json(core, {"ignoreNullFields": "false"})
    opt_json = F.to_json(optional)  # nulls dropped: absent optional fields

    def inner(j):  # object body without the braces
        return F.substring(j, F.lit(2), F.length(j) - 2)
    return F.concat(F.lit("{"), F.concat_ws(",", inner(core_json),
                                            F.when(opt_json != "{}", inner(opt_json))), F.lit("}"))


# ------------------------------------------------------------ endpoint migration
def endpoint_lookup(requested: DataFrame, endpoints: DataFrame) -> DataFrame:
    """FLT9 + SRT9: requested names with the first matching config row (by ``seq``), null when absent."""
    first = endpoints.withColumn("_rn", F.row_number().over(Window.partitionBy("name").orderBy("seq"))) \
        .where(F.col("_rn") == 1).drop("_rn")
    return requested.join(first, requested["endpoint_name"] == first["name"], "left") \
        .withColumn("config_found", F.col("name").isNotNull())


def migration_steps(looked_up: DataFrame) -> DataFrame:
    """Step log: one row per (endpoint, step) that ran, with (success, message, table_name).

    Order and stops as in the reference: no config -> no steps; delete refused
    (gateway set) or failed -> stop; rename failure does not stop creation.
    The JSON columns are parsed once per row in their own projection.
    """
    p = looked_up.where("config_found").select(
        "request_seq", "endpoint_name", "name", "ai_gateway", "auto_capture_config", "exists_in_workspace",
        "table_exists", "create_status", "create_error",
        capture_map(F.col("auto_capture_config")).alias("_acc"),
        served_entities(F.col("served_entities")).alias("_ents"))
    gw_set = ~is_blank_json(F.col("ai_gateway"))
    tbl = inference_table_name(F.col("auto_capture_config"), F.col("_acc"))
    reject = payload_reject_reason(p, F.col("_ents"), F.col("_acc"))
    r = p.select(
        "request_seq", "endpoint_name",
        (~gw_set & F.col("exists_in_workspace")).alias("del_ok"),
        F.when(gw_set, F.lit(MSG_GATEWAY_SKIP)).when(~F.col("exists_in_workspace"), F.lit(MSG_NOT_FOUND))
        .otherwise(F.lit(MSG_DELETED)).alias("del_msg"),
        tbl.alias("_tbl"), "table_exists", reject.alias("_reject"), "create_status", "create_error")
    ren_ok = F.col("_tbl.message").isNull() & F.col("table_exists")
    ren_msg = F.coalesce(F.col("_tbl.message"),
                         F.when(~F.col("table_exists"), F.lit(MSG_TABLE_MISSING)).otherwise(F.lit(MSG_RENAMED)))
    cr_ok = F.col("_reject").isNull() & (F.col("create_status") == 200)
    cr_msg = F.coalesce(F.col("_reject"), F.when(F.col("create_status") == 200, F.lit(MSG_CREATED))
                        .otherwise(F.concat(F.lit("HTTP "), F.col("create_status").cast("string"),
                                            F.lit(": "), F.coalesce(F.col("create_error"), F.lit("")))))

    def step(no, name, ok, msg, table):
        return F.struct(F.lit(no).alias("step_no"), F.lit(name).alias("step"), ok.alias("success"),
                        msg.alias("message"), table.cast("string").alias("table_name"))
    none = F.lit(None).cast("string")
    steps = F.array(step(1, "delete", F.col("del_ok"), F.col("del_msg"), none),
                    step(2, "rename", ren_ok, ren_msg, F.col("_tbl.old_table")),
                    step(3, "create", cr_ok, cr_msg, none))
    out = r.select("request_seq", "endpoint_name", "del_ok", F.explode(steps).alias("s"))
    return out.where((F.col("s.step") == "delete") | F.col("del_ok")).select("request_seq", "endpoint_name", "s.*")


def migration_status(requested: DataFrame, steps: DataFrame) -> DataFrame:
    """PRJ7 + PRJ5: outcome per requested endpoint from the step log, flattened.

    A step that did not run reads (false, 'Not processed').
    """
    def pick(step, field):
        return F.max(F.when(F.col("step") == step, F.col(field)))
    piv = steps.groupBy("request_seq").agg(
        *[pick(s, f).alias(f"{s}_{f}") for s in ("delete", "rename", "create") for f in ("success", "message")])
    j = requested.join(piv, "request_seq", "left")
    out = [F.col("request_seq"), F.col("endpoint_name")]
    for s in ("delete", "rename", "create"):
        out.append(F.coalesce(F.col(f"{s}_success"), F.lit(False)).alias(f"{s}_success"))
        out.append(F.coalesce(F.col(f"{s}_message"), F.lit(MSG_NOT_PROCESSED)).alias(f"{s}_message"))
    ok = F.coalesce(F.col("delete_success"), F.lit(False)) & F.coalesce(F.col("create_success"), F.lit(False))
    out.append(F.when(ok, F.lit(STATUS_SUCCESS)).otherwise(F.lit(STATUS_FAILED)).alias("overall_status"))
    return j.select(*out)


def with_report_columns(flat: DataFrame, env: str, as_of=None) -> DataFrame:
    """PRJ6: report date in Sydney time and the environment name."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(REPORT_TIMEZONE), as_of_lit(as_of))  # ntz in, ntz out
    return flat.withColumn("date", F.date_format(local, REPORT_DATE_FORMAT)) \
               .withColumn("env", F.lit(env))


def migration_report(flat: DataFrame) -> DataFrame:
    """AG10: total, successful, failed = total - successful."""
    return flat.agg(F.count(F.lit(1)).alias("total_endpoints"),
                    F.count_if(F.col("overall_status") == STATUS_SUCCESS).alias("successful_migrations")) \
        .withColumn("failed_migrations", F.col("total_endpoints") - F.col("successful_migrations"))


def migration_run(requested: DataFrame, endpoints: DataFrame, env: str, as_of=None) -> DataFrame:
    """CMP10: lookup -> steps -> status -> flat report with date and env."""
    steps = migration_steps(endpoint_lookup(requested, endpoints))
    return with_report_columns(migration_status(requested, steps), env, as_of)


def parse_name_list(text_df: DataFrame, col: str = "value") -> DataFrame:
    """SC16: JSON list of names -> array; anything that is not a non-empty list gets an error."""
    value = F.try_parse_json(F.col(col))
    is_list = F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))
    arr = F.when(is_list, F.from_json(F.col(col), T.ArrayType(T.StringType())))
    return text_df.select("*", F.when(F.size(arr) > 0, arr).alias("_names"),
                          F.when(value.isNull(), F.lit(NAMES_NOT_JSON))
                          .when(~is_list, F.lit(NAMES_NOT_LIST))
                          .when(F.size(arr) == 0, F.lit(NAMES_EMPTY)).alias("error"))


def name_rows(text_df: DataFrame, key: str, col: str = "value") -> DataFrame:
    """SC16: (key, position, name, error): one row per name in the order of the list, one with the error otherwise."""
    parsed = parse_name_list(text_df, col)
    return parsed.select(key, F.posexplode_outer("_names").alias("position", "name"), "error")


def row_to_map(df: DataFrame, cols=None) -> Column:
    """SC19: a row as a map from column name to text (null stays null)."""
    return F.create_map(*[x for c in cols or df.columns for x in (F.lit(c), F.col(c).cast("string"))])


def to_map(c: Column, is_map: Column) -> Column:
    """SC19: a JSON object text as a map of texts, an empty map for anything else."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(is_map, F.from_json(c, T.MapType(T.StringType(), T.StringType()))), empty)


def map_keys_text(m: Column) -> Column:
    """SC19: the keys of a map in order, joined by a comma."""
    return F.array_join(F.array_sort(F.map_keys(m)), ",")


def missing_keys(cfg: DataFrame, keys) -> DataFrame:
    """FLT15: list of required config keys that are null or the empty text."""
    arr = F.array(*[F.when(F.col(k).isNull() | (F.col(k).cast("string") == ""), F.lit(k)) for k in keys])
    return cfg.withColumn("missing_keys", F.filter(arr, lambda x: x.isNotNull()))


# ------------------------------------------------------------ table migration
def config_check(configs: DataFrame) -> DataFrame:
    """FLT13: first failing rule per configuration row (null error when valid)."""
    err = None
    for f in REQUIRED_CONFIG_FIELDS:
        cond = F.col(f).isNull() | (F.col(f) == "")
        msg = F.lit(f"Missing required configuration field: {f}")
        err = F.when(cond, msg) if err is None else err.when(cond, msg)
    for f in TABLE_NAME_FIELDS:
        err = err.when(F.size(F.split(F.col(f), "\\.", -1)) != 3, F.lit(f"{f} must be in format: catalog.schema.table"))
    cap = F.coalesce(F.col("capacity"), F.lit(DEFAULT_CAPACITY))
    valid = "[" + ", ".join(f"'{c}'" for c in VALID_CAPACITIES) + "]"
    err = err.when(~cap.isin(*VALID_CAPACITIES),
                   F.concat(F.lit("Invalid capacity: "), cap, F.lit(f". Must be one of: {valid}")))
    return configs.withColumn("capacity", cap).withColumn("error", err) \
                  .withColumn("is_valid", F.col("error").isNull())


def dependency_inventory(deps: DataFrame) -> DataFrame:
    """FLT14: named endpoints and jobs; state as text, null -> 'unknown'."""
    return deps.where(F.col("name").isNotNull() & (F.col("name") != "")) \
        .withColumn("state", F.coalesce(F.col("state").cast("string"), F.lit("unknown")))


def dependency_summary(inventory: DataFrame) -> DataFrame:
    """AG14: count per kind."""
    return inventory.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def dependency_report(inventory: DataFrame, kind: str = "job", shown: int = 10) -> DataFrame:
    """SRT7: the first ``shown`` entries of a kind (by id) and how many more there are."""
    k = inventory.where(F.col("kind") == kind)
    total = k.agg(F.count(F.lit(1))).scalar()  # scalar subquery, no join
    return k.orderBy("id").limit(shown).withColumn("more", F.greatest(total - F.lit(shown), F.lit(0)))


def provider_warning(props: Column) -> Column:
    """FLT16: warning when the provider property is present and not delta."""
    p = F.lower(F.element_at(props, "provider"))
    return F.when(p.isNotNull() & (p != "delta"), F.lit(PROVIDER_WARNING))


def source_check(described: DataFrame, properties: DataFrame, stats: DataFrame, shown: int = PREVIEW_COLUMNS) -> DataFrame:
    """CMP11, step 3: one row about the source table: rows, columns, properties, provider warning, schema preview, error.

    ``described`` is (ordinal, col_name, data_type), ``properties`` one row with a
    map, ``stats`` one row with row_count. A table without rows is no error, one
    without columns is.
    """
    cols = described.agg(
        F.count(F.lit(1)).alias("column_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ordinal") <= shown, F.struct("ordinal", "col_name", "data_type")))),
                                 lambda x: F.concat(x["col_name"], F.lit(": "), x["data_type"])), ", ").alias("preview"))
    one = lambda df, c: df.select(c).scalar().alias(c)
    return cols.select(
        one(stats, "row_count"), "column_count", "preview",
        F.greatest(F.col("column_count") - F.lit(shown), F.lit(0)).alias("more_columns"), one(properties, "properties"),
    ).withColumn("warning", provider_warning(F.col("properties"))) \
     .withColumn("error", F.when(F.col("column_count") < 1, F.lit(NO_COLUMNS)))


def publish_verdict(before: DataFrame, after: DataFrame, expected: DataFrame, target: DataFrame) -> DataFrame:
    """CMP11, last step: drift of the source while it was copied, and whether the target holds what it should.

    All four are one-row tables with row_count and checksum.
    """
    val = lambda df, c: df.select(c).scalar()
    rows = before.select(F.col("row_count").alias("rows_before"), val(after, "row_count").alias("rows_after"),
                         val(target, "row_count").alias("target_rows"), val(target, "checksum").alias("target_checksum"),
                         (F.col("checksum") != val(after, "checksum")).alias("content_changed"),
                         (val(expected, "row_count") == val(target, "row_count")).alias("_rows_match"),
                         (val(expected, "checksum") == val(target, "checksum")).alias("_content_match"))
    verdict = F.when(F.col("rows_before") != F.col("rows_after"), F.lit("source rows changed")) \
        .when(F.col("content_changed"), F.lit("source content changed")) \
        .when(~F.col("_rows_match"), F.lit("target rows differ")) \
        .when(~F.col("_content_match"), F.lit("target content differs")).otherwise(F.lit("ok"))
    return rows.select("rows_before", "rows_after", (F.col("rows_before") != F.col("rows_after")).alias("row_count_changed"),
                       "target_rows", "target_checksum", verdict.alias("verdict"))
