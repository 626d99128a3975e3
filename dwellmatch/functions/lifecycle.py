"""Source activation, source health and filter bindings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LIFECYCLE_STATUSES = ["ready", "beta", "experimental", "permission-needed", "blocked"]
ACTIVATABLE = ["ready", "beta"]
DEFAULT_LIFECYCLE = "permission-needed"


def lifecycle(config: Column) -> Column:
    """struct(status, approved, block_reason) from a source's JSON config."""
    read = lambda *names: F.coalesce(*[F.get_json_object(config, f"$.{n}") for n in names])
    status = read("lifecycleStatus", "lifecycle_status")
    # A top-level member with the JSON word true is approval; the string "true" or a member of some
    # nested object is not.
    parsed = F.try_parse_json(config)
    is_true = lambda name: (F.schema_of_variant(F.try_variant_get(parsed, f"$.{name}", "variant")) == "BOOLEAN") & F.try_variant_get(parsed, f"$.{name}", "boolean")
    approved = F.coalesce(is_true("activationApproved"), F.lit(False)) | F.coalesce(is_true("activation_approved"), F.lit(False))
    reason = F.nullif(F.trim(read("activationBlockReason", "activation_block_reason")), F.lit(""))
    return F.struct(
        F.when(status.isin(LIFECYCLE_STATUSES), status).otherwise(DEFAULT_LIFECYCLE).alias("status"),
        approved.alias("approved"),
        reason.alias("block_reason"),
    )


def activation_reasons(slug: Column, registered: Column, life: Column) -> Column:
    """Array of reasons against activation; empty means the source can be activated."""
    # The texts of the reasons.
    quoted = F.concat(F.lit('"'), life["status"], F.lit('"'))
    blocked = F.concat(
        F.lit("Source lifecycle status "),
        quoted,
        F.lit(" blocks activation"),
        F.coalesce(F.concat(F.lit(": "), life["block_reason"]), F.lit("")),
    )
    return F.array_compact(
        F.array(
            F.when(~registered, F.concat(F.lit('No connector registered for source slug "'), slug, F.lit('"'))),
            F.when(~life["status"].isin(ACTIVATABLE), blocked),
            F.when(
                ~life["approved"],
                F.concat(F.lit("Source activationApproved must be true for lifecycle status "), quoted),
            ),
        )
    )


def health(is_active: Column, breaker: Column, run_status: Column, run_errors: Column) -> Column:
    return (
        F.when(~is_active, "paused")
        .when(breaker == "open", "failing")
        .when(breaker == "half_open", "degraded")
        .when(run_status.isNull(), "unknown")
        .when(run_status == "failed", "failing")
        .when((run_status == "partial") | (run_errors > 0), "degraded")
        .when(run_status == "success", "healthy")
        .otherwise("unknown")
    )


# Columns of filter keys stored before bindings were configured.
LEGACY_COLUMNS = {
    "city": "city",
    "bundesland": "bundesland",
    "postal_code": "postal_code",
    "location": "geo",
    "price": "price",
    "area": "area",
    "rooms": "rooms",
}


def resolve_binding(key: Column, data_type: Column, config: Column) -> Column:
    """struct(column, attribute): configured binding, else the legacy column, else a boolean's own key."""
    has_config = F.get_json_object(config, "$.binding").startswith("{")
    col_ = F.get_json_object(config, "$.binding.column")
    attr = F.when(col_.isNull(), F.get_json_object(config, "$.binding.attribute"))
    configured = F.coalesce(has_config, F.lit(False)) & (col_.isNotNull() | attr.isNotNull())
    legacy = F.lit(None).cast("string")
    for name, column in LEGACY_COLUMNS.items():
        legacy = F.when(key == name, F.lit(column)).otherwise(legacy)
    return F.struct(
        F.when(configured, col_).otherwise(legacy).alias("column"),
        F.when(configured, attr).when(legacy.isNull() & (data_type == "bool"), key).alias("attribute"),
    )
