"""Explicit schemas; nothing is inferred."""

TELEMETRY = "factory_id string, parameter_id string, timestamp timestamp_ntz, value double, quality_code string"
TELEMETRY_TEXT = "factory_id string, parameter_id string, timestamp string, value string, quality_code string"
LIMITS = (
    "id int, consent_id int, factory_id string, parameter string, minimum_limit double, maximum_limit double, unit string, "
    "condition_text string, page_number int, table_number int, extraction_confidence double, proxy_source_factory_id string"
)
LABELS = "factory_id string, parameter_id string, tamper_type string, start_timestamp timestamp_ntz, end_timestamp timestamp_ntz, severity string"
INSPECTIONS = "factory_id string, inspection_date date, inspection_type string, status string"
FACTORIES = "site_id string, name string, category string, city string, state string, created_at string"
RUN_LOG = "factory_id string, parameter_id string, row_count bigint, started_at timestamp_ntz, finished_at timestamp_ntz, status string, error_message string"
FINGERPRINTS = ["impossible_ph_range", "inspection_dip", "flatline", "limit_hugging", "correlation_break", "copy_paste", "coordinated_missing_data", "data_integrity"]


def names(schema: str) -> list[str]:
    """The names of a schema's columns."""
    return [part.split()[0] for part in schema.split(",")]
