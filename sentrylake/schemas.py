"""Types of units, verdicts, predictions and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVENT_FIELDS = (
    "timestamp", "event_code", "action", "status", "host", "username", "source_ip", "region", "process_name", "command_line", "new_account",
    "failure_reason", "description", "port", "cidr", "protocol", "policy_name", "change_type", "target_user",
)
EVENT = "struct<" + ",".join(f"{f}:string" for f in EVENT_FIELDS) + ">"
RAW_FIELDS = {
    "count": "bigint", "window_start": "timestamp", "window_end": "timestamp", "sample_lines": "array<string>", "distinct_users": "array<string>", "distinct_targets": "array<string>",
    "user_agents": "array<string>", "sample_paths": "array<string>", "status_sequence": "array<string>", "final_status": "string", "line": "string",
    "path": "string", "user_agent": "string", "command": "string", "event_code": "string", "host": "string", "event": EVENT,
    "events": f"array<{EVENT}>", "source": "string", "synthetic": "boolean", "status_runs": "array<struct<status:string,n:bigint>>", "facts": "struct<first_failure:timestamp>",
}
RAW = "struct<" + ",".join(f"{k}:{v}" for k, v in RAW_FIELDS.items()) + ">"
UNIT_FIELDS = {"source": "string", "timestamp": "timestamp", "actor": "string", "action": "string", "target": "string", "status": "string", "raw": RAW, "line_no": "bigint"}
UNIT = "struct<id:string," + ",".join(f"{k}:{v}" for k, v in UNIT_FIELDS.items() if k != "line_no") + ">"
VERDICT = "struct<is_incident:boolean,technique:string,confidence:double,reason:string>"
PREDICTION = "unit_id string, is_incident boolean, technique string"
LABELED = f"unit_id string, event {UNIT}, label string, technique string, rationale string"


def raw(**known: Column) -> Column:
    """The unit's raw struct with these fields; the others are null."""
    return F.struct(*[known.get(k, F.lit(None)).cast(t).alias(k) for k, t in RAW_FIELDS.items()])


def unit(**known: Column) -> list[Column]:
    """The columns of an unnumbered unit."""
    return [known.get(k, F.lit(None)).cast(t).alias(k) for k, t in UNIT_FIELDS.items()]


def verdict(incident, technique, confidence, reason) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        as_column(incident).cast("boolean").alias("is_incident"),
        as_column(technique).cast("string").alias("technique"),
        as_column(confidence).cast("double").alias("confidence"),
        as_column(reason).cast("string").alias("reason"),
    )
