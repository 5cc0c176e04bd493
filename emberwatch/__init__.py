"""Watch and search event logs with Spark: alerts are functions from DataFrame to DataFrame."""

from emberwatch.functions.text import format_alert, format_denial_alert
from emberwatch.functions.timeparts import event_time, readable_time
from emberwatch.operators.keyword import keyword_alert
from emberwatch.operators.parse import (
    normalize_logs,
    parse_documents,
    parse_logs,
    read_documents,
)
from emberwatch.operators.sequences import followed_by_span
from emberwatch.operators.spans import span_burst_alert
from emberwatch.operators.windows import (
    burst_alert,
    closing_burst_alert,
    echo_events,
    followed_by_window,
    sliding_burst_alert,
)
from emberwatch.plans.rules import Rule, apply_rules, load_rules, run_rule_set, run_rules
from emberwatch.plans.search import (
    log_counts,
    ranked_logs,
    read_index,
    search_logs,
    search_terms,
)
from emberwatch.sources.files import as_envelope, file_logs
from emberwatch.sources.kafka import kafka_logs
from emberwatch.sources.tables import events_as_logs, read_table, stream_table
from emberwatch.streaming.index import delete_merged, index_logs, merge_loads
from emberwatch.streaming.machines import Machine, register_kind
from emberwatch.streaming.runner import (
    alert_log,
    latest_alerts,
    notify_per_batch,
    print_alerts,
    read_alerts,
    run_alerts,
    run_with_retry,
)
from emberwatch.streaming.waiting import cleared_sequences, open_spans, waiting_sequences

__all__ = [
    "Machine",
    "Rule",
    "alert_log",
    "apply_rules",
    "as_envelope",
    "burst_alert",
    "cleared_sequences",
    "closing_burst_alert",
    "delete_merged",
    "echo_events",
    "event_time",
    "events_as_logs",
    "file_logs",
    "followed_by_span",
    "followed_by_window",
    "format_alert",
    "format_denial_alert",
    "index_logs",
    "kafka_logs",
    "keyword_alert",
    "latest_alerts",
    "load_rules",
    "log_counts",
    "merge_loads",
    "normalize_logs",
    "notify_per_batch",
    "open_spans",
    "parse_documents",
    "parse_logs",
    "print_alerts",
    "ranked_logs",
    "read_alerts",
    "read_documents",
    "read_index",
    "read_table",
    "readable_time",
    "run_alerts",
    "register_kind",
    "run_rule_set",
    "run_rules",
    "run_with_retry",
    "search_logs",
    "search_terms",
    "sliding_burst_alert",
    "span_burst_alert",
    "stream_table",
    "waiting_sequences",
]
