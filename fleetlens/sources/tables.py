"""The tables of the telemetry store: columns, time, keys and whether they age."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Table:
    """A table of events, by the day of ``at``, its month's first if ``monthly``; or, with ``keys``, of one row a key, by bucket.

    Of a key's rows the one of the greatest ``version`` stands, in a table whose
    ``first`` row stays the earliest commit's. A null in a key is a value like any other.
    """

    name: str
    ddl: str
    at: str | None = "captured_at"
    keys: tuple[str, ...] = ()
    version: str | None = None
    first: bool = False
    ages: bool = False
    monthly: bool = False

    @property
    def types(self) -> list[tuple[str, str]]:
        return [tuple(c.split(" ")) for c in self.ddl.split(", ")]

    @property
    def columns(self) -> list[str]:
        return [c for c, _ in self.types]

    def folder_day(self, day: str) -> str:
        """The day whose folder holds a day's rows."""
        return f"{day[:8]}01" if self.monthly else day

    @property
    def by(self) -> str:
        return "bucket" if self.keys else "day"


_OF = "instance_id long, captured_at timestamp, "

#: Names of the tables and their columns. Times are timestamps, and events have no number of their own.
_ALL = [
    Table("instances", "instance_id long, name string, server string, db string, auth_mode string, enabled boolean, created_at timestamp", "created_at", ("name",), "created_at"),
    Table("query_store_snapshot", _OF + "query_id long, plan_id long, total_duration_ms long, cpu_ms long, logical_reads long, executions long, query_sql_text string, last_execution_ms long", ages=True),
    Table("live_request_snapshot", _OF + "session_id long, request_id long, duration_ms long, blocking_session_id long, wait_type string, sql_text_hash string, sql_text_preview string", ages=True),
    Table("wait_stats_delta", _OF + "wait_type string, waiting_tasks_count_delta long, wait_time_ms_delta long, signal_wait_ms_delta long", ages=True),
    Table("missing_index_snapshot", _OF + "db_name string, schema_name string, table_name string, equality_columns string, inequality_columns string, included_columns string, user_seeks long, avg_user_impact double, avg_total_user_cost double", ages=True),
    Table("deadlock_capture", _OF + "xml_blob string, victim_session_id long, victim_resource string, graph_hash string", keys=("instance_id", "graph_hash"), version="captured_at", first=True, ages=True),
    Table("index_usage_delta", _OF + "db_name string, schema_name string, table_name string, index_name string, seeks_delta long, scans_delta long, lookups_delta long, updates_delta long", ages=True),
    Table("size_snapshot", _OF + "schema_name string, table_name string, index_name string, reserved_kb long, used_kb long, data_kb long, row_count long", ages=True),
    Table("cpu_pressure_snapshot", _OF + "online_schedulers long, runnable_tasks long, work_queue long, current_workers long, active_workers long, pending_disk_io long", ages=True),
    Table("memory_headroom_snapshot", _OF + "page_life_expectancy long, pending_memory_grants long, granted_memory_kb long, target_server_memory_kb long, total_server_memory_kb long", ages=True),
    Table("io_latency_delta", _OF + "database_name string, file_logical_name string, file_type string, reads_delta long, writes_delta long, read_stall_ms_delta long, write_stall_ms_delta long, avg_read_latency_ms double, avg_write_latency_ms double", ages=True),
    Table("tempdb_contention_snapshot", _OF + "pagelatch_waiters long, pfs_waiters long, gam_waiters long, sgam_waiters long, total_wait_ms long, tempdb_data_files long", ages=True),
    Table("plan_cache_snapshot", _OF + "single_use_plan_count long, single_use_size_kb long, total_plan_count long, total_size_kb long", ages=True),
    Table("alerts_fired", "instance_id long, fired_at timestamp, rule_id string, metric string, value double, threshold double, severity string, message string, notified boolean", "fired_at", ages=True),
    Table("query_baseline", "instance_id long, query_id long, count long, mean double, m2 double, last_value_ms double, last_updated timestamp", "last_updated", ("instance_id", "query_id"), "last_updated", ages=True),
    Table("poller_state", "instance_id long, key string, value string, updated_at timestamp", "updated_at", ("instance_id", "key"), "updated_at"),
    Table("meta", "key string, value string, updated_at timestamp", "updated_at", ("key",), "updated_at"),
    Table("ai_interactions", "id string, occurred_at timestamp, provider string, model string, system_prompt string, user_prompt string, response string, status string, error_message string, latency_ms long, tokens_in long, tokens_out long", "occurred_at", ("id",), "occurred_at"),
    Table("analysis_runs", "id string, occurred_at timestamp, server_name string, database_name string, mode string, sql_hash string, sql_preview string, server_version int, findings_total long, findings_critical long, findings_error long, findings_warning long, findings_info long, plan_attached boolean, plan_subtree_cost double, plan_op_count long, duration_ms long", "occurred_at", monthly=True),
    Table("analysis_findings", "run_id string, rule_id string, severity string, line_no int, col_no int, message string, recommendation string", None),
]
TABLES = {t.name: t for t in _ALL}
