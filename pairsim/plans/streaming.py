"""Streaming queries (O97, O98): arrival files written from the tables, processed with availableNow."""


from pairsim.plans.ingest import LOG_LINES_SQL, log_lines
from pairsim.plans.registry import query
from pairsim.sources.tables import read_table
from pairsim.streaming import scratch_dir, stream_insert_if_absent, stream_log_metrics, write_arrival_files


@query("stream_insert_if_absent", oracle="""
SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY ALL""")
def q_stream_insert_if_absent(spark, d):
    ev = read_table(spark, d, "events", ["event_id", "user_id", "event_type", "value"])
    root = scratch_dir(spark, "arrivals")
    write_arrival_files(ev, f"{root}/in", "event_id", 4)
    t = stream_insert_if_absent(spark, f"{root}/in", f"{root}/table", ["user_id", "event_type"], "event_id")
    return t.select("user_id", "event_type", "event_id", "value")


@query("stream_log_metrics", oracle="WITH " + LOG_LINES_SQL + """,
agg AS (
  SELECT file_name, arg_max(n_functions, line_no) FILTER (WHERE n_functions IS NOT NULL) AS nf,
         count(*) FILTER (WHERE is_merge) AS att, count(*) FILTER (WHERE profitable = 1) AS prof,
         sum(merged_size - (size1 + size2)) AS diff
  FROM parsed GROUP BY file_name)
SELECT f.file_name, benchmark, flags, coalesce(nf, 0)::BIGINT AS total_functions,
       coalesce(att, 0)::BIGINT AS merge_attempts, coalesce(prof, 0)::BIGINT AS profitable_merges,
       coalesce(diff, 0)::BIGINT AS bin_size_difference
FROM files f LEFT JOIN agg USING (file_name)""")
def q_stream_log_metrics(spark, d):
    root = scratch_dir(spark, "logs")
    write_arrival_files(log_lines(spark, d), f"{root}/in", "line_no", 4)
    return stream_log_metrics(spark, f"{root}/in", f"{root}/state")
