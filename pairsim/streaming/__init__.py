from pairsim.streaming.arrival import (  # noqa: F401
    scratch_dir, stream_insert_if_absent, stream_log_metrics, write_arrival_files)
