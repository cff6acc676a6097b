"""Where rows come from: parquet tables, deterministic sequences, JSON, logs."""
