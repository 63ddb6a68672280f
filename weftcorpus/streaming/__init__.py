"""Row-local operators and keyed dedup on streams."""
