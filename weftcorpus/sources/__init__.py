"""Reading and writing records, statistics, metrics and configuration."""
