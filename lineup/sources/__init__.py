"""Sources and sinks: files, nested JSON feeds, HTML tables, JDBC, models."""
