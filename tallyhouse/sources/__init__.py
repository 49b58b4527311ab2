"""Readers of tables, schemas, project files and monitoring results; sinks and upserts."""
