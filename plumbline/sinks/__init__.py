"""Sinks: JSON, NDJSON, SARIF, Markdown, DOT and Mermaid."""
