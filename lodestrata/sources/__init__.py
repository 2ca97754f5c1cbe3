"""Sources and sinks: file trees, index tables, repository listings."""
