"""Sources (tables, events, labelled lines) and sinks."""
