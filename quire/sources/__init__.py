"""Sources and sinks for packaged documents, markup and bibliographies."""
