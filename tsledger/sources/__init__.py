"""Sources and sinks: tables of other libraries, CSV, JSON lines, text."""
