"""Sources and sinks: tables and files as streams, and files as topics."""
