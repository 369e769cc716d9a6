"""Sources and sinks: a file scan that loses no file, and the manifest document."""
