"""Sources and sinks of sets: the compact binary form and the files that hold it."""
