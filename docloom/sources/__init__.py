"""File source, format parsers and sinks."""
