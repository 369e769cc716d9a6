"""The catalog's reports over growing folders, by Structured Streaming."""
