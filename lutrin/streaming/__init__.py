"""The same operators over incremental input."""
