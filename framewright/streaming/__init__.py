"""The same state machines over streams: entries and exits, dwells, sessions."""
