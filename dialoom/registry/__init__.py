"""Registry and experiment tables: append-only events, current state as a view."""
