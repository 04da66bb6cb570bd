"""Table readers, writers and adapters."""
