"""Live queries driven by the journal."""
