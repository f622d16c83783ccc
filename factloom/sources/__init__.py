"""Where facts come from: stored segments, lifted tables, the journal, overlays."""
