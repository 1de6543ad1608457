"""folio."""
