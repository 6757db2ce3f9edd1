"""Tables, seed files, taxonomies, page caches and board payloads."""
