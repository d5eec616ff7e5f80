"""Reading and writing: listings, tables, manifests, state records, checkpoints."""
