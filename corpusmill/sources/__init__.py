"""Reading and writing: lines, JSON, packed tables, metadata, manifests."""
