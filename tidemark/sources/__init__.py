"""Reading and writing: strict CSV, JSON leaves, embedded data in HTML, manifests and snapshots."""
