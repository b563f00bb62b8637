"""Sources of documents: memory, folders, the bundled example, and corpora rendered from the relational tables."""
