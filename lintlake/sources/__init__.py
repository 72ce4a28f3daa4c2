"""Sources: texts, files, folders, archives, the catalog, and samples of metrics."""
