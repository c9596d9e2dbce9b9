"""Text files, catalogs and tables."""
