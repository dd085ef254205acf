"""Part of grainfold; see README.md."""
