"""Lake paths, readers, writers, sitemaps, fetchers and model clients."""
