"""DataFrame operators: features, quality, clustering, event model, windows, scoring."""
