"""DataFrame operators: claims, documents, model answers in; derived tables out."""
