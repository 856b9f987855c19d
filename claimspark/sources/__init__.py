"""Where documents, policies and events come from, and where results go."""
