"""Where documents and voices come from, and where texts and manifests go."""
