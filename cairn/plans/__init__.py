"""Plans: workflows over manifests, and digests that pin what a plan was made from."""
