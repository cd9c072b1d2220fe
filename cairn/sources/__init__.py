"""Where manifests come from."""
