"""Jobs of several steps: readiness of a dataset, training, scoring."""
