"""The analysis jobs: registry, matching, revenue panels, networks, presentation."""
