"""DataFrame-to-DataFrame operators the jobs are built from."""
