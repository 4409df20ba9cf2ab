"""Composite jobs: requests, mask plans, ingestion, lane builds, privacy results."""
