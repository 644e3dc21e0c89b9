"""Column-level building blocks: window frames, rolling statistics, cost models."""
