"""sessionweave: analytics over append-only session logs, written for Spark."""
