"""Append-only patches as a stream of idempotent upserts."""
