"""Readers that turn raw pages, posts and JSON columns into typed rows."""
