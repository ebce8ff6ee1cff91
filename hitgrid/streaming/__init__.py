"""Stateful controllers: step functions shared by batch folds and Structured Streaming."""
