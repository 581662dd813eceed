"""Continuous queries and event queues over change streams."""
