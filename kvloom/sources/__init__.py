"""Connections, databases, versions, ingestion and maintenance."""
