"""Marlstone llm."""
