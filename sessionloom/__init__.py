"""Agent-session analytics as Spark DataFrame plans."""
