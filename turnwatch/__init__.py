"""Conversation policy monitoring and semantic grounding as Spark jobs."""
