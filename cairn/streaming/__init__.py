"""Streaming twins of the job, agent and trust folds."""
