"""Operators on conversations: rules, scores, profiles, evaluation."""
