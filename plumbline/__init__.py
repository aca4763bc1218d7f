"""Behaviour analytics and claim grounding as Spark DataFrame operators."""
