"""Operators on whole tables: memory building, vector search, recall, budgets, evaluation, reports."""
