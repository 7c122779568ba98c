"""Loads the modules that register queries."""

from lexforge.plans import q_evals, q_evidence, q_facts, q_frames, q_reports, q_search, q_structure, q_tree  # noqa: F401
