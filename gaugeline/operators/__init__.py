"""Relational operators: matching, scoring, verification, clustering, perturbation."""
