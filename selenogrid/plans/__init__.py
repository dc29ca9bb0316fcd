"""Registered queries, grouped as the operator inventory groups them."""

from importlib import import_module

GROUPS = ["terrain", "score", "grid", "site", "cluster", "route", "report", "eval"]


def load_all() -> None:
    for group in GROUPS:
        import_module(f"selenogrid.plans.{group}_queries")
