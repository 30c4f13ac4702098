"""Validators and domain rules: boolean Columns, and Columns that are null where a rule fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that values of a kind match, and the ranges of each semantic type.
PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "phone": r"^\+?[\d\s-]{7,15}$",
    "postal_code": r"^[A-Za-z0-9\s-]{3,10}$",
    "country_code": r"^[A-Z]{2,3}$",
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
}
RANGES = {"money": ">= 0", "percentage": "between 0 and 1", "age": "between 16 and 100", "quantity": "> 0", "rating": "between 0 and 5"}


def valid(c: Column, kind: str) -> Column:
    return c.rlike("(?U)" + PATTERNS[kind])


def validate(c: Column, kind: str) -> Column:
    """The value where it is valid, else null."""
    return F.when(valid(c, kind), c)


def in_domain(c: Column, semantic: str) -> Column:
    """Whether a value obeys its semantic type's rule; null for null."""
    return {
        "money": c >= 0, "percentage": c.between(0, 1), "age": c.between(16, 100), "quantity": c > 0, "rating": c.between(0, 5),
    }[semantic]


def apply_domain(c: Column, semantic: str) -> Column:
    return F.when(in_domain(c, semantic), c)
