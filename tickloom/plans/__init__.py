"""Plan building blocks shared by the operators."""

from tickloom.plans.materialize import materialize
from tickloom.plans.scan import (
    count_, first_, last_, max_, min_, numbered, previous, running, sum_, whole,
)

__all__ = [
    "materialize", "running", "previous", "numbered",
    "sum_", "count_", "max_", "min_", "last_", "first_", "whole",
]
