"""The queries of all operators that aren't training-data operators, merged."""

from __future__ import annotations

from siltstone.plans import evaluation, index, paths, retrieval, text
from siltstone.plans.registry import Registry

registry = Registry()
for _plans in (text, retrieval, index, evaluation, paths):
    registry.queries |= _plans.registry.queries
    registry.sql |= _plans.registry.sql
