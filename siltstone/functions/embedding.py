"""A stand-in for an embedding model: how often single characters occur. Retrieval takes any function in its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that are the dimensions of a profile.
CHARACTERS = "etaoinsrhldcumfpgwybv的一在是和用数据检索不"


def profile(text: Column) -> Column:
    """Per hundred code points, how many are each of CHARACTERS; all 0 for an empty text, null for a null one."""
    size = F.greatest(F.char_length(text), F.lit(1))
    return F.when(text.isNotNull(), F.array(*[100.0 * (F.char_length(text) - F.char_length(F.replace(text, F.lit(c), F.lit("")))) / size for c in CHARACTERS]))
