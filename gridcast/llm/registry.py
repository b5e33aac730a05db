"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embeddings import op5_embeddings
from .langid import op9_language
from .lines import op4_lines
from .merkle import SQL as MERKLE_SQL
from .merkle import op12_merkle
from .mixing import SQL as MIXING_SQL
from .mixing import op2_mixing
from .negatives import SQL as NEGATIVES_SQL
from .negatives import op13_negatives
from .packing import op8_packing
from .search import SQL as SEARCH_SQL
from .search import op6_search
from .sharding import op7_sharding
from .simhash import op3_simhash
from .substrings import SQL as SUBSTRINGS_SQL
from .substrings import op11_substrings
from .suffix import op1_suffix
from .toxicity import op10_toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix, op2_mixing, op3_simhash, op4_lines, op5_embeddings, op6_search, op7_sharding, op8_packing, op9_language, op10_toxicity, op11_substrings, op12_merkle, op13_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": MIXING_SQL, "op6_search": SEARCH_SQL, "op11_substrings": SUBSTRINGS_SQL, "op12_merkle": MERKLE_SQL, "op13_negatives": NEGATIVES_SQL}
