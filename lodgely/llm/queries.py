"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

from . import bond, quality
from .bond import op12_bond
from .bpe import op10_bpe
from .common import table
from .gru_lm import op9_gru_lm
from .matroska import op4_matroska
from .mixing import op5_mixing
from .periods import op11_periods
from .quality import op13_rules
from .sharding import op2_sharding
from .simhash import op3_simhash
from .syncmers import op6_syncmers
from .tokenstore import op8_tokenstore
from .toxicity import op7_toxicity
from .warc import op1_warc


def _over(name: str, operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES = {
    "op1_warc": _over("pages", op1_warc),
    "op2_sharding": _over("documents", op2_sharding),
    "op3_simhash": _over("documents", op3_simhash),
    "op4_matroska": _over("documents", op4_matroska),
    "op5_mixing": _over("documents", op5_mixing),
    "op6_syncmers": _over("documents", op6_syncmers),
    "op7_toxicity": lambda spark, sf_dir: op7_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op8_tokenstore": _over("documents", op8_tokenstore),
    "op9_gru_lm": _over("documents", op9_gru_lm),
    "op10_bpe": _over("documents", op10_bpe),
    "op11_periods": _over("documents", op11_periods),
    "op12_bond": _over("embeddings", op12_bond),
    "op13_rules": _over("documents", op13_rules),
}

ORACLES: dict[str, str] = {"op12_bond": bond.ORACLE_SQL, "op13_rules": quality.ORACLE_SQL}
