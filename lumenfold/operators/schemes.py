"""Detection schemes by name: what scores them, what their configuration must be, whether they may run here."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics
from .manifests import config_sha256

#: A key that is published for demonstrations and must not calibrate anything.
DEMO_KEY = 15485863


@dataclass(frozen=True)
class Scheme:
    """score: (df with a token array, its name) -> df with score, scored_units, p_value. runnable: whether everything it needs is here."""

    name: str
    statistic: str
    score: Callable[[DataFrame, str], DataFrame] | None
    runnable: bool
    reason: str = ""


def keyed_ngrams(key: int, gamma: float = 0.25, width: int = 4) -> Scheme:
    """An own n-gram scheme: a gram is green if a keyed hash of it falls below gamma. It is not any published detector's function."""
    validated({"key": key, "gamma": gamma, "width": width})

    def green(gram):
        return F.pmod(F.xxhash64(F.lit(key), F.array_join(gram, " ")), F.lit(1 << 20)) < int(gamma * (1 << 20))

    return Scheme("engine.keyed_ngrams", "unique_ngram_z", lambda df, tokens: metrics.ngram_z(df, tokens, green, width, gamma), True)


def validated(config: Mapping[str, Any]) -> str:
    """The configuration's hash, if it is legal."""
    if config["key"] == DEMO_KEY or config["key"] <= 0:
        raise ValueError("a benchmark key is positive and not the demonstration key")
    if not 0 < config["gamma"] < 1 or config["width"] < 1:
        raise ValueError("gamma is between 0 and 1, the width positive")
    return config_sha256(config)


#: The authorities on record. Only the first is code of this engine; the others' functions are not public or not here.
AUTHORITIES = (
    Scheme("engine.keyed_ngrams", "unique_ngram_z", None, True),
    Scheme("reference.synthid_text", "weighted_mean", None, False, "the reference processor is not part of this environment"),
    Scheme("provider.embedded_text_watermark", "undisclosed", None, False, "configuration, key and detector are not public"),
)


def authority_for(name: str, require_runnable: bool = False) -> Scheme:
    found = next((a for a in AUTHORITIES if a.name == name), None)
    if found is None:
        raise KeyError(f"no authority on record for {name!r}")
    if require_runnable and not found.runnable:
        raise PermissionError(f"{name} cannot run: {found.reason}")
    return found


def authorities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a.name, a.statistic, a.runnable, a.reason) for a in AUTHORITIES], "scheme string, statistic string, runnable boolean, reason string")


#: Operations that are described and never run: semantic rewriting, translation quality, compositions of transforms.
UNEXECUTED = ("paraphrase", "back_translation", "summarization", "translation_quality", "composition")


def descriptors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o, "UNEXECUTED") for o in UNEXECUTED], "operation string, status string")


def environment() -> dict[str, str]:
    """Versions of what results may depend on."""
    import platform
    import unicodedata

    import pandas
    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__, "pandas": pandas.__version__, "unicode_tables": unicodedata.unidata_version}
