"""Helpers the operators of this package share."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
NOT_WORD = "[\\x20\\x09-\\x0D]+"
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files have `name`; PERFCAP_TOKENIZERS names another folder."""
    folder = os.environ.get("PERFCAP_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ascii_lower(column):
    """A-Z lower-cased, everything else as it is."""
    return F.translate(column, A_TO_Z, A_TO_Z.lower())
