import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[2])
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "é"), (4, "é"), (5, "wörd " * 30000), (6, "x" * 70000), (None, "no id here at all"), (7, "no id here at all"), (8, "a\nb\na\nb"), (9, "12 34 !? %% ##"), (10, "\U0001f642 ▁ <s> </s> [INST] \\")]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string")


@pytest.fixture(scope="session")
def clash(odd):
    """Extra columns under the names that operators add."""
    from pyspark.sql import functions as F

    names = ("lang_pred", "score", "size", "source_size", "target", "copies", "token_ids", "decoded", "secrets", "pii", "n_words", "failed_rule", "kept", "digest", "class_id", "value")
    return odd.withColumns({n: F.lit("mine") for n in names}).withColumn("source", F.when(F.col("doc_id") > 4, "a")).withColumn("lang", F.lit("en"))
