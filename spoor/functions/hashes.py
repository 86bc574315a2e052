"""Digests of script code."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def sha2(code: Column) -> Column:
    return F.sha2(code.cast("binary"), 256)


@F.pandas_udf(StringType())
def _sha3(code: pd.Series) -> pd.Series:
    return code.map(lambda x: None if x is None else hashlib.sha3_256(x.encode()).hexdigest())


def sha3(code: Column) -> Column:
    """SHA3-256, lowercase hex. Spark has no such function, so this goes through Arrow."""
    return _sha3(code)


def size(code: Column) -> Column:
    return F.octet_length(code).cast("long")


def instance_hash(log_id: Column, sha: Column, sha_3: Column, n: Column, isolate: Column, script_id: Column) -> Column:
    """Natural key of a script instance: repeatable, as the log id is not random here."""
    return F.sha2(F.concat_ws("|", log_id, sha, sha_3, n.cast("string"), isolate, script_id.cast("string")).cast("binary"), 256)
