"""The monthly card ledger: schema of the raw text file and its canonical form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.config import CARDS
from basketry.sources.files import clean_ledger, read_ledger_csv, shares_to_amounts

# Column names and defaults of the raw file.
CHANNELS = CARDS.channels
CARD_NAMES = [str(i) for i in range(1, 15)] + ["other"]
BLANKS = {"masts": 0, "educd": 0, "trdtp": 0, "naty": 0, "poscd": 0, "cuorg": 0, "slam": 0, "gender_code": -1, "age": 0}
OTHER_ITEM = 49


def _fields() -> list[tuple[str, T.DataType]]:
    byte, short, integer, double = T.ByteType(), T.ShortType(), T.IntegerType(), T.DoubleType()
    return [
        ("dt", byte),
        ("chid", integer),
        ("shop_tag", byte),
        ("txn_cnt", short),
        ("txn_amt", double),
        *[(f"{c}_cnt", short) for c in CHANNELS],
        *[(f"{c}_amt_pct", double) for c in CHANNELS],
        *[(f"card_{c}_txn_cnt", short) for c in CARD_NAMES],
        *[(f"card_{c}_txn_amt_pct", double) for c in CARD_NAMES],
        *[(c, byte) for c in ("masts", "educd", "trdtp", "naty", "poscd", "cuorg")],
        ("slam", double),
        *[(c, byte) for c in ("gender_code", "age", "primary_card")],
    ]


LEDGER_SCHEMA = T.StructType([T.StructField(n, t) for n, t in _fields()])
RAW_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n, _ in _fields()])


def share_columns() -> dict[str, str]:
    """Share column to the amount column derived from it."""
    shares = [f"{c}_amt_pct" for c in CHANNELS] + [f"card_{c}_txn_amt_pct" for c in CARD_NAMES]
    return {s: s.replace("amt_pct", "txn_amt") for s in shares}


def read_card_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Raw text to the canonical ledger: cleaned, typed, with channel and card amounts, item column ``tag``."""
    raw = read_ledger_csv(spark, path, RAW_SCHEMA)
    typed = clean_ledger(raw, LEDGER_SCHEMA, OTHER_ITEM, BLANKS, item="shop_tag")
    widened = typed.withColumns({c: F.col(c).cast("int") for c in ("dt", "shop_tag")})
    return shares_to_amounts(widened, share_columns(), "txn_amt").withColumnRenamed("shop_tag", "tag")
