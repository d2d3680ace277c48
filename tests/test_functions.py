"""Fixed inputs and results of the text, key and similarity functions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import blocking_keys as K
from tessera.functions import similarity as S
from tessera.functions import text as X


def value(spark, f, *args):
    row = spark.createDataFrame([args], ",".join(f"c{i} string" for i in range(len(args))))
    return row.select(f(*(F.col(f"c{i}") for i in range(len(args)))).alias("v")).first().v


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (X.normalize_name, "Pvt. Ltd.", "private limited"),
        (X.normalize_address, "41st St", "41 th street"),
        (X.normalize_address, "5bis Ave.", "5 bis avenue"),
        (X.normalize, None, ""),
        (X.normalize, "", ""),
        (X.strip_legal_suffix, "acme private limited", "acme"),
        (X.strip_legal_suffix, "limited", ""),
        (K.name_prefix, "", "__empty__"),
        (K.stripped_prefix, "the new york diner", "new"),
        (K.address_key, "12 main road foch", "12_foch"),
        (K.address_key, "12", "n_12"),
        (K.address_key, "foch street", "w_foch"),
        (K.address_key, "", "__none__"),
        (K.second_word_key, "acme", "__none__"),
        (S.soundex, "", "0000"),
        (S.soundex, "Ashcraft", "A226"),
    ],
)
def test_one(spark, f, given, wanted):
    assert value(spark, f, given) == wanted


@pytest.mark.parametrize(
    ("f", "a", "b", "wanted"),
    [
        (S.token_jaccard, "", "", 1.0),
        (S.raw_token_jaccard, "", "", 0.0),
        (S.char_dice, "", "", 1.0),
        (S.char_dice, "", "a", 0.0),
        (S.char_dice, "ab", "ab", 1.0),
        (S.length_difference, "", "", 0.0),
        (S.levenshtein, "abc", "abd", 2 / 3),
        (S.jaro_winkler, "martha", "marhta", 0.961111),
    ],
)
def test_two(spark, f, a, b, wanted):
    assert value(spark, f, a, b) == pytest.approx(wanted, abs=1e-6)
