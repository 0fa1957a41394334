"""Compatibility folding against Python's tables, over every assigned character and mixed strings."""

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tallymark.functions import names


def plain(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


ASSIGNED = [chr(p) for p in range(1, sys.maxunicode + 1) if unicodedata.category(chr(p)) not in ("Cn", "Co", "Cs")]


def folded(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return dict(rows.select("i", names.fold_accents(F.col("x")).alias("y")).collect())


def test_every_assigned_character(spark):
    some = [c for c in ASSIGNED if plain(c) != c] + ASSIGNED[::97]
    got = folded(spark, some)
    assert [(c, got[i]) for i, c in enumerate(some) if got[i] != plain(c)] == []


def test_mixed_strings(spark):
    rng = random.Random(2)
    odd = [c for c in ASSIGNED if plain(c) != c]
    texts = ["".join(rng.choice([rng.choice(odd), rng.choice(ASSIGNED), rng.choice("abc XYZ"), "é", "한", "½"]) for _ in range(rng.randint(0, 12))) for _ in range(10_000)]
    got = folded(spark, texts)
    assert [(t, got[i]) for i, t in enumerate(texts) if got[i] != plain(t)] == []


def test_names_of_other_scripts(spark):
    rows = {"Ελλάς": "ελλας", "①Co": "1co", "½ Price": "12 price", "Société Générale S.A.": "societe generale", "Йод АГ": "иод аг", "ﬁnance™": "financetm", "삼성": plain("삼성")}
    got = spark.createDataFrame([(k,) for k in rows], "x string").select("x", names.normalize(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in got} == rows
