"""Language identification: rejection by distance, and a plain version of the scores."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallywright.llm import language_id, queries

FINNISH = (
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on "
    "annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
)
POLISH = (
    "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni "
    "obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa"
)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(labelled):
    return language_id.fit(labelled.where(~language_id.held_out()))


def _spoken(words: str, n: int) -> str:
    r = random.Random(n)
    return " ".join(r.choice(words.split()) for _ in range(n))


def _letters(first: int, last: int, n: int) -> str:
    r = random.Random(first)
    return " ".join("".join(chr(r.randint(first, last)) for _ in range(r.randint(2, 9))) for _ in range(n))


def test_long_texts_of_other_languages_and_scripts_are_rejected(spark, model):
    texts = [_spoken(FINNISH, 1000), _spoken(POLISH, 1000)]
    texts += [_letters(a, b, 1000) for a, b in [(97, 122), (0x430, 0x44F), (0x4E00, 0x9FA5), (0x5D0, 0x5EA)]]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    assert language_id.predict(table, model).where("NOT rejected").count() == 0


def test_labelled_texts_stay_and_are_told_apart(labelled, model):
    got = language_id.predict(labelled.withColumnRenamed("lang", "truth"), model)
    row = got.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("rejected").alias("rejected"),
        F.count_if(F.expr("truth = lang_pred")).alias("right"),
    ).first()
    assert row["rejected"] <= 0.002 * row["n"] and row["right"] >= 0.99 * row["n"]


def _cell(three: bytes) -> int:
    h = sum(x * y for x, y in zip(three, (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35))) % 2**32
    h = (h ^ h >> 15) * 0x2C1B3C6D % 2**32
    return h >> 32 - language_id.BITS


def _plain(text: str | None, model) -> tuple[str, float, bool]:
    if not any(map(str.isalpha, text or "")):
        return "und", 0.0, True
    raw = text.encode().lower()
    raw = b"  " + bytes(x if x >= 128 or chr(x).isalpha() else 32 for x in raw) + b"  "
    threes = [raw[i : i + 3] for i in range(len(raw) - 2)]
    found = Counter(_cell(t) for t in threes if t[:2] != b"  ")
    weight = {c: math.sqrt(n) * float(model.idf[c]) for c, n in found.items()}
    length = math.sqrt(sum(w * w for w in weight.values()))
    near = [sum(w * float(row[c]) for c, w in weight.items()) / length for row in model.centroids]
    best = max(range(len(near)), key=lambda i: near[i])
    return model.languages[best], near[best], near[best] < model.floors[best][sum(found.values()).bit_length()]


def test_scores_equal_a_plain_version(spark, labelled, model):
    rows = [r["text"] for r in labelled.orderBy("doc_id").limit(60).collect()]
    rows += [None, "", "  ", "123 !?", "a", "é", "漢", "A b", "x" * 70000, "tie tie", "tie tie", _spoken(POLISH, 300)]
    table = spark.createDataFrame(list(enumerate(rows)), "n int, text string").repartition(3)
    for r in language_id.predict(table, model).collect():
        lang, score, rejected = _plain(rows[r["n"]], model)
        assert r["score"] == pytest.approx(score, abs=1e-5), rows[r["n"]]
        assert (r["lang_pred"], r["rejected"]) == (lang, rejected) or abs(score) < 1e-9


def test_the_query_returns_every_document(spark, sf_dir):
    got = queries.op10_language_id(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert got.count() == docs.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_few_labelled_rows_have_no_floor(spark):
    table = spark.createDataFrame([(i, f"words of one kind {i}", "x") for i in range(3)], "doc_id bigint, text string, lang string")
    model = language_id.fit(table)
    assert not model.floors.any()
    assert language_id.predict(table, model).where("rejected").count() == 0
