"""Answers to messages against a plain-Python reading of the same rules."""

import random

from stockloom.operators import messages as ms

FIGURES = "product_id long, city_name string, a double, b double"
ASKED = "conv_id int, intent string, product_ids array<long>, cities array<string>, note string"


def plan(table):
    return {
        "stock": ms.Source(table, "a", 2, ("STOCK",), named=True),
        "outlook": ms.Source(table, "b", 3, ("OUTLOOK",), below=2, fill=("STOCK",)),
        "sales": ms.Source(table, "a", 2, ("SALES",), by_product=False, below=1),
    }


def slow(figures, message):
    _, intent, ids, cities, _ = message
    ids, cities = set(ids or []) - {None}, set(cities or []) - {None}

    def best(column, n, narrow=True):
        rows = [r for r in figures if (not narrow or not ids or r[0] in ids) and (not cities or r[1] in cities)]
        return sorted(((-r[column], r[0], r[1]) for r in rows))[:n]

    out = [("stock", k, *r) for k, r in enumerate(best(2, 2), 1)] if intent == "STOCK" or ids else []
    if intent == "OUTLOOK" or intent == "STOCK" and len(out) < 2:
        out += [("outlook", k, *r) for k, r in enumerate(best(3, 3), 1)]
    if intent == "SALES" or not out:
        out += [("sales", k, *r) for k, r in enumerate(best(2, 2, narrow=False), 1)]
    return [(kind, k, product, city, -value) for kind, k, value, product, city in out]


def test_evidence_follows_products_cities_and_gaps(spark):
    rng = random.Random(4)
    figures = [(p, c, float(rng.randint(0, 4)), float(rng.randint(0, 9))) for p in range(8) for c in "xyz" if rng.random() < 0.7]
    asked = [
        (
            k,
            rng.choice(["STOCK", "OUTLOOK", "SALES", "OTHER"]),
            rng.choice([None, [], [1], [3, 3, 5], [99], [2, 99, None]]),
            rng.choice([None, [], ["x"], ["z", "y", "z"], ["nowhere"]]),
            None,
        )
        for k in range(120)
    ]
    asked.append(asked[0])
    table, messages = spark.createDataFrame(figures, FIGURES), spark.createDataFrame(asked, ASKED)
    rows = ms.evidence(messages, plan(table)).collect()
    found = sorted((r.conv_id, r.kind, r.place, r.product_id, r.city_name, r.value) for r in rows)
    assert found == sorted((m[0], *row) for m in asked for row in slow(figures, m))
    assert {r.kind for r in rows} == {"stock", "outlook", "sales"}


def test_evidence_of_empty_tables(spark):
    table, one = spark.createDataFrame([], FIGURES), [(1, "STOCK", [1], None, "n")]
    assert ms.evidence(spark.createDataFrame(one, ASKED), plan(table)).count() == 0
    assert ms.evidence(spark.createDataFrame([], ASKED), plan(table)).count() == 0
