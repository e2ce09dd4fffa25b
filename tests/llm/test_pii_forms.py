"""What op1 adds to the base spans: loose forms planted among look-alikes, and the estimates behind them."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from millpond.llm import pii

# (kind, words before, how the span is made); the first part is personal data, the second looks like it.
TRUE = [
    ("phone", ("call me on ", "phone: ", "Telefon: ", "Rufen Sie an: ", "tél. ", "appelez le ", "llame al ", "móvil "), "({a}) {b}-{c}"),
    ("phone", ("my mobile is ", "Handy ", "mon portable: ", "tel. "), "{a}-{b}-{c}"),
    ("ssn", ("my SSN is ", "social security ", "Sozialversicherung: ", "sécurité sociale: ", "seguro social "), "{a}-{d}-{c}"),
    ("email", ("write to ", "mail: ", "schreiben Sie an ", "escriba a "), "{n} (at) {m} (dot) org"),
    ("email", ("contact: ", "Kontakt: ", "courriel: ", "correo: "), "{n} arroba {m} punto es"),
    ("email", ("reach me: ", "Mail an "), "{n}[at]{m}.de"),
    ("ip", ("host ", "Server ", "serveur ", "IP address "), "2001:db8:{d}:1:2:3:4:{c}"),
]
FALSE = [
    ("phone", ("order ", "invoice no ", "Bestellung ", "pedido ", "facture "), "{a}-{b}-{c}"),
    ("ssn", ("serial ", "part ", "Teil ", "pièce ", "artículo "), "000-00-{c}"),
    ("ip", ("version ", "release ", "section ", "Kapitel "), "{a}.999.{d}.4"),
    ("card", ("isbn ", "order ", "Rechnung ", "pedido "), "1111 1111 1111 111"),
]


def planted(seed: int, size: int):
    rng = random.Random(seed)
    rows, want = [], {}
    for doc in range(size):
        parts = []
        for _ in range(rng.randint(0, 3)):
            real = rng.random() < 0.5
            kind, before, form = rng.choice(TRUE if real else FALSE)
            span = form.format(
                a=rng.randint(201, 799), b=rng.randint(200, 999), c=rng.randint(1000, 9999), d=rng.randint(10, 99),
                n=rng.choice(("ana.ruiz", "k-meyer", "jdupont", "m.smith")), m=rng.choice(("acme", "beispiel", "exemple")),
            )
            parts.append((rng.choice(before), span, kind if real else None))
        text = "Lorem ipsum dolor sit amet, consectetur. "
        for before, span, kind in parts:
            text += before
            if kind:
                want.setdefault(doc, set()).add((kind, len(text), len(text) + len(span)))
            text += span + rng.choice((". Sed do eiusmod tempor incididunt. ", "\nUt enim ad minim veniam quis. "))
        # Base spans are far more common than looser ones.
        text += f"Mail user{doc}@site.org or call +1 (988) 555-{1000 + doc % 9000}."
        rows.append((doc, text))
    return rows, want


def test_added_spans_are_right_and_whole(spark):
    rows, want = planted(1, 1500)
    found = {}
    for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).where(F.col("n_added") > 0).collect():
        text = rows[r.doc_id][1]
        base = {(start, end) for _, start, end, good in pii.base_matches(text) if good}
        spans = [s.split(":") for s in r.spans.split(",")]
        found[r.doc_id] = {(k, int(a), int(b)) for k, a, b in spans if (int(a), int(b)) not in base}
    hits = sum(len(want.get(d, set()) & s) for d, s in found.items())
    recall = hits / sum(map(len, want.values()))
    precision = hits / sum(map(len, found.values()))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)


def test_rates_are_learned_for_each_kind_and_direction():
    """Naming words that stand before false cards and true phones alike lose their weight for cards only."""
    counts = []
    for kind, (true, false) in {2: ((1, 1, 1, 0, 1), (0, -1, 1, -1, -1)), 3: ((0, 1, 1, 0, 1), (0, -1, 0, -1, -1))}.items():
        counts += [(kind, 2, pii.code(true), 500), (kind, 2, pii.code(false), 500)]
    unsure = [(kind, 2, pii.code((0, 0, 1, 0, 0)), 1) for kind in (2, 3)]
    truth = pii.weigh(counts + unsure)
    assert np.all(truth[[0, 2]] > 0.9) and np.all(truth[[1, 3]] < 0.1)
    assert truth[5] > truth[4]


def test_no_candidates_and_one_candidate():
    assert pii.accepted([]) == frozenset()
    assert pii.accepted([(0, 0, pii.code((1, 1, 1, 0, 1)), 5)]) == frozenset()
    sure, never = (3, 2, pii.code((0, 1, 1, 0, 1))), (3, 1, pii.code((-1, -1, 0, -1, -1)))
    assert pii.accepted([(*sure, 4), (*never, 4)]) == {sure}


def test_codes_round_trip():
    for ballot in ((1, -1, 0, -1, 1), (-1, -1, -1, -1, -1), (0, 0, 0, 0, 0)):
        for looks in range(1 << pii.MARKS):
            back = pii.decode(pii.code(ballot, looks))
            assert tuple(back[: pii.LABELERS]) == ballot and sum(b << i for i, b in enumerate(back[pii.LABELERS :])) == looks
