"""Personal data by weak supervision (operator 1): labelers vote on candidate spans, EM weighs them, a classifier decides.

1. One pass over the texts finds candidates: the base patterns (email, ip, card, phone), matches of these patterns that fail
   their test, and looser forms (spelled-out addresses, phone numbers without a plus, colon addresses, social security
   numbers). A candidate that passes the base test is a base span: it always stays.
2. Five labelers vote -1, 0 or 1 on every candidate: pattern (does the strict test hold), two gazetteers (known
   top-level domains, country codes, issuer digits, address ranges; words of four languages that name the kind just before the
   span), context (words before it that speak of versions, orders, pages), and shape (grouping and length).
3. What the span and its surroundings look like is noted as five yes-or-no marks: a colon before it, the start of a line, a
   word joined to its end, groups of digits, a naming word after it.
4. Votes and marks are counted per (kind, form, ballot) over all documents. There are at most `kinds * forms * 3^5 * 2^5` such rows
   whatever the data, so the counts may go to the driver. Expectation-maximisation over them estimates for each kind how often
   each labeler votes each way on true candidates and how often on false ones, and how likely each row is true.
5. A logistic span classifier is trained on those probabilities, with the votes, the marks, the kind and the form as features,
   so marks that no labeler knows carry over from clear candidates to unclear ones. A candidate that is not a base span is
   added if the classifier gives it at least one half and it overlaps no span before it.

The texts are read once; what goes on is one row per document with its candidates. No row meets another except in the
counts, which are added up before the shuffle.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Equal rows get equal spans. Other columns
are not read by `find` and pass through `redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, pieces

KINDS = ("email", "ip", "card", "phone", "ssn")
BASE_KINDS = KINDS[:4]
LABELERS = 5
MARKS = 5
EM_ROUNDS = 50
# What is thought of the labelers before any vote is counted: how they vote (-1, 0, 1) on false and on true candidates. A labeler
# of one direction tells by its silence too. The pattern's silence says nothing: it follows from the form.
PRIOR = (
    ((0.9, 0.0, 0.1), (0.1, 0.0, 0.9)),
    ((0.6, 0.1, 0.3), (0.2, 0.1, 0.7)),
    ((0.0, 0.85, 0.15), (0.0, 0.5, 0.5)),
    ((0.4, 0.6, 0.0), (0.05, 0.95, 0.0)),
    ((0.6, 0.05, 0.35), (0.25, 0.05, 0.7)),
)
PRIOR_VOTES = 10
CLASSIFIER_ROUNDS = 25

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits is tried from its first digit only: a match that starts inside it would start there too.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Signs spelled out (a plain dot stands without spaces, or it ends a sentence) in English, German, French and Spanish.
_AT = r"\[at\]|\(at\)|\{at\}|\(ät\)|\(arroba\)| at | arroba | arobase "
_DOT = r"\[dot\]|\(dot\)|\(punkt\)|\(punto\)|\(point\)| dot | punkt | punto | point "
HAS_AT, HAS_DOT = re.compile(_AT), re.compile(_DOT)
BRACKETED = re.compile(r"[\[({](?:at|ät|arroba)[\])}]")
SPELLED = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} ?(?:{_AT}) ?[A-Za-z0-9-]{{1,63}}(?:(?: ?(?:{_DOT}) ?|\.)[A-Za-z0-9-]{{1,63}}){{1,4}}"
)
LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])")
COLONS = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

# Endings of three letters and more; those of two are countries.
DOMAINS = frozenset("com org net edu gov mil int info biz name pro app dev cloud online shop site store tech blog news mail test example".split())
COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])")
ISSUER = re.compile(r"(?:3[47]|3[068]|4|5[1-5]|2[2-7]|6)")
# Words of English, German, French and Spanish that name a kind, and words that name another number.
NAMING = {
    "email": ("mail", "contact", "write to", "reach", "schreib", "kontakt", "courriel", "écri", "joindre", "correo", "escrib", "contacto"),
    "ip": ("ip", "address", "host", "server", "addr", "adresse", "rechner", "serveur", "hôte", "servidor", "dirección", "gateway", "dns"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "amex", "karte", "zahlung", "carte", "paiement", "tarjeta", "pago", "crédito"),
    "phone": ("phone", "tel", "tél", "call", "mobile", "fax", "contact", "ruf", "handy", "mobil", "appel", "portable", "llam", "móvil", "whatsapp"),
    "ssn": ("ssn", "social security", "taxpayer", "sozialversicherung", "steuer", "sécurité sociale", "seguridad social", "seguro social", "tax id"),
}
AGAINST = re.compile(
    r"(?:version|release|order|invoice|isbn|section|figure|page|chapter|serial|build|sku|part|ticket|item|ref|"
    r"bestellung|rechnung|seite|kapitel|abschnitt|teil|artikel|commande|facture|chapitre|série|pièce|"
    r"pedido|factura|página|capítulo|sección|artículo)(?:\W|no|nr|number|nummer|numéro|número)*$"
)
CONTEXT = 24

# A candidate: (kind, form, start, end, ballot). Form 0 is a base span, 1 a failed base match, 2 a looser form.
Candidate = tuple[int, int, int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: each `@domain` takes the local characters before it, back to the last match."""
    done = 0
    for match in DOMAIN.finditer(text):
        at = start = match.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            done = match.end()
            yield start, done


def base_matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """Every match of a base pattern: kind, start, end, and whether it passes the kind's test."""
    if "@" in text:
        for start, end in emails(text):
            yield 0, start, end, True
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 12:
            yield 2, m.start(), m.end(), 14 <= len(digits) <= 19 and luhn(digits)
    for m in PHONE.finditer(text):
        yield 3, m.start(), m.end(), 10 <= sum(c.isdigit() for c in m[0]) <= 15


def loose_matches(text: str) -> Iterator[tuple[int, int, int]]:
    if HAS_AT.search(text) and (HAS_DOT.search(text) or BRACKETED.search(text)):
        for m in SPELLED.finditer(text):
            if HAS_DOT.search(m[0]) or BRACKETED.search(m[0]):
                yield 0, m.start(), m.end()
    if DIGIT.search(text):
        for kind, pattern in ((1, COLONS), (3, LOCAL_PHONE), (4, SSN)):
            for m in pattern.finditer(text):
                yield kind, m.start(), m.end()


def votes(text: str, kind: int, form: int, start: int, end: int) -> tuple[int, ...]:
    """What each labeler says of a candidate: 1 personal data, -1 not, 0 nothing."""
    span = text[start:end]
    before = text[max(0, start - CONTEXT) : start].lower()
    digits = re.sub("[^0-9]", "", span)
    name = KINDS[kind]
    pattern = (1, -1, 0)[form]
    if name == "email":
        ending = re.sub(r"^.*[.\]) ]", "", span).lower()
        known = 1 if ending in DOMAINS or (len(ending) == 2 and ending.isalpha()) else -1
        shape = 1 if 6 <= len(span) <= 64 else -1
    elif name == "ip":
        first = span.split(".")[0].lstrip("0")
        known = -1 if first in ("", "127", "255") else 1
        shape = 1 if form == 2 or all(p == "0" or not p.startswith("0") for p in span.split(".")) else -1
    elif name == "card":
        known = 1 if ISSUER.match(digits) else -1
        shape = 1 if len(digits) in (14, 15, 16, 19) and len(set(digits)) > 2 else -1
    elif name == "phone":
        known = 0 if form == 2 else 1 if COUNTRY.match(span) else -1
        shape = 1 if len(set(digits)) > 2 and len(digits) >= 10 else -1
    else:
        known = -1 if digits[:3] in ("000", "666") or digits[0] == "9" else 1
        shape = 1 if digits[3:5] != "00" and digits[5:] != "0000" else -1
    naming = 1 if any(w in before for w in NAMING[name]) else 0
    against = -1 if AGAINST.search(before) else 0
    return pattern, known, naming, against, shape


def marks(text: str, kind: int, start: int, end: int) -> int:
    """How the span and its surroundings look, a bit each."""
    before, after = text[max(0, start - 2) : start], text[end : end + CONTEXT]
    seen = (
        ":" in before or "=" in before,
        start == 0 or text[start - 1] == "\n",
        after[:1].isalnum() or after[:1] in ("_", "/"),
        bool(re.search("[0-9][ .:-][0-9]", text[start:end])),
        any(w in after.lower() for w in NAMING[KINDS[kind]]),
    )
    return sum(bit << i for i, bit in enumerate(seen))


def code(ballot: tuple[int, ...], looks: int = 0) -> int:
    """Votes, base 3, and marks as one number."""
    total = 0
    for vote in ballot:
        total = total * 3 + vote + 1
    return total << MARKS | looks


def decode(number: int) -> list[int]:
    """The votes, then the marks."""
    looks, number = [number >> i & 1 for i in range(MARKS)], number >> MARKS
    out = []
    for _ in range(LABELERS):
        out.append(number % 3 - 1)
        number //= 3
    return out[::-1] + looks


def candidates(text: str) -> list[Candidate]:
    """All candidates of a text, base spans first in their order, then the others."""
    good, rest = [], []
    for kind, start, end, passes in base_matches(text):
        (good if passes else rest).append((kind, 0 if passes else 1, start, end))
    rest.extend((kind, 2, start, end) for kind, start, end in loose_matches(text))
    good.sort(key=lambda c: (c[2], c[0]))
    rest.sort(key=lambda c: (c[2], c[0], -c[3]))
    return [(*c, code(votes(text, *c), marks(text, c[0], c[2], c[3]))) for c in good + rest]


def weigh(counts: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Expectation-maximisation: for each (kind, form, ballot, count) the probability that such candidates are true.

    For each kind a labeler has two rows of rates: how it votes on true candidates and how on false ones, silence included. Each
    kind and form has a share of true candidates. It starts from PRIOR, and every rate is estimated with PRIOR_VOTES votes of it
    before the data, so a kind that is seldom seen keeps what is thought of it, and true and false cannot change places.
    """
    ballots = np.array([decode(c[2])[:LABELERS] for c in counts]) + 1
    kind = np.array([c[0] for c in counts])
    group = np.array([c[0] * 3 + c[1] for c in counts])
    n = np.array([c[3] for c in counts], dtype=float)
    prior = np.array(PRIOR)
    rates = np.tile(prior, (len(KINDS), 1, 1, 1))
    share = np.tile((0.95, 0.3, 0.5), len(KINDS))
    start = share.copy()
    for _ in range(EM_ROUNDS):
        log_odds = np.log(share / (1 - share))[group]
        for j in range(LABELERS):
            said = np.log(np.maximum(rates[kind, j, :, ballots[:, j]], 1e-3))
            cast = ballots[:, j] != 1 if j == 0 else True
            log_odds = log_odds + np.where(cast, said[:, 1] - said[:, 0], 0.0)
        truth = 1 / (1 + np.exp(-np.clip(log_odds, -30, 30)))
        share = (np.bincount(group, n * truth, len(share)) + PRIOR_VOTES * start) / (np.bincount(group, n, len(share)) + PRIOR_VOTES)
        for j in range(LABELERS):
            for side, part in enumerate((n * (1 - truth), n * truth)):
                seen = np.bincount(kind * 3 + ballots[:, j], part, 3 * len(KINDS)).reshape(-1, 3) + PRIOR_VOTES * prior[j, side]
                rates[:, j, side] = seen / seen.sum(axis=1, keepdims=True)
    return truth


def features(kind: np.ndarray, form: np.ndarray, ballots: np.ndarray) -> np.ndarray:
    """A constant, the kind, the form, each labeler's vote for and against, and the marks."""
    columns = [np.ones(len(kind))]
    columns += [kind == k for k in range(1, len(KINDS))] + [form == f for f in (1, 2)]
    columns += [ballots[:, j] == v for j in range(LABELERS) for v in (-1, 1)]
    columns += [ballots[:, LABELERS + j] for j in range(MARKS)]
    return np.column_stack(columns).astype(float)


def _features(rows: list[tuple[int, int, int]]) -> np.ndarray:
    return features(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([decode(r[2]) for r in rows]))


def train(counts: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Weights of the span classifier: logistic regression on the probabilities of `weigh`, by Newton steps with a ridge.

    Each kind and form weighs the same in total, so the many base spans do not drown the few looser ones.
    """
    if not counts:
        return np.zeros(1 + len(KINDS) - 1 + 2 + 2 * LABELERS + MARKS)
    # Two unanimous ballots per kind and form, a hundredth of all weight together, teach what the data may never show.
    sure = [(k, f, code((v,) * LABELERS)) for k in range(len(KINDS)) for f in range(3) for v in (-1, 1)]
    x = _features([c[:3] for c in counts] + sure)
    n = np.array([c[3] for c in counts], dtype=float)
    group = np.array([c[0] * 3 + c[1] for c in counts])
    n /= np.bincount(group, n)[group]
    n = np.concatenate([n / n.sum(), np.full(len(sure), 0.01 / len(sure))])
    y = np.concatenate([weigh(counts), [float(v > 0) for _ in range(len(sure) // 2) for v in (-1, 1)]])
    weights = np.zeros(x.shape[1])
    for _ in range(CLASSIFIER_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (n * (p - y)) + 1e-4 * weights
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(weights))
        weights = weights - np.linalg.solve(curve, slope)
    return weights


def accepted(counts: list[tuple[int, int, int, int]]) -> frozenset[tuple[int, int, int]]:
    """Every counted (kind, form, ballot) of no base span that the classifier gives at least one half."""
    rows = [c[:3] for c in counts if c[1]]
    return frozenset(r for r, z in zip(rows, _features(rows) @ train(counts)) if z >= 0) if rows else frozenset()


def choose(found: list[Candidate], allowed: frozenset[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of a text as (start, kind, end): all base spans, and allowed candidates that overlap none before them.

    What is taken is kept as sorted stretches without overlap, so each candidate is looked up by bisection.
    """
    spans = [(start, kind, end) for kind, form, start, end, _ in found if form == 0]
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    for kind, form, start, end, ballot in found:
        if form and (kind, form, ballot) in allowed:
            before = bisect_left(starts, end)
            if not before or ends[before - 1] <= start:
                spans.append((start, kind, end))
                starts.insert(before, start)
                ends.insert(before, end)
    return sorted(spans)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


_PARTS = ("kind", "form", "start", "end", "votes")


def _scan(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`keep` and `found`, the candidates as five parallel lists, one row per document."""
    names = [*keep, *_PARTS]
    kept = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in docs.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = [candidates(t) if t else [] for t in piece.column("text").to_pylist()]
                columns = [pa.array([[c[i] for c in doc] for doc in found], type=pa.list_(pa.int32())) for i in range(5)]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), *columns], names)

    schema = kept + ", ".join(f"`{p}` array<int>" for p in _PARTS)
    return mapped(docs.select(*keep, F.col("text").cast("string").alias("text")), run, schema)


def tally(scanned: DataFrame) -> list[tuple[int, int, int, int]]:
    """How many candidates each (kind, form, ballot) has: at most 5 * 3 * 3^5 * 2^5 rows."""
    zipped = scanned.select(F.explode(F.arrays_zip("kind", "form", "votes")).alias("c"))
    rows = zipped.groupBy("c.kind", "c.form", "c.votes").agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r[0], r[1], r[2], r[3]) for r in rows)


def find(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, base counts and digest, and all spans."""
    scanned = cut(_scan(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), ("doc_id",)), "pii")
    allowed = accepted(tally(scanned))
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_found = [list(zip(*row)) for row in zip(*(batch.column(p).to_pylist() for p in _PARTS))]
            base = [[(start, kind, end) for kind, form, start, end, _ in found if form == 0] for found in docs_found]
            spans = [choose(found, allowed) for found in docs_found]
            counts = [pa.array([sum(s[1] == k for s in b) for b in base], type=pa.int64()) for k in range(len(BASE_KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *counts,
                    pa.array([hashlib.sha256(listed(b).encode()).hexdigest() for b in base], type=pa.string()),
                    pa.array([listed(s) for s in spans], type=pa.string()),
                    pa.array([len(s) - len(b) for s, b in zip(spans, base)], type=pa.int64()),
                ],
                names,
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return mapped(scanned, run, schema)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the kind of its first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All documents with all their columns; spans in `text` replaced by their kind, `n_chars` (if there) the new length.

    Texts without candidates, nearly all, are passed on as they are. The reliabilities are estimated first, then the texts
    are read a second time.
    """
    allowed = accepted(tally(_scan(docs.select("text"), ())))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = [t and masked(t, choose(candidates(t), allowed)) for t in piece.column("text").to_pylist()]
                columns = []
                for name, column in zip(piece.schema.names, piece.columns):
                    if name == "text":
                        column = pa.array(texts, type=column.type)
                    elif name == "n_chars":
                        column = pa.array([None if t is None else len(t) for t in texts]).cast(column.type)
                    columns.append(column)
                yield pa.RecordBatch.from_arrays(columns, piece.schema.names)

    return docs.mapInArrow(run, schema)
