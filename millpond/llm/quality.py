"""Line-first cleaning (operator 5): rules judge each line, failing lines go, and a document losing too much text is rejected.

A line is what stands between line feeds; only lines with a word are judged. A line fails if

- punctuation: over 30 % of its characters outside white space are symbols or marks of the ASCII range, or it has
  fewer than three words, fewer than ten characters of scripts written in three bytes (most without spaces), and does not end a
  sentence of any script;
- navigation: it has at least three parts between bars or pointers (`|`, `>`, `»`, `•`), or three words at least that are
  all words of menus;
- boilerplate: it holds one of the fixed phrases of notices and forms.

In a line of over 300 characters outside white space, bars and phrases are prose that mentions them: there they fail the line only
if the bars, or the words of its phrases, are at least a fifth as many as its words.

A document is kept if it passes the base rules (ten words at least; at most a fifth of its words in five-word windows that
come twice) and its failing lines hold at most half of the characters of its words. All counts are taken by vector
operations over whole texts in pieces of about a megabyte; nothing is shuffled.

Null and empty texts have no words, fail the base rules and are cleaned to the empty text. Repeated rows are judged alike,
each on its own. Other columns, whatever their names, are left out of `measure` and pass through `clean`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import mapped, pieces, raw, run_lengths, starts_of
from .words import LOWER, Words, combine, fold_hash, tokenize, windows

MIN_WORDS = 10
REPEAT_PERCENT = 20
MARK_PERCENT = 30
SHORT_LINE = 3
MENU_PARTS = 3
LOST_PERCENT = 50
LONG_LINE = 300
SHARE_PERCENT = 20
WIDE_CHARS = 10

MENU_WORDS = (
    b"home about contact login logout register search menu sitemap help faq blog news shop cart account "
    b"subscribe next previous back top share print archive categories tags"
).split()
PHRASES = (
    b"all rights reserved", b"terms of service", b"terms of use", b"privacy policy", b"cookie policy",
    b"we use cookies", b"accept cookies", b"enable javascript", b"click here", b"read more", b"sign up now",
    b"subscribe to our", b"follow us on", b"share this", b"skip to content", b"lorem ipsum",
)
MENU_HASHES = tokenize(MENU_WORDS).hash

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
# ASCII characters that are neither letters, digits nor white space.
MARK = np.zeros(256, dtype=bool)
MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
BAR = np.zeros(256, dtype=bool)
BAR[list(b"|>")] = True
SENTENCE_END = np.zeros(256, dtype=bool)
SENTENCE_END[list(b".!?:;\"')")] = True
# Ends of sentences and quotes outside ASCII, by their last three bytes; those of two bytes by these.
WIDE_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "。！？．：；…”’」』》】）｡।॥።။។‼⁇⁈⁉"])
SLIM_ENDS = np.array([int.from_bytes(c.encode(), "big") for c in "؟؛۔։"])
# Bytes that begin a character of U+0800 to U+1FFF or U+3000 to U+DFFF: Indic, Thai, Khmer, kana, Chinese, Hangul and others.
WIDE = np.zeros(256, dtype=bool)
WIDE[[0xE0, 0xE1, *range(0xE3, 0xEE)]] = True
# Bytes that begin a character.
LEAD = np.zeros(256, dtype=bool)
LEAD[:128] = True
LEAD[192:] = True

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
VERDICTS = f"{MEASURES}, n_lines long, n_failed_lines long, failed_chars long, kept boolean"


def _sums(flags: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])


def repeated_words(words: Words, size: int = 5) -> np.ndarray:
    """Per text, its words inside windows of `size` words that the text holds twice or more."""
    keys, first = windows(words, size)
    covered = np.zeros(len(words.hash) + 1, dtype=np.int64)
    if len(first):
        keys = combine([keys, words.doc[first].astype(np.uint64)])
        order = np.argsort(keys)
        start, length = run_lengths(starts_of(keys[order]))
        twice = first[order[np.repeat(length > 1, length)]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + size, -1)
    return np.bincount(words.doc[np.cumsum(covered[:-1]) > 0], minlength=len(words.offsets) - 1)


def judge(texts: list[bytes]) -> dict[str, np.ndarray]:
    """All counts and verdicts of some texts, and of their lines with a word (keys that begin with `line_`)."""
    n = len(texts)
    exact = tokenize(texts, lower=False)
    buf, offsets = exact.buf, exact.offsets
    counts = exact.counts
    leads = _sums(LEAD[buf])
    chars = leads[exact.end] - leads[exact.start]
    symbols = _sums(SYMBOL[buf])

    # Lines end at a line feed or at the byte that closes a text.
    end = np.union1d(np.flatnonzero(buf == 10), offsets[1:] - 1)
    start = np.concatenate([[0], end[:-1] + 1])
    line = np.searchsorted(end, exact.start)
    line_words_all = np.bincount(line, minlength=len(end))
    line_chars = np.bincount(line, weights=chars, minlength=len(end)).astype(np.int64)
    real = np.flatnonzero(line_words_all)
    start, end, line_words, line_chars = start[real], end[real], line_words_all[real], line_chars[real]
    owner = np.searchsorted(offsets, start, side="right") - 1
    number = (np.cumsum(line_words_all > 0) - 1)[line]

    keys = combine([fold_hash(buf, start, end), owner.astype(np.uint64)])
    order = np.argsort(keys)
    later = np.zeros(len(keys), dtype=bool)
    later[order] = ~starts_of(keys[order])

    marks = _sums(MARK[buf])
    last = np.zeros(len(real), dtype=np.int64)
    last[number] = exact.end - 1
    failed = 100 * (marks[end] - marks[start]) > MARK_PERCENT * line_chars
    wide = _sums(WIDE[buf])
    few = (line_words < SHORT_LINE) & (wide[end] - wide[start] < WIDE_CHARS)
    failed |= few & ~SENTENCE_END[buf[last]] & ~_ends_wide(buf, last)
    bars = _sums(BAR[buf])
    parts = bars[end] - bars[start]

    lowered = LOWER[buf]
    text = lowered.tobytes()
    menu = np.isin(fold_hash(lowered, exact.start, exact.end), MENU_HASHES)
    failed |= (line_words >= MENU_PARTS) & (np.bincount(number[menu], minlength=len(real)) == line_words)
    for sign in ("»".encode(), "•".encode()):
        parts += _hits(text, sign, start, len(real))
    long = line_chars > LONG_LINE
    share = SHARE_PERCENT * line_words
    failed |= (parts >= MENU_PARTS - 1) & (~long | (100 * parts >= share))
    said = np.zeros(len(real), dtype=np.int64)
    for phrase in PHRASES:
        if phrase in text:
            said += _hits(text, phrase, start, len(real)) * len(phrase.split())
    failed |= (said > 0) & (~long | (100 * said >= share))

    total = np.bincount(exact.doc, weights=chars, minlength=n).astype(np.int64)
    lost = np.bincount(owner, weights=line_chars * failed, minlength=n).astype(np.int64)
    repeats = repeated_words(exact)
    base = (counts < MIN_WORDS) | (100 * repeats > REPEAT_PERCENT * counts)
    return {
        "n_words": counts,
        "word_chars": total,
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": np.bincount(owner[later], minlength=n),
        "n_repeat_words": repeats,
        "base_failed": base,
        "n_lines": np.bincount(owner, minlength=n),
        "n_failed_lines": np.bincount(owner[failed], minlength=n),
        "failed_chars": lost,
        "kept": ~base & (100 * lost <= LOST_PERCENT * total),
        "line_doc": owner,
        "line_start": start - offsets[owner],
        "line_end": end - offsets[owner],
        "line_failed": failed,
    }


def _ends_wide(buf: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the character whose last byte is at `last` ends a sentence and is not ASCII."""
    c = [buf[np.maximum(last - back, 0)].astype(np.int64) for back in range(3)]
    pair = c[1] << 8 | c[0]
    return np.isin(c[2] << 16 | pair, WIDE_ENDS) | np.isin(pair, SLIM_ENDS)


def _hits(text: bytes, what: bytes, start: np.ndarray, n: int) -> np.ndarray:
    """How often `what` begins in each line; a find per hit."""
    found, at = [], text.find(what)
    while at >= 0:
        found.append(at)
        at = text.find(what, at + 1)
    line = np.searchsorted(start, np.array(found, dtype=np.int64), side="right") - 1
    return np.bincount(line[line >= 0], minlength=n)


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, the base counts, and the verdict of the line rules."""
    kinds = [c.split() for c in VERDICTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                got = judge(raw(piece.column("text")))
                kind = {"long": pa.int64(), "boolean": pa.bool_()}
                columns = [pa.array(got[name], type=kind[k]) for name, k in kinds]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *columns], ["doc_id", *(name for name, _ in kinds)])

    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text"), run, f"doc_id long, {VERDICTS}")


def cleaned(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without some of its lines, each with the line feed after it."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end + 1
    kept.append(text[at:])
    return b"".join(kept)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns; `text` without failing lines, `n_chars` (if there) its new length."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts = raw(piece.column("text"))
                got = judge(texts)
                spans: dict[int, list[tuple[int, int]]] = {}
                bad = np.flatnonzero(got["line_failed"] & got["kept"][got["line_doc"]])
                for doc, lo, hi in zip(got["line_doc"][bad].tolist(), got["line_start"][bad].tolist(), got["line_end"][bad].tolist()):
                    spans.setdefault(doc, []).append((lo, hi))
                for doc, cuts in spans.items():
                    texts[doc] = cleaned(texts[doc], cuts)
                out = pa.array([t.decode("utf-8", "replace") for t in texts], type=pa.string())
                columns = []
                for name, column in zip(piece.schema.names, piece.columns):
                    if name == "text":
                        column = out
                    elif name == "n_chars":
                        column = pc.utf8_length(out).cast(column.type)
                    columns.append(column)
                whole = pa.RecordBatch.from_arrays(columns, piece.schema.names)
                yield whole.filter(pa.array(got["kept"]))

    return docs.mapInArrow(run, schema)
