"""Column expressions over log lines: plain text, level, event time. All of it stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import holds

# The levels from low to high, the words that mean one of them, the JSON and logfmt keys that hold one,
# and the shapes of a line that states one.
SEVERITIES = ("debug", "info", "warning", "error", "critical")
SYNONYMS = {"warn": "warning", "fatal": "critical"}
JSON_KEYS = ("level", "severity", "levelname", "log.level", "lvl")
LOGFMT_KEYS = ("level", "lvl")
WORD = r"(DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)"
STAMP = r"\[?\d{2,4}[-/]\d{2}[-/]\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|\s?[+-]\d{2}:?\d{2}|\s?UTC)?\]?\s*"
LEADING = rf"(?:{STAMP}(?:[-|]\s*)?)?(?:{WORD}|\[\s*(?i:{WORD})\s*\])(?=[\s:|\]-]|$)"
PYTHON = rf"{STAMP}- \S+ - {WORD} - "
MARK = "\x01"
OPENING = rf"(?s)^{MARK}(?:{LEADING}|{PYTHON}).*$"
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
# One logfmt token. Every repeat is possessive: the matcher never steps back into a token, so a line of any length is
# read once from left to right, without recursion. A quoted value is one token, whatever it holds.
QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
TOKEN = rf'(?:[A-Za-z_][\w.]*+=(?:{QUOTED}|[^\s"]*+)|{QUOTED}|[^\s"=]++)(?=\s|$)'
LOGFMT_KEY = f"(?:{'|'.join(LOGFMT_KEYS)})="
LOGFMT_LEVEL = rf"^(?:\s*+(?!{LOGFMT_KEY}){TOKEN})*+\s*+{LOGFMT_KEY}({QUOTED}|[^\s\"]*+)(?=\s|$)(?:\s*+{TOKEN})*+$"


def plain(text: Column) -> Column:
    """Text without terminal control sequences."""
    return F.regexp_replace(text, ANSI, "")


def level_name(word: Column) -> Column:
    """The level a word names, or null. Numbers and other words are no level."""
    names = {level: level for level in SEVERITIES} | SYNONYMS
    pairs = [F.lit(part) for pair in names.items() for part in pair]
    return F.try_element_at(F.create_map(*pairs), F.lower(word))


def rank(level: Column) -> Column:
    """0 for debug up to 4 for critical, -1 without a level."""
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), level) - 1, F.lit(-1)).cast("int")


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


# JSON as the standard has it: no single quotes.
JSON_OPTIONS = {"allowSingleQuotes": "false"}


def json_level(text: Column) -> Column:
    """The level a JSON object states, by the first key that holds a known word."""
    fields = F.from_json(text, "map<string, string>", JSON_OPTIONS)
    return bind(fields, lambda m: F.coalesce(*[level_name(F.try_element_at(m, F.lit(key))) for key in JSON_KEYS]))


def opening_level(text: Column) -> Column:
    """A level word that opens the line, or Python logging's third field. A bare word counts in upper case only.

    The line is replaced by the word in one pass; a mark before it keeps a line that does not match from being one."""
    return level_name(F.regexp_replace(F.concat(F.lit(MARK), text), OPENING, "$1$2$3"))


def logfmt_level(text: Column) -> Column:
    """The first top-level `level=` or `lvl=` of a line that is logfmt whole. Any other line has none.

    A cheap search comes first: most lines never reach the whole-line match."""
    candidate = F.when(text.rlike(LOGFMT_KEY), text)
    return level_name(F.regexp_replace(F.regexp_extract(candidate, LOGFMT_LEVEL, 1), '^"|"$', ""))


def level_of(message: Column) -> Column:
    """The level a message states: as JSON, as its opening word, or as logfmt, in that order; null when it states none.

    A JSON object answers for itself, even with no level.
    """

    def stated(text: Column) -> Column:
        # A line with text after the closing brace is no JSON.
        is_object = text.startswith("{") & text.endswith("}") & F.from_json(text, "map<string, string>", JSON_OPTIONS).isNotNull()
        return F.when(is_object, json_level(text)).otherwise(F.coalesce(opening_level(text), logfmt_level(text)))

    return bind(F.regexp_replace(plain(message), r"^\s+|\s+$", ""), stated)


def instant(stamp: Column) -> Column:
    """The time of an ISO stamp, or null. A stamp without an offset is UTC. Microseconds are kept."""
    iso = stamp.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$")
    return F.when(iso, F.translate(stamp, ",", ".").try_cast("timestamp"))


def event_ns(stamp: Column, fallback: Column | None = None) -> Column:
    """Epoch nanoseconds as a whole number: seconds from the time, digits below from the text, so none is lost."""
    chosen = stamp if fallback is None else F.when(instant(stamp).isNotNull(), stamp).otherwise(fallback)
    digits = F.regexp_extract(chosen, r"[.,](\d+)", 1)
    fraction = F.when(digits == "", "0").otherwise(F.rpad(F.substring(digits, 1, 9), 9, "0")).cast("bigint")
    seconds = F.unix_seconds(instant(chosen))
    return F.coalesce(seconds * 1_000_000_000 + fraction, F.lit(-1).cast("bigint"))


def split_stamp(line: Column) -> tuple[Column, Column]:
    """A line cut at its first space: the stamp and the rest."""
    at = F.locate(" ", line)
    rest = F.when(at > 0, F.substring(line, at + 1, F.length(line))).otherwise("")
    return F.substring_index(line, " ", 1), rest


def holds_text(message: Column, text: str) -> Column:
    """Case-folded search."""
    return holds(message, text)
