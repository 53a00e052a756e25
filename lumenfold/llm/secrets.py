"""Secrets in texts: patterns of known forms, and strings near sensitive words that their surroundings do not explain.

Novelty is measured by compression: a candidate's marginal bytes are what zstandard, primed with a dictionary of identifiers, needs for the text
around it with the candidate, less what it needs without. How many that are depends on those surroundings too, so they are held against the marginal
bytes of the same characters shuffled: words and names cost clearly less than their characters in disorder, as they are copied from the dictionary
or the surroundings; a random string costs the same."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, batch, bounded_batches, cut, pick, texts

#: Kinds in the order of the results; the first three are the base kinds.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Bytes by class, for a quick look whether a text holds a run of hexadecimal digits.
_HEX_CLASS = bytes(49 if chr(c) in "0123456789abcdef" else 48 for c in range(256))
_HEX_RUN = b"1" * LEAST["hex"]

#: Words (lower case) that make a string after them sensitive, within SENSITIVE_CHARS.
SENSITIVE = ("password", "passwd", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "private", "signature", "session", "cookie")
SENSITIVE_CHARS = 48
#: Characters of the surroundings on either side that a candidate is compressed with.
AROUND = 256
#: A candidate is reported if its marginal bytes are at least LEAST_BYTES a character, and NOVEL times those of its characters in SHUFFLES orders (median).
LEAST_BYTES, NOVEL, SHUFFLES = 0.4, 0.9, 3
#: Letters that a candidate has at least, besides one digit.
LEAST_LETTERS = 4
#: Words of the corpus in the dictionary at most; they have to be in texts of so many of 64 classes by hash, so that copies of a text count once.
MOST_IDENTIFIERS, LEAST_CLASSES = 4096, 32

#: Names common in source code and configuration.
IDENTIFIERS = (
    "access", "account", "address", "api", "app", "application", "args", "array", "async", "auth", "authorization", "await", "base64", "bearer", "boolean", "bucket",
    "build", "cache", "callback", "catch", "certificate", "class", "client", "cloud", "code", "config", "connection", "const", "content", "context", "cookie", "count",
    "create", "credentials", "data", "database", "date", "debug", "default", "delete", "deploy", "dev", "digest", "docker", "email", "enabled", "endpoint", "env",
    "environment", "error", "event", "example", "export", "false", "file", "function", "get", "github", "group", "handler", "hash", "header", "host", "http", "https",
    "id", "image", "import", "index", "input", "install", "instance", "integer", "interface", "internal", "item", "json", "key", "label", "length", "library", "list",
    "local", "localhost", "log", "login", "main", "message", "method", "model", "module", "name", "namespace", "network", "node", "none", "null", "number", "object",
    "option", "output", "package", "param", "password", "path", "port", "print", "private", "process", "profile", "project", "properties", "protected", "provider",
    "public", "query", "queue", "random", "region", "release", "remote", "request", "resource", "response", "result", "return", "role", "route", "schema", "secret",
    "security", "self", "server", "service", "session", "set", "setting", "signature", "source", "staging", "static", "status", "storage", "string", "table", "target",
    "task", "template", "test", "time", "timeout", "timestamp", "token", "true", "type", "undefined", "update", "url", "user", "username", "util", "value", "variable",
    "version", "view", "void", "worker", "yaml",
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    novelty: float | None


def identifiers(docs: DataFrame, most: int = MOST_IDENTIFIERS, least_classes: int = LEAST_CLASSES) -> list[str]:
    """The corpus' most frequent words of 3 to 24 letters by number of rows, ties by the word; counted over all whole texts and combined before the
    exchange. A list of bounded size. Words have letters of one case, or a capital first."""
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64("text"), F.lit(64)).cast("int"))
    words = pick(docs, text="string").where("text is not null").select(mark.alias("mark"), F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("word"))
    counted = words.where(F.char_length("word").between(3, 24)).groupBy("word").agg(F.count("*").alias("n"), F.bit_or("mark").alias("marks"))
    wordlike = F.col("word").rlike("^([a-z]+|[A-Z]+|[A-Z][a-z]+)$")
    size = F.floor(16 * F.log2("n")).cast("int")
    known = cut(counted.where((F.bit_count("marks") >= least_classes) & wordlike).select("word", "n", size.alias("size")), "identifiers")
    # by sizes of counts, a thousand at most, it is known how frequent words have to be; no others are sent to the driver
    least, met = 0, 0
    for r in sorted(known.groupBy("size").agg(F.count("*").alias("words")).collect(), reverse=True):
        least, met = r["size"], met + r["words"]
        if met >= most:
            break
    return [r["word"] for r in known.where(F.col("size") >= least).orderBy(F.desc("n"), "word").limit(most).collect()]


class Novelty:
    """Marginal bytes under a raw dictionary of identifiers: those last in it are the nearest, so the most frequent come last. Case is ignored."""

    def __init__(self, words: Sequence[str] = ()) -> None:
        content = " ".join([*reversed(words), *IDENTIFIERS]).lower().encode()
        primed = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=6)
        self._of = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self._of.compress(text.lower().encode("utf-8", "surrogatepass")))

    def __call__(self, text: str, start: int, end: int) -> float:
        """Marginal bytes of text[start:end] as a share of those of its characters shuffled; 0 if they are few anyway."""
        around, own = text[max(0, start - AROUND) : start] + text[end : end + AROUND], text[start:end]
        least = self.size(around)
        marginal = self.size(around + own) - least
        if marginal < LEAST_BYTES * len(own):
            return 0.0
        shuffled = []
        for seed in range(SHUFFLES):
            letters = list(own)
            random.Random(seed).shuffle(letters)
            shuffled.append(self.size(around + "".join(letters)) - least)
        return marginal / max(1, sorted(shuffled)[SHUFFLES // 2])


def base_spans(text: str) -> list[Span]:
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [Span("assign", *m.span(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [Span("access", *m.span(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _HEX_RUN in text.encode("utf-8", "surrogatepass").translate(_HEX_CLASS):
        found += [Span("hex", *m.span(), None) for m in _HEX.finditer(text)]
    return found


def find_secrets(text: str | None, novelty: Novelty) -> list[Span]:
    """All spans by start, then kind. None and "" have none. Candidates are runs of 16 characters and more with letters and digits, after a sensitive
    word, that touch no base span; each costs a bounded part of the text around it, so a text takes linear time."""
    if not text:
        return []
    found = base_spans(text)
    low = text.lower()
    if any(k in low for k in SENSITIVE):
        taken = sorted((s.start, s.end) for s in found)
        reach, at = 0, 0  # the furthest end of spans that start before the candidate's end
        for m in _LONG.finditer(text):
            a, b = m.span()
            while at < len(taken) and taken[at][0] < b:
                reach = max(reach, taken[at][1])
                at += 1
            near = text[max(0, a - SENSITIVE_CHARS) : a].lower()
            if reach > a or not any(k in near for k in SENSITIVE):
                continue
            run = m.group()
            if sum(map(str.isalpha, run)) < LEAST_LETTERS or not any(map(str.isdigit, run)):
                continue
            value = novelty(text, a, b)
            if value >= NOVEL:
                found.append(Span("novel", a, b, value))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def _joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _mapped(docs: DataFrame, ddl: str, row: Callable[[list[Span]], tuple]) -> DataFrame:
    """doc_id and row(spans) of every whole text, in one map without shuffle."""
    known, schema = identifiers(docs), arrow_schema(ddl)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known)
        for b in batches:
            made = [row(find_secrets(t, novelty)) for t in texts(b.column(1))]
            yield batch([b.column(0), *map(list, zip(*made, strict=True))] if made else [[] for _ in schema], schema)

    bounded_batches(docs.sparkSession)
    return pick(docs, doc_id="long", text="string").mapInArrow(scan, ddl)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and its spans (code points, end exclusive; novelty of the kind "novel" alone), by start and kind.

    A null or empty text has none; a null doc_id stays null; repeated rows give repeated rows; an empty table gives none. The dictionary comes from
    all texts of docs, so what is novel is so in that table."""
    return _mapped(docs, "doc_id long, spans array<struct<kind string, start int, end int, novelty double>>", lambda spans: ([s._asdict() for s in spans],))


def secret_digest(docs: DataFrame) -> DataFrame:
    """The spans of secret_spans() as counts of the base kinds, a digest of the base spans, and all spans and novelties as text."""

    def row(spans: list[Span]) -> tuple:
        base = [s for s in spans if s.kind in BASE_KINDS]
        counts = [sum(s.kind == k for s in base) for k in BASE_KINDS]
        return (*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), ",".join(f"{s.novelty:.2f}" for s in spans if s.novelty is not None))

    return _mapped(docs, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, novelties string", row)
