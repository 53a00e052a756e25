"""Token-id output: whole texts are encoded, ids are packed by Simple-8b into files in ascending order of doc_id, and files are read back."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simple8b
from .common import LAST_ID, arrow_schema, batch, bounded_batches, only, pick, scratch, written
from .staged import get, put

TOKENIZER, END_ID = "word_bpe_49k.json", 1
#: A file is closed when it holds this many ids; a task keeps no more than a file in memory.
FILE_IDS = 4 << 20
MAGIC = b"LFS8B\0\0\2"
#: Words whose ids a worker keeps; at this number it starts anew, so its memory is bounded.
CACHED_WORDS = 400_000
#: Rows encoded at once.
ROWS = 1024

_tokenizers: dict[int, "WordTokenizer"] = {}


class _Words(dict):
    """Numbers of words; an unknown word gets the next one and is noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.new.append(word)
        return i


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(n - len(a), len(a)), a.dtype)])


#: What a word must not have for its pieces to be plain: anything but printable ASCII and Latin letters up to U+024F, apostrophes, U+0130
#: (whose lower case is two characters), or the beginning of a special token.
_ODD = re.compile("[^!-&(-~\xa1-\u012f\u0131-\u024f\n]|<\\|")
#: Pieces of plain words in lower case, one a line.
_PIECES = regex.compile(r"\p{L}+|\p{N}|\n|[^\p{L}\p{N}\n]+")


class WordTokenizer:
    """Encodes texts by a tokenizer that never joins characters across ASCII white space: each word's ids are computed once and kept.

    This holds for word_bpe_49k, whose pre-tokenizer removes white space and whose normalizer maps white space to itself."""

    def __init__(self, json: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(1 + max(names.values()), bool)
        self.ends[[i for t, i in names.items() if t.endswith("</w>")]] = True
        # Letters alone need neither normalizer nor patterns: the model by itself gives their ids faster, if it does.
        from tokenizers import pre_tokenizers

        self.plain = Tokenizer(Tokenizer.from_str(json).model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = "a word of letters é ß ñandú"
        if self.plain.encode(probe).ids != self.tokenizer.encode(probe, add_special_tokens=False).ids:
            self.plain = self.tokenizer
        self.clear()

    def clear(self) -> None:
        self.known = _Words()
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.words, self.used = np.zeros(1 << 18, np.uint32), 0, 0
        #: Ids of pieces as little-endian bytes; they outlive some generations of words.
        self.pieces: dict[str, bytes] = {} if len(self.__dict__.get("pieces", ())) > CACHED_WORDS else self.__dict__.get("pieces", {})

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_pieces(self, found: set[str], whole: set[str]) -> None:
        """Pieces of letters (but not odd words, which are `whole`) go many to a text: the last id of each, and no other, ends a word. The rest go one by one."""
        letters = sorted(p for p in found if p not in whole and p.isalpha())
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        alone = sorted(found.difference(letters))
        for group, listed in zip(groups, self.plain.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(listed.ids, "<u4")
            at = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(at) == len(group):
                raw = ids.tobytes()
                self.pieces.update(zip(group, (raw[a:b] for a, b in zip([0, *at], at, strict=False)), strict=True))
            else:
                alone += group
        self.pieces.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(alone, self._ids(alone), strict=True))

    def _learn(self) -> None:
        """Ids of new words from those of their pieces, which are what the pre-tokenizer makes of them: letters, single digits, other
        characters. Words for which that is not plain (apostrophes, controls, letters beyond Latin, special tokens) are pieces of their own."""
        text = b"\n".join(self.known.new).decode("utf-8", "replace")
        self.known.new.clear()
        words = text.split("\n")
        odd = [i for i, w in enumerate(words) if _ODD.search(w)] if _ODD.search(text) else []
        own = [words[i] for i in odd]
        if odd:
            for i in odd:
                words[i] = "a"  # its place in the list of plain words; what it is replaced by comes after them
            text = "\n".join(words)
        split = _PIECES.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower() + "\n")
        ends = np.flatnonzero(np.fromiter(map("\n".__eq__, split), bool, len(split)))
        counts = np.diff(ends, prepend=-1) - 1
        pieces = [p for p in split if p != "\n"] + own
        begins = np.cumsum(counts) - counts
        begins[odd] = int(counts.sum()) + np.arange(len(odd))
        missing = set(pieces).difference(self.pieces)
        if missing:
            self._learn_pieces(missing, set(own))
        parts = list(map(self.pieces.__getitem__, pieces))
        places = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) // 4)])
        starts = places[begins]
        lengths = places[begins + counts] - starts
        ids = np.frombuffer(b"".join(parts), "<u4")
        n, self.words, end = self.words, self.words + len(counts), self.used + len(ids)
        self.starts, self.lengths, self.flat = _room(self.starts, self.words), _room(self.lengths, self.words), _room(self.flat, end)
        self.lengths[n : self.words] = lengths
        self.starts[n : self.words] = self.used + starts
        self.flat[self.used : end] = ids
        self.used = end

    def encode_all(self, rows: pa.Array | list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, with end_id after each, and the number of each row's. Words are split and numbered within the
        batch by Arrow, so that each of its distinct words is looked up once; the empty word (at a text's edge) has no ids."""
        if not isinstance(rows, pa.Array):
            rows = pa.array([r.encode("utf-8", "replace").decode() for r in rows], pa.string())
        split = pc.ascii_split_whitespace(pc.fill_null(rows, ""))
        if len(self.known) > CACHED_WORDS:
            self.clear()
        counts = np.diff(split.offsets.to_numpy())
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(coded.dictionary.type) else pa.binary()).to_pylist()
        numbers = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        at = numbers[coded.indices.to_numpy()]
        if self.known.new:
            self._learn()
        starts, lengths, flat = self.starts, self.lengths, self.flat
        if end_id is not None:  # one more word, of one id
            flat = _room(flat, self.used + 1)
            flat[self.used] = end_id
            starts, lengths = np.append(starts[: self.words], self.used), np.append(lengths[: self.words], 1)
            at = np.insert(at, np.cumsum(counts), self.words)
            counts = counts + 1
        starts, lengths = starts[at], lengths[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        small = np.int32 if max(total, self.used + 1) < 1 << 31 else np.int64
        ids = flat[np.repeat((starts - (ends - lengths)).astype(small), lengths) + np.arange(total, dtype=small)]
        per = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
        return ids, per


def encoder_of(json: str) -> WordTokenizer:
    """The worker's own, kept from task to task. (A function of the module: a task's closure would carry a copy of the dictionary.)"""
    only("tokens", _tokenizers.clear)
    own = hash(json)
    if own not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[own] = WordTokenizer(json)
    return _tokenizers[own]


def tokenizer_json(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, frequent ones first, and the ids as places in that list: small numbers, of which a word of Simple-8b holds many."""
    if len(ids) and int(ids.max()) < 1 << 22:
        counts = np.bincount(ids)
        distinct = np.flatnonzero(counts)
        distinct = distinct[np.argsort(-counts[distinct], kind="stable")]
        place = np.zeros(len(counts), np.uint32)
        place[distinct] = np.arange(len(distinct), dtype=np.uint32)
        return distinct, place[ids]
    distinct, number, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return distinct[order], place[number]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A file: magic, numbers of documents, ids, blocks and distinct ids; doc_ids, null flags and counts; distinct ids by descending frequency;
    block offsets; words of the ids' places in that list. All little-endian."""
    distinct, places = _ranked(ids)
    words, offsets = simple8b.encode(places)
    head = MAGIC + struct.pack("<QQQQ", len(doc_ids), len(ids), len(offsets) - 1, len(distinct))
    nulls = np.array([i is None for i in doc_ids], np.uint8)
    parts = [np.array([0 if i is None else i for i in doc_ids], "<i8"), nulls, counts.astype("<i8"), distinct.astype("<u8"), offsets.astype("<i8"), words.astype("<u8")]
    return b"".join([head, *(x.tobytes() for x in parts)])


def unpack(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a token file of this format and version")
    docs, n, blocks, kinds = struct.unpack_from("<QQQQ", raw, len(MAGIC))
    at = len(MAGIC) + 32

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(raw, kind, count, at)
        at += found.nbytes
        return found

    doc_ids, nulls, counts, distinct, offsets = take("<i8", docs), take("u1", docs), take("<i8", docs), take("<u8", kinds), take("<i8", blocks + 1)
    words = take("<u8", int(offsets[-1]))
    ids = distinct[simple8b.decode(words, offsets, n).view(np.int64)]
    return [None if x else i for i, x in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], counts, ids


MANIFEST = "part long, seq long, path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes token files into folder and returns their manifest, itself a table in it. Files in the order of (part, seq) hold the documents
    in ascending order of doc_id, nulls last; rows of one doc_id are ordered by their text's hash, so a common doc_id may span files."""
    spark = docs.sparkSession
    bounded_batches(spark)
    json = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    schema = arrow_schema(MANIFEST)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(json.value)
        part, seq = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        counts: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq
            all_ids, all_counts = np.concatenate(ids), np.concatenate(counts)
            path = put(f"{folder}/files", f"tokens-{part:06d}-{seq:06d}.bin", pack(doc_ids, all_counts, all_ids))
            row = batch([[part], [seq], [path], [len(doc_ids)], [len(all_ids)]], schema)
            seq += 1
            doc_ids.clear(), counts.clear(), ids.clear()
            return row

        for b in batches:
            for low in range(0, len(b), ROWS):
                got, per = encoder.encode_all(b.column(1).slice(low, ROWS), end_id)
                ids.append(got)
                counts.append(per)
                doc_ids += b.column(0).slice(low, ROWS).to_pylist()
                if sum(map(len, ids)) >= FILE_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    rows = pick(docs, doc_id="long", text="string")
    order = (F.coalesce("doc_id", F.lit(LAST_ID)), F.col("doc_id").isNull(), F.xxhash64("text"), F.monotonically_increasing_id())
    ordered = rows.select("doc_id", "text", *[c.alias(f"o{i}") for i, c in enumerate(order)])
    keys = [f"o{i}" for i in range(len(order))]
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return written(ordered.mapInArrow(write, MANIFEST), f"{folder}/manifest")


TOKENS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document of the files, decoded from them: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    schema = arrow_schema(TOKENS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                doc_ids, counts, ids = unpack(get(path))
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield batch([doc_ids, base + ends - counts, counts, crc], schema)

    # One row a file: the running sum is over the manifest only.
    before = manifest.select("path", (F.sum("n_ids").over(Window.orderBy("part", "seq")) - F.col("n_ids")).alias("base"))
    spread = before.repartition(max(1, manifest.count()), "path")
    return spread.mapInArrow(read, TOKENS)


def token_output(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as token files and returns, per row, what the files say. A null or empty text has the end id alone; null doc_ids come last;
    repeated rows are documents of their own; an empty table writes no file and gives no rows."""
    return read_tokens(write_tokens(docs, folder or scratch(docs.sparkSession, "tokens"), tokenizer))
