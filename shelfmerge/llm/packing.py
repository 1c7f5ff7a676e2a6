"""Concatenate-and-cut packing of tokenized documents into fixed windows.

First pass: every task tokenizes its rows, keeps the running token count inside
its part and writes ids, part and count to a shared table. A prefix sum over the
parts' totals then gives each part its global offset. Second pass, over the
written table: a document's global offset is known from its own row, so it is
cut at the multiples of the window without any exchange; a document that crosses
such a boundary leaves one piece on either side.

Defined results: null text is empty and has only the closing id; repeated rows
are packed each; the last window alone may hold fewer ids than the others; an
empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmerge.llm.common import in_text_batches, materialise, per_worker

WINDOW = 2048
END_ID = 1
#: Words that a worker remembers at most; then it starts afresh.
CACHE_WORDS = 500_000
#: A letter and the run of marks that ends its word. Arrow matches bytes: the second
#: choice is a lower-case Latin letter of two.
MARKS = r"([a-z]|\xC3[\xA0-\xB6\xB8-\xBF])([.,;:!?]+)(?:[ \n]|$)"

# The parts of a tokenizer file under which words may be encoded one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def by_words(config: dict) -> bool:
    """Whether the tokenizer treats words as WordEncoder assumes; else texts are encoded whole."""
    model = config["model"]
    return (
        config["normalizer"] == NORMALIZER
        and config["pre_tokenizer"] == PRE_TOKENIZER
        and not config["post_processor"]
        and not config["truncation"]
        and model["type"] == "BPE"
        and not model["dropout"]
        and not model["ignore_merges"]
        and all(t["content"].startswith("<|") for t in config["added_tokens"])
    )


#: Words of Latin letters are one pre-token and stay as they are when normalized, so the
#: tokenizer's merges can be asked directly; it names the two bytes of an accented letter
#: by the characters of their codes, those from 0x80 to 0xA0 and 0xAD by ones past 0xFF.
LATIN = re.compile("[a-zA-ZÀ-ÖØ-öø-ÿ]+")
SIGNS = [c for c in range(256) if not (33 <= c <= 126 or 161 <= c <= 172 or c >= 174)]
BYTE_SIGNS = {c: "".join(chr(256 + SIGNS.index(b)) if b in SIGNS else chr(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Token ids by white-space separated word, each kind of word encoded once.

    The tokenizer lowers letters, and never joins text across white space, nor a
    letter with a mark; so texts may be lowered and marks set apart beforehand,
    which leaves few kinds of words, and the ids of a text are those of its words
    in order. Only its own special strings, ``<|...|>``, it looks up unlowered:
    texts with ``<|`` are encoded as they are. So are all texts where the file's
    normalizer, pre-tokenizer or model is another.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = np.zeros(1 << 20, np.uint32)
        self.end = np.zeros(1 << 16, np.int64)
        if self.by_words:
            self.learn([""])

    def learn(self, fresh: list[str]) -> None:
        """Appends the ids of unseen words to the store."""
        plain = [bool(LATIN.fullmatch(w)) for w in fresh]
        rest = iter(self.tokenizer.encode_batch_fast([w for w, p in zip(fresh, plain, strict=True) if not p], add_special_tokens=False))
        merge = self.tokenizer.model.tokenize
        found = [
            [t.id for t in merge(w.lower().translate(BYTE_SIGNS))] if p else next(rest).ids
            for w, p in zip(fresh, plain, strict=True)
        ]
        at = len(self.place)
        used = int(self.end[at - 1]) if at else 0
        ends = used + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.end) < at + len(fresh):
            self.end = np.concatenate([self.end, np.zeros_like(self.end)])
        self.flat[used : ends[-1]] = np.fromiter(chain.from_iterable(found), np.uint32, int(ends[-1]) - used)
        self.end[at : at + len(fresh)] = ends
        self.place.update(zip(fresh, range(at, at + len(fresh)), strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.by_words:
            found = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([*found, np.zeros(0, np.uint32)]), np.fromiter(map(len, found), np.int64, len(found))
        texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower misreads slices
        odd = pc.match_substring(texts, "<|")
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), MARKS, r"\1 \2 ")
        lists = pc.ascii_split_whitespace(pc.if_else(odd, "", plain))
        codes = lists.flatten().dictionary_encode()
        values = codes.dictionary.to_pylist()
        if len(self.place) > CACHE_WORDS:
            self.forget()
        place = self.place
        if fresh := [v for v in values if v not in place]:
            self.learn(fresh)
        kind = np.fromiter(map(place.__getitem__, values), np.int64, len(values))
        first = np.where(kind > 0, self.end[kind - 1], 0)
        size = self.end[kind] - first
        code = codes.indices.to_numpy(zero_copy_only=False)
        per_word = size[code]
        ends = np.cumsum(per_word)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.flat)) < 2**31 else np.int64
        at = np.repeat((first[code] - (ends - per_word)).astype(kind), per_word)
        at += np.arange(total, dtype=kind)
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets)]
        ids, sizes = self.flat[at], np.diff(bounds)
        if pc.any(odd).as_py():
            parts = np.split(ids, bounds[1:-1])
            for k in np.nonzero(odd.to_numpy(zero_copy_only=False))[0].tolist():
                parts[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return ids, sizes


def tokenize(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Per row: doc_id, part, start_in_part, ids (with the closing id); materialised."""
    schema = "doc_id bigint, part int, start_in_part bigint, ids array<int>"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return materialise(in_text_batches(rows, token_rows(path or tokenizer_path(), end_id), schema), "tokens")


def token_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        encoder = per_worker("word-encoder", path, lambda: WordEncoder(path))
        for batch in batches:
            ids, sizes = encoder.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)
            offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(at + offsets[:-1]),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                ],
                ["doc_id", "part", "start_in_part", "ids"],
            )
            at += int(offsets[-1])

    return run


def part_offsets(tokens: DataFrame) -> dict[int, int]:
    """Global offset of each part: prefix sums over one total for each task of the first pass.

    These numbers, 16 bytes a task, are all that reaches the driver: 16 MB for a million
    tasks, that is for some 128 TB in tasks of 128 MB.
    """
    totals = tokens.groupBy("part").agg(F.sum(F.size("ids")).alias("n")).orderBy("part").collect()
    out, at = {}, 0
    for r in totals:
        out[r.part], at = at, at + r.n
    return out


PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def pack(docs: DataFrame, window: int = WINDOW, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: its place in the document and in its sequence, checksum, and its ids."""
    tokens = tokenize(docs, path)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    return tokens.mapInArrow(cutter(part_offsets(tokens), window, with_ids), schema)


def cutter(base: dict[int, int], window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            bounds = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
            size = np.diff(bounds)
            part = batch.column("part").to_numpy()
            place = batch.column("start_in_part").to_numpy() + np.array([base[p] for p in part.tolist()], np.int64)
            n = (place + size - 1) // window - place // window + 1
            row = np.repeat(np.arange(len(size)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            sequence = place[row] // window + nth
            begin = np.maximum(sequence * window, place[row])
            end = np.minimum((sequence + 1) * window, place[row] + size[row])
            start = begin - place[row]
            lo, hi = bounds[row] + start, bounds[row] + end - place[row]
            crc = [zlib.crc32(ids[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            columns = [
                batch.column("doc_id").take(pa.array(row)),
                pa.array(start),
                pa.array(end - begin),
                pa.array(crc, pa.int64()),
                pa.array(size[row]),
                pa.array(sequence),
                pa.array(begin - sequence * window),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def packing_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """pack() with production parameters, without the ids."""
    return pack(docs, with_ids=False)
