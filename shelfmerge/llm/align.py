"""Alignment of two tokenizers by an associative monoid of fragments.

A byte range of a text yields a fragment: the tokens up to the first byte at which
tokens of both kinds end (open prefix), the groups between such bytes (closed), and the
tokens after the last one (open suffix). Two neighbours compose by closing the left
suffix and the right prefix into one group; that is associative, so the fragments of a
very long text are composed in a tree of Spark tasks, wherever its ranges were cut.

Inside a range the fragments are those of words. Both tokenizers end a token where a
space follows a character that is no white space, so a word, with its space before it,
is a fragment without open ends, worked out once per worker. Tasks write their
documents as bags of words in blocks. A pair's count is summed over the blocks' own
counts; each block then asks for the counts of its distinct pairs, so what is shuffled
are distinct pairs of blocks and compact documents, not the pairs of every document.
Texts of more than RANGE bytes are cut into ranges, dealt out on their own; a pair that
several of its ranges hold still counts once for the document.

Defined results: null and empty texts, and texts whose joined bytes of either kind are
not a space and the text, have no tokens: zeros and an empty digest. Repeated rows are
documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmerge.llm.common import in_text_batches, materialise, per_worker
from shelfmerge.llm.words import text_bytes

#: Bytes of a text in one range; longer texts are cut.
RANGE = 1 << 16
#: Bytes without a safe cut after which a range goes on to the next one.
STRETCH = 1 << 12
#: Fragments composed by one task of a level.
FAN = 64
#: Text bytes in a block; words that a worker remembers before it starts afresh.
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 150_000
#: Counts told to a block in one row.
ANSWERS = 4096

#: Where both tokenizers end a token: after a visible character, before a space.
SAFE = re.compile(r"(?<=\S)(?= )")
# Fixed value: how the byte-level tokenizer parts words.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts that single spaces do not cut into such words: white space before a space, a space in front, or the sign that stands for a space.
ODD = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}] |^ |\x{2581}"


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_of_sign() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


@dataclass
class Fragment:
    """Tokens of a byte range: lists of ids of either kind. Without a common end (cut) all are in the prefix."""

    cut: bool = False
    head: tuple[list, list] = field(default_factory=lambda: ([], []))
    closed: list = field(default_factory=list)
    tail: tuple[list, list] = field(default_factory=lambda: ([], []))


def joined(x: tuple[list, list], y: tuple[list, list]) -> tuple[list, list]:
    return x[0] + y[0], x[1] + y[1]


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of x's range and y's after it."""
    if not x.cut:
        return Fragment(y.cut, joined(x.head, y.head), y.closed, y.tail)
    if not y.cut:
        return Fragment(True, x.head, x.closed, joined(x.tail, y.head))
    met = joined(x.tail, y.head)
    return Fragment(True, x.head, x.closed + ([met] if met[0] or met[1] else []) + y.closed, y.tail)


def fragment(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> Fragment:
    """Of the (end, id) of a range's tokens."""
    ends = sorted({e for e, _ in a} & {e for e, _ in b})
    if not ends:
        return Fragment(head=([i for _, i in a], [i for _, i in b]))
    groups = [([], []) for _ in range(len(ends) + 1)]
    for kind, tokens in enumerate((a, b)):
        for e, i in tokens:
            groups[int(np.searchsorted(ends, e))][kind].append(i)
    return Fragment(True, groups[0], groups[1:-1], groups[-1])


def shown(group: tuple[list, list]) -> str:
    return ",".join(map(str, group[0])) + "|" + ",".join(map(str, group[1]))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... for size[k] numbers, one k after another."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def offsets(size: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


class Aligner:
    """Words with the groups and pairs of their tokens, each worked out once."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a_path, self.whole = a_path, None
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            config = json.load(f)
        signs, special = byte_of_sign(), {t["content"] for t in config["added_tokens"]}
        self.a_bytes = [b""] * (1 + max(config["model"]["vocab"].values()))
        for token, i in config["model"]["vocab"].items():
            self.a_bytes[i] = b"" if token in special else bytes(signs[c] for c in token)
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        ]
        self.blank = self.b.piece_to_id("▁")
        self.by_words = cut_by_words(a_path, b_path)
        self.fast = self.ranked(config["model"]) if self.by_words else None
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.forget()

    def ranked(self, model: dict):
        """The first tokenizer by ranks, where its merges come in the order of their ids; else None."""
        import tiktoken

        for k, merge in enumerate(model["merges"]):
            x, y = merge.split(" ") if isinstance(merge, str) else merge
            if model["vocab"].get(x + y) != 256 + k:
                return None
        ranks = {x: i for i, x in enumerate(self.a_bytes) if x}
        return tiktoken.Encoding("a", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(model["merges"]) else None

    def encode_a(self, words: list[str]) -> list[list[int]]:
        """By the tokenizer itself."""
        if self.whole is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.a_path)
            self.whole.encode_special_tokens = True
        return [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.text: list[str] = []
        self.good = np.zeros(0, bool)
        self.sums = np.zeros((0, 4), np.int64)
        self.pair_at = np.zeros(1, np.int64)
        self.pair, self.mult = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode_b(self, words: list[str]) -> list[list[int]]:
        """Of words that begin with a space; the tokenizer puts that space there itself."""
        b = self.b.encode([w[1:] for w in words], num_threads=1)
        return [[self.blank] if w == " " else x for w, x in zip(words, b, strict=True)]

    def fits(self, word: str, a: list[int], b: list[int]) -> bool:
        raw = word.encode()
        return b"".join([self.a_bytes[i] for i in a]) == raw == b"".join([self.b_bytes[i] for i in b])

    def ends(self, word: str) -> tuple[bool, list[tuple[int, int]], list[tuple[int, int]]]:
        """Whether the bytes fit, and (end, id) of the tokens of either kind."""
        (a,), (b,) = self.encode_a([word]), self.encode_b([word])
        ends = [np.cumsum(size[x]).tolist() for size, x in ((self.a_size, a), (self.b_size, b))]
        return self.fits(word, a, b), list(zip(ends[0], a, strict=True)), list(zip(ends[1], b, strict=True))

    def all_ids(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """(ids, word of each id) of either kind, and which words' bytes fit; the others have no ids.

        Words that end visibly are encoded in one go by ranks, as they cannot run together.
        """
        n = len(words)
        size = np.fromiter((len(w.encode()) for w in words), np.int64, n)
        b_lists = self.encode_b(words)
        b_many = np.fromiter(map(len, b_lists), np.int64, n)
        b = np.fromiter(chain.from_iterable(b_lists), np.int64, int(b_many.sum()))
        b_own = np.repeat(np.arange(n), b_many)
        if self.fast and all(w[-1] > " " and not w[-1].isspace() for w in words):
            a = np.array(self.fast.encode_ordinary("".join(words)), np.int64)
            a_own = np.searchsorted(np.cumsum(size), np.cumsum(self.a_size[a]))
        else:
            a_lists = self.encode_a(words)
            a_many = np.fromiter(map(len, a_lists), np.int64, n)
            a, a_own = np.fromiter(chain.from_iterable(a_lists), np.int64, int(a_many.sum())), np.repeat(np.arange(n), a_many)
        raw = "".join(words).encode()
        good = np.ones(n, bool)
        for ids, own, table, sizes in ((a, a_own, self.a_bytes, self.a_size), (b, b_own, self.b_bytes, self.b_size)):
            if b"".join(map(table.__getitem__, ids.tolist())) != raw or (np.bincount(own, sizes[ids], n) != size).any():
                bounds = np.searchsorted(own, np.arange(n + 1)).tolist()
                held = ids.tolist()
                good &= np.array([b"".join(map(table.__getitem__, held[x:y])) == w.encode() for w, x, y in zip(words, bounds, bounds[1:])], bool)
        if not good.all():
            a, a_own, b, b_own = a[good[a_own]], a_own[good[a_own]], b[good[b_own]], b_own[good[b_own]]
        return [a, b], [a_own, b_own], good

    def learn(self, fresh: list[str]) -> None:
        """Works out unseen words, all at once."""
        n = len(fresh)
        flat, own, good = self.all_ids(fresh)
        # words that fit have as many bytes of either kind
        start = np.bincount(own[0], self.a_size[flat[0]], n).astype(np.int64)
        end = [np.cumsum(size[x]) for size, x in zip((self.a_size, self.b_size), flat, strict=True)]
        common = np.intersect1d(*end)
        group = [np.searchsorted(common, e) for e in end]
        size = [np.bincount(g, minlength=len(common)) for g in group]
        of_word = np.searchsorted(np.cumsum(start), common)
        text = [pc.binary_join(lists(offsets(s), pa.array(x).cast(pa.string())), ",") for s, x in zip(size, flat, strict=True)]
        per_word = np.bincount(of_word, minlength=n)
        text = pc.binary_join(lists(offsets(per_word), pc.binary_join_element_wise(*text, "|")), ";").to_pylist()
        # every token of the first kind with all of the second in its group
        fan = size[1][group[0]]
        at = ragged(offsets(size[1])[group[0]], fan)
        word, pair = np.repeat(own[0], fan), np.repeat(flat[0], fan) << 32 | flat[1][at]
        order = np.lexsort((pair, word))
        word, pair = word[order], pair[order]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (pair[1:] != pair[:-1])][: len(word)])
        mult = np.diff(np.r_[first, len(word)])
        links = np.bincount(word, minlength=n)
        self.place.update(zip(fresh, range(len(self.text), len(self.text) + n), strict=True))
        self.text += text
        self.good = np.concatenate([self.good, good])
        counted = [np.bincount(o, minlength=n) for o in own]
        self.sums = np.concatenate([self.sums, np.stack([*counted, per_word, links], axis=1)])
        self.pair_at = np.concatenate([self.pair_at, self.pair_at[-1] + np.cumsum(np.bincount(word[first], minlength=n))])
        self.pair, self.mult = np.concatenate([self.pair, pair[first]]), np.concatenate([self.mult, mult])

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Where each text's words begin among all, each word's bytes and its place in a list of the different ones, and that list.

        Words come with the space before them, the first with the one put there.
        """
        texts = texts.cast(pa.large_string()).fill_null("").take(pa.array(np.arange(len(texts))))
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        data, bounds = text_bytes(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
        start = np.flatnonzero(data == 32)
        if odd.any():
            text = np.searchsorted(bounds, start, "right") - 1
            found = [start[~odd[text]]]
            for k in np.flatnonzero(odd).tolist():
                size = [len(w.encode()) for w in odd_words(texts[k].as_py(), self.by_words)]
                found.append(bounds[k] + offsets(np.array(size))[:-1])
            start = np.sort(np.concatenate(found))
        at = np.r_[start, len(data)].astype(np.int64)
        found = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
        found = found.dictionary_encode()
        return np.searchsorted(start, bounds), np.diff(at), found.indices.to_numpy(zero_copy_only=False), found.dictionary.to_pylist()


def odd_words(text: str, by_words: bool) -> list[str]:
    """Words of a text that single spaces do not part, with the space put in front."""
    return SAFE.split(" " + text) if by_words and "▁" not in text else [" " + text]


def cut_by_words(a_path: str, b_path: str) -> bool:
    """Whether the first tokenizer parts words as SAFE does, and no piece of the second goes on over a space."""
    import sentencepiece

    with open(a_path, encoding="utf-8") as f:
        config = json.load(f)
    level = config["pre_tokenizer"] or {}
    pieces = sentencepiece.SentencePieceProcessor(model_file=b_path)
    plain = level.get("type") == "ByteLevel" and level.get("use_regex") and not level.get("add_prefix_space") and not config["normalizer"]
    return bool(plain) and not any(re.search("[^▁]▁", pieces.id_to_piece(i)) for i in range(pieces.vocab_size()))


def lists(at: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)


def int_lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
    return lists(at, pa.array(values.astype(np.int32)))


# --- ranges of long texts ---

PIECES = "uid bigint, doc_id bigint, k bigint, text string, skip int, over int"


def range_cuts(raw: bytes, size: int, stretch: int) -> list[tuple[int, int, int, int]]:
    """(from, to, first and last byte of what is read) of each range: what is read goes from safe cut to safe cut.

    Where no safe cut is near, the range goes on to the next one, so that reading stays linear.
    """
    text_end, at, out = len(raw), 0, []
    safe = re.compile(rb"(?<=[!-~])(?= )")  # an ASCII sign before the space: surely visible
    while at < text_end:
        to = min(text_end, at + size)
        while to < text_end and raw[to] & 0xC0 == 0x80:
            to += 1
        near = safe.search(raw, to, to + stretch) if to < text_end else None
        if to < text_end and not near:
            near = safe.search(raw, to)
            to = near.start() if near else text_end
        begin = at
        if at:
            before = [m.start() for m in safe.finditer(raw, out[-1][0], at + 1)]
            begin = before[-1] if before else out[-1][2]
        out.append((at, to, begin, near.start() if near else text_end))
        at = to
    return out


def split_ranges(size: int, stretch: int, by_words: bool):
    """Rows (uid, doc_id, text) to PIECES. skip, over: bytes read before and after the range itself; the space put in front counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text")), strict=True):
                raw = text.encode()
                cut = by_words and "▁" not in text
                cuts = range_cuts(raw, size, stretch) if cut else [(0, len(raw), 0, len(raw))]
                for k in range(0, len(cuts), FAN):
                    some = cuts[k : k + FAN]
                    # what is read begins with a space, which is put there again when it is encoded
                    texts = [raw[c + (c > 0) : d].decode() for _, _, c, d in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([uid] * len(some), pa.int64()),
                            pa.array([doc_id] * len(some), pa.int64()),
                            pa.array(range(k, k + len(some)), pa.int64()),
                            pa.array(texts, pa.string()),
                            pa.array([a - c + (a > 0 and c == 0) for a, _, c, _ in some], pa.int32()),
                            pa.array([d - b for _, b, _, d in some], pa.int32()),
                        ],
                        ["uid", "doc_id", "k", "text", "skip", "over"],
                    )

    return run


# --- encoding into blocks ---

GROUPS = "array<struct<a:array<int>,b:array<int>>>"
IDS = pa.list_(pa.int32())
GROUP_LIST = pa.list_(pa.struct([("a", IDS), ("b", IDS)]))
ENCODED = (
    "block bigint, kind int, doc_id bigint, uid bigint, k bigint, good boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
    "sha string, middle string, units array<int>, counts array<int>, third array<int>, pairs array<bigint>, df array<bigint>, "
    f"cut boolean, edge {GROUPS}, front {GROUPS}, back {GROUPS}"
)
NAMES = [c.strip().split()[0] for c in re.sub("<[^ ]*>", "", ENCODED).split(",")]


class Block:
    """The documents and ranges that a task holds until they are written."""

    def __init__(self, aligner: Aligner, number: int):
        self.aligner, self.number = aligner, number
        self.rows: list[tuple] = []
        self.units: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.bytes = 0

    def add(self, batch: pa.RecordBatch, keep_text: bool) -> None:
        al = self.aligner
        at, size, code, words = al.words(batch.column("text"))
        if fresh := [w for w in words if w not in al.place]:
            al.learn(fresh)
        place = np.fromiter(map(al.place.__getitem__, words), np.int64, len(words))[code]
        sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(al.sums[place], axis=0)])
        wrong = offsets(~al.good[place])
        valid = batch.column("text").is_valid().to_pylist()
        texts = al.text
        for k, (doc_id, uid, nth, skip, over) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "uid", "k", "skip", "over")), strict=True)):
            low, high, long = int(at[k]), int(at[k + 1]), uid is not None
            front, back, cut, fits = Fragment(), None, True, True
            if long:
                low, high, front, back, fits = self.edges(low, high, size, code, words, skip, over)
                cut = high > low or front.cut or back is not None
            good = fits and wrong[high] == wrong[low] and (long or (valid[k] and size[low:high].tolist() != [1]))
            if not good:
                high = low
            own = place[low:high]
            unit, count = np.unique(own, return_counts=True)
            shown_groups = ";".join(map(texts.__getitem__, own.tolist()))
            sha = hashlib.sha256(shown_groups.encode()).hexdigest() if good else ""
            pairs = np.unique(al.pair[ragged(al.pair_at[unit], al.pair_at[unit + 1] - al.pair_at[unit])]) if long else None
            edge = [front.head, front.tail if front.cut else ([], []), back.tail if back else ([], [])]
            self.rows.append(
                (doc_id, uid, nth, good, *(sums[high] - sums[low]).tolist(), sha, shown_groups if long or keep_text else None, pairs, cut)
                + (tuple(as_struct(x) for x in (edge, front.closed, back.closed if back else [])) if long else (None,) * 3)
            )
            self.units.append(unit)
            self.counts.append(count)
        self.bytes += batch.column("text").nbytes

    def edges(self, low: int, high: int, size: np.ndarray, code: np.ndarray, words: list[str], skip: int, over: int):
        """The whole words of a range, the fragments of those that its ends cut (the last None if none is), and whether their bytes fit."""
        front, back, fits = Fragment(), None, True
        while skip and skip >= size[low]:
            skip, low = skip - int(size[low]), low + 1
        while over and over >= size[high - 1]:
            over, high = over - int(size[high - 1]), high - 1
        if skip:
            fits, *tokens = self.aligner.ends(words[code[low]])
            to = int(size[low]) - (over if high - low == 1 else 0)
            front = fragment(*([(e, i) for e, i in t if skip < e <= to] for t in tokens))
            low += 1
        if over and high > low:
            good, *tokens = self.aligner.ends(words[code[high - 1]])
            fits, high = fits and good, high - 1
            back = fragment(*([(e, i) for e, i in t if e <= size[high] - over] for t in tokens))
            # the word begins at a common end, so its first group is closed, or open behind only
            back = Fragment(True, ([], []), [back.head, *back.closed] if back.cut else [], back.tail if back.cut else back.head)
        return low, high, front, back, fits

    def batches(self) -> Iterator[pa.RecordBatch]:
        """The block's own row, then its documents."""
        al, n = self.aligner, len(self.rows)
        unit, local = np.unique(np.concatenate([*self.units, np.zeros(0, np.int64)]), return_inverse=True)
        many = al.pair_at[unit + 1] - al.pair_at[unit]
        at = ragged(al.pair_at[unit], many)
        pairs, of_unit = np.unique(al.pair[at], return_inverse=True)
        unit_at = offsets(many)
        df = np.zeros(len(pairs), np.int64)
        bounds = offsets(np.fromiter(map(len, self.units), np.int64, n))
        for k, row in enumerate(self.rows):
            if row[1] is None:
                own = local[bounds[k] : bounds[k + 1]]
                df[np.unique(of_unit[ragged(unit_at[own], many[own])])] += 1
        one = {"block": [self.number], "kind": [0], "units": [unit_at.astype(np.int32)], "counts": [of_unit.astype(np.int32)], "third": [al.mult[at].astype(np.int32)], "pairs": [pairs], "df": [df]}
        yield filled(one)
        counts = np.concatenate([*self.counts, np.zeros(0, np.int64)])
        fields = ["doc_id", "uid", "k", "good", "n_a", "n_b", "n_groups", "n_links", "sha", "middle", "pairs", "cut", "edge", "front", "back"]
        for a in range(0, n, 512):
            rows = self.rows[a : a + 512]
            b = a + len(rows)
            held = dict(zip(fields, map(list, zip(*rows, strict=True)), strict=True))
            part = slice(int(bounds[a]), int(bounds[b]))
            held["units"] = int_lists(bounds[a : b + 1] - bounds[a], local[part])
            held["counts"] = int_lists(bounds[a : b + 1] - bounds[a], counts[part])
            yield filled({"block": [self.number] * len(rows), "kind": [2] * len(rows)} | held)


ARROW = {
    **{c: pa.int64() for c in ("block", "doc_id", "uid", "k", "n_a", "n_b", "n_groups", "n_links")},
    "kind": pa.int32(), "good": pa.bool_(), "cut": pa.bool_(), "sha": pa.string(), "middle": pa.string(),
    **{c: IDS for c in ("units", "counts", "third")},
    **{c: pa.list_(pa.int64()) for c in ("pairs", "df")},
    **{c: GROUP_LIST for c in ("edge", "front", "back")},
}


def filled(columns: dict) -> pa.RecordBatch:
    n = len(columns["block"])
    made = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns.get(c, [None] * n), ARROW[c]) for c in NAMES]
    return pa.RecordBatch.from_arrays(made, NAMES)


def as_struct(groups: list[tuple[list, list]]) -> list[dict]:
    return [{"a": a, "b": b} for a, b in groups]


def encoder(paths: tuple[str, str], keep_text: bool, block_bytes: int = BLOCK_BYTES):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth, block = TaskContext.get().partitionId(), 0, None
        aligner = per_worker("aligner", paths, lambda: Aligner(*paths))
        for batch in batches:
            if block is None:
                if len(aligner.place) > CACHE_WORDS:
                    aligner.forget()
                block = Block(aligner, part << 24 | nth)
                nth += 1
            block.add(batch, keep_text)
            if block.bytes > block_bytes or len(aligner.place) > 2 * CACHE_WORDS:
                yield from block.batches()
                block = None
        if block:
            yield from block.batches()

    return run


def encoded(docs: DataFrame, paths: tuple[str, str], keep_text: bool, range_bytes: int, block_bytes: int) -> DataFrame:
    """Blocks (kind 0), documents and ranges (kind 2), written."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    none = F.lit(None).cast("bigint")
    short = rows.filter(size <= range_bytes).select(
        "doc_id", "text", none.alias("uid"), none.alias("k"), F.lit(0).alias("skip"), F.lit(0).alias("over")
    )
    long = rows.filter(size > range_bytes).withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "text")
    pieces = materialise(in_text_batches(long, split_ranges(range_bytes, STRETCH, cut_by_words(*paths)), PIECES), "align-ranges")
    dealt = pieces.repartition("uid", "k").select(*short.columns)
    return materialise(in_text_batches(short.unionByName(dealt), encoder(paths, keep_text, block_bytes), ENCODED), "align-blocks")


# --- the tree ---

LEVEL = f"uid bigint, k bigint, at bigint, done boolean, cut boolean, edge {GROUPS}"


def compose_level(fan: int):
    def run(key: tuple, rows):
        """Fragments (uid, k, at, cut, edge: prefix, suffix) of one node's children, in order: what they close, and their composition."""
        import pandas as pd

        out, held, first = [], Fragment(), None
        for r in rows.sort_values("k").itertuples():
            head, tail = (([*g["a"]], [*g["b"]]) for g in r.edge)
            fresh = compose(held, Fragment(bool(r.cut), head, [], tail))
            out += [(key[0], r.k, r.at, True, True, as_struct([g])) for g in fresh.closed]
            if r.cut and first is None:
                first = r.at
            held = Fragment(fresh.cut, fresh.head, [], fresh.tail)
        at = -1 if first is None else first
        out.append((key[0], int(key[1]), at, False, held.cut, as_struct([held.head, held.tail])))
        return pd.DataFrame(out, columns=["uid", "k", "at", "done", "cut", "edge"])

    return run


def boundary_groups(ranges: DataFrame, fan: int = FAN) -> DataFrame:
    """(uid, k, a, b): the groups that ranges leave open, each with the range in which it closes.

    Level by level fan fragments are composed by one task, so no task sees a long
    text's fragments all; the levels are as many as its ranges have digits.
    """
    # a range's own fragment: prefix, and the suffix behind its last common end
    two = F.array(F.col("edge")[0], F.when(F.size(F.col("edge")[2]["a"]) + F.size(F.col("edge")[2]["b"]) > 0, F.col("edge")[2]).otherwise(F.col("edge")[1]))
    level = ranges.select("uid", "k", F.col("k").alias("at"), F.lit(False).alias("done"), F.col("cut"), two.alias("edge"))
    highest, closed, n = ranges.agg(F.max("k")).first()[0] or 0, [], 0
    while True:
        made = level.select("uid", "k", "at", "cut", "edge", F.floor(F.col("k") / fan).alias("node"))
        made = materialise(made.groupBy("uid", "node").applyInPandas(compose_level(fan), LEVEL), f"align-tree-{n}")
        closed.append(made.filter("done").select("uid", F.col("at").alias("k"), F.col("edge")[0].alias("g")))
        level, highest, n = made.filter("not done"), highest // fan, n + 1
        if not highest:
            break
    # a text begins and ends with a common end: what is open there is a group
    ends = level.select("uid", F.posexplode("edge"), F.col("at")).select("uid", F.when(F.col("pos") == 0, F.greatest("at", F.lit(0))).otherwise(F.lit(2**62)).alias("k"), F.col("col").alias("g"))
    every = ends.filter("size(g.a) + size(g.b) > 0")
    for c in closed:
        every = every.unionByName(c)
    return every.select("uid", "k", F.col("g.a").alias("a"), F.col("g.b").alias("b"))


def edge_groups(ranges: DataFrame, fan: int = FAN) -> DataFrame:
    """(uid, k, place, nth, a, b): all groups of long texts that whole words of a range do not hold."""
    out = boundary_groups(ranges, fan).select("uid", "k", F.lit(0).alias("place"), F.lit(0).alias("nth"), "a", "b")
    for place, c in ((1, "front"), (3, "back")):
        each = ranges.select("uid", "k", F.posexplode(c))
        out = out.unionByName(each.select("uid", "k", F.lit(place).alias("place"), F.col("pos").alias("nth"), F.col("col.a").alias("a"), F.col("col.b").alias("b")))
    return out


def stream_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, text) in order to (uid, sha): one range is held at a time."""
    now, h, some = None, None, False
    out: list[tuple[int, str]] = []
    for batch in batches:
        for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if uid != now:
                if h:
                    out.append((now, h.hexdigest()))
                now, h, some = uid, hashlib.sha256(), False
            if text:
                h.update((";" * some + text).encode())
                some = True
    if h:
        out.append((now, h.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["uid", "sha"])


# --- counts ---


def score_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by (block, kind): a block's words, the counts of its pairs, then its documents with their sums."""
    per_unit = unit_at = of_unit = mult = value = None
    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        for k in np.flatnonzero(kinds < 2).tolist():
            x, y, z, df = (batch.column(c)[k].values for c in ("units", "counts", "third", "df"))
            if kinds[k] == 0:
                unit_at, of_unit, mult = (np.asarray(c).astype(np.int64) for c in (x, y, z))
                value = np.zeros((2, int(of_unit.max(initial=-1)) + 1), np.int64)
            else:
                value[0, np.asarray(x)], value[1, np.asarray(x)] = np.asarray(z), np.asarray(df)
            per_unit = None
        docs = batch.filter(pa.array(kinds == 2))
        if not docs.num_rows:
            continue
        if per_unit is None:
            per_unit = np.zeros((2, len(unit_at) - 1), np.int64)
            for j in (0, 1):
                np.add.at(per_unit[j], np.repeat(np.arange(len(unit_at) - 1), np.diff(unit_at)), mult * value[j, of_unit])
        out = np.zeros((2, docs.num_rows), np.int64)
        lists_of = docs.column("units")
        bounds = np.asarray(lists_of.offsets).astype(np.int64)
        unit = np.asarray(lists_of.flatten())
        count = np.asarray(docs.column("counts").flatten()).astype(np.int64)
        own = np.repeat(np.arange(docs.num_rows), np.diff(bounds))
        for j in (0, 1):
            np.add.at(out[j], own, count * per_unit[j, unit])
        yield pa.RecordBatch.from_arrays(
            [*(docs.column(c) for c in DOC_COLUMNS), pa.array(out[0]), pa.array(out[1])], [*DOC_COLUMNS, "n_best", "count_sum"]
        )


DOC_COLUMNS = ["doc_id", "uid", "k", "good", "n_a", "n_b", "n_groups", "n_links", "sha"]
SCORED = "doc_id bigint, uid bigint, k bigint, good boolean, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, sha string, n_best bigint, count_sum bigint"


def one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts batches where a block ends."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        yield from (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return score_rows(one_block(batches))


def links_of(a: str = "a", b: str = "b"):
    """Every pair of a group, as one number."""
    pair = lambda x: F.transform(F.col(b), lambda y: F.shiftleft(x.cast("bigint"), 32).bitwiseOR(y.cast("bigint")))
    return F.flatten(F.transform(F.col(a), pair))


class Alignment:
    """The written blocks and pair counts of a table of documents; every output is read from them."""

    def __init__(
        self, docs: DataFrame, paths: tuple[str, str] | None = None, keep_text: bool = False, range_bytes: int = RANGE, block_bytes: int = BLOCK_BYTES, fan: int = FAN
    ):
        self.rows = encoded(docs, paths or tokenizer_paths(), keep_text, range_bytes, block_bytes)
        self.blocks = self.rows.filter("kind = 0")
        self.ranges = self.rows.filter("kind = 2 and uid is not null")
        sound = self.ranges.groupBy("uid").agg(F.min("good").alias("sound"))
        self.bad = materialise(sound.filter("not sound").select("uid"), "align-bad")
        edges = edge_groups(self.ranges.select("uid", "k", "cut", "edge", "front", "back"), fan).join(self.bad, "uid", "left_anti")
        self.edges = materialise(edges, "align-edges")
        self.counted = materialise(self.count(), "align-pairs")

    def count(self) -> DataFrame:
        """(pair, n, best): how many documents hold a pair linked, and whether none of its first id's counts is higher.

        The highest counts are a row for each id of the first vocabulary.
        """
        short = self.blocks.select(F.explode(F.arrays_zip("pairs", "df")).alias("x")).select("x.pairs", "x.df")
        held = self.ranges.join(self.bad, "uid", "left_anti").select("uid", F.explode("pairs").alias("pair"))
        held = held.union(self.edges.select("uid", F.explode(links_of()))).distinct()
        every = short.select(F.col("pairs").alias("pair"), "df").union(held.select("pair", F.lit(1).cast("bigint")))
        counts = materialise(every.groupBy("pair").agg(F.sum("df").alias("n")).filter("n > 0"), "align-counts")
        a = F.shiftright("pair", 32)
        top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
        return counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))

    def pairs(self) -> DataFrame:
        """(a, b, n, best) of every linked id pair."""
        return self.counted.select(F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), "n", "best")

    def scored(self) -> DataFrame:
        """Documents and ranges with the sums over their whole words."""
        asked = self.blocks.select("block", F.posexplode("pairs")).select("block", "pos", F.col("col").alias("pair"))
        told = asked.join(self.counted, "pair").groupBy("block", F.floor(F.col("pos") / ANSWERS)).agg(F.collect_list(F.struct("pos", F.col("best").cast("int").alias("best"), "n")).alias("x"))
        empty = [F.lit(None).cast(t).alias(c) for c, t in zip(DOC_COLUMNS, ("bigint", "bigint", "bigint", "boolean", *["bigint"] * 4, "string"), strict=True)]
        answers = told.select("block", F.lit(1).alias("kind"), *empty, F.col("x.pos").alias("units"), F.lit(None).cast("array<int>").alias("counts"), F.col("x.best").alias("third"), F.col("x.n").alias("df"))
        own = self.rows.select("block", "kind", *DOC_COLUMNS, "units", "counts", "third", F.lit(None).cast("array<bigint>").alias("df"))
        dealt = own.unionByName(answers).repartition("block").sortWithinPartitions("block", "kind")
        return dealt.mapInArrow(scorer, SCORED)

    def report(self) -> DataFrame:
        """One row per document: the contract's digest."""
        names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
        scored = materialise(self.scored(), "align-scored")
        short = scored.filter("uid is null").select("doc_id", *names, F.col("sha").alias("groups_sha256"))
        linked = self.edges.select("uid", F.explode(links_of()).alias("pair")).join(self.counted, "pair")
        zero = F.lit(0).cast("bigint")
        of_links = linked.groupBy("uid").agg(F.sum(F.col("best").cast("bigint")).alias("n_best"), F.sum("n").alias("count_sum"))
        of_links = of_links.select("uid", *[zero.alias(c) for c in names[:4]], "n_best", "count_sum")
        size_a, size_b = F.size("a").cast("bigint"), F.size("b").cast("bigint")
        of_groups = self.edges.select("uid", size_a, size_b, F.lit(1).cast("bigint"), size_a * size_b, zero, zero)
        parts = scored.filter("uid is not null").join(self.bad, "uid", "left_anti").select("uid", *names)
        sums = parts.union(of_groups).union(of_links).groupBy("uid").agg(*[F.sum(c).alias(c) for c in names])
        known = scored.filter("uid is not null and k = 0").select("uid", "doc_id")
        text = F.concat_ws("|", F.array_join("a", ","), F.array_join("b", ","))
        order = ["uid", "k", "place", "nth"]
        strings = self.ranges.join(self.bad, "uid", "left_anti").select("uid", "k", F.lit(2).alias("place"), F.lit(0).alias("nth"), F.col("middle").alias("text"))
        strings = strings.union(self.edges.select(*order, text)).repartition("uid").sortWithinPartitions(*order)
        sha = strings.select("uid", "text").mapInArrow(stream_digests, "uid bigint, sha string")
        long = known.join(sums, "uid", "left").join(sha, "uid", "left")
        return short.unionByName(long.select("doc_id", *[F.coalesce(c, zero).alias(c) for c in names], F.coalesce("sha", F.lit("")).alias("groups_sha256")))


def alignment_report(docs: DataFrame) -> DataFrame:
    """Alignment with production parameters."""
    return Alignment(docs).report()
