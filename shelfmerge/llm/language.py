"""Language identification in two steps: the family, then the language within it.

Texts become counts of hashed three-byte runs over lower-cased letters. A linear
SVM per family, each against the others, names the family; inside it, linear
SVMs for every pair of its languages vote. All are fitted on the driver from at
most ``SAMPLE`` labelled texts, dealt evenly over the languages and drawn by a
hash from the documents whose crc32(doc_id) mod 5 is not 0; only their text and
lang are used. Of a longer text ``SAMPLE_CHARS`` characters are learned from, at a
place drawn by hash. A text to be named is counted whole, piece by piece.

A linear SVM names some language for any text, also for one in none it has learned. So
of each text the share of its runs is counted that the learned texts hold. How low that
share may be is calibrated: each half of the learned texts is held against the runs of
the other, and a text with under half of the lowest share found is in no learned
language and scores 0. Texts with fewer than ``LEAST`` unknown runs are too short to tell.

Defined results: null texts and texts without a letter are ``und`` with score 0;
without any labelled text to learn from, every text is ``und``; a null doc_id
hashes as the empty string and so is held out; repeated rows each get a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmerge.llm.common import in_text_batches

#: Labelled texts to learn from, at most (so these are the languages at most); characters learned from each.
SAMPLE = 2400
SAMPLE_CHARS = 16384
SIZE = 1 << 13
PIECE = 4 << 20
#: Unknown runs without which no text is taken to be in no learned language.
LEAST = 12
#: Score below which keep_identified() rejects a text; texts in a learned language score more than 0, all others 0.
REJECT_BELOW = 1e-9

#: Families of the languages that have relatives among the usual ones; any other is its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy"],
    "romance": ["fr", "es", "it", "pt", "ca", "gl", "ro", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "sl", "bs"],
    "turkic": ["tr", "az", "kk", "uz"],
    "uralic": ["fi", "et", "hu"],
    "baltic": ["lt", "lv"],
}
FAMILY = {lang: name for name, langs in FAMILIES.items() for lang in langs}

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """Whether a letter of any script is in the text; numerals such as a half are none."""
    return any(map(str.isalpha, text or ""))


def runs(data: bytes) -> Iterator[np.ndarray]:
    """The three-byte runs over lower-cased letters, as numbers, piece by piece."""
    for at in range(0, max(1, len(data) - 2), PIECE):
        b = np.frombuffer((data[at : at + PIECE + 2]).translate(LETTERS), np.uint8).astype(np.uint32)
        if len(b) < 3:
            b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)])
        code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        yield code[code != 0x202020]


def counted(data: bytes, known: np.ndarray | None = None) -> tuple[np.ndarray, int, int]:
    """(features, runs, known runs): hashed counts of the runs, damped and scaled to length one; known: a table over all runs."""
    out, n, met = np.zeros(SIZE, np.int64), 0, 0
    for code in runs(data):
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(32 - SIZE.bit_length() + 1), minlength=SIZE)
        n += len(code)
        met += int(np.count_nonzero(known[code])) if known is not None else 0
    x = np.sqrt(out.astype(np.float32))
    return x / max(float(np.linalg.norm(x)), 1e-9), n, met


def features(data: bytes) -> np.ndarray:
    return counted(data)[0]


def table_of(codes: np.ndarray) -> np.ndarray:
    """Over all runs, whether they are among the codes."""
    table = np.zeros(1 << 24, bool)
    table[codes] = True
    return table


def calibrated(rows: list[bytes]) -> tuple[np.ndarray, float]:
    """(codes, share): the runs of the texts, and half of the lowest share that a half of the texts knows of a text of the other."""
    half, lowest = [(k // 4) % 2 for k in range(len(rows))], 1.0  # a text and its snippet lie side by side
    tables = [table_of(np.zeros(0, np.int64)) for _ in range(2)]
    for data, h in zip(rows, half, strict=True):
        for code in runs(data):
            tables[h][code] = True
    for data, h in zip(rows, half, strict=True):
        _, n, met = counted(data, tables[1 - h])
        lowest = min(lowest, met / n) if n - met >= LEAST else lowest
    return np.flatnonzero(tables[0] | tables[1]).astype(np.uint32), lowest / 2


def fit_svm(x: np.ndarray, y: np.ndarray, steps: int = 120, cost: float = 20.0) -> np.ndarray:
    """Weights and, last, the bias of a linear SVM with squared hinge loss; y is +1 or -1; classes weigh alike."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    look, rate = w.copy(), 1.0 / (1.0 + 4.0 * cost)
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ look[:-1] + look[-1]))
        pull = (2 * cost * share * slack * y).astype(np.float32)
        slope = look - np.append(x.T @ pull, pull.sum() + look[-1])
        after = look - rate * slope
        look = after + (k / (k + 3)) * (after - w)
        w = after
    return w


class Classifier:
    """Families against each other, then pairs of languages within a family."""

    def __init__(self, rows: list[tuple[bytes, str]]):
        self.languages = sorted({lang for _, lang in rows})
        self.families: dict[str, list[str]] = {}
        for lang in self.languages:
            self.families.setdefault(FAMILY.get(lang.lower().split("-")[0], lang), []).append(lang)
        x = np.array([features(t) for t, _ in rows], np.float32) if rows else np.zeros((0, SIZE), np.float32)
        lang = np.array([v for _, v in rows])
        self.family_names = sorted(self.families)
        self.by_family = [
            fit_svm(x, np.where(np.isin(lang, self.families[f]), 1, -1).astype(np.float32)) for f in self.family_names
        ]
        self.by_pair = {}
        for langs in self.families.values():
            for a, b in combinations(langs, 2):
                own = np.isin(lang, [a, b])
                self.by_pair[a, b] = fit_svm(x[own], np.where(lang[own] == a, 1, -1).astype(np.float32))
        self.codes, self.share = calibrated([t for t, _ in rows])
        self.known: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}  # made anew by each worker

    def predict(self, data: bytes) -> tuple[str, float]:
        """(language, score): the likeliest learned language; score 0 if the text is in none of them."""
        if self.known is None:
            self.known = table_of(self.codes)
        x, n, met = counted(data, self.known)
        lang, score = self.likeliest(x)
        return lang, 0.0 if n - met >= LEAST and met < self.share * n else score

    def likeliest(self, x: np.ndarray) -> tuple[str, float]:
        """(language, score): the family's share times the language's mean share of its pairs."""
        margins = np.array([w[:-1] @ x + w[-1] for w in self.by_family])
        shares = np.exp(3 * (margins - margins.max()))
        best = int(margins.argmax())
        langs = self.families[self.family_names[best]]
        score = float(shares[best] / shares.sum())
        if len(langs) == 1:
            return langs[0], score
        votes = {v: [0, 0.0] for v in langs}
        for a, b in combinations(langs, 2):
            w = self.by_pair[a, b]
            m = float(w[:-1] @ x + w[-1])
            votes[a if m > 0 else b][0] += 1
            p = 1 / (1 + np.exp(-3 * m))
            votes[a][1] += p
            votes[b][1] += 1 - p
        lang = max(langs, key=lambda v: (votes[v][0], votes[v][1]))
        return lang, score * float(votes[lang][1]) / (len(langs) - 1)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, sample: int = SAMPLE) -> list[tuple[bytes, str]]:
    """The bounded sample: for each of the most frequent languages equally many texts, by hash, and a snippet of each."""
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not common:
        return []
    each, span = max(1, sample // len(common)), 1 << 40
    order = F.xxhash64("doc_id", "text")
    length = F.length("text")
    begin = F.when(length > SAMPLE_CHARS, F.pmod(order, length - SAMPLE_CHARS + 1)).otherwise(F.lit(0)).cast("int")
    snippet = F.substr("text", begin + 1, F.lit(SAMPLE_CHARS))
    # about twice as many as needed pass by their hash alone, so few rows are dealt by language
    share = F.lit(False)
    for r in common:
        share |= (F.col("lang") == r.lang) & (F.pmod(order, F.lit(span)) < min(span, 2 * each * span // r["count"] + 1))
    few = usable.filter(share).select("lang", snippet.alias("text"), order.alias("o"))
    top = Window.partitionBy("lang").orderBy("o", "text")
    rows = few.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= each).orderBy("lang", "n").collect()
    out = []
    for k, r in enumerate(rows):
        text = r.text.encode()
        out.append((text, r.lang))
        found = text.split()
        if len(found) > 12:
            at = (k * 7919) % (len(found) - 8)
            out.append((b" ".join(found[at : at + 3 + k % 6]), r.lang))
    return out


def train(docs: DataFrame) -> Classifier:
    return Classifier(training_rows(docs.select("doc_id", "text", "lang")))


def identify(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs with lang_pred and score; existing columns of these names are replaced."""
    out = docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for t in batch.column("text").to_pylist():
                known = model.languages and has_letter(t)
                made.append(model.predict(t.encode()) if known else ("und", 0.0))
            new = {"lang_pred": [a for a, _ in made], "score": [b for _, b in made]}
            arrays = [
                pa.array(new[f.name], f.type) if f.name in new else batch.column(i) for i, f in enumerate(batch.schema)
            ]
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return in_text_batches(out, run, out.schema)


def language_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, below: float = REJECT_BELOW) -> DataFrame:
    """Documents in a learned language, by a score of at least ``below``, with their own columns.

    Where there is nothing to learn from, no text can be told to be in no language, and all with a letter stay.
    """
    model = train(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "text")
    kept = identify(packed, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= below))
    return kept.select(*[F.col(f"d.`{c}`").alias(c) for c in docs.columns])
