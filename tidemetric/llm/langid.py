"""Language ID with language-bitmask n-gram filters.

Training counts character n-grams per language in Spark and keeps, per language, the
most frequent ones whose rate is not far below their rate elsewhere: down to the count
that a histogram of counts gives, so n-grams are never sorted within a language. The
sample of documents is drawn per language, so a rare language is not lost in a large
corpus. They go into a bit-sliced Bloom filter: a row of the table holds one bit per language, so ANDing the
rows at an n-gram's hash positions returns all languages that contain it. A text's hits
are counted per language bit, corrected for the filter's false-positive rate of that
language, and the largest corrected share decides. Texts are handled in slabs, in Arrow
batches; the filter is the only broadcast and its size is a parameter.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemetric.llm.common import cut, is_held_out, small_batches, stored, table
from tidemetric.llm.words import mix

SIZES = (3, 4)
#: Training looks at about so many labelled documents in all, as many of each language, picked by a hash of the id.
TRAIN_DOCS = 40_000
#: N-grams of one language at most; as each language has its own bit in a row, the table need not grow with languages.
GRAMS = 30_000
LEAST_RATIO = 0.05
LEAST_COUNT = 2
ROWS = 1 << 18
HASHES = 3
SLAB = 1 << 18
_PLACES = 1 << 40  # places that a hash deals documents to; far more than a language has documents

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    return _letters


def gram_hashes(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(position, hash) per n-gram size. The inner code points are letters, the outer two letters or a border."""
    folded = np.where(letters, codes, 0).astype(np.uint64)
    for n in SIZES:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        inner = letters[1 : count + 1].copy()
        for k in range(2, n - 1):
            inner &= letters[k : count + k]
        at = np.flatnonzero(inner)
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * np.uint64(0x1FFFFF) + folded[at + k]
        yield at, mix(value)


def slabs(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(text of each position, code points, letters) for runs of texts; long texts go in overlapping pieces."""
    table, edge = letter_table(), max(SIZES) - 1

    def out(pieces):
        owner = np.repeat([i for i, _ in pieces], [len(p) for _, p in pieces])
        codes = np.frombuffer("".join(p for _, p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        return owner, codes, table[codes]

    pieces, size = [], 0
    for i, text in enumerate(texts):
        low = f"\n{text.lower()}\n"
        at = 0
        while True:
            piece = low[at : at + SLAB]
            pieces.append((i, piece))
            size += len(piece)
            if size >= SLAB:
                yield out(pieces)
                pieces, size = [], 0
            if at + SLAB >= len(low):
                break
            at += SLAB - edge
    if pieces:
        yield out(pieces)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            for _, codes, letters in slabs(part["text"].fillna("").tolist()):
                for _, value in gram_hashes(codes, letters):
                    grams, n = np.unique(value.view(np.int64), return_counts=True)
                    yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})


@dataclass
class LanguageFilter:
    """``table[row]`` is a bitmask over ``langs``; ``wrong[l]`` is the false-positive rate of language l."""

    langs: list[str]
    table: np.ndarray
    wrong: np.ndarray
    likeliest: int

    def positions(self, grams: np.ndarray) -> list[np.ndarray]:
        """Hash positions by double hashing."""
        a, b = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1)
        return [(a + np.uint64(i) * b) % np.uint64(len(self.table)) for i in range(HASHES)]

    def languages(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask words of all languages that hold each n-gram."""
        rows = self.positions(grams)
        mask = self.table[rows[0]]
        for r in rows[1:]:
            mask = mask & self.table[r]
        return mask


def build_filter(grams: dict[str, np.ndarray], likeliest: str | None, rows: int = ROWS) -> LanguageFilter:
    langs = sorted(grams)
    out = LanguageFilter(langs, np.zeros((rows, max(1, -(-len(langs) // 64))), np.uint64), np.zeros(len(langs)), langs.index(likeliest) if likeliest in langs else 0)
    for i, lang in enumerate(langs):
        for at in out.positions(grams[lang].view(np.uint64)):
            out.table[at, i // 64] |= np.uint64(1) << np.uint64(i % 64)
    for i in range(len(langs)):
        out.wrong[i] = (((out.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES
    return out


def train_filter(docs: DataFrame, train_docs: int = TRAIN_DOCS, grams: int = GRAMS) -> LanguageFilter:
    """Learn a filter from (doc_id, text, lang); rows with a null lang or text teach nothing."""
    small_batches(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    total = sum(sizes.values())
    if not total:
        return build_filter({}, None)
    quota = train_docs / len(sizes)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(_PLACES, int(_PLACES * quota / n)))])
    picked = known.filter(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(_PLACES)) < F.element_at(share, F.col("lang")))
    counts = stored(picked.select("lang", "text").mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("all_n"))
    rated = counts.join(F.broadcast(totals), "lang").withColumn("rate", F.col("n") / F.col("all_n"))  # a row a language
    most = F.max("rate").over(Window.partitionBy("gram"))
    own = cut(rated.withColumn("most", most).filter((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= LEAST_RATIO * F.col("most"))).select("lang", "gram", "n"))
    down = Window.partitionBy("lang").orderBy(F.desc("n"))
    levels = own.groupBy("lang", "n").agg(F.count("*").alias("level")).withColumn("room", grams - F.sum("level").over(down) + F.col("level"))
    share = F.least(F.lit(1.0), F.col("room") / F.col("level"))  # the level that fills the room keeps a part of its n-grams, by hash
    last = F.broadcast(levels.filter("room > 0").groupBy("lang").agg(F.min("n").alias("least"), F.min_by(share, "n").alias("share")))
    best = own.join(last, "lang").filter((F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (F.pmod(F.col("gram"), F.lit(1_000_003)) < F.col("share") * 1_000_003)))
    found = best.select("lang", "gram").toArrow().to_pandas()  # about ``grams`` rows a language
    return build_filter({lang: part.to_numpy(np.int64) for lang, part in found.groupby("lang")["gram"]}, max(sorted(sizes), key=sizes.get))


def classify(texts: list[str | None], model: LanguageFilter) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    n, count = len(texts), len(model.langs)
    hits, grams, letters = np.zeros((n, max(1, count))), np.zeros(n), np.zeros(n, bool)
    for owner, codes, is_letter in slabs([t or "" for t in texts]):
        letters[owner[is_letter]] = True
        if not count:
            continue
        for at, value in gram_hashes(codes, is_letter):
            mask, who = model.languages(value), owner[at]
            grams += np.bincount(who, minlength=n)
            for i in range(count):
                bit = (mask[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                hits[:, i] += np.bincount(who, bit, minlength=n)
    if not count:
        return ["und"] * n, np.zeros(n)
    true = np.clip((hits - grams[:, None] * model.wrong) / (1 - np.minimum(model.wrong, 0.999)), 0, None)
    total = true.sum(1)
    best = np.where(total > 0, true.argmax(1), model.likeliest)
    score = np.where(total > 0, true.max(1) / np.where(total > 0, total, 1), 0.0)
    return [model.langs[b] if has else "und" for b, has in zip(best, letters, strict=True)], np.where(letters, score, 0.0)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs`` (doc_id, text), whole texts.

    Null texts and texts without a letter are ``und`` with score 0; a text none of whose
    n-grams is known gets the language with most training documents and score 0. With
    nothing learned every row is ``und``. Repeated rows get equal results.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                langs, score = classify(part["text"].tolist(), shared.value)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64"), "lang_pred": langs, "score": score})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, lang_pred string, score double")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_filter(docs.filter(~is_held_out()))
    return identify(docs, model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
