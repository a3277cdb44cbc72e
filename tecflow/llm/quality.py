"""Quality rules: how far a document's histograms lie from those of the languages.

References are learned from all documents that carry a language: the share of
each character class, and the share of each of the language's most common words.
A document is compared with every reference by Jensen-Shannon distance, for each
histogram that has enough observations, and is kept if it is close to one
language in all of them. Counting rules come first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from . import textnum as tn
from .common import lean
from .crossentropy import HELD, Tally

#: Words that make a language's reference, and languages at most; more are an error.
COMMON, LANGUAGES = 100, 1_000
#: Least observations for a histogram to be judged, and the farthest distance kept.
MIN_CHARS, MIN_WORDS = 200, 100
FAR_CHARS, FAR_WORDS = 0.30, 0.45
MIN_LENGTH, REPEATED_SHARE, WINDOW = 20, 30, 8

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def classes() -> np.ndarray:
    """Class of each leading byte: 26 letters, digits, blanks, punctuation, symbols, controls; other characters by leading byte; 255: continues a character."""
    out = np.full(256, 255, np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) - 97 if c.isalpha() else 26 if c.isdigit() else 27 if c.isspace() else 28 if c in ".,;:'\"!?-()" else 29 if b >= 32 and b < 127 else 30
    for b in range(0xC0, 256):
        out[b] = 31 + b - 0xC0
    return out


CLASS = classes()
N_CLASSES = 31 + 64


def class_counts(texts: tn.Texts) -> np.ndarray:
    kinds = CLASS[texts.data]
    seen = kinds < N_CLASSES
    at = tn.row_of_bytes(texts)[seen] * N_CLASSES + kinds[seen]
    return np.bincount(at, minlength=len(texts) * N_CLASSES).reshape(-1, N_CLASSES)


@dataclass
class References:
    """languages in order; chars: (languages, classes) shares; words: hashes in order; common: (languages, words + 1) shares, the last of all other words."""

    languages: list[str]
    chars: np.ndarray
    words: np.ndarray
    common: np.ndarray


def word_places(found: tn.Words, known: np.ndarray) -> np.ndarray:
    """Place of each word's hash in known; len(known) for others."""
    if not len(known):
        return np.zeros(len(found.hash), np.int64)
    at = np.searchsorted(known, found.hash).clip(max=len(known) - 1)
    return np.where(known[at] == found.hash, at, len(known))


def histograms(texts: tn.Texts, found: tn.Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    m = len(known) + 1
    words = np.bincount(found.row * m + word_places(found, known), minlength=len(texts) * m).reshape(-1, m)
    return class_counts(texts), words


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """(rows, references) Jensen-Shannon distance, base 2; 1 for a row without counts."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)

    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.sum(x * np.log2(np.where(x > 0, x, 1)), axis=1)

    out = np.ones((len(p), len(reference)))
    of_p = entropy(p)
    for k, q in enumerate(reference):
        split = entropy((p + q) / 2) - (of_p + entropy(q[None, :])) / 2
        out[:, k] = np.sqrt(np.clip(split, 0, 1))
    out[total[:, 0] == 0] = 1
    return out


def summed_by_language(batch_languages: list, rows: np.ndarray, into: dict) -> None:
    for language, row in zip(batch_languages, rows, strict=True):
        if language is not None:
            into[language] = into[language] + row if language in into else row.astype(np.int64)


def words_of(tallies: dict[str, Tally]) -> Iterator[pa.RecordBatch]:
    """Hands on and empties the word counts of each language."""
    for language, tally in tallies.items():
        for batch in tally.batches():
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([language] * n, pa.string()), pa.array(np.ones(n, np.int32)), *batch.columns], ["lang", "kind", "key", "n"])
    tallies.clear()


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> References:
    """Histograms of each language over all its documents.

    A first pass counts character classes and all words of each language; the most
    common by their whole counts make the vocabulary, and a second pass counts them
    in all documents. What reaches the driver is bounded
    by languages times (classes + words).
    """
    source = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null")

    @lean
    def first(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars: dict[str, np.ndarray] = {}
        tallies: dict[str, Tally] = {}
        for batch in found:
            langs = batch.column(1).to_pylist()
            for texts in tn.pieces(batch.column(0)):
                here = langs[texts.first : texts.first + len(texts)]
                summed_by_language(here, class_counts(texts), chars)
                w = tn.words(texts)
                for language in set(here):
                    mine = np.array([x == language for x in here])
                    tally = tallies.setdefault(language, Tally(["key", "n"], [pa.int64()] * 2))
                    tally.add(*np.unique(w.hash[mine[w.row]], return_counts=True))
                    tally.full()  # sums equal words
                if sum(t.held for t in tallies.values()) > HELD:
                    yield from words_of(tallies)
        yield from words_of(tallies)
        yield as_batch([(x, 0, k, int(c)) for x, row in chars.items() for k, c in enumerate(row) if c], ["lang", "kind", "key", "n"])

    if source.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"{lang_col} has more than {LANGUAGES} values")
    counted = source.select("text", "lang").mapInArrow(first, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    ranked = counted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))).where((F.col("at") <= max(COMMON, N_CLASSES)) & ((F.col("kind") == 0) | (F.col("at") <= COMMON)))
    found = ranked.select("lang", "kind", "key", "n").collect()
    languages = sorted({r.lang for r in found})
    known = np.unique(np.array([r.key for r in found if r.kind == 1], np.int64).view(np.uint64))
    place = {x: i for i, x in enumerate(languages)}
    chars = np.zeros((len(languages), N_CLASSES))
    for r in found:
        if r.kind == 0:
            chars[place[r.lang], r.key] = r.n

    @lean
    def second(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, np.ndarray] = {}
        for batch in found:
            langs = batch.column(1).to_pylist()
            for texts in tn.pieces(batch.column(0)):
                w = tn.words(texts)
                m = len(known) + 1
                rows = np.bincount(w.row * m + word_places(w, known), minlength=len(texts) * m).reshape(-1, m)
                summed_by_language(langs[texts.first : texts.first + len(texts)], rows, words)
        yield as_batch([(x, k, int(c)) for x, row in words.items() for k, c in enumerate(row) if c], ["lang", "key", "n"])

    common = np.zeros((len(languages), len(known) + 1))
    if languages:
        for r in source.select("text", "lang").mapInArrow(second, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).collect():
            common[place[r.lang], r.key] = r.n
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    return References(languages, share(chars), known, share(common))


def as_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "kind": pa.int32(), "key": pa.int64() if "kind" in names else pa.int32(), "n": pa.int64()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for c, n in zip(columns, names, strict=True)], names)


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[back] > 1


def in_row(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Keys that differ between rows."""
    return tn.mixed(keys + tn.mixed(row.astype(np.uint64) + np.uint64(1)))


def base_counts(texts: tn.Texts, found: tn.Words) -> dict[str, np.ndarray]:
    """The counting rules' figures by row."""
    starts = np.concatenate(([0], np.cumsum(tn.char_starts(texts.data))))
    ends = np.flatnonzero(texts.data == 0x0A)
    line_start = np.unique(np.concatenate((texts.offsets[:-1], ends + 1)))
    line_start = line_start[line_start < len(texts.data)]
    line_end = np.append(line_start[1:], len(texts.data))[: len(line_start)]
    line_end = line_end - (texts.data[line_end - 1] == 0x0A)
    has_word = np.searchsorted(found.start, line_start) < np.searchsorted(found.start, line_end)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(texts.offsets, line_start, "right") - 1
    keys = in_row(tn.hashes(texts.data, line_start, line_end), line_row)
    fresh = np.zeros(len(keys), bool)
    fresh[np.unique(keys, return_index=True)[1]] = True
    at, window = tn.windows(found, WINDOW)
    again = at[repeated(in_row(window, found.row[at]))]
    cover = np.zeros(len(found.hash) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return {
        "n_words": found.per_row(),
        "word_chars": found.per_row(starts[found.end] - starts[found.start]),
        "n_symbols": tn.count_rows(texts, SYMBOL[texts.data]),
        "n_dup_lines": np.bincount(line_row[~fresh], minlength=len(texts)),
        "n_repeat_words": found.per_row(np.cumsum(cover[:-1]) > 0),
    }


def judged(docs: DataFrame, known: References, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, char_distance, word_distance, nearest, base_failed, kept) for every row of docs.

    A histogram with fewer than MIN_CHARS characters or MIN_WORDS words is not
    judged and its distance is null; without languages to compare with, nothing
    is. kept: the counting rules pass and one language is near in all judged
    histograms. Null and empty texts have no words and fail the counting rules.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for texts in tn.pieces(batch.column(1)):
                w = tn.words(texts)
                c = base_counts(texts, w)
                chars, words = histograms(texts, w, known.words)
                by_char, by_word = js_distance(chars, known.chars), js_distance(words, known.common)
                enough_chars = (chars.sum(axis=1) >= MIN_CHARS) & bool(known.languages)
                enough_words = (c["n_words"] >= MIN_WORDS) & bool(known.languages)
                excess = np.maximum(np.where(enough_chars[:, None], by_char / FAR_CHARS, 0), np.where(enough_words[:, None], by_word / FAR_WORDS, 0))
                best = excess.argmin(axis=1) if known.languages else np.zeros(len(texts), int)
                pick = lambda x: x[np.arange(len(texts)), best] if known.languages else np.zeros(len(texts))
                failed = (c["n_words"] < MIN_LENGTH) | (100 * c["n_repeat_words"] > REPEATED_SHARE * c["n_words"])
                near = [known.languages[k] if a or b else None for k, a, b in zip(best, enough_chars, enough_words, strict=True)] if known.languages else [None] * len(texts)
                columns = [batch.column(0).slice(texts.first, len(texts)), *(pa.array(c[n].astype(np.int64)) for n in names)]
                columns += [pa.array(pick(by_char), mask=~enough_chars), pa.array(pick(by_word), mask=~enough_words), pa.array(near, pa.string())]
                columns += [pa.array(failed), pa.array(~failed & (pick(excess) <= 1))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, *names, "char_distance", "word_distance", "nearest", "base_failed", "kept"])

    fields = [T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names)]
    fields += [T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("nearest", T.StringType())]
    fields += [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, T.StructType(fields))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns the references from docs and judges all of docs by them."""
    return judged(docs, references(docs, text_col, lang_col), id_col, text_col)
