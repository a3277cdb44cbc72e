"""Exact byte-level BPE token counts at every prefix, by dynamic programming.

The encoding of a word's first i bytes ends in exactly one token. It is the
token t for which the encoding of the bytes before t, followed by t, is what BPE
gives; for that it is enough that t and the token before it don't merge across
their border at any time. So count[i] = count[i - len(t)] + 1, and a left-to-right
pass has the counts of all prefixes of a word. A text's counts are running sums
over its words, so truncation and budget questions are look-ups.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import lean

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: Words whose counts a worker remembers before it starts anew.
REMEMBERED = 1 << 20
#: Characters split into words at a time, cut where no word can be torn.
PIECE = 1 << 20

#: Fixed value: how byte-level BPE splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of texts and of all their prefixes; equal to the tokenizers library on the same file."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        letters = byte_letters()
        raw = lambda piece: bytes(letters[c] for c in piece)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.merge: dict[tuple[int, int], int] = {}
        for left, right in pairs:
            left, right = raw(left), raw(right)
            at = (self.rank[left], self.rank[right])
            number = 256 + len(self.merge)
            self.merge[at] = number
            self.parts.append(at)
            self.rank.setdefault(left + right, number)
        self.longest = max(map(len, self.rank))
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.word = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.apart: dict[tuple[int, int], bool] = {}

    def stays_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves a border between tokens a and b: undo merges from the latest, looking for one across it."""
        latest = len(self.parts)
        while True:
            if self.merge.get((a, b), latest) < latest:
                return False
            if a > b:
                latest, inner = a, self.parts[a][1]
                if inner != a:
                    a = inner
                    continue
                latest, inner = b + 1, self.parts[b][0]
                if inner == b:
                    return True
                b = inner
            else:
                latest, inner = b + 1, self.parts[b][0]
                if inner != b:
                    b = inner
                    continue
                latest, inner = a, self.parts[a][1]
                if inner == a:
                    return True
                a = inner

    def prefixes(self, word: bytes) -> list[int]:
        """count[i]: tokens of word[:i], for i from 0 to len(word)."""
        count, last, apart = [0], [-1], self.apart
        rank, longest = self.rank, self.longest
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - longest), i):
                token = rank.get(word[j:i])
                if token is None:
                    continue
                if j:
                    pair = (last[j], token)
                    ok = apart.get(pair)
                    if ok is None:
                        if len(apart) >= REMEMBERED:
                            apart.clear()
                        ok = apart[pair] = self.stays_apart(*pair)
                    if not ok:
                        continue
                last.append(token)
                count.append(count[j] + 1)
                break
        return count

    def of_word(self, word: str) -> int:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        n = self.known[word] = self.prefixes(word.encode())[-1]
        return n

    def of_words(self, text: str) -> int:
        total, known = 0, self.known.get
        for piece in stretches(text):
            for word in self.word.findall(piece):
                n = known(word)
                total += self.of_word(word) if n is None else n
        return total

    def sections(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text cut at special strings; True: a special string, which is one token."""
        at = 0
        for found in self.split_special.finditer(text) if self.split_special else ():
            yield text[at : found.start()], False
            yield found[0], True
            at = found.end()
        yield text[at:], False

    def count(self, text: str | None) -> int:
        return sum(1 if special else self.of_words(part) for part, special in self.sections(text or "")) if text else 0

    def at_prefixes(self, text: str) -> np.ndarray:
        """counts[i]: tokens of text[:i], for i from 0 to len(text) characters, exactly as if text[:i] were encoded alone.

        A prefix may end inside a word and is then split as a text's end: a run of
        blanks no longer leaves its last blank to the next word, a torn contraction
        is two words, a torn special string is ordinary text.
        """
        out = np.zeros(len(text) + 1, np.int64)
        at, plain, before = 0, "", 0
        for part, special in self.sections(text):
            if special:
                for i in range(1, len(part)):
                    out[at + i] = before + self.of_words(plain + part[:i])
                out[at + len(part)] = out[at] + 1
            else:
                plain, before = part, int(out[at])
                self.section_prefixes(part, out[at:])
            at += len(part)
        return out

    def section_prefixes(self, part: str, out: np.ndarray) -> None:
        """Fills out[1:len(part) + 1]; out[0] holds the tokens before this section."""
        done, blanks = int(out[0]), None
        for found in self.word.finditer(part):
            word, start = found[0], found.start()
            begun = done
            torn = word.isspace() or (word[0] == "'" and word[-1].isalpha())
            counts = None if torn else self.prefixes(word.encode())
            size = 0
            for i, c in enumerate(word, 1):
                size += len(c.encode())
                if blanks and part[start : start + i].isspace():
                    out[start + i] = blanks[1] + self.of_words(part[blanks[0] : start + i])
                elif torn or (i == 1 and c == " "):
                    out[start + i] = begun + self.of_words(word[:i])
                else:
                    out[start + i] = begun + counts[size]
            done = begun + (counts[-1] if counts else self.of_words(word))
            blanks = (start, begun) if word.isspace() else None


def truncated(counts: np.ndarray, budget: int) -> int:
    """Length of the longest prefix with at most budget tokens, given the counts at all prefixes.

    Counts may fall when a word is completed, so the last fitting prefix is taken.
    """
    return int(np.flatnonzero(counts <= budget)[-1])


def stretches(text: str) -> Iterator[str]:
    """A long text in pieces whose words are the text's: cut before a blank that follows a letter and precedes one."""
    at = 0
    while len(text) - at > PIECE:
        cut = regex.compile(r"(?<=\p{L})(?= \p{L})").search(text, at + PIECE)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each vocabulary and worker."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; every machine has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text; null and empty texts have 0 of both.

    vocabulary names a public tokenizer file; it is looked up on the executor.
    Rows are counted one by one, so repeated or null ids stay as they are; other
    columns are ignored.
    """

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary_path(vocabulary)).count
        for batch in found:
            tokens = [count(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(tokens, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return docs.select(id_col, text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(batches, schema)


def prefix_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): array with the token count at every character prefix, from 0 to the text's length.

    With it no later question encodes anything: see tokens_of_prefix and fitting_prefix.
    """

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(vocabulary_path(vocabulary))
        for batch in found:
            for i in range(batch.num_rows):
                counts = c.at_prefixes(batch.column(1)[i].as_py() or "").astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([counts], pa.list_(pa.int32()))], [id_col, "counts"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("counts", T.ArrayType(T.IntegerType()))])
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(batches, schema)


def tokens_of_prefix(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first n_chars characters, from stored counts."""
    return F.get(counts, F.least(F.greatest(n_chars, F.lit(0)), F.size(counts) - 1))


def fitting_prefix(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix with at most budget tokens, from stored counts."""
    return F.size(counts) - 1 - F.array_position(F.reverse(F.transform(counts, lambda n: n <= budget)), True).cast("int") + 1
