"""Byte-level BPE as a finite-state transducer that is made deterministic while it runs, and streaming decoding.

A row of tokens is what BPE gives for its bytes exactly if BPE leaves the border
between every two neighbours. So encoding is a machine that reads bytes, guesses
where tokens end, and checks each guess against the token before it. Its guesses
are followed side by side: a state holds, for every guess that can still come
true, the tokens since the last agreed one and the bytes of the unfinished token.
What all guesses agree on is written at once, so nothing waits for longer than the
guesses differ. States and steps are made when first met, and forgotten when there
are too many.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import sys
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from .common import lean
from .token_counts import PrefixCounter, stretches, vocabulary_path

VOCABULARY = "byte_bpe_50k.tiktoken"
#: What a worker keeps: states of the machine, words of at most SHORT bytes and their ids, pairs of tokens. Ids decoded at a time.
STATES, WORDS, SHORT, REMEMBERED, TOGETHER = 1 << 17, 1 << 19, 48, 1 << 18, 1 << 18

#: An unfinished guess: tokens since the last agreed one, bytes of the token that is being read.
Guess = tuple[tuple[int, ...], bytes]
#: Fixed value: what stands for bytes that are no text.
REPLACEMENT = "�".encode()


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: base64 and a number in each line; smaller ids merge first."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


class Transducer:
    """Compiled merges of a rank file. Tokens inside are numbers in order of merging: bytes first, then the rest by rank."""

    stays_apart = PrefixCounter.stays_apart

    def __init__(self, ranks: dict[bytes, int]):
        order = sorted(ranks, key=lambda t: (len(t) > 1, ranks[t]))
        if len(order) < 256 or any(len(t) != 1 for t in order[:256]):
            raise ValueError("every byte must be a token")
        self.id, self.number = [ranks[t] for t in order], {t: n for n, t in enumerate(order)}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = []
        for n, token in enumerate(order):
            at = self.last_merge(token, n) if len(token) > 1 else (n, n)
            self.parts.append(at or (n, n))
            if at is None:
                del self.number[token]  # no merges lead to it: it only stands for a word that equals it
            elif len(token) > 1:
                self.merge[at] = n
        self.begun = {token[:i] for token in self.number for i in range(1, len(token))}
        self.apart: dict[tuple[int, int], bool] = {}
        self.states: dict[tuple[int, tuple[Guess, ...]], State] = {}
        self.forget()

    def last_merge(self, token: bytes, limit: int) -> tuple[int, int] | None:
        """The two tokens left before the last merge, when only tokens below limit are merged; None if more are left."""
        parts, number = [token[i : i + 1] for i in range(len(token))], self.number
        while len(parts) > 2:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                n = number.get(parts[i] + parts[i + 1], limit)
                if n < best:
                    best, at = n, i
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return number[parts[0]], number[parts[1]]

    def forget(self) -> None:
        """Only the start is left: no token yet, nothing read."""
        for state in self.states.values():
            state.clear()  # states refer to each other in circles
        self.states.clear()
        self.start = self.state(-1, (((), b""),))

    def state(self, last: int, guesses: tuple[Guess, ...]) -> State:
        """The state with these guesses after token last (-1: none)."""
        for tokens, _ in guesses:
            if not tokens:
                break
        else:
            last = -1  # no guess follows it directly
        key = (last, guesses)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, last, guesses)
        return found

    def may_follow(self, last: int, token: int) -> bool:
        if len(self.apart) >= REMEMBERED:
            self.apart.clear()
        ok = self.apart[last, token] = self.stays_apart(last, token)
        return ok

    def transduce(self, data: bytes) -> list[int]:
        """Ids of one word's bytes."""
        state, out = self.start, []
        for byte in data:
            state, written = state[byte]
            if written:
                out += written
        out += state.rest
        return out


class State(dict):
    """For each byte that was read here: the state after it, and the ids that are written on the way."""

    __slots__ = ("machine", "last", "guesses", "rest")

    def __init__(self, machine: Transducer, last: int, guesses: tuple[Guess, ...]):
        self.machine, self.last, self.guesses = machine, last, guesses
        #: What is written if the input ends here: the last guess is always the one without an unfinished token.
        self.rest = tuple([machine.id[t] for t in guesses[-1][0]])

    def __missing__(self, byte: int) -> tuple[State, tuple[int, ...]]:
        """Follows every guess by one byte: its token grows, ends here if it may stand after the one before, or both."""
        machine, last, letter = self.machine, self.last, bytes((byte,))
        number, apart, begun = machine.number.get, machine.apart.get, machine.begun
        found: list[Guess] = []
        ended = None
        for tokens, unread in self.guesses:
            grown = unread + letter
            if ended is None and (token := number(grown)) is not None:
                before = tokens[-1] if tokens else last
                ok = before < 0 or apart((before, token))
                if ok is None:
                    ok = machine.may_follow(before, token)
                if ok:
                    ended = ((*tokens, token), b"")
            if grown in begun:
                found.append((tokens, grown))
        found.append(ended)
        agreed, first = 0, found[0][0]
        for token in first:
            for tokens, _ in found:
                if len(tokens) <= agreed or tokens[agreed] != token:
                    break
            else:
                agreed += 1
                continue
            break
        written = ()
        if agreed:
            last, written = first[agreed - 1], tuple([machine.id[t] for t in first[:agreed]])
            found = [(tokens[agreed:], unread) for tokens, unread in found]
        if len(machine.states) >= STATES:
            machine.forget()
            return machine.state(last, tuple(found)), written
        out = self[byte] = machine.state(last, tuple(found)), written
        return out


class Words(dict):
    """Ids of words as the bytes of unsigned 32-bit numbers; a word is encoded when first asked for, long ones each time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.machine = ranks, Transducer(ranks)

    def __missing__(self, word: str) -> bytes:
        data = word.encode()
        whole = self.ranks.get(data)
        ids = array("I", self.machine.transduce(data) if whole is None else (whole,))
        if sys.byteorder == "big":
            ids.byteswap()
        ids = ids.tobytes()
        if len(data) <= SHORT:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


#: Ranges of the bytes that follow a first byte (the Unicode Standard, well-formed UTF-8). States: 0 between
#: characters, 1 to 3 that many bytes to come, 4 to 7 after E0, ED, F0 and F4, whose next byte has a range of its own.
FIRST = {(0x00, 0x7F): 0, (0xC2, 0xDF): 1, (0xE0, 0xE0): 4, (0xE1, 0xEC): 2, (0xED, 0xED): 5, (0xEE, 0xEF): 2, (0xF0, 0xF0): 6, (0xF1, 0xF3): 3, (0xF4, 0xF4): 7}
LATER = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}


def utf8_states() -> list[list[int]]:
    """next[state][byte]; -1: the byte cannot follow."""
    table = [[-1] * 256 for _ in range(8)]
    for (low, high), state in FIRST.items():
        table[0][low : high + 1] = [state] * (high - low + 1)
    for state, (low, high, after) in LATER.items():
        table[state][low : high + 1] = [after] * (high - low + 1)
    return table


UTF8 = utf8_states()


class Decoder:
    """Bytes of whole characters from ids that arrive in any portions; what is no UTF-8 becomes the replacement character."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens: list[bytes | None] = [None] * size
        self.known, self.whole = np.zeros(size, bool), np.zeros(size, bool)
        for token, rank in ranks.items():
            tokens[rank] = token
            state = 0
            for byte in token:
                state = UTF8[state][byte] if state >= 0 else -1
            self.known[rank], self.whole[rank] = True, state == 0  # whole: starts and ends between characters
        self.token = pa.array(tokens, pa.large_binary())
        #: For bytes held and a token after them: whole characters, bytes held then, state.
        self.steps: dict[tuple[bytes, int], tuple[bytes, bytes, int]] = {}
        self.start()

    def start(self) -> None:
        self.state, self.held = 0, b""

    def read(self, data: bytes | memoryview) -> bytes:
        out = bytearray()
        for byte in bytes(data):
            after = UTF8[self.state][byte]
            if after < 0 and self.held:
                out += REPLACEMENT  # of what was held; the byte may start anew
                self.held, self.state, after = b"", 0, UTF8[0][byte]
            if after < 0:
                out += REPLACEMENT
                continue
            self.held += bytes((byte,))
            self.state = after
            if not after:
                out += self.held
                self.held = b""
        return bytes(out)

    def feed(self, ids: np.ndarray) -> bytes:
        """Whole characters that these ids complete; an id that is no token is an error."""
        if not len(ids):
            return b""
        if int(ids.max()) >= len(self.known) or not self.known[ids].all():
            raise ValueError("an id is no token")
        tokens = self.token.take(pa.array(ids, pa.int32()))
        ends = np.frombuffer(tokens.buffers()[1], np.int64)[: len(ids) + 1]
        data = memoryview(tokens.buffers()[2])[ends[0] : ends[-1]]
        torn = np.flatnonzero(~self.whole[ids])
        if not len(torn) and not self.held:
            return bytes(data)
        out, at, n, ends = [], 0, len(ids), ends - ends[0]
        for k in ([0] if self.held else []) + torn.tolist():
            if k < at:
                continue
            if k > at:
                out.append(data[ends[at] : ends[k]])
            at = k
            while at < n and (self.held or not self.whole[ids[at]]):
                step = (self.held, int(ids[at]))
                if step not in self.steps:
                    if len(self.steps) >= REMEMBERED:
                        self.steps.clear()
                    self.steps[step] = self.read(data[ends[at] : ends[at + 1]]), self.held, self.state
                written, self.held, self.state = self.steps[step]
                out.append(written)
                at += 1
        out.append(data[ends[at] :])
        return b"".join(out)

    def end(self) -> bytes:
        """A character that was never completed is replaced; the next ids start anew."""
        out = REPLACEMENT if self.held else b""
        self.start()
        return out


class Coder:
    """Encodes and decodes texts by one rank file."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.words, self.decoder, self.word = Words(ranks), Decoder(ranks), regex.compile(pattern)

    def encode(self, text: str) -> np.ndarray:
        known, find = self.words.__getitem__, self.word.findall
        return np.frombuffer(b"".join([b"".join(map(known, find(part))) for part in stretches(text)]), "<u4")

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        self.decoder.start()
        for at in range(0, len(ids), TOGETHER):
            yield self.decoder.feed(ids[at : at + TOGETHER])
        yield self.decoder.end()


def without_collections(program: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Python looks for circles among all states again and again while there are new ones, and forget() leaves none."""

    @functools.wraps(program)
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from program(found)
        finally:
            gc.enable()

    return run


_coders: dict[str, Coder] = {}


def coder(vocabulary: str) -> Coder:
    """One coder for each vocabulary and worker."""
    if vocabulary not in _coders:
        import public_tokenizers

        _coders[vocabulary] = Coder(vocabulary_path(vocabulary), public_tokenizers.PATTERN)
    return _coders[vocabulary]


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", ids_col: str = "bpe_ids") -> DataFrame:
    """docs with ids_col: the ids of every row's whole text; null and empty texts have an empty list.

    A column of that name is replaced; other columns, repeated rows and nulls
    elsewhere stay as they are. Ids are those of the tiktoken library without
    special tokens: their strings in a text are ordinary text.
    """
    kept = docs.drop(ids_col)
    at = kept.columns.index(text_col)

    @lean
    @without_collections
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = coder(vocabulary).encode
        for batch in found:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                ids = encode(part.column(at)[0].as_py() or "").astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([ids], pa.list_(pa.int32()))], [*part.schema.names, ids_col])

    fields = [T.StructField(f.name, f.dataType) for f in kept.schema]
    return kept.mapInArrow(batches, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]))


def decoded(df: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "bpe_ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the text of ids_col; a null list gives null, an empty one an empty text.

    Bytes that are no UTF-8 give replacement characters, as Python's decoder does;
    a null within a list or an id that is no token is an error.
    """
    kept = df.drop(out_col)
    at = kept.columns.index(ids_col)

    @lean
    @without_collections
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = coder(vocabulary).decode
        for batch in found:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                ids = part.column(at)[0].as_py()
                text = None if ids is None else b"".join(decode(np.array(ids, np.uint32))).decode()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([text], pa.string())], [*part.schema.names, out_col])

    fields = [T.StructField(f.name, f.dataType) for f in kept.schema]
    return kept.mapInArrow(batches, T.StructType([*fields, T.StructField(out_col, T.StringType())]))


def digest(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, encoded and decoded again; null and empty texts have no ids.

    ids_sha256 is over the ids as little-endian unsigned 32-bit numbers,
    decoded_sha256 over the UTF-8 bytes that decoding gives. Rows are handled one
    by one, so repeated or null ids stay as they are; other columns are ignored.
    """

    @lean
    @without_collections
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(vocabulary)
        for batch in found:
            n, of_ids, of_text = [], [], []
            for text in batch.column(1):
                ids, sha = c.encode(text.as_py() or ""), hashlib.sha256()
                for data in c.decode(ids):
                    sha.update(data)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
    types = [docs.schema[id_col].dataType, T.LongType(), T.StringType(), T.StringType()]
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(batches, T.StructType([T.StructField(*x) for x in zip(names, types, strict=True)]))
