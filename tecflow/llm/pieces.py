"""SentencePiece: unigram Viterbi over a double-array trie of pieces with log scores.

Encoding: a marker stands for every space and before the text; the pieces whose
log scores sum to the most are taken, ties going to the longest last piece; a
character without a piece becomes its bytes' pieces. Decoding joins the pieces,
bytes included, and turns markers back into spaces.

No piece holds a marker after another character, so a text falls apart before
each marker run and its parts are independent. Equal parts are encoded once in
each partition; new parts of a batch go through the trie together, a step of the
trie and of the Viterbi recursion being one NumPy operation over all of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import lean
from .token_counts import vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
#: How far an unknown character scores below the worst piece.
PENALTY = 10.0
#: Parts remembered in a partition; bytes of parts that go through the trie together; longer parts go alone.
REMEMBERED, TOGETHER, ALONE = 1 << 18, 1 << 16, 96
#: Characters encoded at a time and rows in an output batch.
PIECE, ROWS = 1 << 20, 256


@dataclass
class Trie:
    """Double array: the child of node n by byte c is base[n] + c if check there is n; value: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def double_array(keys: dict[bytes, int]) -> Trie:
    children: list[dict[int, int]] = [{}]
    piece = [-1]
    for key, number in keys.items():
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                piece.append(-1)
            node = children[node][c]
        piece[node] = number
    size = 2 * len(children) + 1024
    taken = bytearray(size)
    taken[0] = 1
    base, check, value = (np.full(size, fill, np.int32) for fill in (0, -1, -1))
    slot = {0: 0}
    start = 1
    for node, below in enumerate(children):
        at = slot.pop(node)
        value[at] = piece[node]
        if not below:
            continue
        letters = sorted(below)
        if len(letters) == 1:
            start = taken.find(0, start)
        place = start
        while place < letters[0] + 1 or any(taken[place - letters[0] + c] for c in letters):
            place = taken.find(0, place + 1)
            if place + 512 > len(taken):
                taken.extend(bytes(size))
                base, check, value = (np.concatenate((x, np.full(size, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (value, -1)))
        base[at] = place - letters[0]
        for c in letters:
            taken[base[at] + c] = 1
            check[base[at] + c] = at
            slot[below[c]] = int(base[at]) + c
    room = 256  # a step past the end finds no child
    return Trie(*(np.concatenate((x, np.full(room, fill, np.int32))) for x, fill in ((base, 0), (check, -1), (value, -1))))


CHAR_BYTES = np.ones(256, np.int64)
CHAR_BYTES[0xC0:0xE0], CHAR_BYTES[0xE0:0xF0], CHAR_BYTES[0xF0:] = 2, 3, 4


@dataclass
class Pieces:
    """A vocabulary: trie over its ordinary pieces, log scores, text of every id, ids of single bytes."""

    trie: Trie
    score: np.ndarray
    surface: list[bytes]
    of_byte: list[int]
    unknown: int
    dummy_prefix: bool
    apart: bool

    def __post_init__(self):
        self.known: dict[str, bytes] = {}
        self.part = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n") if self.apart else re.compile("(?s).+")
        self.unknown_score = float(self.score[self.trie.value[self.trie.value >= 0]].min()) - PENALTY if (self.trie.value >= 0).any() else -PENALTY

    @classmethod
    def load(cls, path: str) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model

        proto = model.ModelProto()
        proto.ParseFromString(open(path, "rb").read())
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary, surface, of_byte, unknown = {}, [], [-1] * 256, sp.unk_id()
        texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        for i, text in enumerate(texts):
            if sp.is_byte(i):
                of_byte[int(text[3:-1], 16)] = i
                surface.append(bytes([int(text[3:-1], 16)]))
            elif sp.is_control(i):
                surface.append(b"")
            elif sp.is_unknown(i):
                surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                if not sp.is_unused(i):
                    ordinary[text.encode()] = i
                surface.append(text.replace(MARK, " ").encode())
        if proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only vocabularies that leave texts as they are can be decoded exactly")
        apart = not any(re.search(f"[^{MARK}]{MARK}", t) or ("\n" in t and len(t) > 1) for t in texts)
        score = np.array([sp.get_score(i) for i in range(len(texts))], np.float64)
        return cls(double_array(ordinary), score, surface, of_byte, unknown, proto.normalizer_spec.add_dummy_prefix, apart)

    def ids_of(self, data: bytes, ends: list[tuple[int, int]]) -> bytes:
        """Ids as int32 bytes, from (start, id or -1) of the pieces in order."""
        out: list[int] = []
        for k, (start, number) in enumerate(ends):
            if number >= 0:
                out.append(number)
            else:
                end = ends[k + 1][0] if k + 1 < len(ends) else len(data)
                spelled = [self.of_byte[c] for c in data[start:end]]
                out += spelled if min(spelled) >= 0 else [self.unknown]
        return np.array(out, np.int32).tobytes()

    def viterbi(self, parts: list[bytes]) -> list[bytes]:
        """Best ids of each part; all parts advance through the trie together."""
        n, width = len(parts), max(map(len, parts))
        size = np.array([len(p) for p in parts])
        text = np.zeros((n, width + 1), np.uint8)
        for k, p in enumerate(parts):
            text[k, : len(p)] = np.frombuffer(p, np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for s in range(width):
            rows = np.flatnonzero((s < size) & (best[:, s] > -np.inf))
            if not len(rows):
                continue
            letter = CHAR_BYTES[text[rows, s]]
            single = np.zeros(len(rows), bool)
            live, node = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for e in range(s + 1, width + 1):
                step = base[node] + text[rows[live], e - 1]
                ok = (check[step] == node) & (e <= size[rows[live]])
                live, node = live[ok], step[ok]
                if not len(live):
                    break
                number = value[node]
                hit = number >= 0
                at, number = live[hit], number[hit]
                single[at[letter[at] == e - s]] = True
                self.offer(best, came, piece, rows[at], s, np.full(len(at), e), self.score[number], number)
            lone = np.flatnonzero(~single)
            self.offer(best, came, piece, rows[lone], s, np.minimum(s + letter[lone], size[rows[lone]]), self.unknown_score, -1)
        ids, n_ids, end = np.full((n, width), -1, np.int32), np.zeros(n, np.int64), size.copy()
        known = np.ones(n, bool)
        for k in range(1, width + 1):
            rows = np.flatnonzero(end > 0)
            if not len(rows):
                break
            ids[rows, width - k] = number = piece[rows, end[rows]]
            known[rows[number < 0]] = False
            n_ids[rows] = k
            end[rows] = came[rows, end[rows]]
        raw = ids.tobytes()
        out = [raw[4 * (k * width + width - m) : 4 * (k + 1) * width] for k, m in enumerate(n_ids.tolist())]
        for k in np.flatnonzero(~known).tolist():
            out[k] = self.ids_of(parts[k], self.path(came[k], piece[k], len(parts[k])))
        return out

    @staticmethod
    def offer(best, came, piece, rows, start, end, score, number) -> None:
        total = best[rows, start] + score
        better = total > best[rows, end]
        rows, end = rows[better], end[better]
        best[rows, end] = total[better]
        came[rows, end] = start
        piece[rows, end] = number[better] if isinstance(number, np.ndarray) else number

    @staticmethod
    def path(came, piece, end: int) -> list[tuple[int, int]]:
        out = []
        while end:
            out.append((int(came[end]), int(piece[end])))
            end = int(came[end])
        return out[::-1]

    def alone(self, part: bytes) -> bytes:
        """The same for one long part, without padding."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best, came, piece = [0.0] + [-np.inf] * len(part), [0] * (len(part) + 1), [-1] * (len(part) + 1)
        for s in range(len(part)):
            if best[s] == -np.inf:
                continue
            node, end, letter, single = 0, s, int(CHAR_BYTES[part[s]]), False
            while end < len(part):
                step = int(base[node]) + part[end]
                if check[step] != node:
                    break
                node, end = step, end + 1
                number = int(value[node])
                if number >= 0:
                    single |= end - s == letter
                    if best[s] + self.score[number] > best[end]:
                        best[end], came[end], piece[end] = best[s] + self.score[number], s, number
            if not single and best[s] + self.unknown_score > best[min(s + letter, len(part))]:
                end = min(s + letter, len(part))
                best[end], came[end], piece[end] = best[s] + self.unknown_score, s, -1
        return self.ids_of(part, self.path(came, piece, len(part)))

    def learn(self, parts: set[str]) -> None:
        """Makes sure that all of parts are known; earlier ones are forgotten when there are too many."""
        fresh = parts - self.known.keys()
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = parts
        coded = sorted(((p.encode(), p) for p in fresh), key=lambda x: len(x[0]))
        while coded and len(coded[-1][0]) > ALONE:
            data, p = coded.pop()
            self.known[p] = self.alone(data)
        i = 0
        while i < len(coded):
            j, width = i, len(coded[i][0])
            while j < len(coded) and (j - i) * len(coded[j][0]) <= TOGETHER and len(coded[j][0]) <= width + 3:
                j += 1
            for (_, p), ids in zip(coded[i:j], self.viterbi([d for d, _ in coded[i:j]]), strict=True):
                self.known[p] = ids
            i = j

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none."""
        parts = [self.part.findall((MARK if self.dummy_prefix else "") + t.replace(" ", MARK)) if t else [] for t in texts]
        self.learn(set().union(*parts))
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, found)), np.int32) for found in parts]

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and data.startswith(b" "):
            data = data[1:]
        return data.decode("utf-8", "replace")


_loaded: dict[str, Pieces] = {}


def loaded(vocabulary: str) -> Pieces:
    if vocabulary not in _loaded:
        _loaded[vocabulary] = Pieces.load(vocabulary_path(vocabulary))
    return _loaded[vocabulary]


def grouped(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in groups of at most ROWS rows and about PIECE characters."""
    first, held, n = 0, [], 0
    for k, t in enumerate(texts):
        t = t.as_py()
        if held and (n + len(t or "") > PIECE or len(held) >= ROWS):
            yield first, held
            first, held, n = k, [], 0
        held.append(t)
        n += len(t or "")
    if held:
        yield first, held


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text", ids_col: str = "piece_ids") -> DataFrame:
    """docs with ids_col: the ids of every row's whole text; null and empty texts have an empty list.

    A column of that name is replaced. Rows are encoded one by one, so repeated
    rows and nulls elsewhere stay as they are.
    """
    kept = docs.drop(ids_col)
    at = kept.columns.index(text_col)

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(vocabulary)
        for batch in found:
            for first, texts in grouped(batch.column(at)):
                ids = coder.encode(texts)
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, ids_col])
        coder.known.clear()

    fields = [T.StructField(f.name, f.dataType) for f in kept.schema]
    return kept.mapInArrow(batches, T.StructType([*fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False))]))


def decoded(df: DataFrame, vocabulary: str = VOCABULARY, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """df with out_col: the text of ids_col; a null list gives null, an empty one an empty text."""
    kept = df.drop(out_col)
    at = kept.columns.index(ids_col)

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(vocabulary)
        for batch in found:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                lists = part.column(at)
                ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
                texts = [coder.decode(values[i:j].tolist()) if ok else None for i, j, ok in zip(ends, ends[1:], lists.is_valid().to_pylist(), strict=False)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out_col])

    fields = [T.StructField(f.name, f.dataType) for f in kept.schema]
    return kept.mapInArrow(batches, T.StructType([*fields, T.StructField(out_col, T.StringType())]))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_hash, round_trip) of every row: round_trip says that decoding gives the text back (null: the empty text)."""
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    found = decoded(encoded(source))
    return found.select(id_col, F.size("piece_ids").cast("long").alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


