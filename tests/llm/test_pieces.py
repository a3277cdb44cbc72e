import random

import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model

from tecflow.llm import pieces


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The public vocabulary as a unigram model. Its blank-run pieces score -1e9, past what the library's 32-bit sums can tell apart, so they get -40000."""
    proto = model.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path(pieces.VOCABULARY), "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000)
    path = tmp_path_factory.mktemp("pieces") / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def texts(n):
    rng = random.Random(3)
    bits = ["the", "and", " ", " ", "  ", "\n", "thorre", "éè", "ß", "日本", "😀", "\x07", "a" * 5, ".", ",", "1234", "unrecognisable", "\t", "ü"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_equal_the_librarys_viterbi(unigram, monkeypatch):
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=unigram), pieces.Pieces.load(unigram)
    assert ours.apart
    some = texts(2000)
    for t, ids in zip(some, ours.encode(some), strict=True):
        assert ids.tolist() == theirs.encode(t), t
        assert ours.decode(ids) == t
    monkeypatch.setattr(pieces, "ALONE", 3)
    again = pieces.Pieces.load(unigram)
    assert [x.tolist() for x in again.encode(some)] == [x.tolist() for x in ours.encode(some)]


def test_forgotten_parts_are_encoded_again(unigram, monkeypatch):
    some = texts(300)
    want = [x.tolist() for x in pieces.Pieces.load(unigram).encode(some)]
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    small = pieces.Pieces.load(unigram)
    assert [x.tolist() for t in some for x in small.encode([t])] == want


def test_double_array_holds_exactly_its_keys():
    rng = random.Random(1)
    keys = {bytes(rng.choice(b"abcdefgh\xff\x00") for _ in range(rng.randint(1, 6))): i for i in range(800)}
    trie = pieces.double_array(keys)

    def find(key):
        node = 0
        for c in key:
            step = int(trie.base[node]) + c
            if trie.check[step] != node:
                return -1
            node = step
        return int(trie.value[node])

    assert all(find(k) == v for k, v in keys.items())
    others = {bytes(rng.choice(b"abcdefgh\xff\x00") for _ in range(rng.randint(1, 7))) for _ in range(3000)} - keys.keys()
    assert all(find(k) == -1 for k in others)


def test_round_trip_and_odd_rows(spark):
    rows = [(1, "Hello  world\n\nline é 😀", "x"), (2, None, None), (3, "", "y"), (None, " lead", "z"), (1, "Hello  world\n\nline é 😀", "x"), (4, "z" * 3000 + " " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece_ids string")
    got = pieces.digest(docs).collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    assert {r.n_pieces for r in got if r.doc_id in (2, 3)} == {0}
    assert pieces.encoded(docs).columns == ["doc_id", "text", "piece_ids"]
    assert pieces.digest(docs.limit(0)).count() == 0
