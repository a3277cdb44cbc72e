import codecs
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tecflow.llm import transducer as td


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def both(request):
    ranks = td.read_ranks(public_tokenizers.path(request.param))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return td.coder(request.param), library


def texts(n, seed=5):
    rng = random.Random(seed)
    bits = ["the", "And", " ", " ", "  ", "\n", "thorre", "éè", "ß", "日本", "😀", "\x07", "aaaaa", ".", "...", "1234", "unrecognisable", "\t", "ü", "'ll", "<|endoftext|>", "\x85", "ſ", "----", "zq"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_ids_equal_the_librarys(both):
    ours, library = both
    for t in texts(3000):
        ids = ours.encode(t)
        assert ids.tolist() == library.encode_ordinary(t), t
        assert b"".join(ours.decode(ids)) == t.encode()


def test_any_bytes_as_one_word(both):
    """Beyond texts: the machine against the library on bytes of few kinds, where merges overlap most."""
    ours, library = both
    rng = random.Random(8)
    for k in range(4000):
        letters = rng.choice([b"a", b"ab", b"the ", b"\xe3\x81\x82\x84", b" \n", bytes(range(256)), b"ing", b"-=", b"0123"])
        word = bytes(rng.choice(letters) for _ in range(rng.randint(1, 60)))
        if word not in ours.words.ranks:
            assert ours.words.machine.transduce(word) == library._core_bpe.encode_single_piece(word), word
        else:
            assert library._core_bpe.encode_single_piece(word) == [ours.words.ranks[word]]


def test_few_states_are_enough(monkeypatch):
    ours = td.coder(td.VOCABULARY)
    some = [t.encode() for t in texts(200) if t]
    want = [ours.words.machine.transduce(t) for t in some]
    monkeypatch.setattr(td, "STATES", 7)
    small = td.Transducer(ours.words.ranks)
    assert [small.transduce(t) for t in some] == want
    assert len(small.states) <= 8


def test_ids_are_written_while_reading(both):
    """Tokens leave once the guesses agree: never more than two longest tokens' bytes behind, on words and runs without end."""
    machine = both[0].words.machine
    longest = max(map(len, machine.number))
    for data in (b"a" * 3000, b" " * 3000, b"internationalisation" * 100, bytes(random.Random(2).choice(b"etaoin") for _ in range(3000))):
        state, out, read, worst = machine.start, 0, 0, 0
        size = {machine.id[n]: len(t) for t, n in machine.number.items()}
        for byte in data:
            state, written = state[byte]
            read, out = read + 1, out + sum(size[i] for i in written)
            worst = max(worst, read - out)
        assert worst <= 2 * longest


def test_a_vocabulary_with_a_token_that_no_merge_reaches():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"ab": 257, b"abc": 258, b"xyz": 259, b"aa": 260, b"aaa": 261, b"cab": 262}
    library = tiktoken.Encoding("own", pat_str=r"[a-z]+|[^a-z]+", mergeable_ranks=ranks, special_tokens={})
    words = td.Words(ranks)
    rng = random.Random(4)
    for _ in range(3000):
        word = "".join(rng.choice("abcxyz") for _ in range(rng.randint(1, 9)))
        assert np.frombuffer(words[word], "<u4").tolist() == library.encode_ordinary(word), word


def test_streams_decode_like_pythons_decoder(both):
    ours = both[0]
    rng = random.Random(3)
    single = {t[0]: r for t, r in ours.words.ranks.items() if len(t) == 1}
    token = {r: t for t, r in ours.words.ranks.items()}.__getitem__
    for _ in range(1500):
        data = bytes(rng.choice([0x41, 0xC3, 0xA9, 0xE0, 0xA0, 0x80, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xBF, 0xFF, 0xC0]) for _ in range(rng.randint(0, 9)))
        ids = [single[b] for b in data] + rng.choices(list(ours.words.ranks.values()), k=rng.randint(0, 3))
        whole = b"".join(map(token, ids))
        theirs = codecs.getincrementaldecoder("utf-8")("replace")
        ours.decoder.start()
        got, want, at = "", "", 0
        while at < len(ids):
            step = rng.randint(1, 3)
            part = ids[at : at + step]
            got += ours.decoder.feed(np.array(part)).decode()
            want += theirs.decode(b"".join(map(token, part)))
            assert got.startswith(want)  # Python's keeps bytes of surrogates back, which no later byte can mend
            at += step
        assert got + ours.decoder.end().decode() == want + theirs.decode(b"", True) == whole.decode("utf-8", "replace")
    with pytest.raises(ValueError):
        ours.decoder.feed(np.array([10**6]))


def test_digest_encoding_and_decoding_of_odd_rows(spark):
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=td.read_ranks(public_tokenizers.path(td.VOCABULARY)), special_tokens={})
    rows = [(1, "Hello  world\n\nline é 😀", "x"), (2, None, None), (3, "", "y"), (None, " lead", "z"), (1, "Hello  world\n\nline é 😀", "x"), (4, "z" * 30000 + " " * 50 + "word " * 300000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in td.digest(docs).collect()}
    want = set()
    for doc_id, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.add((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == want and td.digest(docs).count() == len(rows)
    assert td.digest(docs.limit(0)).count() == 0
    back = td.decoded(td.encoded(docs, ids_col="n_tokens"), ids_col="n_tokens", out_col="text2")
    assert back.columns == ["doc_id", "text", "n_tokens", "text2"]
    assert all((r.text or "") == r.text2 for r in back.collect())
    assert td.decoded(spark.createDataFrame([(None,), ([],)], "bpe_ids array<int>")).collect()[0].decoded is None
