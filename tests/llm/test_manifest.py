import hashlib
import zlib

import duckdb
import pytest

from tecflow.llm import manifest as mf


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """(root, the siblings' digests of each leaf), level by level."""
    proofs, at, now = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(now) > 1:
        for i, p in enumerate(at):
            if p ^ 1 < len(now):
                proofs[i].append(("left" if p % 2 else "right", now[p ^ 1]))
            else:
                proofs[i].append(("none", ""))
        now = [H(*now[i : i + 2]) for i in range(0, len(now), 2)]
        at = [p // 2 for p in at]
    return now[0], proofs


def plain(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    text = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, t, lang, s, n: H(*map(text, (i, s, lang, n, t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    done = {g: tree([leaf(*r) for r in sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for g in order}
    top, above = tree([done[g][0] for g in order]) if order else (None, [])
    out = []
    for k, g in enumerate(order):
        for r, proof in zip(sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))), done[g][1], strict=True):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            now = leaf(*r[:4], r[4] + 1) if bad else leaf(*r)
            for side, sibling in proof + above[k]:
                now = H(sibling, now) if side == "left" else H(now, sibling) if side == "right" else H(now)
            out.append((r[0], leaf(*r), done[g][0], top, H(*[s for _, s in proof + above[k]]), now, now == top))
            assert (now == top) is not bad
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


@pytest.mark.parametrize("subtree", [1, 2, 3, 8])
def test_traversal_gives_every_proof_and_holds_little(subtree):
    for n in [*range(1, 40), 63, 64, 65, 200, 255, 256]:
        leaves = [H(str(i)) for i in range(n)]
        root, proofs = tree(leaves)
        height = mf.levels(n)
        assert mf.root(leaves, height) == root
        assert list(mf.paths(leaves, height, subtree)) == proofs
        # A block of a taller tree: its lone nodes go on alone.
        taller = list(mf.paths(leaves, height + 2, subtree))
        assert [p[:height] for p in taller] == proofs and all(p[height:] == [("none", "")] * 2 for p in taller)
        assert mf.root(leaves, height + 2) == H(H(root))


def test_a_subtree_is_ready_in_two_digests_a_leaf():
    leaves = [H(str(i)) for i in range(300)]
    for top, first in ((3, 8), (4, 16), (4, 288), (5, 288), (6, 256)):
        grown = mf.Growing(leaves, first, top, top - 2)
        steps = 0
        while grown.step():
            steps += 1
        assert steps < 2 << top and len(grown.kept) <= 6 and len(grown.stack) == 1


def docs(n, langs):
    return [(i * 3 % 1000 if i % 50 else None, f"text é {i}", langs[i * i % len(langs)], None if i % 7 == 0 else "web", None if i % 11 == 0 else i) for i in range(n)]


@pytest.mark.parametrize("block", [1, 3, 8])
def test_equals_plain_tree(spark, monkeypatch, block):
    rows = docs(700, ["de", "en", None, "fr", "en", "en", "", "é"]) + [(5, None, "zz", None, None), (7, "", "yy", "", 0), (8, "x", "yy", "", 1)]
    rows += [(77, "copy", "en", "web", 4)] * 300
    monkeypatch.setattr(mf, "manifest", lambda r, f=mf.manifest: f(r, block=block))
    df = spark.createDataFrame([(*r, "other", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars int, root string, id int").repartition(5)
    assert got(mf.digest(df)) == plain(rows)


def test_small_tables(spark):
    for rows in ([], docs(1, ["en"]), docs(2, [None]), docs(9, ["a", "b", "c", "d", "e"]), [(1, "w" * 2_000_000, "en", None, 2_147_483_647)]):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
        assert got(mf.digest(df)) == plain(rows)


def test_query_equals_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    want = duckdb.sql(mf.SQL.replace("from documents", f"from '{path}'"))
    assert got(mf.digest(spark.read.parquet(path))) == sorted(want.fetchall(), key=str)
