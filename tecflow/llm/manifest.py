"""A Merkle manifest of a dataset: a digest for every row, one for the whole, and a proof for each row.

Rows of a group are numbered in order and cut into aligned blocks. A block's proofs
come from a fractal traversal: for every few levels it holds the subtree above the
current leaf and grows the next one beside it, two digests a leaf, so that it never
holds the whole tree. Roots of blocks are the leaves of the tree above, which is
treated the same way until one root is left; a block's own proof is then put
behind those of its rows. Which siblings stand left or right follows from a row's
place, and proofs say so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import bounded, lean, staged

#: Levels of a block and of a subtree.
BLOCK, SUBTREE = 8, 4
#: What a leaf is made of.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

PROOF = "array<struct<side:string,digest:string>>"


def leaf_digest(*fields: Column | str) -> Column:
    """sha256 of the fields, each as length in bytes, colon, value; a null field is a dash."""
    text = [(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def joined(*digests: str) -> str:
    """Digest of a node, from its children's as text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def levels(n: int) -> int:
    """Levels above n leaves until one node is left."""
    return max(0, (n - 1).bit_length())


class Growing:
    """A subtree that is worked out digest by digest from its leaves on; keeps the nodes of its upper levels.

    Its leaves are first to first + 2**top of n. A last node without a neighbour is
    joined alone, as long as its level has other nodes.
    """

    def __init__(self, leaves: Sequence[str], first: int, top: int, bottom: int):
        self.leaves, self.n, self.next, self.top, self.bottom = leaves, len(leaves), first, top, bottom
        self.end = min(first + (1 << top), self.n)
        self.stack: list[tuple[int, int, str]] = []  # level, place, digest
        self.kept: dict[tuple[int, int], str] = {}

    def step(self) -> bool:
        """Makes one digest; False: nothing is left to do."""
        if self.stack and (node := self.parent()):
            pass
        elif self.next < self.end:
            node = (0, self.next, self.leaves[self.next])
            self.next += 1
        else:
            return False
        self.stack.append(node)
        if self.bottom <= node[0] < self.top:
            self.kept[node[:2]] = node[2]
        return True

    def parent(self) -> tuple[int, int, str] | None:
        """What the last nodes of the stack can be joined to."""
        level, place, digest = self.stack[-1]
        if level == self.top:
            return None
        if place & 1:
            left = self.stack[-2]
            del self.stack[-2:]
            return level + 1, place >> 1, joined(left[2], digest)
        if place == -(-self.n >> level) - 1 and place:  # the level's last, and not its only one
            self.stack.pop()
            return level + 1, place >> 1, joined(digest)
        return None

    def finish(self) -> str:
        while self.step():
            pass
        return self.stack[-1][2]


def root(leaves: Sequence[str], height: int) -> str:
    """The node height levels above leaves; a lone node is joined alone up to there."""
    now = list(leaves)
    for _ in range(height):
        now = [joined(*now[i : i + 2]) for i in range(0, len(now), 2)]
    return now[0]


def paths(leaves: Sequence[str], height: int, subtree: int = SUBTREE) -> Iterator[list[tuple[str, str]]]:
    """For each leaf in order (side, digest) of its sibling at each of height levels; side: left, right, or none with an empty digest.

    Existing subtrees give the siblings. When the current leaf leaves one, the
    desired subtree beside it takes its place, and a new one is begun.
    """
    n = len(leaves)
    tops = [min(at + subtree, height) for at in range(0, height, subtree)]
    bottoms = list(range(0, height, subtree))
    exist: list[dict[tuple[int, int], str]] = []
    desired: list[Growing | None] = []
    for bottom, top in zip(bottoms, tops, strict=True):
        first = Growing(leaves, 0, top, bottom)
        first.finish()
        exist.append(first.kept)
        desired.append(Growing(leaves, 1 << top, top, bottom) if 1 << top < n else None)
    for leaf in range(n):
        out = []
        for nodes, bottom, top in zip(exist, bottoms, tops, strict=True):
            for level in range(bottom, top):
                place = leaf >> level
                sibling = nodes.get((level, place ^ 1))
                out.append(("none", "") if sibling is None else ("left" if place & 1 else "right", sibling))
        yield out
        for i, top in enumerate(tops):
            grown = desired[i]
            if grown is None:
                continue
            for _ in range(2):
                grown.step()
            if (leaf + 1) % (1 << top) == 0:
                exist[i] = grown.kept
                after = leaf + 1 + (1 << top)
                desired[i] = Growing(leaves, after, top, bottoms[i]) if after < n else None


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    text = lambda s, now: F.when(s["side"] == "left", F.concat(s["digest"], now)).when(s["side"] == "right", F.concat(now, s["digest"])).otherwise(now)
    return F.aggregate(proof, leaf, lambda now, s: F.sha2(text(s, now), 256))


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with place, their number from 0 within group in order (nulls first, ties by the columns after), and n, the group's rows.

    Rows are dealt out by ranges of group and order, so a group may be as large as
    it likes: only a count for each partition and group is added up over partitions.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    at = F.monotonically_increasing_id()
    dealt = rows.withColumn("_tie", at).repartitionByRange(*by, F.col("_tie")).sortWithinPartitions(*by, "_tie")
    dealt = staged(dealt.drop("_tie").withColumn("_at", at), "sorted")
    part = F.shiftright("_at", 33).cast("int")
    counts = dealt.groupBy(group, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(group)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(w).alias("n"))
    out = dealt.join(bounded(staged(counts, "counts")), dealt[group].eqNullSafe(F.col("_group")) & (part == F.col("_of")))
    return out.withColumn("place", F.col("_at") + F.col("_shift")).drop("_group", "_of", "_shift", "_at")


BLOCK_FIELDS = ("group", "block", "n", "root", "ids", "leaves", "extra")


def blocks(leaves: DataFrame, block: int) -> DataFrame:
    """(group, block, n, root, ids, leaves, extra) from (group, place, n, id, leaf, extra): one row for 2**block places of a group."""
    in_order = F.array_sort(F.collect_list(F.struct("place", "id", "leaf", "extra")))  # 2**block rows at most
    rows = leaves.groupBy("group", F.shiftright("place", block).alias("block"), "n").agg(in_order.alias("_rows"))
    rows = rows.select("group", "block", "n", F.col("_rows.id").alias("ids"), F.col("_rows.leaf").alias("leaves"), F.col("_rows.extra").alias("extra"))

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            tops = [root(x, min(block, levels(n))) for x, n in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tops, pa.string())], [*batch.schema.names, "root"])

    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], T.StructField("root", T.StringType())])
    return staged(rows.mapInArrow(batches, schema).select(*BLOCK_FIELDS), "blocks")


def proven(leaves: DataFrame, block: int = BLOCK, subtree: int = SUBTREE) -> tuple[DataFrame, DataFrame]:
    """(group, id, leaf, extra, root, proof) of leaves (group, place, n, id, leaf, extra), and (group, root).

    root is that of the row's group, proof leads there.
    """
    held = blocks(leaves, block)
    rest = held.where(F.col("n") > 1 << block)
    small = held.where(F.col("n") <= 1 << block).select("group", "block", F.col("root").alias("_root"), F.array().cast(PROOF).alias("_above"))
    if rest.limit(1).count():
        above = rest.select("group", F.col("block").alias("place"), F.shiftright(F.col("n") + ((1 << block) - 1), block).alias("n"), F.col("block").alias("id"), F.col("root").alias("leaf"), F.lit(None).cast("string").alias("extra"))
        upper, _ = proven(above, block, subtree)
        small = small.unionByName(upper.select("group", F.col("id").alias("block"), F.col("root").alias("_root"), F.col("proof").alias("_above")))
    known = staged(small.withColumnsRenamed({"group": "_group", "block": "_block"}), "upper")
    wide = bounded(known, 96 + 90 * F.size("_above"))
    joined_up = held.join(wide, held["group"].eqNullSafe(F.col("_group")) & (held["block"] == F.col("_block"))).select("group", "n", "ids", "leaves", "extra", "_root", "_above")

    @lean
    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for k in range(batch.num_rows):
                group, n, ids, digests, extra, top, above = (batch.column(i).slice(k, 1) for i in range(7))
                digests = digests[0].as_py()
                sides, siblings, ends = [], [], [0]
                for path in paths(digests, min(block, levels(n[0].as_py())), subtree):
                    for side, digest in path:
                        sides.append(side)
                        siblings.append(digest)
                    ends.append(len(sides))
                steps = pa.StructArray.from_arrays([pa.array(sides, pa.string()), pa.array(siblings, pa.string())], ["side", "digest"])
                many = pa.array([0] * len(digests))
                columns = [group.take(many), ids[0].values, pa.array(digests), extra[0].values, top.take(many), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps), above.take(many)]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["group", "id", "leaf", "extra", "root", "_own", "_above"]
    kinds = [held.schema["group"].dataType, held.schema["ids"].dataType.elementType, T.StringType(), held.schema["extra"].dataType.elementType, T.StringType(), known.schema["_above"].dataType, known.schema["_above"].dataType]
    out = joined_up.mapInArrow(batches, T.StructType([T.StructField(*x) for x in zip(names, kinds, strict=True)]))
    return out.select("group", "id", "leaf", "extra", "root", F.concat("_own", "_above").alias("proof")), known.select(F.col("_group").alias("group"), F.col("_root").alias("root"))


def manifest(rows: DataFrame, group: str = "group", block: int = BLOCK) -> DataFrame:
    """(group, id, leaf, extra, subroot, root, proof) from rows (group, id, leaf, extra): proof leads from leaf to root.

    subroot is the root of a group's rows in order of id (ties by leaf), root that of
    the groups' subroots (null first, else by their bytes). Of several nodes of a
    level every two neighbours are joined, a last lone one alone. proof: side (left,
    right, none) and digest of the sibling at each level. A null id comes first;
    repeated rows are leaves of their own; an empty table gives an empty one.
    """
    found, roots = proven(numbered(rows, group, ["id", "leaf"]), block)
    tops = roots.groupBy("group").agg(F.min("root").alias("leaf")).select(F.lit(0).alias("all"), F.col("group").alias("id"), "leaf")
    above, _ = proven(numbered(tops, "all", ["id"]).select(F.col("all").alias("group"), "place", "n", "id", "leaf", F.lit(None).cast("string").alias("extra")))
    above = staged(above.select(F.col("id").alias("_group"), F.col("root").alias("_root"), F.col("proof").alias("_above")), "top")
    out = found.join(bounded(above, 96 + 90 * F.size("_above")), found["group"].eqNullSafe(F.col("_group")))
    return out.select("group", "id", "leaf", "extra", F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("proof", "_above").alias("proof"))


def tampered(id_: Column) -> Column:
    """Whether a row's number of characters is changed before it is verified."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % 7 == 0, F.lit(False))


def digest(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs, grouped by lang.

    Rows for which tampered holds are verified with n_chars one higher; where it is
    null, and for a null id, nothing changes. proof_sha256 is over the siblings'
    digests from the leaf to the root. Other columns are ignored. The staged tables
    stay, as the result reads them.
    """
    changed = [F.col(c).cast("decimal(38,0)") + 1 if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
    forged = F.when(tampered(F.col(id_col)), leaf_digest(*changed))
    rows = staged(docs.select(F.col("lang").alias("group"), F.col(id_col).alias("id"), leaf_digest(*LEAF_COLUMNS).alias("leaf"), forged.alias("extra")), "leaves")
    found = manifest(rows)
    siblings = F.array_join(F.transform("proof", lambda s: s["digest"]), "")
    found = found.withColumn("folded_root", folded(F.coalesce("extra", "leaf"), F.col("proof")))
    return found.select(F.col("id").alias(id_col), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, four bits at a time; the table follows from the polynomial."""
    table = []
    for c in range(16):
        for _ in range(4):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        table.append(c)
    half = lambda x: f"xor(({x}) >> 4, ([{', '.join(map(str, table))}]::bigint[])[(({x}) & 15) + 1])"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)), lambda a, b: {half(half('xor(a, b)'))}))"


def sql() -> str:
    field = lambda x: f"coalesce(strlen({x}::varchar) || ':' || {x}::varchar, '-')"
    leaf = lambda **other: "sha256(" + " || ".join(field(other.get(c, c)) for c in LEAF_COLUMNS) + ")"
    up = """select lvl + 1, g, place // 2, (n + 1) // 2, sha256(string_agg(h, '' order by place)) from {0} where n > 1 group by lvl, g, place // 2, n"""
    join = "case when s.h is null then sha256({0}) when w.place % 2 = 1 then sha256(s.h || {0}) else sha256({0} || s.h) end"
    step = f"""select r, lvl + 1, g, place // 2, (n + 1) // 2, sibs || coalesce(h, ''), now from (select w.*, s.h, {join.format('w.cur')} as now from {{0}} as w
left join {{1}} as s on s.lvl = w.lvl and s.g = w.g and s.place = xor(w.place, 1) where w.n > 1)"""
    return f"""with recursive d as (select row_number() over () as r, doc_id, dense_rank() over (order by lang nulls first) as g, {leaf()} as leaf,
case when {crc_sql('doc_id::varchar')} % 7 = 0 then {leaf(n_chars='(n_chars + 1)')} end as forged from documents),
p as materialized (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by g) as n from d),
low(lvl, g, place, n, h) as (select 0, g, place, n, leaf from p union all {up.format('low')}),
sub as materialized (select g, h from low where n = 1),
high(lvl, g, place, n, h) as (select 0, 0, row_number() over (order by g) - 1, count(*) over (), h from sub union all {up.format('high')}),
w1(r, lvl, g, place, n, sibs, cur) as (select r, 0, g, place, n, '', coalesce(forged, leaf) from p union all {step.format('w1', 'low')}),
w2(r, lvl, g, place, n, sibs, cur) as (select r, 0, 0, g - 1, (select count(*) from sub), sibs, cur from w1 where n = 1 union all {step.format('w2', 'high')})
select doc_id, leaf, sub.h as subroot, high.h as root, sha256(sibs) as proof_sha256, cur as folded_root, cur = high.h as verified
from w2 join p using (r) join sub on sub.g = p.g, high where w2.n = 1 and high.n = 1"""


SQL = sql()
