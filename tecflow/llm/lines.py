"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line's words are a set. Words are put in one order for all lines, rarest first:
by the count of the hash bucket they fall in, counted over all lines but copies,
then by hash. For lines x and y of Jaccard similarity t or more:
 - length: the smaller has at least t times the words of the larger;
 - prefix: some word is among the first |x| - ceil(t |x|) + 1 of both;
 - positional: after a shared word at places i and j, at most
   1 + min(|x| - i, |y| - j) words can be shared (for places from 1, one less);
   at the first word shared this also holds the smaller line to a shorter prefix;
 - parity: each word flips one bit of a mask, so the masks of x and y differ in no
   more bits than words are in one of them alone.
What passes is verified by the Jaccard similarity of all words, as 64-bit hashes: these are staged once, and counts, order and verification read them there. A line that equals or is similar
to an earlier line (by document id, then place) is removed, whether or not that
line stays.

Equal lines go first, by one grouping, so every line joined is the only one of its
kind. Whether it has any similar earlier one is all that is asked, so a large
group of similar lines needs no pairs of all its members: see removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import bounded, drop_staged, staged

SIMILAR = 0.8
#: Hash buckets in which words are counted: as many as the fast map of an aggregation holds.
BUCKETS = 1 << 16
#: Parts, by word, in which lines are joined: the shuffle of one part is on disk at a time.
PASSES = 2
#: A word is crowded if it is in the prefixes of about CROWD * SAMPLED lines of one length: of CROWD of every SAMPLED-th line. Groups of similar lines have such words. What is crowded changes the work, never the result.
CROWD, SAMPLED = 8, 8
#: A word is hot whose bucket counts this part of all words and 256 more.
HOT = 1 << 14
BLANKS = "[\\\\x20\\\\x09-\\\\x0D]+"
#: Bits of a word's hash in the join, below the class of its count.
BITS = 52
#: From this many words on a line's bits are 128, as 64 can't tell long lines apart. mask: the 64 of every line, or both halves folded together; mask2: one half of a long line.
LONG = 90
MASKS = ("mask", "mask2")


#: SQL: whether a line has a word. Most start with one, and need no pattern.
WORDY = "(line >= '!' or line rlike '[^\\\\x20\\\\x09-\\\\x0D]')"


def split(line: str) -> str:
    """SQL: words of a line, some of them empty. Most lines have no other blanks than spaces, and need no pattern."""
    other = " or ".join(f"contains({line}, chr({c}))" for c in (0x09, 0x0B, 0x0C, 0x0D))
    return f"case when {other} then split({line}, '{BLANKS}') else split({line}, ' ') end"


def count_class(n: Column) -> Column:
    """Grows with the count n by a class for every 2.2 %: 11 bits hold any count."""
    return F.floor(F.log2(n + 1) * 32).cast("smallint")


def bucket(word: str) -> str:
    """SQL: the bucket in which a word, as a hash, is counted."""
    return f"{word} & {BUCKETS - 1}L"


def bucket_counts(found: DataFrame) -> tuple[DataFrame, int]:
    """One row, counts: array with the class of the number of words in each bucket, over all lines of found (words), above the bits of a word's hash; and the number of words."""
    words = found.select(F.explode("words").alias("w"))
    seen = staged(words.select(F.expr(bucket("w")).alias("b")).groupBy("b").agg(F.count("*").alias("n")), "buckets")
    every = seen.union(found.sparkSession.range(BUCKETS).select(F.col("id"), F.lit(0).cast("bigint"))).groupBy("b").agg(F.sum("n").alias("n"))
    rows = every.select(F.struct("b", F.shiftleft(count_class(F.col("n")).cast("long"), BITS).alias("n")).alias("x"))
    counts = staged(rows.agg(F.sort_array(F.collect_list("x")).alias("x")).select(F.expr("transform(x, y -> y.n)").alias("counts")), "counts")
    total = seen.agg(F.sum("n")).first()[0] or 0
    drop_staged(seen)
    return counts, total


def placed(docs: DataFrame) -> DataFrame:
    """(id, th, no, key, key2): every line with a word of docs (id, text, th), and 128 bits that stand for it."""
    rows = docs.select("id", "th", F.posexplode(F.split("text", "\n")).alias("no", "line")).where(WORDY)
    return rows.select("id", "th", "no", F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("key2"))


def place() -> Column:
    """What lines are ordered by: those of rows with an id first."""
    return F.struct(F.col("id").isNull().alias("unnamed"), "id", "th", "no")


def copies(docs: DataFrame) -> DataFrame:
    """(id, th, no): every line that equals an earlier one."""
    lines = staged(placed(docs), "lines")
    repeated = staged(lines.groupBy("key", "key2").agg(F.count("*").alias("n")).where("n > 1").select("key", "key2"), "repeated")
    some = staged(lines.join(bounded(repeated), ["key", "key2"], "left_semi").withColumn("place", place()), "some")
    first = staged(some.groupBy("key", "key2").agg(F.min("place").alias("first")), "first")
    out = staged(some.join(bounded(first), ["key", "key2"]).where("place > first").select("id", "th", "no"), "copies")
    drop_staged(lines, repeated, some, first)
    return out


def by_text(places: DataFrame) -> DataFrame:
    """(id, th, gone) of places (id, th, no)."""
    return staged(places.groupBy("id", "th").agg(F.collect_set("no").alias("gone")), "gone")


def joined_texts(docs: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """docs (id, th, text) with known (id, th, gone): by broadcast while known is small, else by a shuffle."""
    known = bounded(known, 48 + 4 * F.size("gone")).withColumnsRenamed({"id": "known_id", "th": "known_th"})
    on = docs["id"].eqNullSafe(F.col("known_id")) & (docs["th"] == F.col("known_th"))
    return docs.join(known, on, how).drop("known_id", "known_th")


def kept(lines: str, gone: str) -> str:
    """SQL: places of lines that are not gone; in time that grows with the lines."""
    every = f"sequence(0, size({lines}) - 1)"
    return f"case when {gone} is null then {every} else array_except({every}, {gone}) end"


def parity(keys: str, half: bool = False) -> str:
    """SQL: 64 bits of which every word flips one; with half, only the words of one of two halves do, whose bit a constant array holds, as that takes fewer steps a word."""
    if not half:
        return f"aggregate({keys}, 0L, (a, k) -> a ^ shiftleft(1L, cast(k & 63 as int)))"
    bits = ", ".join(["0L"] * 64 + [f"shiftleft(1L, {i})" for i in range(64)])
    return f"aggregate({keys}, 0L, (a, k) -> a ^ get(array({bits}), k & 127))"


def flipped(a: str, b: str) -> tuple[Column, Column, Column]:
    """Bits in which the masks of a and b differ: folded, and of each half."""
    folded, half = (F.col(f"{a}.{m}").bitwiseXOR(F.col(f"{b}.{m}")) for m in MASKS)
    return F.bit_count(folded), F.bit_count(folded.bitwiseXOR(half)), F.bit_count(half)


def shortest_shared(n: str) -> str:
    """SQL: words that a line of n words at least shares with a similar one."""
    return f"cast(ceil({SIMILAR}D * {n} - 1e-9D) as int)"


def line_words(docs: DataFrame) -> DataFrame:
    """Lines of docs (id, th, text, gone) that are not gone: key, key2, first (place), words (each once, as a hash of 64 bits)."""
    lines = docs.select("id", "th", "gone", F.split("text", "\n").alias("lines")).select("id", "th", "lines", F.explode(F.expr(kept("lines", "gone"))).alias("no"))
    lines = lines.select("id", "th", "no", F.get("lines", "no").alias("line")).where(WORDY)
    words = f"array_remove(array_distinct(transform({split('line')}, w -> xxhash64(w))), xxhash64(''))"
    return lines.select(F.xxhash64("line").alias("key"), F.xxhash64(F.lit(1), "line").alias("key2"), place().alias("first"), F.expr(words).alias("words"))


def classes(words: DataFrame, counts: Column) -> DataFrame:
    """Lines of words (line_words): key, key2, first (place), n (words), prefix (in order), masks.

    counts stands in a projection of its own that the optimizer folds into the
    next one, so the table is looked into and not copied to every row. An array
    that can hold no null is sorted as plain numbers.
    """
    ordered = f"coalesce(get(counts, {bucket('w')}) | shiftrightunsigned(w, {64 - BITS}), 0L)"
    rows = words.select("*", counts.alias("counts")).select("key", "key2", "first", F.expr(f"sort_array(transform(words, w -> {ordered}))").alias("keys"))
    n = "size(keys)"
    return rows.select(
        "key", "key2", "first", F.expr(n).alias("n"), F.expr(f"slice(keys, 1, {n} - {shortest_shared(n)} + 1)").alias("prefix"),
        F.expr(parity("keys")).alias(MASKS[0]), F.expr(f"case when {n} >= {LONG} then {parity('keys', True)} else 0L end").alias(MASKS[1]),
    )


def passes(a: str, b: str) -> Column:
    """Length, positional and parity filters on two postings (at, masks) that share a word."""
    n, m = (F.shiftright(F.col(f"{x}.at"), 32) for x in (a, b))
    i, j = (F.col(f"{x}.at").bitwiseAND(F.lit(0xFFFFFFFF)) for x in (a, b))
    # In whole numbers: what is shared is at least t / (1 + t) of n + m, and what is not at most the rest, (1 - t) / (1 + t).
    part, rest = (n + m) * round(1000 * SIMILAR), (n + m) * round(1000 * (1 - SIMILAR))
    least = lambda x: x * round(1000 * (1 + SIMILAR))
    bits, *halves = flipped(a, b)
    folded = least(bits) <= rest
    long = least(halves[0] + halves[1]) <= rest
    apart_at = F.coalesce(~F.arrays_overlap(f"{a}.before", f"{b}.before"), F.lit(True))
    return (least(F.least(n - i, m - j)) >= part) & folded & ((F.least(n, m) < LONG) | long) & apart_at


def postings(found: DataFrame, hot: int, *also: str) -> DataFrame:
    """(key, word, at, rank, masks, before) and columns also: at holds the line's size and, from 0, the word's place in it.

    before: the words before this one, where the word is hot (counts of class hot
    or above), so that lines which share many such words meet at the first of
    these alone.

    rank grows with the line's place, as far as a number can tell: a whole-number
    id, else the same for all.
    """
    rank = F.coalesce(F.col("first.id"), F.lit((1 << 63) - 1)).cast("long") if isinstance(found.schema["first"].dataType["id"].dataType, T.IntegralType) else F.lit(0).cast("long")
    rows = found.select("key", "n", "prefix", rank.alias("rank"), *MASKS, *also, F.posexplode("prefix").alias("i", "word"))
    before = F.when(F.shiftright("word", BITS) >= hot, F.slice("prefix", 1, F.col("i")))
    return rows.select("key", "word", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("i")).alias("at"), "rank", *MASKS, before.alias("before"), *also)


def paired(pairs: DataFrame) -> DataFrame:
    """(key, other, apart) of joined postings a and b, the later line first; both ways where ranks don't tell. apart: bits in which their masks differ."""
    _, *halves = flipped("a", "b")
    apart = halves[0] + halves[1]
    one, two = (F.struct(F.col(f"{x}.key").alias("key"), F.col(f"{y}.key").alias("other")) for x, y in ("ab", "ba"))
    order = F.when(F.col("a.rank") > F.col("b.rank"), F.array(one)).when(F.col("a.rank") < F.col("b.rank"), F.array(two)).otherwise(F.array(one, two))
    return pairs.select(apart.alias("apart"), F.explode(order).alias("x")).select("x.key", "x.other", "apart").distinct()


def crowded(found: DataFrame) -> DataFrame:
    """(word): words in the prefixes of very many lines of one length."""
    sample = found.where(F.col("key").bitwiseAND(F.lit(SAMPLED - 1)) == 0)
    return staged(sample.select("n", F.explode("prefix").alias("word")).groupBy("word", "n").agg(F.count("*").alias("k")).where(F.col("k") >= CROWD).select("word").distinct(), "crowded")


def with_head(there: DataFrame) -> DataFrame:
    """Pairs of a line and the earliest one with one of its crowded words, where the filters pass. there: postings of crowded words, with no."""
    heads = staged(there.groupBy("word").agg(F.min(F.struct("rank", "no", "key", "at", *MASKS, "before")).alias("h")).select("word", "h.*"), "heads")
    on = (F.col("a.word") == F.col("b.word")) & (F.col("a.key") != F.col("b.key")) & passes("a", "b")
    out = staged(paired(there.alias("a").join(bounded(heads, 128 + 8 * F.coalesce(F.size("before"), F.lit(0))).alias("b"), on)), "pairs")
    drop_staged(heads)
    return out


def with_any(done: DataFrame, there: DataFrame, found: DataFrame, crowd: DataFrame, hot: int) -> DataFrame:
    """Pairs of lines and all earlier ones that share a prefix word and pass the filters.

    By a crowded word (postings there) only lines whose key is not in done are
    joined with all; for all other words, which few lines have, found is joined
    with itself, so that both sides are one shuffle.
    """
    words = bounded(crowd)
    a, b = there.join(done, "key", "left_anti").alias("a"), there.alias("b")
    same = (F.col("a.word") == F.col("b.word")) & (F.col("a.key") != F.col("b.key"))
    parts = [staged(paired(a.join(b, same & (F.col("a.rank") >= F.col("b.rank")) & passes("a", "b"))), "pairs")]
    n, m = (F.shiftright(F.col(f"{x}.at"), 32) for x in "ab")
    larger = (n > m) | ((n == m) & (F.col("a.key") > F.col("b.key")))
    for part in range(PASSES):
        mine = postings(found, hot).where(F.col("word").bitwiseAND(F.lit(PASSES - 1)) == part).join(words, "word", "left_anti")
        parts.append(staged(paired(mine.alias("a").join(mine.alias("b"), same & larger & passes("a", "b"))), "pairs"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    out = staged(every.distinct(), "pairs")
    drop_staged(*parts)
    return out


def nearest(pairs: DataFrame) -> DataFrame:
    """Of each key's pairs the one whose masks differ least."""
    return pairs.groupBy("key").agg(F.min_by("other", F.struct("apart", "other")).alias("other"))


def verified(lines: DataFrame, pairs: DataFrame, unique: bool = False) -> DataFrame:
    """(key, key2, first) of the later line of every pair that is similar indeed. lines: of line_words; unique: no two of their texts are equal in id and text."""
    ends = staged(pairs.select("key").union(pairs.select("other")).distinct(), "ends")
    picked = lines.join(bounded(ends), "key", "left_semi")
    words = staged(picked if unique else picked.dropDuplicates(["key", "key2"]), "picked")
    other = words.select(F.col("key").alias("other"), F.col("key2").alias("other2"), F.col("first").alias("other_first"), F.col("words").alias("other_words"))
    both = pairs.join(words, "key").join(other, "other")
    # In whole numbers, and with the intersection named once, as a filter works out every mention.
    shared, all_words = F.size(F.array_intersect("words", "other_words")).cast("long"), (F.size("words") + F.size("other_words")).cast("long")
    alike = both.where(shared * round(1000 * (1 + SIMILAR)) >= all_words * round(1000 * SIMILAR))
    later = F.when(F.col("first") > F.col("other_first"), F.struct("key", "key2", "first")).otherwise(F.struct(F.col("other").alias("key"), F.col("other2").alias("key2"), F.col("other_first").alias("first")))
    out = staged(alike.select(later.alias("x")).select("x.*").distinct(), "resolved")
    drop_staged(ends, words)
    return out


def removals(docs: DataFrame) -> DataFrame:
    """(id, th, gone): places of the removed lines of each text that has any.

    Lines equal to an earlier one are found by a grouping. Three rounds find the
    lines with a similar earlier one, each over those that are still open: by the
    earliest line with a crowded word of theirs, by the likeliest candidate of
    all, and by all candidates. So of n similar lines, n pairs are verified and
    not n * n.
    """
    unique = docs.groupBy("id", "th").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    equal = copies(docs)
    earlier = by_text(equal)
    words = staged(line_words(joined_texts(docs, earlier, "left")), "words")
    counts, total = bucket_counts(words)
    hot = docs.sparkSession.range(1).select(count_class(F.lit(total // HOT + 256))).first()[0]
    found = staged(classes(words, counts.scalar()), "classes").withColumn("no", F.col("first.no"))
    crowd = crowded(found)
    there = staged(postings(found, hot, "no").join(bounded(crowd), "word", "left_semi"), "there")
    heads = with_head(there)
    near = verified(words, heads, unique)
    done = bounded(staged(near.select("key", "key2"), "done"))
    pairs = with_any(done, there, found, crowd, hot)
    drop_staged(counts, earlier, found, crowd, there)
    opened = staged(pairs.join(done, "key", "left_anti"), "open")
    likely = verified(words, best := staged(nearest(opened), "nearest"), unique)
    rest = staged(opened.join(likely.select("key").distinct(), "key", "left_anti").join(best, ["key", "other"], "left_anti"), "rest")
    last = verified(words, rest, unique)
    similar = near.union(likely).union(last).select("first.id", "first.th", "first.no")
    out = by_text(equal.union(similar))
    drop_staged(equal, words, heads, near, pairs, opened, best, likely, rest, last)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col less its removed lines, and two columns more: n_lines and n_removed.

    Rows keep their place even if all lines go; the text is then empty. A null
    text stays null, with 0 lines. Lines without a word always stay. Rows equal in id and text are one document and keep the
    same lines; rows with a null id come after all others. Columns of docs named
    n_lines or n_removed are replaced.
    """
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_removed")]
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.struct(*rest).alias("rest"))
    gone = removals(source.select("id", "text", "th").where("text is not null"))
    out = joined_texts(source, gone, "left").withColumn("lines", F.split("text", "\n"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.expr(f"transform({kept('lines', 'gone')}, i -> get(lines, i))"), "\n"))
    out = out.select("rest", text.alias("text"), F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_removed"))
    kinds = [F.col(f"rest.{c}") if c != text_col else F.col("text").alias(text_col) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*kinds, F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.greatest("n_removed", F.lit(0)).cast("long").alias("n_removed"))


def has_word(text: str) -> Column:
    """Whether a text has any word; null for a null text."""
    return F.col(text).rlike("[^\\x20\\x09-\\x0D]")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_removed, text_md5) of every row after line dedup."""
    return deduplicated(docs, id_col, text_col).select(id_col, "n_lines", "n_removed", F.md5(F.col(text_col).cast("binary")).alias("text_md5"))


#: The same for tables of unique ids: lines that share a rare word are compared.
SQL = f"""with t as (select doc_id, text, string_split(text, chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as no from t),
c as (select line, min(row(doc_id, no)) as place, list_distinct(list_filter(string_split_regex(any_value(line), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) as words from l group by line),
w as (select *, len(words) as n from c where len(words) > 0),
u as (select line, n, unnest(words) as word from w), f as (select word, count(*) as df from u group by word),
p as (select line, word from (select line, n, word, row_number() over (partition by line order by df, word) as i from u join f using (word)) where i <= n - ceil({SIMILAR} * n - 1e-9) + 1),
q as (select distinct a.line as a, b.line as b from p a join p b on a.word = b.word and a.line <> b.line),
late as (select distinct x.line from q join w x on x.line = q.a join w y on y.line = q.b and y.place < x.place where len(list_intersect(x.words, y.words)) * {1 + SIMILAR} >= {SIMILAR} * (x.n + y.n) - 1e-9),
k as (select l.doc_id, l.no, l.line, coalesce(len(w.words) > 0 and (row(l.doc_id, l.no) <> w.place or late.line is not null), false) as gone from l left join w on w.line = l.line left join late on late.line = l.line),
o as (select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, coalesce(string_agg(line, chr(10) order by no) filter (where not gone), '') as text from k group by doc_id)
select t.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, case when t.text is not null then md5(o.text) end as text_md5 from t left join o on o.doc_id = t.doc_id"""
