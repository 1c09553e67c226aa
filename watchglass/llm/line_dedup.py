"""Line dedup: lines equal to, or within a few edits of, an earlier line are taken out of the corpus.

Lines are near if they are within one edit for each CHARS characters of the shorter one, and EDITS in all: a bound on
the rate of edits, so that short lines of different words are not called copies. Two lines within t edits share, if
the shorter is cut into t + 1 segments, one of these unchanged, at a place that the lengths and the segment's number
confine to a few offsets. Their counts of any character differ by no more than two for each edit in all, which keeps
most lines that share a segment by other ways apart. Each different line files its own segments and looks up its
substrings at those offsets for every length it may meet (Li et al., "Pass-Join", PVLDB 2011), with as many segments
as each length's bound asks for. Substrings of a line's own length at no offset are its segments, so lines of one
length meet there by the filed keys alone. Candidates are verified by bit-parallel edit distance in a band of 2 t + 1 diagonals
(Hyyrö 2003), after what both begin and end with alike is cut off. All of it is built-in expressions: nothing is
handed to Python.

Equal lines are one line from the start, so copies never meet in the join; verified links go to connected components.
"""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm.common import quoted, stored, table
from watchglass.llm.quality_rules import SPACE, bound
from watchglass.operators.components import connected_components

#: Most edits between near lines, and the characters of the shorter one that each of them takes (two at least).
EDITS, CHARS = 2, 8
#: Characters whose counts, modulo 4, are compared before two lines meet, and before they are verified.
COUNTED, COUNTED_THEN = "ethanoisrd", "lucmpgbfvyw,. "
#: So many groups, of at most eight numbers each (13 MB), are broadcast; so many numbers of positions in documents.
SMALL_GROUPS, SMALL_POSITIONS = 200_000, 1_500_000
#: Keys of fewer rows than this are never frequent ones.
LEAST_HOT = 1000
#: So many candidate lines' 64-bit hashes (8 MB) are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def _release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are no longer named.

    Python tells the JVM of objects that it has let go from a thread that looks for them once a second; only then does
    a collection there find them.
    """
    if spark.sparkContext.master.startswith("local"):
        return
    gc.collect()
    time.sleep(2.5)
    spark.sparkContext._jvm.System.gc()


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, pos, line, h1, h2) for each line with a word; mark tells texts of one id apart."""
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.split(text, "\n").alias("all"))
    found = slim.select("doc_id", "mark", F.posexplode("all").alias("pos", "line")).filter(F.col("line").rlike(f"[^{SPACE}]"))
    return found.withColumns({f"h{k}": F.xxhash64(F.lit(k), F.col("line")) for k in (1, 2)})


def _segment(length: Column, edits: int, number: int) -> tuple[Column, Column]:
    """First character (from 1) and length of a segment, numbered from 1; the last ones are the longer ones."""
    n = edits + 1
    size = lambda i: F.floor((length + (i - 1)) / n).cast("int")
    start = F.lit(1)
    for i in range(1, number):
        start = start + size(i)
    return start, size(number)


def _key(line: Column, length: Column, number: int, start: Column, size: Column) -> Column:
    return F.xxhash64(length, F.lit(number), line.substr(start, size))


def allowed(length: Column, edits: int = EDITS, chars: int = CHARS) -> Column:
    """Edits that a line of so many characters is near within."""
    return F.least(F.lit(edits), F.floor(length / chars)).cast("int")


def _by_bound(length: Column, edits: int, chars: int, most_first: list[Column]) -> Column:
    """The choice, from ``edits`` down to 1, that the bound of a line of ``length`` asks for; null for none."""
    out = F.when(length >= edits * chars, most_first[0])
    for t, choice in zip(range(edits - 1, 0, -1), most_first[1:], strict=False):
        out = out.when(length >= t * chars, choice)
    return out


def filed_keys(line: Column, n: Column, edits: int, chars: int) -> Column:
    """Keys of a line of ``n`` characters; counting these anew for each key would take longer than all the rest."""
    return _by_bound(n, edits, chars, [F.array(*[_key(line, n, i, *_segment(n, t, i)) for i in range(1, t + 2)]) for t in range(edits, 0, -1)])


def _sought(line: Column, n: Column, shorter: int, t: int) -> list[Column]:
    """Keys of the lines, ``shorter`` characters shorter and of bound ``t``, that this one may be near to.

    Those of its own segments are left out. Between two lines of one length and two edits an unchanged segment that is
    moved is moved forward in one of them and back in the other: seeking it forward is enough, as each line seeks.
    """
    length, found = n - shorter, []
    for i in range(1, t + 2):
        start, size = _segment(length, t, i)
        low, high = max(1 - i, shorter - (t + 1 - i)), min(i - 1, shorter + t + 1 - i)
        offsets = range(low, high + 1) if shorter else [o for o in range(low, high + 1) if o > 0 or (o < 0 and t > 2)]
        found += [_key(line, length, i, start + offset, size) for offset in offsets]
    return found


def looked_keys(line: Column, n: Column, edits: int) -> Column:
    """Keys of the lines, no longer than this one, that it may be near to within ``edits``, but for its ``filed_keys``."""
    return F.array(*[k for shorter in range(edits + 1) for k in _sought(line, n, shorter, edits)])


def looked_keys_of_short(line: Column, n: Column, edits: int, chars: int) -> Column:
    """The same for a line so short that the bound of some lines it may be near to is under ``edits``."""
    none, parts = F.array().cast("array<bigint>"), []
    for shorter in range(edits + 1):
        ways = [F.array(*_sought(line, n, shorter, t)).cast("array<bigint>") if t >= shorter else none for t in range(edits, 0, -1)]
        parts.append(F.coalesce(_by_bound(n - shorter, edits, chars, ways), none))
    return F.concat(*parts)


def counts(line: Column, characters: str = COUNTED) -> Column:
    """Two bits for each of at most 16 characters: how often it is in the line, modulo 4."""
    out = F.lit(0).cast("long")
    for i, c in enumerate(characters):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))  # without walking over the text
        out = out.bitwiseOR(F.shiftleft(n.bitwiseAND(3).cast("long"), 2 * i))
    return out


def counts_near(a: Column, b: Column, edits: int) -> Column:
    """Whether counts differ by no more than so many edits can change: two in all for each."""
    differ, low = a.bitwiseXOR(b), F.lit(0x55555555).cast("long")
    one, two = differ.bitwiseAND(low), F.shiftright(differ, 1).bitwiseAND(low).bitwiseAND(F.bitwise_not(differ))
    return F.bit_count(one) + 2 * F.bit_count(two) <= 2 * edits


def _alike(a: Column, b: Column, most: Column) -> Column:
    """Length of what both begin with alike, at most ``most``, by halving."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda s: s <= most)
    step = lambda at, s: F.when((at + s <= most) & (a.substr(F.lit(1), at + s) == b.substr(F.lit(1), at + s)), at + s).otherwise(at)
    return F.aggregate(steps, F.lit(0), step)


def banded(pattern: Column, text: Column, edits: int) -> Column:
    """Edit distance of two arrays of characters that differ by at most ``edits`` in length; over ``edits`` if it is larger.

    Bit k of a word stands for the row k - edits away from the diagonal, so one step serves the band's whole column.
    Both arrays get the same head, which changes no distance, so that the diagonal starts inside them.
    """
    width = 2 * edits + 1
    mask, head = (1 << width) - 1, F.array(*[F.lit("")] * (edits + 1))
    long = lambda v: F.lit(v).cast("long")
    bit = lambda word, at: F.when(word.bitwiseAND(at) != 0, long(1)).otherwise(long(0))

    def over(p: Column, t: Column) -> Column:
        rows = F.size(p)

        def column(state: Column, j: Column) -> Column:
            c = F.get(t, j - 1)
            same = None
            for k in range(width):
                one = F.when(F.get(p, j - 1 - edits + k) == c, long(1 << k)).otherwise(long(0))
                same = one if same is None else same + one

            def ahead(d0: Column) -> Column:
                vp, vn = state["vp"], state["vn"]
                hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask)
                hn = d0.bitwiseAND(vp)
                down = F.shiftright(d0, 1)
                last = F.call_function("shiftright", long(1 << (width - 1)), j + edits - rows)
                moved = F.when(j + edits <= rows, long(1) - bit(d0, long(1 << (width - 1)))).otherwise(bit(hp, last) - bit(hn, last))
                return F.struct(
                    hn.bitwiseOR(F.bitwise_not(down.bitwiseOR(hp)).bitwiseAND(mask)).alias("vp"),
                    down.bitwiseAND(hp).alias("vn"),
                    (state["at"] + moved).alias("at"),
                )

            vp, vn = state["vp"], state["vn"]
            d0 = bound(same, lambda x: ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask))
            # On the diagonal the distance never falls; past the last row it can fall by 2 * edits.
            return F.when(state["at"] > 3 * edits, state).otherwise(bound(d0, ahead))

        start = F.struct(long(mask - ((1 << edits) - 1)).alias("vp"), long(0).alias("vn"), long(edits).alias("at"))
        return F.aggregate(F.sequence(F.lit(1), F.size(t)), start, column, lambda s: s["at"].cast("int"))

    return bound(F.concat(head, pattern), lambda p: bound(F.concat(head, text), lambda t: over(p, t)))


def edit_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two strings if it is at most ``edits``, else a larger number."""
    n, m = F.length(a), F.length(b)

    def trimmed(cut: Column) -> Column:
        x, y = a.substr(cut + 1, n), b.substr(cut + 1, m)
        back = _alike(F.reverse(x), F.reverse(y), F.least(n, m) - cut)

        def verify(end: Column) -> Column:
            p, t = x.substr(F.lit(1), n - cut - end), y.substr(F.lit(1), m - cut - end)
            chars = lambda s: F.filter(F.split(s, ""), lambda c: c != "")
            shorter = F.least(F.length(p), F.length(t))
            return F.when(shorter == 0, F.greatest(F.length(p), F.length(t))).otherwise(banded(chars(p), chars(t), edits))

        return bound(back, verify)

    return F.when(F.abs(n - m) > edits, F.abs(n - m)).otherwise(bound(_alike(a, b, F.least(n, m)), trimmed))


def different_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, line, n, chars, counts) of each different line of ``lines_of``: how often it comes, and its characters."""
    return lines.groupBy("h1", "h2", "line").agg(F.count("*").alias("n")).withColumns({"chars": F.length("line"), "counts": counts(F.col("line"))})


def line_links(different: DataFrame, edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """Pairs (a, b) of near lines, as structs (h1, h2), among those of ``different_lines``."""
    if edits < 1 or chars < 2:
        raise ValueError("an edit takes two characters at least, so that no segment is empty")
    spark = different.sparkSession
    line, n = F.col("line"), F.col("chars")
    long_ones = different.filter(n >= chars)
    filed = long_ones.select(F.col("h1").alias("b"), F.col("counts").alias("b_n"), F.explode(filed_keys(line, n, edits, chars)).alias("key"))
    # Two plain expressions instead of one that covers all lengths: Java compiles no method of its size.
    usual = n >= edits * chars + edits
    seek = lambda rows, keys: rows.select(F.col("h1").alias("a"), F.col("counts").alias("a_n"), F.explode(keys).alias("key"))
    looked = seek(long_ones.filter(usual), looked_keys(line, n, edits)).unionByName(seek(long_ones.filter(~usual), looked_keys_of_short(line, n, edits, chars)))
    same = filed.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), "key")  # the same exchange as that of ``filed``
    meet = lambda rows, once: rows.join(filed, "key").filter(once & counts_near(F.col("a_n"), F.col("b_n"), edits)).select("a", "b")
    met = meet(looked, F.col("a") != F.col("b")).unionByName(meet(same, F.col("a") < F.col("b")))
    pairs = stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-candidates")
    del filed, looked, same, met
    _release(spark)
    ids = pairs.select(F.col("a").alias("h1")).unionByName(pairs.select(F.col("b").alias("h1"))).distinct()
    ids = F.broadcast(ids) if 2 * pairs.count() <= BROADCAST_LINES else ids
    texts = stored(long_ones.join(ids, "h1", "left_semi").select("h1", "h2", "line"), "line-texts")
    side = lambda name: texts.select(F.col("h1").alias(name), F.struct("h1", "h2").alias(f"{name}_id"), F.col("line").alias(f"{name}_line"), counts(F.col("line"), COUNTED_THEN).alias(f"{name}_n"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(counts_near(F.col("a_n"), F.col("b_n"), edits))
    bound_of = allowed(F.least(F.length("a_line"), F.length("b_line")), edits, chars)
    near = both.filter(edit_distance(F.col("a_line"), F.col("b_line"), edits) <= bound_of)
    return stored(near.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")), "line-links")


def _joined(rows: DataFrame, keys: list[str], groups: DataFrame, value: str, rows_of_a_group: str, total: int) -> DataFrame:
    """``rows`` with ``value`` of their group, or null: a left join that no frequent key brings into one task.

    Few groups are broadcast. Else: ``groups`` has a row per key and how many rows it has. Of keys with a ten thousandth of all rows or more there are
    ten thousand at most: these are broadcast, and their rows are dealt by something else in the join with the others.
    """
    if groups.count() <= SMALL_GROUPS:
        return rows.join(F.broadcast(groups.select(*keys, value)), keys, "left").select(*rows.columns, value)
    most = max(LEAST_HOT, total // 10_000)
    hot = groups.filter(F.col(rows_of_a_group) > most).select(*keys, F.col(value).alias("hot"))
    rest = groups.filter(F.col(rows_of_a_group) <= most).select(*[F.col(k).alias(f"g_{k}") for k in keys], F.col(value).alias("rest"))
    known = rows.join(F.broadcast(hot), keys, "left")
    elsewhere = F.xxhash64(*[F.col(c) for c in rows.columns])
    known = known.withColumns({f"k_{k}": F.when(F.col("hot").isNull(), F.col(k)).otherwise(elsewhere) for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & (F.col(f"k_{k}") == F.col(f"g_{k}"))
    joined = known.join(rest, condition, "left")
    return joined.select(*rows.columns, F.coalesce("hot", "rest").alias(value))


def repeated_lines(docs: DataFrame, edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """(doc_id, mark, dropped, near): positions of the lines to take out of each text that has any.

    Lines that links lead to form a class; of each class the first line stays, by doc_id (null last), the text's hash
    and position. ``near`` has the positions of those taken out for a line that is not equal.
    """
    lines = lines_of(docs)
    different = stored(different_lines(lines), "different-lines")
    _release(docs.sparkSession)
    found = connected_components(line_links(different, edits, chars)).select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), F.col("component").alias("root"))
    _release(docs.sparkSession)
    # Only lines that come again, or that are near to others, can be taken out.
    met = different.select("h1", "h2", "n").join(found, ["h1", "h2"], "left").filter((F.col("n") > 1) | F.col("root").isNotNull())
    met = stored(met.withColumn("root", F.coalesce("root", F.struct("h1", "h2"))), "repeated-lines")
    total = met.agg(F.sum("n")).first()[0] or 0
    places = _joined(lines.select("doc_id", "mark", "pos", "h1", "h2"), ["h1", "h2"], met, "root", "n", total).filter(F.col("root").isNotNull())
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "pos", "h1", "h2").alias("place")
    marked = stored(places.select(F.col("root.h1").alias("r1"), F.col("root.h2").alias("r2"), order), "line-places")
    first = stored(marked.groupBy("r1", "r2").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1"), "first-lines")
    taken = _joined(marked, ["r1", "r2"], first, "first", "n", total).filter(F.col("first").isNotNull() & ~F.col("place").eqNullSafe(F.col("first")))
    near = (F.col("place.h1") != F.col("first.h1")) | (F.col("place.h2") != F.col("first.h2"))
    # Rows with one id and one text come to the same places; each place counts once.
    once = taken.select(F.col("place.doc_id").alias("doc_id"), F.col("place.mark").alias("mark"), F.col("place.pos").alias("pos"), near.alias("near"))
    return once.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("dropped"), F.collect_set(F.when(F.col("near"), F.col("pos"))).alias("near"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """All columns of ``docs``, with the text that stays in ``text``, and n_lines, n_dropped and n_near.

    Lines end at a line feed; those without a word always stay. Lines are near within one edit for each ``chars``
    characters of the shorter one, ``edits`` at most; equal ones are near at any length. A null text stays null, with
    no lines; an empty one stays empty; lines and texts may have any length. Rows with a null doc_id come last in the
    order. Rows that repeat an id and its text are the same document and keep the same lines. Columns of ``docs``
    named n_lines, n_dropped or n_near are replaced; all others are handed through, whatever their names. An empty
    table gives an empty one.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "n_near")]
    # Written first, so that its size is known and a small one needs no shuffle of the texts.
    gone = stored(repeated_lines(docs.select("doc_id", "text"), edits, chars).select("doc_id", "mark", "dropped", F.size("near").alias("n_near")), "lines-to-drop")
    if (gone.agg(F.sum(F.size("dropped") + 3)).first()[0] or 0) <= SMALL_POSITIONS:
        gone = F.broadcast(gone)
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in names]).alias("row"))  # its columns' names meet no others
    text = F.col("row")["text"].cast("string")
    match = F.col("row")["doc_id"].cast("long").eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("mark"))
    joined = whole.join(gone, match, "left")
    lines = F.split(text, "\n")

    def left(all_lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("dropped"))
        return F.array_join(F.transform(kept, lambda i: all_lines[i]), "\n")

    return joined.select(
        *[F.when(F.col("dropped").isNull(), text).otherwise(bound(lines, left)).alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names],
        # A match begins at a line's first word and takes the rest of the line.
        F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}][^\\n]*+")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", "n_near", F.length("text").alias("kept_chars"), F.md5("text").alias("kept_md5"))
