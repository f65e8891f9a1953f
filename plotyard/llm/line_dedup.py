"""Near-duplicate lines by a segment-partition edit join, as DataFrame and SQL functions only.

Exact copies of a line that is not blank are found at every length. The edits that near copies may have grow with the line: one
for every ``CHARS_PER_EDIT`` code points of the shorter line, at most ``threshold``.

Two lines within k edits share at least one of k + 1 segments of the shorter one, nearly in place.
Every distinct line is indexed under its segments, each with the line's length and the segment's number; every line
probes, for each length it may match, only the substrings that can start a match given the length difference. A pair counts
where it meets first. Pairs that meet must also be close in their letter counts (each edit changes at most two), and are
verified by banded bit-parallel edit distance: the band of 2 * threshold + 1 diagonals is one machine word that slides along the
lines. Letters are counted only of lines that meet others.

Distinct lines, not occurrences, are joined, so copies meet nobody. Linked lines form classes (connected components);
of each class the first occurrence in order of (doc_id, line number) stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotyard.llm.columns import let, unused_names, with_row_ids
from plotyard.llm.components import components
from plotyard.session import discard, hand_over, release_shuffles

THRESHOLD = 2
CHARS_PER_EDIT = 10  # few edits make unrelated short lines equal, so short lines may have fewer
BLOCK = 32  # lines with a segment in common that are paired as rows; more are verified in blocks of about this size
LONG_LINE = 128  # code points
COUNTED = "etaoinsrhdlu"  # characters whose counts, modulo 16, bound the edit distance from below


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether the edit distance of ``a`` and ``b``, ``a`` at least as long and at most ``k`` longer, is at most ``k``.

    Bit i of the word is the cell on diagonal i - k. The distance is followed down the lowest diagonal until it meets the
    last row of ``a`` and then along that row.
    """
    full, low = (1 << (2 * k + 1)) - 1, 1 << (2 * k)

    def run(s: Column) -> Column:
        turn = F.size(s["a"]) - k

        def step(acc: Column, i: Column) -> Column:
            equal = F.lit(0)
            for bit in range(2 * k + 1):
                equal = equal + F.when(F.get(s["a"], i - k + bit) == F.get(s["b"], i), 1 << bit).otherwise(0)

            def advance(x: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                return (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(full))

            def move(d0: Column) -> Column:
                vp, vn = acc["vp"], acc["vn"]
                hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d0.bitwiseOR(vp)))
                hn = d0.bitwiseAND(vp)
                down = F.when(d0.bitwiseAND(F.lit(low)) == 0, 1).otherwise(0)
                past = i - turn + 1  # the last row leaves the band by one cell a column
                bit = F.coalesce(*(F.when(past == m, low >> m) for m in range(1, 2 * k + 1)), F.lit(0))
                along = F.when(hp.bitwiseAND(bit) != 0, 1).otherwise(0) - F.when(hn.bitwiseAND(bit) != 0, 1).otherwise(0)
                half = F.shiftright(d0, 1)
                return F.struct(
                    hn.bitwiseOR(F.lit(full).bitwiseXOR(half.bitwiseOR(hp).bitwiseAND(F.lit(full)))).alias("vp"),
                    half.bitwiseAND(hp).alias("vn"),
                    (acc["d"] + F.when(i < turn, down).otherwise(along)).alias("d"),
                )

            return F.when(acc["d"] > 3 * k, acc).otherwise(let(let(equal, advance), move))

        start = F.struct(F.lit(full >> k << k).alias("vp"), F.lit(0).alias("vn"), F.lit(k).alias("d"))
        columns = F.when(F.size(s["b"]) > 0, F.sequence(F.lit(0), F.size(s["b"]) - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.aggregate(columns, start, step)["d"] <= k

    return let(F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b")), run)


def letter_counts(line: Column) -> Column:
    """Counts of ``COUNTED`` modulo 16, four bits each."""
    packed = F.lit(0).cast("long")
    for k, c in enumerate(COUNTED):
        count = (F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(count.bitwiseAND(F.lit(15)), 4 * k))
    return packed


def _counts_differ(a: Column, b: Column) -> Column:
    total = F.lit(0)
    for k in range(len(COUNTED)):
        nibble = lambda x: F.shiftrightunsigned(x, 4 * k).bitwiseAND(F.lit(15))  # noqa: E731, B023
        gap = F.pmod(nibble(a) - nibble(b), F.lit(16))
        total = total + F.least(gap, 16 - gap)
    return total


def _segment(length: Column, i: int, k: int) -> tuple[Column, Column]:
    """Start (from 1) and size of segment ``i`` (from 0) of a line of ``length``; the last ones are one longer."""
    size, longer = F.floor(length / (k + 1)).cast("int"), length % (k + 1)
    ones = F.greatest(F.lit(i) - (k + 1 - longer), F.lit(0))
    return size * i + ones + 1, size + F.when(F.lit(i) >= k + 1 - longer, 1).otherwise(0)


def _moves(i: int, shorter: int, k: int) -> range:
    """Places, next to its own, where segment ``i`` of a line can stand in one that is longer by ``shorter``."""
    return range(max(-i, shorter - (k - i)), min(i, shorter + (k - i)) + 1)


def _key(line: Column, at: Column, size: Column, length: Column, i: int) -> Column:
    return F.xxhash64(F.substring(line, at, size), length, F.lit(i))


def permitted_edits(length: Column, threshold: int, chars_per_edit: int) -> Column:
    """Edits within which the shorter line, of ``length``, is a near copy."""
    return F.least(F.floor(length / chars_per_edit).cast("int"), F.lit(threshold))


def _index_and_probes(lines: DataFrame, threshold: int, chars_per_edit: int) -> tuple[DataFrame, DataFrame]:
    """``key`` and ``code`` of segments and of probes. A segment's code is its line's id and its number, a probe's the id and whether it looks
    for lines of its own length. Where these have the segment in the same place, the segments meet by themselves and need no probe."""
    n, line = F.col("n"), F.col("line")
    none = F.expr("cast(array() as array<bigint>)")
    segments, probes, own_length = none, [], F.lit(0)
    for k in range(1, threshold + 1):
        here = lambda length: permitted_edits(length, threshold, chars_per_edit) == k  # noqa: E731, B023
        segments = F.when(here(n), F.array(*(_key(line, *_segment(n, i, k), n, i) for i in range(k + 1)))).otherwise(segments)
        own_length = F.when(here(n), sum(len(_moves(i, 0, k)) - 1 for i in range(k + 1))).otherwise(own_length)
    for shorter in range(threshold + 1):
        keys = none
        for k in range(max(shorter, 1), threshold + 1):
            length = n - shorter
            found = []
            for i in range(k + 1):
                at, size = _segment(length, i, k)
                found += [_key(line, at + move, size, length, i) for move in _moves(i, shorter, k) if shorter or move]
            if found:
                keys = F.when(permitted_edits(length, threshold, chars_per_edit) == k, F.array(*found)).otherwise(keys)
        probes.append(keys)
    index = lines.select("id", F.posexplode(segments).alias("i", "key"))
    index = index.select("key", (F.col("id") * (threshold + 1) + F.col("i")).alias("code"))
    probe = lines.select("id", own_length.alias("own"), F.posexplode(F.concat(*probes)).alias("at", "key"))
    probe = probe.select("key", (F.col("id") * 2 + F.when(F.col("at") < F.col("own"), 1).otherwise(0)).alias("code"))
    return index, probe


def _pieces_left(a: Column, b: Column, n: Column, k: int) -> Column:
    """Whether ``a`` holds enough pieces of ``b``, of length ``n``, for k edits, each of which breaks one piece at most. A long line has more of
    them, as edits that lie apart then break more."""

    def enough(pieces: int) -> Column:
        left = F.lit(0)
        for i in range(pieces):
            left = left + F.when(F.contains(a, F.substring(b, *_segment(n, i, pieces - 1))), 1).otherwise(0)
        return left >= pieces - k

    return enough(2 * (k + 1)) & ((n < LONG_LINE) | enough(16))


def _near(a: Column, b: Column, threshold: int, chars_per_edit: int) -> Column:
    """Whether a probing line ``a`` and an indexed one ``b``, which met at segment ``b.i``, are near copies that met at no earlier segment."""

    def check(n: Column) -> Column:
        shorter, out = a["n"] - n, F.lit(False)
        for k in range(1, threshold + 1):
            earlier = F.lit(False)
            for i in range(k):
                at, size = _segment(n, i, k)
                same = F.lit(False)
                for move in range(-i, i + 1):
                    allowed = F.lit(False)
                    for s in range(k + 1):
                        allowed = allowed | ((shorter == s) if move in _moves(i, s, k) else F.lit(False))
                    same = same | (allowed & (F.substring(a["line"], at + move, size) == F.substring(b["line"], at, size)))
                earlier = earlier | ((b["i"] > i) & same)
            fits = (_counts_differ(a["letters"], b["letters"]) <= 2 * k) & _pieces_left(a["line"], b["line"], n, k) & ~earlier
            out = F.when(permitted_edits(n, threshold, chars_per_edit) == k, F.when(fits, within_edits(a["line"], b["line"], k)).otherwise(False)).otherwise(out)
        return out

    # lines of equal length would meet in both directions; a key is a hash, so the lengths are compared too
    fresh = F.when(a["equal"] == 1, (a["n"] == b["n"]) & (b["id"] < a["id"])).otherwise((a["n"] > b["n"]) & (a["n"] <= b["n"] + threshold))
    return F.when(fresh, check(b["n"])).otherwise(False)


def _side(rows: DataFrame, code: str, side: str, texts: DataFrame, threshold: int) -> DataFrame:
    """``rows`` with ``side``, what ``_near`` needs of the line that a column of codes stands for."""
    per_line, mark = (threshold + 1, "i") if side == "b" else (2, "equal")
    coded = rows.withColumn("of_line", F.expr(f"{code} div {per_line}"))
    found = coded.join(texts, F.col("of_line") == texts["id"])
    described = F.struct("id", F.pmod(code, F.lit(per_line)).cast("int").alias(mark), "line", "n", "letters").alias(side)
    return found.select(*rows.columns, described)


def _in_blocks(members: DataFrame, side: str) -> DataFrame:
    """The lines of a key in blocks of about ``BLOCK``, chosen by a hash of the line: ``key``, the number of blocks, ``block_<side>`` and the lines."""
    sizes = members.groupBy(F.col("key").alias("of_key")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(f"blocks_{side}"))
    placed = members.join(sizes, F.col("key") == F.col("of_key"))
    block = F.pmod(F.xxhash64(f"{side}.id"), F.col(f"blocks_{side}")).cast("int").alias(f"block_{side}")
    return placed.groupBy("key", f"blocks_{side}", block).agg(F.collect_set(side).alias(side))


def _links_of_blocks(a: Column, b: Column, threshold: int, chars_per_edit: int) -> Column:
    """Array of ``id``, ``other`` and ``n``: lines of two blocks that have near copies in the other, how many, and a line that each is connected to."""
    pairs = F.flatten(F.transform(a, lambda x: F.transform(F.filter(b, lambda y: _near(x, y, threshold, chars_per_edit)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))

    def summed(found: Column) -> Column:
        ids = F.array_distinct(F.concat(F.transform(found, lambda e: e["a"]), F.transform(found, lambda e: e["b"])))
        start = F.transform(ids, lambda v: F.struct(v.alias("id"), v.alias("other"), F.size(F.filter(found, lambda e: (e["a"] == v) | (e["b"] == v))).cast("long").alias("n")))

        def merge(acc: Column, e: Column) -> Column:
            label = lambda v: F.get(F.filter(acc, lambda x: x["id"] == v), F.lit(0))["other"]
            least, most = F.least(label(e["a"]), label(e["b"])), F.greatest(label(e["a"]), label(e["b"]))
            renamed = lambda x: F.struct(x["id"].alias("id"), F.when(x["other"] == most, least).otherwise(x["other"]).alias("other"), x["n"].alias("n"))
            return F.when(least == most, acc).otherwise(F.transform(acc, renamed))

        return F.aggregate(found, start, merge)

    return let(pairs, summed)


def linked_lines(lines: DataFrame, threshold: int = THRESHOLD, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """``id``, ``other`` and ``n``, a written table: distinct lines that have near copies within the edits permitted to the shorter line. ``n`` summed
    over an id is the number of its near copies; the pairs of ``id`` and ``other`` connect what near copies connect. ``lines``,
    a written table as it is read several times, has ``id``, ``line`` and ``n`` (its code points).

    A segment or probe that at most ``BLOCK`` lines have in common gives a row per pair. The lines of a more common one are put
    in blocks and each two blocks are one row, in which pairs are verified and counted, so that rows never grow with the
    square of a group.
    """
    spark = lines.sparkSession
    index, probe = _index_and_probes(lines, threshold, chars_per_edit)
    a, b = F.expr("probing div 2"), F.expr(f"indexed div {threshold + 1}")
    owner = F.expr(f"code div {threshold + 1}")
    held = index.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.min(owner).alias("low"), F.max(owner).alias("high"))
    # probes that meet another line, a row each, however many lines they meet, and segments that several lines have in the same place
    found = held.join(probe.withColumnRenamed("code", "probing"), "key", "left").withColumn("shared", F.col("low") != F.col("high"))
    found = found.filter(F.col("shared") | (F.col("low") != a)).select("key", "probing", (F.col("lines") > BLOCK).alias("common"), "shared")
    found = hand_over(found, "met-probes")
    release_shuffles(spark)
    keys = hand_over(found.select("key", "common", "shared").distinct(), "met-segments")
    segments = hand_over(index.withColumnRenamed("code", "indexed").join(keys, "key"), "met-index")
    release_shuffles(spark)
    probes = found.filter("probing IS NOT NULL").select("key", "probing", "common")
    probes = probes.unionByName(segments.filter("shared").select("key", (b * 2 + 1).alias("probing"), "common"))
    segments_of = segments.drop("shared")
    wanted = probes.select(a.alias("id")).unionByName(segments.select(b.alias("id"))).distinct()
    # ids that grow with the input are merged at every size, never broadcast
    texts = lines.join(wanted.hint("merge"), "id", "left_semi").select("id", "line", "n", letter_counts(F.col("line")).alias("letters"))
    texts = hand_over(texts, "met-texts")
    release_shuffles(spark)
    letters = lambda rows, line, side: rows.filter(~F.col("common")).drop("common").withColumn("id", line).join(
        texts.select("id", F.col("letters").alias(f"letters_{side}")), "id"
    )
    met = letters(probes, a, "a").drop("id").join(letters(segments_of, b, "b").drop("id"), "key")
    once = (a != b) & ((F.pmod("probing", F.lit(2)) == 0) | (b < a))
    met = met.filter(once & (_counts_differ(F.col("letters_a"), F.col("letters_b")) <= 2 * threshold))
    met = hand_over(met.select("probing", "indexed").distinct(), "met-lines")
    release_shuffles(spark)
    near = _near(F.col("a"), F.col("b"), threshold, chars_per_edit)
    pairs = _side(_side(met, "probing", "a", texts, threshold), "indexed", "b", texts, threshold)
    pairs = hand_over(pairs.filter(near).select("a.id", F.col("b.id").alias("other")), "near-pairs")
    often = [rows.filter("common").select("key", code) for rows, code in ((probes, "probing"), (segments, "indexed"))]
    sides = [_in_blocks(_side(rows, rows.columns[1], side, texts, threshold).select("key", side), side) for rows, side in zip(often, "ab", strict=True)]
    counts = sides[1].select("key", "blocks_b").distinct()
    # every block of probes goes to each block of segments by number, so that a common key is spread over tasks
    sent = sides[0].join(counts, "key").withColumn("block_b", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
    blocks = sent.join(sides[1].drop("blocks_b"), ["key", "block_b"])
    # few bytes, but much work: dealt out by hand, as Spark would put small partitions together
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks = blocks.repartition(tasks, "key", "block_a", "block_b")
    blocks = blocks.select(F.explode(_links_of_blocks(F.col("a"), F.col("b"), threshold, chars_per_edit)).alias("v")).select("v.*")
    one = F.lit(1).cast("long").alias("n")
    links = pairs.select("id", "other", one).unionByName(pairs.select(F.col("other").alias("id"), "other", one)).unionByName(blocks)
    links = hand_over(links, "line-links")
    release_shuffles(spark)
    discard(found, keys, segments, met, texts, pairs)
    return links


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(7), line).alias("h2")]


def _exploded(documents: DataFrame, min_chars: int | None, row: str) -> DataFrame:
    """A row per line: document row, ``doc_id``, line number and the line; ``eligible`` if it takes part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.col(row).alias("doc_row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    lines = docs.select("doc_row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.withColumn("eligible", (F.length("line") >= (min_chars or 1)) & F.col("line").rlike(r"[^\s]"))


def duplicate_lines(
    documents: DataFrame, threshold: int = THRESHOLD, min_chars: int | None = None, row: str | None = None
) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed``, ``removed`` (sorted line numbers from 0 that repeat an earlier line of any
    document, exactly or within the permitted edits, directly or over other lines), ``n_links`` (other distinct lines within those
    edits, summed over its lines) and ``first_docs`` (sorted ids of the documents that keep the removed lines).

    ``documents`` needs ``doc_id`` and ``text``; other columns are ignored. A null text is an empty one: one empty line, which
    stays. Lines are what line feeds part; blank ones stay. Where ``min_chars`` is given, lines under it stay and all others may have
    ``threshold`` edits. Null ids come first; of repeated rows one
    keeps the lines. An empty table gives no rows. ``doc_row`` is the column ``row`` where named, unique and the same whenever the table is read. The result is a written table.
    """
    if min_chars is not None and min_chars < 3 * (threshold + 1):
        raise ValueError("lines of min_chars must give segments of three characters")
    chars_per_edit = CHARS_PER_EDIT if min_chars is None else min_chars // max(threshold, 1)
    spark = documents.sparkSession
    if row is None:
        (row,) = unused_names(documents, 1)
        documents = with_row_ids(documents, row)
    occurrences = _exploded(documents, min_chars, row)
    distinct = occurrences.filter("eligible").groupBy("line").agg(F.count(F.lit(1)).alias("copies"))
    lines = hand_over(distinct.select(F.monotonically_increasing_id().alias("id"), "line", F.length("line").alias("n"), "copies"), "lines")
    release_shuffles(spark)
    links = linked_lines(lines, threshold, chars_per_edit)
    degree = links.groupBy("id").agg(F.sum("n").alias("links"))
    classes = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    # lines with a copy or a link; the rest of the lines need no class
    hashed = lines.select("id", "copies", *_hashes(F.col("line")))
    known = hashed.join(classes.join(degree, "id"), "id", "left").filter("copies > 1 OR links IS NOT NULL")
    known = known.select("h1", "h2", F.coalesce("component", "id").alias("class"), F.coalesce("links", F.lit(0)).alias("links"))
    known = hand_over(known, "line-classes")
    release_shuffles(spark)
    discard(lines, links, classes)
    own, (h1, h2) = F.col("eligible"), _hashes(F.col("line"))
    marked = occurrences.select(  # lines that take no part get a key of their own
        "doc_row", "doc_id", "line_no", "eligible", F.when(own, h1).otherwise(F.xxhash64("doc_row", "line_no")).alias("h1"), F.when(own, h2).otherwise(0).alias("h2")
    )
    of_class = lambda c: F.when(own, F.col(c)).alias(c)
    placed = hand_over(marked.join(known, ["h1", "h2"], "left").select("doc_row", "doc_id", "line_no", of_class("class"), of_class("links")), "placed-lines")
    release_shuffles(spark)
    discard(known)
    place = F.struct("doc_id", "line_no", "doc_row")
    # a written table, so that Spark can split the join where one class holds much of the lines
    firsts = hand_over(placed.filter("class IS NOT NULL").groupBy("class").agg(F.min(place).alias("first")), "first-lines")
    judged = placed.join(firsts, "class", "left").withColumn("gone", F.col("class").isNotNull() & (F.col("first") != place))
    gone = lambda c: F.collect_list(F.when(F.col("gone"), c))
    found = judged.groupBy("doc_row", "doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.col("gone").cast("long")).alias("n_removed"),
        F.array_sort(gone(F.col("line_no"))).alias("removed"),
        F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"),
        F.array_sort(F.array_distinct(gone(F.col("first.doc_id")))).alias("first_docs"),
    )
    found = hand_over(found, "judged-documents")
    release_shuffles(spark)
    discard(placed, firsts)
    return found


def without_duplicate_lines(
    documents: DataFrame, threshold: int = THRESHOLD, min_chars: int | None = None, plain_reader: bool = False
) -> DataFrame:
    """``documents``, same columns, without the lines that repeat earlier ones; rows that lose their last word go. ``n_chars``, where
    there is one, is that of the new text.

    Null texts, blank texts, repeated rows and null ids are as in ``duplicate_lines``: a row without words stays as it is, of repeated
    rows one keeps the lines. An empty table gives an empty one. Columns of any name come through. A ``plain_reader`` of files is read again, anything
    else is first written.
    """
    row, removed = unused_names(documents, 2)
    numbered = with_row_ids(documents, row, plain_reader)
    gone = duplicate_lines(numbered, threshold, min_chars, row).filter("n_removed > 0")
    gone = gone.select(F.col("doc_row").alias(row), F.col("removed").alias(removed))
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(removed), i)), "\n")
    joined = numbered.join(gone.hint("merge"), row, "left")  # grows with the input: never broadcast
    joined = joined.withColumn("text", F.when(F.col(removed).isNull(), F.col("text")).otherwise(kept))
    left = joined.filter(F.col(removed).isNull() | F.col("text").rlike(r"[^\s]"))
    if "n_chars" in documents.columns:
        size = F.length("text").cast(documents.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", F.when(F.col(removed).isNull(), F.col("n_chars")).otherwise(size))
    return left.select(*documents.columns)
