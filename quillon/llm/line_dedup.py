"""Removal of repeated line runs with a suffix structure made by prefix doubling.

A text is a sequence of units: lines, cut further after each sentence end (full
stop, '!', '?', ';' and an ellipsis with space behind, and their forms in other
writing), as passages are often pasted into the middle of a line; a sentence
of one word goes with the one before it. A sentence
of more than 12 words (half of ``min_words``) is cut after its words of the
first of ``LEVELS`` that occurs, and parts that are still too long by the next
level; what no level cuts is cut at the least hashes of windows. So each cut
depends on the words around alone: of any 51 words (2 * ``min_words`` + 1) that
occur at two places, 25 or more are whole units at both.

1. Classes. Units are counted by a 64-bit hash, with map-side aggregation; a
   class that occurs once is dropped. (A run that counts has two units at
   least, so a confusion takes two pairs of adjacent units with equal hashes.)
   For each class it is known whether all its units have one left, and one
   right neighbour.
   Where a unit follows itself often (a word said a thousand times), the middle
   is one unit with its number: ``min_words`` words of it stay at both ends, so
   runs that lead into or out of such a place are found as before.
2. Segments. Where a unit is always followed by the same unit, which always
   follows it, both are one segment: unary paths of the suffix tree are
   contracted before any sorting. A document that is copied whole is one
   segment, whatever its length.
3. Prefix doubling names the runs of 1, 2, 4, ... segments: a run's name is a
   64-bit digest of the names of its halves, so names of all lengths are made in
   one pass over a document's segments, for the runs that begin and those that
   end at each. Names serve as ranks, as only their equality is used. Doubling
   ends at the length that ``min_words`` words can have.
4. Intervals. All suffixes that begin with one run of ``min_words`` words are a
   longest-common-prefix interval; its name is two names of 2**k that overlap.
   The first copy of an interval's run (smallest doc_id, then position) stays
   and later ones are deleted. The shortest runs of ``min_words`` words that
   begin, or end, at each segment cover every maximal repeated run, so the
   units that go are those of the maximal runs.

All of it is DataFrame code. A document's units are one row of hashes; rows of
single units are made for counting and joining only. A frequent unit is folded
by partial aggregation before the shuffle; the join with the classes has two
plain sides, so AQE can split its rows, too.

Defined results: null text has no units and stays null; a text whose units all
go becomes empty but for white space before its first word; if doc_ids are null, repeated, negative or 2**39 and above,
the rows are numbered in order of doc_id and text first, and repeated rows then
are documents that repeat each other; texts of more than 2**24 units are
refused; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import materialize, release, tidy

MIN_WORDS = 25
STRIDE = 1 << 24
MAX_ID = 1 << 39
#: White space, of all alphabets.
SPACE = r"\s\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "".join(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c, re.ASCII))
#: Sentence ends that need a space behind, and those of writing that needs none.
STOPS = ".!?;\u2026"
WIDE_STOPS = "\u3002\uff01\uff1f\uff1b\uff61\u061f\u06d4\u061b\u0964\u0965\u1362\u1367\u0589\u17d4\u104b"
#: Writing that needs the wide forms. For other texts the patterns below are
#: of Latin-1 alone, which Java's matcher looks up in a table.
FAR = r"[։-\x{10ffff}]"
NEAR_STOPS, NEAR_SPACE = ".!?;", r" \t\n\x0b\f\r\x85\xa0"
_SIGNS = rf"[^\p{{L}}\p{{N}}{SPACE}]{{0,64}}+"
#: A unit ends after a line break, or after a sentence end (other marks may follow) and the space behind it.
BREAK = rf"[\n{STOPS}{WIDE_STOPS}](?:(?<=\n)|(?<=[{WIDE_STOPS}]){_SIGNS}|{_SIGNS}[{SPACE}])[{SPACE}]*+(?!\z)"
NEAR_BREAK = rf"[\n{NEAR_STOPS}](?:(?<=\n)|{_SIGNS}[{NEAR_SPACE}])[{NEAR_SPACE}]*+(?!\z)"
#: The mark of a break before a sentence of one word, where no line ends.
ONE_WORD = rf"@(?<!\n@)(?=[^{NEAR_SPACE}@]++ @)"
#: Letters of writing without spaces; each counts as a word.
ALONE = r"\u0e01-\u0eff\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\x{20000}-\x{3ffff}"
WORD = rf"[{ALONE}]|[^{SPACE}{ALONE}]++"
#: Levels of words after which long sentences are cut: by their last sign, then by their length.
LEVELS = [rf"[{ends}][{NEAR_SPACE}]++(?!\z)" for ends in (r",;:)\]dl", "ghyfkp", "uizmcbv", "an", "ro", "ts")]
LEVELS += [rf"(?<![^{NEAR_SPACE}])[^{NEAR_SPACE}]{{{size}}}[{NEAR_SPACE}]++(?!\z)" for size in ("12,", "9,", "7,", "5,", "4", "3", "1,2")]
#: One that is not in the text marks its breaks. (A text with all of them is cut in another way, and keeps sentences of one word.)
MARKS = ("\x01", "\x02", "\ue000")


def _blanks(unit: Column) -> Column:
    return F.octet_length(unit) - F.octet_length(F.replace(unit, F.lit(" "), F.lit("")))


def _plain(text: Column) -> Column:
    """Whether words are parted by single blanks and line breaks alone, and no
    wide forms are there, so that words within a unit are its inner blanks + 1."""
    odd = F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" "))
    return ~(odd | F.rlike(text, F.lit(rf"[\t\x0b\f\r\x85\xa0{FAR[1:-1]}]")))


def n_words(unit: Column, plain: Column | None = None) -> Column:
    """Maximal runs without white space; letters of ALONE are words of their
    own. ``unit`` is trimmed if ``plain`` is given."""
    counted = F.regexp_count(unit, F.lit(WORD))
    if plain is None:
        return counted
    return F.when(plain, F.when(unit == "", 0).otherwise(_blanks(unit) + 1)).otherwise(counted)


def _cut(text: Column, pattern: str, mark: str, join: str = "") -> Column:
    """``text`` cut after each match, which is not at its end; joined the parts
    are the text again. Where ``join`` (with ``@`` for the mark) matches, there is no cut."""
    if not mark:
        return F.regexp_extract_all(text, F.lit(f"(?s)(?=.).*?(?:{pattern}|\\z)"), F.lit(0))
    marked = F.regexp_replace(text, F.lit(pattern), F.lit("$0" + mark))
    return F.split(F.regexp_replace(marked, F.lit(join.replace("@", mark)), F.lit("")) if join else marked, mark)


def _sentences(text: Column, mark: str, plain: Column) -> Column:
    """Lines, cut at sentence ends; a sentence of one word goes with the one before it."""
    far, near = (_cut(text, rx, mark, ONE_WORD) for rx in (BREAK, NEAR_BREAK))
    return F.when(plain | ~F.rlike(text, F.lit(FAR)), near).otherwise(far)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _chunks(sentence: Column, most: int) -> Column:
    """A sentence of more than ``most`` words, cut after each word whose hash is
    the least in some window of ``most`` words (the first of equal ones)."""

    def cut(tokens: Column) -> Column:
        def ends(hashes: Column) -> Column:
            def least(at: Column) -> Column:
                return _let(F.slice(hashes, at, most), lambda w: (at + F.array_position(w, F.array_min(w)) - 1).cast("int"))

            inner = F.transform(F.sequence(F.lit(1), F.size(tokens) - most + 1), least)
            return F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(F.size(tokens))))

        def pieces(at: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(1), F.size(at) - 1),
                lambda k: F.array_join(F.slice(tokens, F.get(at, k - 1) + 1, F.get(at, k) - F.get(at, k - 1)), ""),
            )

        hashes = F.transform(tokens, lambda t: F.xxhash64(F.regexp_replace(t, F.lit(f"[{SPACE}]+"), F.lit(""))))
        return _let(_let(hashes, ends), pieces)

    return _let(F.regexp_extract_all(sentence, F.lit(f"[{SPACE}]*+(?:{WORD})[{SPACE}]*+"), F.lit(0)), cut)


def _most(min_words: int) -> int:
    """Of 2 * ``min_words`` + 1 words pasted anywhere, whole units hold ``min_words``
    at least if each end loses so many words, and one more, at most."""
    return max(min_words // 2, 1)


def _parts(unit: Column, most: int, plain: Column, mark: str, level: int = 0) -> Column:
    """A unit of more than ``most`` words, cut by the levels from ``level`` on."""
    if level == len(LEVELS):
        return _chunks(unit, most)
    parts = _cut(unit, LEVELS[level], mark)
    return F.flatten(F.transform(parts, lambda u: F.when(_long(u, most, plain), _parts(u, most, plain, mark, level + 1)).otherwise(F.array(u))))


def _long(unit: Column, most: int, plain: Column) -> Column:
    """Whether a unit has more than ``most`` words."""
    trimmed = F.rtrim(unit, F.lit(" \n"))
    words = F.when(plain, _blanks(trimmed) + 1).otherwise(F.regexp_count(unit, F.lit(WORD)))
    return (F.octet_length(unit) > 2 * most) & (words > most)


def units(text: Column, most: int = _most(MIN_WORDS)) -> Column:
    """The units of a text; joined they are the text again. Every ``most`` words
    in a row hold the end of a unit, and which one depends on these words (and
    on whether a sentence of one word follows them) alone."""

    def cut(plain: Column, mark: str) -> Column:
        parts = F.transform(_sentences(text, mark, plain), lambda u: F.when(_long(u, most, plain), _parts(u, most, plain, mark)).otherwise(F.array(u)))
        return F.flatten(parts)

    def choice(plain: Column) -> Column:
        out = cut(plain, "")
        for mark in reversed(MARKS):
            out = F.when(F.contains(text, F.lit(mark)), out).otherwise(cut(plain, mark))
        return out

    return _let(_plain(text), choice)


def _numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text, rest): ``doc`` is a small number, unique, in order of
    doc_id; ``rest`` has all columns of the row as they were."""
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.struct("*").alias("rest"))
    odd = F.col("doc_id").isNull() | (F.col("doc_id") < 0) | (F.col("doc_id") >= MAX_ID)
    ids = docs.select("doc_id", odd.cast("int").alias("odd")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("odd").alias("odd"))
    if ids.filter("n > 1 OR odd = 1").isEmpty():
        return docs.withColumn("doc", F.col("doc_id"))
    rows = materialize(docs.orderBy("doc_id", "text").withColumn("at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"part": F.shiftright("at", 33), "place": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    # One row per partition, so this window is over few rows.
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(parts, "part").select((F.col("before") + F.col("place")).alias("doc"), "doc_id", "text", "rest")


def unit_hashes(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, keys, words, starts, n, own): the units of each of ``docs`` (doc,
    text): hashes, numbers of words, and where they start among ``n`` units
    (null: one each). Where one follows itself often, ``min_words`` words of
    it stay at both ends, and those between are one unit with their number; ``own``
    has the runs [start, end) of later copies that such a place has in itself."""
    cut = docs.filter("text is not null").select("doc", _plain(F.col("text")).alias("plain"), units(F.col("text"), _most(min_words)).alias("units"))
    refused = F.raise_error(F.lit(f"a text has more than {STRIDE} units")).cast(cut.schema["units"].dataType)
    cut = cut.withColumn("units", F.when(F.size("units") > STRIDE, refused).otherwise(F.col("units")))
    plain = F.col("plain")
    trimmed = F.when(plain, F.transform("units", lambda u: F.btrim(u, F.lit(" \n")))).otherwise(F.transform("units", lambda u: F.btrim(u, F.lit(SPACES))))
    each = cut.withColumn("units", trimmed).select(
        "doc",
        F.transform("units", lambda u: F.xxhash64(u)).alias("keys"),
        F.transform("units", lambda u: n_words(u, plain).cast("int")).alias("words"),
    )
    changes = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda k: (k == 0) | (F.get("keys", k) != F.get("keys", k - 1)))
    each = each.withColumns({"n": F.size("keys"), "changes": F.when(F.size(F.array_distinct("keys")) < F.size("keys"), changes)})

    def length(at: Column, k: Column) -> Column:
        return F.coalesce(F.get("changes", k + 1), F.col("n")) - at

    def shown(at: Column, k: Column) -> Column:
        side = F.ceil(F.lit(min_words) / F.greatest(F.get("words", at), F.lit(1))).cast("int")
        end = at + length(at, k)
        parts = F.concat(F.sequence(at, at + side), F.sequence(end - side, end - 1))
        return F.when(length(at, k) > 2 * side + 1, parts).otherwise(F.sequence(at, end - 1))

    def copies(at: Column, k: Column) -> Column:
        later = F.struct((at + 1).cast("long").alias("start"), (at + length(at, k)).cast("long").alias("end"))
        return F.when((length(at, k) - 1) * F.get("words", at) >= min_words, later)

    each = each.withColumns({"starts": F.flatten(F.transform("changes", shown)), "own": F.array_compact(F.transform("changes", copies))})

    def times(at: Column, k: Column) -> Column:
        return F.coalesce(F.get("starts", k + 1), F.col("n")) - at

    def key(at: Column, k: Column) -> Column:
        return F.when(times(at, k) > 1, F.xxhash64(F.get("keys", at), times(at, k))).otherwise(F.get("keys", at))

    keys = F.coalesce(F.transform("starts", key), F.col("keys"))
    words = F.coalesce(F.transform("starts", lambda at, k: F.get("words", at) * times(at, k)), F.col("words"))
    return each.select("doc", keys.alias("keys"), words.alias("words"), "starts", "n", "own")


def _rows(hashes: DataFrame, *columns: Column) -> DataFrame:
    """A row (pos, key, columns) for each unit that has words."""
    rows = hashes.select("*", F.posexplode("keys").alias("pos", "key"))
    # A unit without words is white space before the first one.
    return rows.filter(F.get("words", F.col("pos")) > 0).select("pos", "key", *columns)


def unit_classes(hashes: DataFrame) -> DataFrame:
    """(key, one_left, one_right): units that occur more than once, and whether
    all of a class have the same left, or right, neighbour."""

    def neighbour(step: int) -> Column:
        return F.coalesce(F.shiftright(F.get("keys", F.col("pos") + step), 32), F.lit(0)).cast("int")

    rows = _rows(hashes, neighbour(-1).alias("left"), neighbour(1).alias("right"))
    found = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("left", "right")])
    found = found.filter("n > 1")
    return found.select("key", *[(F.col(f"min_{c}") == F.col(f"max_{c}")).alias(f"one_{c}") for c in ("left", "right")])


def segments(hashes: DataFrame, classes: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, stretch, start, key, units, words): stretches of adjacent repeated
    units with ``min_words`` words or more, as segments."""
    start = F.coalesce(F.get("starts", F.col("pos")), F.col("pos"))
    times = F.when(F.col("starts").isNull(), 1).otherwise(F.coalesce(F.get("starts", F.col("pos") + 1), F.col("n")) - start)
    # Two numbers of a unit in a long: these are the rows that most are of.
    sizes = F.shiftleft(times.cast("long"), 32) + F.get("words", F.col("pos"))
    rows = _rows(hashes, (F.col("doc") * STRIDE + start).alias("at"), sizes.alias("sizes")).drop("pos").join(classes, "key")
    rows = rows.withColumns({"doc": F.expr(f"at div {STRIDE}"), "start": F.col("at") % STRIDE})
    rows = rows.withColumns({"units": F.shiftright("sizes", 32), "words": F.col("sizes").bitwiseAND((1 << 32) - 1)}).drop("at", "sizes")
    order = Window.partitionBy("doc").orderBy("start")
    rows = rows.withColumns({"before": F.lag(F.col("start") + F.col("units")).over(order), "open": F.lag("one_right").over(order)})
    adjacent = F.coalesce(F.col("before") == F.col("start"), F.lit(False))
    rows = rows.withColumns({"apart": (~adjacent).cast("int"), "opens": F.when(adjacent & F.col("one_left") & F.col("open"), 0).otherwise(1)})
    rows = rows.withColumns({"stretch": F.sum("apart").over(order), "segment": F.sum("opens").over(order)})
    first = F.min(F.struct("start", "key"))
    found = rows.groupBy("doc", "stretch", "segment").agg(first.alias("first"), F.sum("units").alias("units"), F.sum("words").alias("words"))
    found = found.withColumn("all_words", F.sum("words").over(Window.partitionBy("doc", "stretch"))).filter(F.col("all_words") >= min_words)
    return found.select("doc", "stretch", "first.start", "first.key", "units", "words")


def _named(rows: DataFrame, key: list[str], columns: list[str], label: str) -> DataFrame:
    """``columns`` and ``name`` of those of ``rows`` (key, doc, start, ...) whose
    key occurs more than once. The names are written first: a join of two plain
    sides is one whose rows AQE can split where very many have one key."""
    at = F.col("doc") * STRIDE + F.col("start")
    names = rows.groupBy(*key).agg(F.min(at).alias("name"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    names = materialize(names, "group-names")
    out = materialize(rows.join(names, key).select(*columns, "name"), label)
    release(names)
    return out


def run_names(segments: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``segments`` with the names of the runs of 1, 2, 4, ... segments that
    begin (``ahead``) and that end (``behind``) at each: null beyond its
    stretch. A run that counts has ``min_words`` segments at most."""
    order = Window.partitionBy("doc", "stretch").orderBy("start")
    names = segments.withColumns({"ahead_0": F.col("key"), "behind_0": F.col("key")})
    size = min_words.bit_length()
    for k in range(1, size):
        far = 1 << (k - 1)
        near, next_one, last_one = f"_{k - 1}", F.lead(f"ahead_{k - 1}", far).over(order), F.lag(f"behind_{k - 1}", far).over(order)
        names = names.withColumns({"next": next_one, "last": last_one})
        names = names.withColumns({
            f"ahead_{k}": F.when(F.col("next").isNotNull(), F.xxhash64("ahead" + near, "next")),
            f"behind_{k}": F.when(F.col("last").isNotNull(), F.xxhash64("last", "behind" + near)),
        })
    sides = [F.array(*[f"{side}_{k}" for k in range(size)]).alias(side) for side in ("ahead", "behind")]
    return names.select("doc", "stretch", "start", "units", "words", *sides)


def _candidates(names: DataFrame, min_words: int) -> DataFrame:
    """(doc, start, end, length, a, b): the shortest runs of ``min_words`` words
    that begin or end at a segment, each by its two names of 2**k segments that overlap."""
    whole = Window.partitionBy("doc", "stretch")
    rows = names.withColumn("upto", F.sum("words").over(whole.orderBy("start")))
    rows = rows.withColumn("before", F.col("upto") - F.col("words"))
    ahead, behind = whole.orderBy("before").rangeBetween(0, min_words - 1), whole.orderBy("upto").rangeBetween(1 - min_words, 0)

    def run(over: WindowSpec, a: Column, b: Column) -> Column:
        one = {"n": F.count(F.lit(1)), "words": F.sum("words"), "start": F.first("start"), "end": F.last(F.col("start") + F.col("units"))}
        return F.struct(*[f.over(over).alias(c) for c, f in one.items()], a.alias("a"), b.alias("b"))

    rows = rows.select(
        "doc",
        run(ahead, F.col("ahead"), F.last("behind").over(ahead)).alias("from"),
        run(behind, F.first("ahead").over(behind), F.col("behind")).alias("to"),
    )
    rows = rows.select("doc", F.inline(F.array("from", "to"))).filter(F.col("words") >= min_words)
    k = F.floor(F.log2(F.col("n") + 0.5)).cast("int")
    ends = [F.col(c).cast("long").alias(c) for c in ("start", "end")]
    return rows.select("doc", *ends, F.col("n").alias("length"), F.get("a", k).alias("a"), F.get("b", k).alias("b")).distinct()


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, cuts): sorted disjoint [start, end) runs of units to delete. ``docs`` has doc and text."""
    hashes = materialize(unit_hashes(docs, min_words), "units")
    classes = materialize(unit_classes(hashes), "classes")
    own = materialize(hashes.select("doc", F.inline("own")), "own")
    if classes.isEmpty():
        release(hashes, classes)
        return materialize(_merged(own), "cuts")
    keyed = materialize(segments(hashes, classes, min_words), "segments")
    release(hashes, classes)
    runs = materialize(_candidates(run_names(keyed, min_words), min_words), "candidates")
    release(keyed)
    named = _named(runs, ["a", "b", "length"], ["doc", "start", "end"], "found")
    found = named.filter(F.col("name") < F.col("doc") * STRIDE + F.col("start")).select("doc", "start", "end")
    cuts = materialize(_merged(found.unionByName(own)), "cuts")
    release(runs, named, own)
    return cuts


def _merged(found: DataFrame) -> DataFrame:
    """(doc, cuts): runs (doc, start, end) that overlap or touch are one."""
    order = Window.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("opens", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    found = found.withColumn("cut", F.sum("opens").over(order)).groupBy("doc", "cut").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"))
    return found.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))


def _without(all_units: Column, cuts: Column) -> Column:
    """The units between the cuts, as text; each unit is touched once."""

    def piece(k: Column) -> Column:
        start = F.when(k > 0, F.get(cuts, k - 1)["end"]).otherwise(0)
        end = F.when(k < F.size(cuts), F.get(cuts, k)["start"]).otherwise(F.size(all_units))
        return F.array_join(F.slice(all_units, start + 1, end - start), "")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(cuts)), piece), "")


def _cut_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text, new_text, n_removed, cuts, rest)"""
    rows = _numbered(docs)
    cuts = later_copies(rows.select("doc", "text"), min_words)
    nothing = cuts.isEmpty()
    tidy(docs.sparkSession)
    if nothing:
        none = F.array().cast("array<struct<start:int,end:int>>")
        return rows.select("doc_id", "text", F.col("text").alias("new_text"), F.lit(0).cast("long").alias("n_removed"), none.alias("cuts"), "rest")
    # Not by broadcast, also where it would do: the cuts grow with the documents.
    joined = rows.join(cuts.hint("merge"), "doc", "left")
    joined = joined.withColumn("units", F.when(F.col("cuts").isNotNull(), units(F.col("text"), _most(min_words))))
    removed = F.aggregate("cuts", F.lit(0).cast("long"), lambda n, c: n + c["end"] - c["start"])
    return joined.select(
        "doc_id",
        "text",
        F.when(F.col("cuts").isNull(), F.col("text")).otherwise(_without(F.col("units"), F.col("cuts"))).alias("new_text"),
        F.coalesce(removed, F.lit(0)).alias("n_removed"),
        F.coalesce("cuts", F.array().cast("array<struct<start:int,end:int>>")).alias("cuts"),
        "rest",
    )


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without later copies, n_removed (units) and cuts (runs of
    units that went) for every row of ``docs`` (doc_id, text)."""
    rows = _cut_rows(docs.select("doc_id", "text"), min_words)
    return rows.select("doc_id", F.col("new_text").alias("text"), "n_removed", "cuts")


def drop_later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` (any columns) with the new text in place of text;
    rows of which nothing but white space is left by the cuts go."""
    rows = _cut_rows(docs, min_words).filter((F.col("n_removed") == 0) | (F.length(F.btrim("new_text", F.lit(" \n\r\t"))) > 0))
    return rows.select(*[F.col("new_text").alias(c) if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])
