r"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines of at least ``min_chars`` code points that hold a word are compared (1: every such line);
shorter lines are kept always. Two lines are linked if their edit distance is at most what the
shorter one allows: ``max_edits``, or as many as its length can be searched for, which is at
least ``(2 * edits + 1) * (edits + 1)`` characters: 2 edits from 15 characters on, 1 from 6 on,
and below that only equal lines meet, by their hash. The lines of a linked component, equal lines
included, are one class; the first occurrence (smallest document, then line) is kept and the
others are removed.

Join over the distinct lines. A line of n characters is split into ``max_edits + 1`` even
segments; a line within ``max_edits`` of it must hold one of them unchanged. Segments are
indexed under (n, segment number, text). A line probes the indexes of the lengths from its own
down to ``max_edits`` less, and for each segment only the substrings whose start allows for the
edits left and right of it to fit the limit, so each linked pair is found and few others.
Keys that meet no other line's key are left out before the join. A candidate pair must also
agree in the counts of common letters up to what the edits can change (one edit changes at most
two counts by one), which is tested inside the join, so near copies that share segments but
differ more are not emitted as pairs.

Verification takes off what two lines share at their ends, then runs a bit-parallel edit distance
over the band of ``2 * max_edits + 1`` diagonals: one bit per diagonal and error level, all in one
long, updated per character.

Only the texts of lines that share a segment are shuffled; keys and candidate pairs are longs.
Candidates are verified on the texts themselves, and equal lines are told by 128 bits, so a
collision of the 64 bits can at worst leave one of two colliding lines without its links.

Defined results: null and empty texts have no compared lines; rows with a null id come after
all others and are ordered by text; rows that are equal in id and text count as one document;
a line end is ``\n``, other white space belongs to the line; an empty table gives no rows;
further columns are kept by ``drop_duplicate_lines`` and otherwise ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, let, text_of
from lakebuild.llm.components import connected_components
from lakebuild.llm.exact_dedup import _bit, _slot, survivor_bitmap

MAX_EDITS, MIN_CHARS = 2, 1
#: ASCII white space; a line of nothing else holds no word.
SPACES = " \t\n\x0b\f\r"
#: Lines are cut into segments in this form, whose code points have one width in bytes: a cut needs no walk from the start.
CHARSET, WIDTH = "UTF-32", 4
#: Letters whose counts are compared, four bits each in one long.
LETTERS = "eaotnrihsd"


def lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, line_no, line): the compared lines."""
    # a text is hashed before it is split, so once, not once per line
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), text_of().alias("text"))
    each = keyed.select("doc_id", "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return each.where((F.length("line") >= min_chars) & (F.ltrim("line", F.lit(SPACES)) != ""))


def least_chars(edits: int) -> int:
    """The length from which on all of a line's probes for so many edits lie inside it."""
    return (2 * edits + 1) * (edits + 1)


def line_key(line: Column) -> Column:
    """With the line's id (its hash), 128 bits that stand for the line."""
    return F.xxhash64(F.lit(1), line)


def _profile(line: Column) -> Column:
    """Counts of the letters modulo 16, packed into one long."""
    packed = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        count = ((F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))) % 16).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(count, 4 * i))
    return packed


def _profile_gap(a: Column, b: Column) -> Column:
    """How far the letter counts are apart, at least (differences are taken modulo 16)."""
    total = F.lit(0)
    for i in range(len(LETTERS)):
        d = (F.shiftrightunsigned(a, 4 * i).bitwiseAND(F.lit(15)) - F.shiftrightunsigned(b, 4 * i).bitwiseAND(F.lit(15)) + 16) % 16
        total = total + F.least(d, 16 - d)
    return total


def _bound(edits: int, d: int, i: int) -> str:
    return f"at_{edits}_{d}_{i}"


def segment_bounds(n: Column, edits: int) -> list[Column]:
    """The bytes at which the inner segments of lines of n - d characters start, d up to ``edits``, as columns."""
    return [(F.floor((n - d) * i / (edits + 1)).cast("int") * WIDTH).alias(_bound(edits, d, i))
            for d in range(edits + 1) for i in range(1, edits + 1)]


def _key(units: Column, n: Column, edits: int, d: int, i: int, shift: int = 0) -> Column:
    """The key under which a line of n - d characters has segment i, for the substring ``shift`` characters further.
    ``segment_bounds`` are taken as columns: worked out in each key, they make the generated code of all keys outgrow
    what the JVM compiles (8,000 bytes a method), and all of it is interpreted."""
    m = n - d if d else n
    start, end = (F.lit(0) if j == 0 else m * WIDTH if j > edits else F.col(_bound(edits, d, j)) for j in (i, i + 1))
    return F.xxhash64(m, F.lit(i), F.substr(units, start + (WIDTH * shift + 1), end - start))


def index_keys(units: Column, n: Column, max_edits: int) -> list[Column]:
    """Keys of the segments of a line of n characters, given in ``CHARSET``."""
    return [_key(units, n, max_edits, 0, i) for i in range(max_edits + 1)]


def probe_keys(units: Column, n: Column, max_edits: int) -> list[Column]:
    """Keys of the substrings that a line of n characters looks up for indexed lines of n - d characters, but for
    its own segments, which are indexed already. All lie inside a line of ``least_chars(max_edits)`` characters or more."""
    keys = []
    for d in range(max_edits + 1):
        for i in range(max_edits + 1):
            # i edits at most left of segment i, the others right of it
            low, high = max(-i, d - (max_edits - i)), min(i, d + (max_edits - i))
            keys += [_key(units, n, max_edits, d, i, shift) for shift in range(low, high + 1) if d or shift]
    return keys


def _common_start(a: Column, b: Column) -> Column:
    """How many characters two strings share at their start: halving steps over substrings, not characters."""
    n = F.least(F.length(a), F.length(b))
    steps = F.transform(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), lambda i: F.call_function("shiftleft", F.lit(1), i))

    def add(done: Column, step: Column) -> Column:
        same = F.substr(a, done + 1, step) == F.substr(b, done + 1, step)
        return F.when((done + step <= n) & same, done + step).otherwise(done)

    return F.aggregate(steps, F.lit(0), add)


def banded_distance(a: Column, b: Column, max_edits: int) -> Column:
    """The edit distance of two strings if it is at most ``max_edits``, else null.

    Bit k of level e is set if, after j characters of b, the first j + k - max_edits characters
    of a can be reached with e edits. All levels lie in one long, a free bit between them; a
    character of b first becomes the mask of the diagonals on which it matches."""
    width = 2 * max_edits + 1
    gap = width + 1
    if (max_edits + 1) * gap > 63:
        raise ValueError("the levels of max_edits do not fit a long")

    def each_level(bits: int, levels: int = max_edits + 1) -> int:
        return sum(bits << (e * gap) for e in range(levels))

    full = F.lit(each_level((1 << width) - 1)).cast("long")
    chars = lambda s: F.array_remove(F.split(s, ""), "")

    def run(p: Column) -> Column:  # p: the characters of a
        def matches(c: Column, j: Column) -> Column:
            mask = F.lit(0).cast("long")
            for k in range(width):  # get() is null outside of a; what steps over its end cannot come back
                mask = mask + F.when(F.get(p, j + (k - max_edits)) == c, F.lit(each_level(1 << k)).cast("long")).otherwise(F.lit(0).cast("long"))
            return mask

        def step(s: Column, mask: Column) -> Column:
            # a match, or one edit more: a character replaced, or one of b left out
            now = s.bitwiseAND(mask).bitwiseOR(F.shiftleft(s.bitwiseOR(F.shiftright(s, 1)), gap).bitwiseAND(full))
            out = now
            for t in range(1, max_edits + 1):  # t characters of a left out
                inside = F.lit(each_level((1 << (width - t)) - 1, max_edits + 1 - t)).cast("long")
                out = out.bitwiseOR(F.shiftleft(now.bitwiseAND(inside), t * (gap + 1)))
            return out

        # before any character of b: e edits skip up to e characters of a
        first = sum(1 << (e * gap + max_edits + x) for e in range(max_edits + 1) for x in range(e + 1))
        at = F.size(p) - F.length(b) + max_edits

        def end(s: Column) -> Column:
            found = F.lit(None).cast("int")
            for e in reversed(range(max_edits + 1)):
                found = F.when(F.call_function("shiftright", s, at + e * gap).bitwiseAND(F.lit(1).cast("long")) == 1, e).otherwise(found)
            return F.when((at >= 0) & (at < width), found)

        return F.aggregate(F.transform(chars(b), matches), F.lit(first).cast("long"), step, end)

    return let(chars(a), run)


def near_distance(a: Column, b: Column, max_edits: int) -> Column:
    """``banded_distance`` after taking off the common start and the common end, which leaves the distance as it is.
    Every value is bound by ``let``, as the optimizer would otherwise copy its expression into each use."""
    def turned(s: Column) -> Column:  # without the common start, and the other way round
        return let(_common_start(s["a"], s["b"]), lambda n: F.struct(*[F.reverse(F.substr(s[c], n + 1)).alias(c) for c in "ab"]))

    whole = F.struct(a.alias("a"), b.alias("b"))
    return let(whole, lambda s: let(turned(s), lambda r: let(turned(r), lambda m: banded_distance(m["a"], m["b"], max_edits))))


def allowed_edits(n: Column, max_edits: int) -> Column:
    """The edits within which a line of n characters is compared with lines of its length or more."""
    edits = F.lit(0)
    for e in range(1, max_edits + 1):
        edits = F.when(n >= least_chars(e), e).otherwise(edits)
    return edits


def _keyed_for(n: Column, edits: int, max_edits: int) -> Column:
    """Whether a line of n characters has keys for so many edits: if it allows for them, or if it is in
    reach of shorter lines that allow for no more."""
    enough = n >= least_chars(edits)
    return enough if edits == max_edits else enough & (n < least_chars(edits + 1) + edits)


def _all_keys(keys, units: Column, n: Column, max_edits: int) -> list[Column]:
    """The keys for every number of edits, null where the line has none for it."""
    return [F.when(_keyed_for(n, e, max_edits), k) for e in range(1, max_edits + 1) for k in keys(units, n, e)]


def shared_segments(texts: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(id, own, segment): the keys of the lines (columns id, line) that meet the key of another line, at least one of
    the two being a segment of its own line (``own``).

    No text is shuffled: a line's keys, one long each, are brought together by its id, so copies count once, and then
    once more by key. Nearly all keys end here, as most lines are near to no other."""
    units, n = F.col("units"), F.col("n")
    coded = texts.select("id", F.coalesce(F.encode("line", CHARSET), F.lit(b"")).alias("units"))
    measured = coded.select("id", "units", (F.octet_length("units") / WIDTH).cast("int").alias("n"))
    measured = measured.select("*", *[b for e in range(1, max_edits + 1) for b in segment_bounds(n, e)])
    own, probes = (_all_keys(keys, units, n, max_edits) for keys in (index_keys, probe_keys))
    names = [f"k{i}" for i in range(len(own) + len(probes))]
    keyed = measured.select("id", *[k.alias(c) for k, c in zip(own + probes, names)])
    once = keyed.groupBy("id").agg(*[F.max(c).alias(c) for c in names])  # equal in all rows of an id
    keys = once.select("id", F.posexplode(F.array(*names)).alias("no", "segment")).where("segment is not null") \
        .select("id", (F.col("no") < len(own)).alias("own"), "segment")
    met = Window.partitionBy("segment")
    return keys.withColumns({"least": F.min("id").over(met), "most": F.max("id").over(met), "indexed": F.max("own").over(met)}) \
        .where("indexed and least < most").select("id", "own", "segment")


def verified_links(shared: DataFrame, texts: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b): the pairs of lines that share a segment and lie within the edits that the shorter one allows, each pair
    once. ``texts`` (id, line) holds at least the lines of ``shared``."""
    distinct = texts.select("id", "line", _profile(F.col("line")).alias("profile")).dropDuplicates(["id"])
    known = shared.join(distinct.select("id", "profile"), "id")
    near = _profile_gap(F.col("p.profile"), F.col("i.profile")) <= 2 * max_edits
    other = F.when(F.col("p.own"), F.col("p.id") < F.col("i.id")).otherwise(F.col("p.id") != F.col("i.id"))  # two own segments meet twice
    pairs = known.alias("p").join(known.where("own").alias("i"), (F.col("p.segment") == F.col("i.segment")) & other & near) \
        .select(F.least("p.id", "i.id").alias("a"), F.greatest("p.id", "i.id").alias("b")).distinct()
    # each pair takes the text of one line, then that of the other
    both = pairs.join(distinct.alias("x"), F.col("a") == F.col("x.id")).join(distinct.alias("y"), F.col("b") == F.col("y.id"))
    allowed = allowed_edits(F.least(F.length("x.line"), F.length("y.line")), max_edits)
    return both.where(near_distance(F.col("x.line"), F.col("y.line"), max_edits) <= allowed).select("a", "b")


def edit_links(texts: DataFrame, max_edits: int = MAX_EDITS) -> DataFrame:
    """(a, b): ids of different lines (columns id, line; equal rows count once) within the edits that the shorter one
    allows, each pair once."""
    return verified_links(cut(shared_segments(texts, max_edits)), texts, max_edits)


def line_classes(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row_key, line_no, class_doc, class_line, n_links, kept) per compared line: the class is named by its
    first occurrence; ``n_links`` counts the different lines linked to this one.

    The texts are read twice and shuffled only where a line shares a segment: the pass that lists the places of the lines
    looks their ids up in a bitmap of bounded size and keeps those lines (and a few more, which meet no pair)."""
    compared = lines(docs, min_chars).withColumn("id", F.xxhash64("line"))
    shared = cut(shared_segments(compared.select("id", "line"), max_edits))
    bitmap, bits = survivor_bitmap(shared.select(F.col("id").alias("size"), F.col("id").alias("head")).distinct())
    marked = compared.withColumn("slot", _slot(F.col("id"), F.col("id"), bits)) \
        .join(F.broadcast(bitmap), F.bitmap_bucket_number("slot") == F.col("bucket"), "left")
    shares = _bit(F.col("bitmap"), F.bitmap_bit_position("slot"))
    places = cut(marked.select("doc_id", "row_key", "line_no", "id", line_key(F.col("line")).alias("key"), F.when(shares, F.col("line")).alias("line")))
    links = cut(verified_links(shared, places.where("line is not null").select("id", "line"), max_edits))
    places = places.drop("line")
    degree = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    parts = connected_components(links).withColumnRenamed("node", "id")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "line_no")
    first = places.groupBy("id", "key").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    named = first.join(parts, "id", "left").join(degree, "id", "left") \
        .select("id", "key", "place", F.col("component").isNotNull().alias("linked"),
                F.when(F.col("component").isNotNull(), F.col("component").cast("string"))
                .otherwise(F.concat_ws(" ", "id", "key")).alias("component"),
                F.coalesce("n_links", F.lit(0)).alias("n_links"), "n")
    shared = cut(named.where(F.col("linked") | (F.col("n") > 1)))  # all other lines are classes of one
    best = shared.groupBy("component").agg(F.min("place").alias("class"))
    known = shared.join(best, "component").select("id", "key", "class", "n_links")
    mine = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key", "line_no")
    got = places.join(known, ["id", "key"], "left").select("doc_id", "row_key", "line_no", "n_links", F.coalesce("class", mine).alias("class"))
    return got.select("doc_id", "row_key", "line_no", F.col("class.doc_id").alias("class_doc"), F.col("class.line_no").alias("class_line"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (F.col("class") == mine).alias("kept"))


def drop_duplicate_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without their removed lines; ``n_chars`` follows the text. Untouched texts stay as they are.

    Only documents that may lose a line are shuffled to their removed lines: a bitmap of those, of bounded size, is looked
    up first. A document that shares a bit by chance meets no removed line and stays as it is."""
    gone = cut(line_classes(docs, max_edits, min_chars).where(~F.col("kept")).groupBy("doc_id", "row_key")
               .agg(F.collect_set("line_no").alias("gone")))
    bitmap, bits = survivor_bitmap(gone.select(F.col("doc_id").alias("size"), F.col("row_key").alias("head")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"),
                       F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_key"))
    slot = _slot(F.col("own_id"), F.col("own_key"), bits)
    marked = rows.withColumn("slot", slot).join(F.broadcast(bitmap), F.bitmap_bucket_number("slot") == F.col("bucket"), "left")
    maybe = _bit(F.col("bitmap"), F.bitmap_bit_position("slot"))
    own = F.col("own_id").eqNullSafe(F.col("g.doc_id")) & (F.col("own_key") == F.col("g.row_key"))
    text, hit = F.col("d.text"), F.col("g.gone").isNotNull()
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(F.col("g.gone"), i)), "\n")
    new = {"text": F.when(hit, rest).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(rest).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("d.n_chars"))
    touched = marked.where(maybe).select("d", "own_id", "own_key").join(gone.alias("g"), own, "left") \
        .select(*[new.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
    return touched.union(marked.where(~maybe).select(*[F.col(f"d.`{c}`") for c in docs.columns]))
