"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its lower-cased words, ordered by rarity: a counter class (the logarithm of the words counted, over
all documents, in a table of fixed size) above 60 bits of hash. Any table gives the same matches. Two sets with Jaccard
>= t share a word among the first n - ceil(t n) + 1 of each (prefix filter), at places that leave room for the overlap
needed (positional filter), and differ in size by no more than t (length filter); 64 or 128 parities of each set's hashed words
bound the overlap, as words of both sets leave no bit apart. What passes is verified on the whole sets.

A word that was counted once joins nothing and is left out. Rare words join alone, so at most 2^RARE sets meet at
one. Frequent ones join as pairs: sets that share no rare word of the prefix share two frequent ones in a prefix longer
by one. Sets of over LONG words, which bits tell apart less well, share three words of a prefix longer by two: two rare ones, or
two frequent ones at least. Two sets meet at the first pair of frequent words that they share, and at few later ones. Above MOST words, where pairs would be too many, frequent words join alone, too.

A line goes if an earlier one matches it. So at each frequent key a set first meets the earliest of its size band; sets
matched there are done, and the rest meets every earlier set of the key.

Keys are joined in slices, each with about SLICE rows a set, and the files of a slice's shuffles go before the next one, so the disk
that keys take stays in proportion to the sets. Only lines that a bitmap of the candidates lets pass are shuffled with their text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motiontab.llm.common import released, removed, table

#: Counters of word rarity are 2^COUNTERS; a class is the logarithm of a count, rounded up, at most 15.
COUNTERS = 19
#: Words up to class RARE (counted up to 2^RARE times) join alone, others as pairs in sets of up to MOST words.
RARE, MOST = 10, 256
#: Pairs of sets of over LONG words share two keys; sets up to BITS words carry bits.
LONG, BITS = 64, 128
#: Sets from HALVES words on carry two longs of bits.
HALVES = 32
#: Rows up to which pairs of lines (48 bytes each) and documents with flags of their lines (FLAGS bytes in all) are broadcast.
BROADCAST_ROWS, FLAGS = 500_000, 8_000_000
#: Rows a set, on average, that a slice of the keys shuffles (LEAST_ROWS in all at least); longs of 64 bits in the bitmap of candidates are 2^MARKS.
SLICE, LEAST_ROWS, MARKS = 8, 1_000_000, 19
_LOW, _KEY = (1 << 60) - 1, (1 << 48) - 1


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder; the files of its shuffles are removed."""
    with released(df.sparkSession):
        return table(df)


def among(rows: DataFrame, columns: list[str], keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows whose columns may be those of a key: all that are, and few others as long as keys are fewer than the bitmap's bits."""

    def place(columns: list[str]) -> tuple[Column, Column]:
        h = F.xxhash64(*columns)
        return h.bitwiseAND(F.lit((1 << MARKS) - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, MARKS).bitwiseAND(F.lit(63)).cast("int"))

    at, bit = place(names)
    marks = keys.select(at.alias("mark_at"), bit.alias("bit")).groupBy("mark_at").agg(F.bit_or("bit").alias("marks"))
    at, bit = place(columns)
    return rows.join(F.broadcast(marks), (at == F.col("mark_at")) & (F.col("marks").bitwiseAND(bit) != 0)).drop("mark_at", "marks")


def words(text: Column) -> Column:
    """Lower-cased words between spaces, tabs, \\x0B, \\f and \\r; an empty one wherever two of these meet."""
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(F.lower(text), " ")


def rarity(docs: DataFrame) -> Column:
    """A constant array of longs, each of 16 counters' classes in 4 bits; 8 is added so that they sort as signed numbers."""
    word = F.explode(words(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")
    at = F.xxhash64("w").bitwiseAND(F.lit((1 << COUNTERS) - 1)).cast("int")
    counts = docs.select(word).where("w <> ''").select(at.alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    classes = counts.select("b", (F.least(F.lit(15), F.ceil(F.log2("n"))).cast("long") + 8).bitwiseAND(F.lit(15)).alias("c"))
    longs = 1 << (COUNTERS - 4)
    one = F.call_function("shiftleft", "c", (F.shiftright("b", COUNTERS - 4) * 4).cast("int"))
    with released(docs.sparkSession):
        found = classes.groupBy(F.col("b").bitwiseAND(F.lit(longs - 1)).alias("b")).agg(F.bit_or(one).alias("c")).toArrow().to_pydict()
    packed = dict(zip(found["b"], found["c"], strict=True))
    return F.from_json(F.lit("[" + ",".join(str(packed.get(b, 0)) for b in range(longs)) + "]"), "array<bigint>")


def hashes(line: Column) -> Column:
    return F.transform(F.array_remove(words(line), ""), lambda w: F.xxhash64(w))


def has_words(line: Column) -> Column:
    return F.ltrim(line, F.lit(" \t\x0b\f\r")) != ""


def set_of(line: Column, classes: Column) -> Column:
    """A line's distinct words as sorted longs: the class, less 8, above 60 bits of hash."""

    def word(h: Column) -> Column:
        some = F.get(classes, h.bitwiseAND(F.lit((1 << (COUNTERS - 4)) - 1)).cast("int"))
        place = F.shiftright(h, COUNTERS - 6).bitwiseAND(F.lit(60)).cast("int")
        return F.coalesce(F.shiftleft(F.call_function("shiftright", some, place), 60).bitwiseOR(h.bitwiseAND(F.lit(_LOW))), F.lit(0))

    return F.sort_array(F.array_distinct(F.transform(hashes(line), word)))


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with near-duplicate lines taken from the text, then (n_lines, n_removed).

    Lines end at \\n; n_lines counts those that hold a word. In the order of (id, content, line number), null ids
    first, a line goes if an earlier line of any document has a word set with 100 * intersection >= percent * union;
    so does every later copy. Lines without words stay. A null text stays null and an empty one empty (0 lines). Of
    equal rows one keeps its lines. Columns named n_lines or n_removed are replaced. Equal sets are told by their size
    and 96 bits of hash, words of a pair of lines by 48.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    unique = keyed.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    doc = ["id"] if unique else ["id", "k"]  # the content's hash tells rows of one id apart
    f = [*doc, "at"]
    if not unique:
        keyed = keyed.withColumn("k", F.xxhash64("id", "text"))
    classes = rarity(keyed)
    lines = keyed.select(*doc, F.posexplode(F.split("text", "\n")).alias("at", "line")).where(has_words(F.col("line")))

    p = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    bit = lambda a, w: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int")))
    sets = lines.select(*f, set_of(F.col("line"), classes).alias("words")).withColumn("n", F.size("words"))
    sets = sets.withColumn("once", F.size(F.filter("words", lambda w: w < F.lit(-7 << 60)))).withColumn("p", p)
    more = F.when(F.col("n") > LONG, 2).otherwise(1)  # words of the longer prefix
    most = F.col("p") - F.col("once") + more
    prefix = F.when(F.col("p") > F.col("once"), F.slice("words", F.col("once") + 1, most)).otherwise(F.array().cast("array<long>"))
    narrow = F.transform(prefix, lambda w: F.shiftrightunsigned(w, 12).bitwiseXOR(F.lit(1 << 51)))  # class from 0 above 48 bits
    bits = F.when(F.col("n") <= BITS, F.aggregate("words", F.lit(0).cast("long"), bit))
    some = F.filter("words", lambda w: w.bitwiseAND(F.lit(64)) != 0)
    half = F.when(F.col("n").between(HALVES, BITS), F.aggregate(some, F.lit(0).cast("long"), bit))
    sets = sets.select("n", F.xxhash64("words").alias("sid"), F.hash("words").alias("h"), F.struct(*f, "once", bits.alias("bits"), half.alias("half"), narrow.alias("prefix")).alias("s"))
    made: list[DataFrame] = []

    def kept_until_end(df: DataFrame) -> DataFrame:
        made.append(df)
        return df

    firsts = kept_until_end(cut(sets.groupBy("n", "sid", "h").agg(F.min("s").alias("s")).select("n", "s.*")))

    over = F.lit((RARE + 1) << 48)
    row = [*f, "n", "bits", "half"]
    place = F.col("once") + F.col("i")
    loose = F.when(F.col("n") > LONG, 2).otherwise(0)  # of three shared words this may be the last
    each = firsts.where(F.size("prefix") > 0).select(*row, p.alias("p"), "once", "prefix", F.posexplode("prefix").alias("i", "word"))
    tiny = percent * F.col("n") <= 100  # may match by one word
    each = each.where((place < F.col("p") + loose) & ((F.col("word") < over) | tiny))
    rare = lambda of_slice: of_slice(each).select(F.col("word").bitwiseAND(F.lit(_KEY)).alias("key"), *row, (F.col("n") - place + loose).alias("left"))
    long = F.coalesce(F.element_at("prefix", F.when(F.size("prefix") > 0, F.size("prefix"))) >= over, F.lit(False))
    high = firsts.where(long)  # sets with a frequent word in their prefix

    def frequent(high: DataFrame, of_slice: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A row for each pair of frequent words of the prefixes, or for each word of large sets, whose rarer word a slice holds."""
        each = of_slice(high.select(*row, p.alias("p"), "once", "prefix", F.posexplode("prefix").alias("i", "word")).where(F.col("word") >= over))
        second = F.posexplode(F.slice("prefix", F.col("i") + 2, F.greatest(F.lit(0), F.col("p") + more - place - 1))).alias("j", "other")
        pairs = each.where((F.col("n") <= MOST) & ~tiny).select(*row, "once", "i", "word", "prefix", second)
        word = lambda at: F.get("prefix", at)
        prev, mid = F.when(word(F.col("i") - 1) >= over, word(F.col("i") - 1)), F.when(F.col("j") > 0, word(F.col("i") + F.col("j")))
        pairs = pairs.select(F.xxhash64("word", "other").bitwiseAND(F.lit(_KEY)).alias("key"), F.lit(1).alias("kind"), *row, (F.col("n") - place - F.col("j") + loose).alias("left"), prev.alias("prev"), mid.alias("mid"))
        # sets around MOST words meet both ways
        single = each.where((F.col("n") * 100 >= MOST * percent) & ~tiny).select(F.col("word").bitwiseAND(F.lit(_KEY)).alias("key"), F.lit(2).alias("kind"), *row, (F.col("n") - place + 2).alias("left"), *[F.lit(None).cast("long").alias(c) for c in ("prev", "mid")])
        return pairs.unionAll(single)

    def same(columns: list[str], a: str, b: str) -> Column:
        return reduce(lambda x, y: x & y, (F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in columns))

    def apart(x, y) -> Column:
        """So many words at least are in one of the sets alone; null without bits."""
        bits, half = (lambda z: z("bits")), (lambda z: z("half"))
        differ = lambda c: c(x).bitwiseXOR(c(y))
        other = differ(bits).bitwiseXOR(differ(half))
        return F.coalesce(F.bit_count(differ(half)) + F.bit_count(other), F.bit_count(differ(bits)))

    def passes(a: str, b: str) -> Column:
        """b is an earlier set that may match a at this key."""
        x, y = (lambda c: F.col(f"{a}{c}")), (lambda c: F.col(f"{b}{c}"))
        total = percent * (x("n") + y("n"))
        fits = lambda overlap: (100 + percent) * overlap >= total
        close = (100 * x("n") >= percent * y("n")) & (100 * y("n") >= percent * x("n"))
        bound = F.coalesce(fits(F.shiftright(x("n") + y("n") - apart(x, y), 1)), F.lit(True))
        before = F.lit(False)
        for c in reversed(f):
            before = F.coalesce(y(c) < x(c), y(c).isNull() & x(c).isNotNull()) | (y(c).eqNullSafe(x(c)) & before)
        return close & fits(F.least(x("left"), y("left"))) & bound & before

    def met(a: DataFrame, b: DataFrame, on: list[str], strong: Column, test: Column | None = None) -> DataFrame:
        """Candidates (line a, line b, strong, near) of rows that share a key; near is greater the fewer bits differ."""
        test = passes("a.", "b.") if test is None else test & passes("a.", "b.")
        n = F.col("a.n") + F.col("b.n")
        near = F.coalesce(F.floor(100 * (n - apart(lambda c: F.col(f"a.{c}"), lambda c: F.col(f"b.{c}"))) / n).cast("int"), F.lit(0))
        both = a.alias("a").join(b.alias("b"), reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on)) & test)
        return both.select(*[F.col(f"a.{c}").alias(f"a_{c}") for c in f], *[F.col(f"b.{c}").alias(f"b_{c}") for c in f], strong.alias("strong"), near.alias("near"))

    ends = [[f"{s}_{c}" for c in f] for s in "ab"]

    def verified(pairs: DataFrame) -> DataFrame:
        """Lines a of distinct pairs whose word sets match."""
        few = pairs.count() <= BROADCAST_ROWS
        small = lambda keys: F.broadcast(keys) if few else keys
        some = lambda names: lines if few else among(lines, f, pairs, names)
        own = lambda name: F.array_distinct(F.transform(hashes(F.col("line")), lambda h: h.bitwiseAND(F.lit(_KEY)))).alias(name)
        x = some(ends[0]).join(small(pairs), same(f, "", "a_")).select(*ends[0], *ends[1], own("x"))
        y = some(ends[1]).join(small(pairs.select(*ends[1]).distinct()), same(f, "", "b_"), "left_semi").select(*[F.col(c).alias(f"y_{c}") for c in f], own("y"))
        both = x.join(y, same(f, "b_", "y_"))
        both = both.where((100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * (F.size("x") + F.size("y")))
        return kept_until_end(cut(both.select(*[F.col(c).alias(c[2:]) for c in ends[0]]).distinct()))

    def matched(candidates: Callable[[Callable[[DataFrame], DataFrame]], DataFrame]) -> DataFrame:
        """Lines a of candidates whose word sets match; each first meets the line whose bits are nearest. candidates: those that meet
        at words which a function leaves."""
        parts = []
        for k in range(slices):
            of_slice = lambda rows, k=k: rows.where(F.pmod(F.col("word").bitwiseAND(F.lit(_KEY)), F.lit(slices)) == k) if slices > 1 else rows
            part = candidates(of_slice).groupBy(*ends[0], *ends[1]).agg(F.count("*").alias("c"), F.max("strong").alias("strong"), F.max("near").alias("near"))
            with released(part.sparkSession):
                parts.append(table(part) if slices > 1 else part)
        found = parts[0]
        if slices > 1:
            found = reduce(DataFrame.unionAll, parts).groupBy(*ends[0], *ends[1]).agg(F.sum("c").alias("c"), F.max("strong").alias("strong"), F.max("near").alias("near"))
        found = kept_until_end(cut(found.where(F.col("strong") | (F.col("c") >= 2)).drop("strong")))
        removed(parts if slices > 1 else [])
        best = kept_until_end(cut(found.groupBy(*ends[0]).agg(F.max(F.struct("near", "c", *ends[1])).alias("b")).select(*ends[0], "b.*").drop("near", "c")))
        done = verified(best)
        left = found.drop("near", "c").join(done.select(*[F.col(c).alias(f"k_{c}") for c in f]), same(f, "a_", "k_"), "left_anti")
        return done.unionAll(verified(kept_until_end(cut(left.exceptAll(best)))))

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        return rows.join(gone.select(*[F.col(c).alias(f"k_{c}") for c in f]), same(f, "", "k_"), "left_anti")

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))).cast("int")
    on = ["key", "kind"]
    sure = F.col("a.kind") == 1
    # rows of keys: rare words once, pairs of frequent ones once in each of two joins on either side
    many = F.size(F.filter("prefix", lambda w: w >= over))
    rows = F.size("prefix") - many + F.when(F.col("n") <= MOST, many * (many - 1)).otherwise(2 * many)
    total = firsts.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("rows"), F.count("*").alias("sets")).first()
    slices = max(1, -(-total.rows // max(SLICE * total.sets, LEAST_ROWS)))

    def earliest(of_slice: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Candidates at rare words, and those with the earliest set of a frequent key and size band."""
        own, often = rare(of_slice), frequent(high, of_slice).withColumn("band", band)
        lead = often.groupBy(*on, "band").agg(F.min(F.struct(*row, "left")).alias("s")).select(*on, "band", "s.*")
        return met(own, own, ["key"], F.least("a.n", "b.n") <= LONG).unionAll(met(often, lead, [*on, "band"], sure))

    done = matched(earliest)
    few = done.count() <= BROADCAST_ROWS
    rest = without(high, F.broadcast(done)) if few else kept_until_end(cut(without(high, done)))
    # where the words before are the same, too, the two sets share an earlier pair of words, at which they meet
    again = F.coalesce(F.col("a.prev") == F.col("b.prev"), F.lit(False)) | F.coalesce(F.col("a.mid") == F.col("b.mid"), F.lit(False))
    done = done.unionAll(matched(lambda of_slice: met(frequent(rest, of_slice), frequent(high, of_slice), on, sure, ~again)))
    kept = without(firsts.select(*f), done).groupBy(*[F.col(c).alias(f"k_{c}") for c in doc]).agg(F.sort_array(F.collect_list("at")).alias("kept"))
    # a byte for each line up to the last kept one
    before = F.concat(F.array(F.lit(-1)), F.slice("kept", F.lit(1), F.size("kept") - 1))
    flags = F.array_join(F.zip_with("kept", before, lambda a, b: F.concat(F.repeat(F.lit("0"), a - b - 1), F.lit("1"))), "").cast("binary")
    kept = kept.withColumn("n", F.size("kept")).withColumn("kept", flags)

    out = docs.drop("n_lines", "n_removed")
    mark = "".join(out.columns) + "_"  # names that no column of docs has
    k, copy, stay, many = f"{mark}k", f"{mark}copy", f"{mark}kept", f"{mark}n"
    kept = cut(kept.withColumnsRenamed({"kept": stay, "n": many}))
    removed(made)
    if unique:
        sizes = kept.agg(F.count("*").alias("rows"), F.sum(F.octet_length(stay)).alias("bytes")).first()
        small = sizes.rows <= BROADCAST_ROWS and (sizes.bytes or 0) <= FLAGS
        out = out.withColumn(copy, F.lit(1)).join(F.broadcast(kept) if small else kept, F.col(id_col).eqNullSafe(F.col("k_id")) & F.col(text_col).isNotNull(), "left").drop("k_id")
    else:
        out = out.withColumn(k, F.xxhash64(id_col, text_col)).join(kept.drop("k_id").withColumnRenamed("k_k", k), k, "left")
        out = out.withColumn(copy, F.row_number().over(Window.partitionBy(k).orderBy(k))).drop(k)  # equal rows; no further shuffle
    whole = F.split(text_col, "\n")
    stays = F.filter(whole, lambda line, i: ~has_words(line) | ((F.col(copy) == 1) & F.coalesce(F.substring(stay, i + 1, F.lit(1)) == F.lit(b"1"), F.lit(False))))
    n_lines = F.coalesce(F.size(F.filter(whole, has_words)), F.lit(0))
    left = F.when(F.col(copy) == 1, F.coalesce(F.col(many), F.lit(0))).otherwise(0)
    wordy = F.col(text_col).isNotNull()
    out = out.withColumn("n_lines", F.when(wordy, n_lines).otherwise(0)).withColumn("n_removed", F.when(wordy, F.col("n_lines") - left).otherwise(0))
    return out.withColumn(text_col, F.array_join(stays, "\n")).drop(copy, stay, many)
