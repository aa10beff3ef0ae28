"""N-gram Jaccard self-join by a grouped prefix join.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Two documents link when 100 * shared >=
80 * all. The join, exact but for collisions of 64-bit (and, for equal sets, 128-bit) hashes:

1. Documents with equal sets are one class. A frequency sketch of fixed size over the shingles of all documents gives the
   order in which sets are sorted, rare cells first; any order is right, this one keeps frequent shingles out of prefixes.
2. Prefixes of the length that a link needs are taken. Classes with equal prefix and size are collapsed into one group, and
   only groups are put into the posting lists; lists of one group go. Lists of cells that the sketch shows as hot are salted.
3. In each list, groups are paired with the list's first group only (a star), filtered by size and position and bounded by
   cell histograms.
4. Lists that still hold several components are worked on in rounds: their groups are paired with a few hashed ones of the list
   (pivots; filtered by size, position and the parities of 512 cells), which joins most of what links, until an estimate says that pairs in proportion to the entries are left. Then
   groups meet across components, never within one, and are expanded to their members and bounded. Then all pairs are
   verified on whole sets. Where verified links leave a component in parts, lists are worked on again across these parts. No
   link between different components is left unseen.

Defined cases: null or empty texts and texts without words have no set and link with nothing; fewer than five words are
one shingle; repeated rows are in one class; a null doc_id is never a component's smallest unless all its ids are null.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BASE, bounded_batches, drop_scratch, encode, materialize, mix, prefix_hash, range_hash, spread_join
from .components import components

WORDS = 5
PERCENT = 80
#: Cells of the sketch, which is broadcast with a byte a cell.
SKETCH_BITS = 22
BLOCK = 1 << 17
PIECE = 1 << 20
#: Expected rows of a posting list's salted part.
PART = 20_000
HISTOGRAM = 256
PARITY = 512
#: Hashed entries of an open list with which all others are paired in a round, and rounds at most.
PIVOTS, ROUNDS = 4, 6

_LOWER = bytes.maketrans(bytes(range(65, 91)) + bytes(range(9, 14)), bytes(range(97, 123)) + b" " * 5)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of ``raw``, which is read in pieces that end between words."""
    raw, hashes, starts, at = raw.translate(_LOWER), [], [], 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= PIECE else raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        piece = np.frombuffer(raw, np.uint8, end - at, at)
        turns = np.diff(np.concatenate(([0], piece != 32, [0])).astype(np.int8))
        a, b = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
        hashes.append(range_hash(prefix_hash(piece), a, b))
        starts.append(a + at)
        at = end
    return (np.concatenate(hashes), np.concatenate(starts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def roll(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words."""
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * BASE + words[i : len(words) - n + 1 + i]
    return mix(total + np.uint64(n))


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def flush() -> None:
        words, starts = word_hashes(b" ".join(held))
        bounds = np.searchsorted(starts, np.cumsum([0] + [len(h) + 1 for h in held]))
        rolled = roll(words, WORDS) if len(words) >= WORDS else words[:0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = b - a
            out.append(np.unique(rolled[a : b - WORDS + 1]) if n >= WORDS else roll(words[a:b], n) if n else words[:0])
        held.clear()

    size = 0
    for text in texts:
        held.append(encode(text))
        size += len(held[-1])
        if size >= PIECE:
            flush()
            size = 0
    if held:
        flush()
    return out


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    with np.errstate(over="ignore"):
        return int(np.int64(np.add.reduce(mix(shingles)).astype(np.int64))), int(np.bitwise_xor.reduce(mix(shingles * BASE), initial=np.uint64(0)).astype(np.int64))


def histogram(shingles: np.ndarray) -> bytes:
    """Shingles in each of HISTOGRAM cells, up to 255."""
    return np.minimum(np.bincount((shingles & np.uint64(HISTOGRAM - 1)).astype(np.int64), minlength=HISTOGRAM), 255).astype(np.uint8).tobytes()


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of PARITY cells whether its number of shingles is odd, as signed 64-bit words: sets differ in as many shingles at least as in bits."""
    counts = np.bincount((shingles >> np.uint64(16) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """For each cell, 8 * log2(1 + shingles of all documents in it), as bytes. Sums of blocks meet in two levels."""

    def partial(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            sets = shingle_sets(batch["text"])
            if sets:
                total += np.bincount(cells(np.concatenate(sets)), minlength=1 << SKETCH_BITS)
        yield from ship(total)

    def ship(total: np.ndarray):
        kind = np.int32 if total.max(initial=0) < 1 << 31 else np.int64
        yield pd.DataFrame({"block": np.arange(len(total) // BLOCK, dtype=np.int32), "sums": [total[i : i + BLOCK].astype(kind).tobytes() for i in range(0, len(total), BLOCK)]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for one in rows["sums"]:
            total += np.frombuffer(one, np.int32 if len(one) == 4 * BLOCK else np.int64)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "sums": [total.tobytes()]})

    def levels(row: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(row["sums"].iloc[0], np.int64)
        return row.assign(sums=[np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8).tobytes()])

    shape = "block int, sums binary"
    parts = docs.select("text").mapInPandas(partial, shape).withColumn("part", F.spark_partition_id() % 997)
    merged = parts.groupBy("block", "part").applyInPandas(merge, shape).groupBy("block").applyInPandas(lambda rows: levels(merge(rows)), shape)
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in merged.collect():  # a byte a cell
        out[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.sums, np.uint8)
    return out


def prefixes(docs: DataFrame, percent: int) -> DataFrame:
    """One row a document: id, key of its text, size, set signature, group signature, histogram, parities, prefix in rare-first order, salts (empty if all are 1)."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs))

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, key, s in zip(batch["doc_id"], batch["key"], shingle_sets(batch["text"]), strict=True):
                n = len(s)
                a, b = signature(s)
                if not n:
                    rows.append((doc_id, key, 0, a, b, 0, 0, b"", [], [], []))
                    continue
                level = sketch.value[cells(s)]
                order = np.lexsort((s, level))[: n - -(-percent * n // 100) + 1]
                prefix, salts = s[order], (2.0 ** (level[order] / 8.0) / PART).astype(np.int32) + 1
                c, d = signature(np.append(prefix, np.uint64(n)))
                rows.append((doc_id, key, n, a, b, c, d, histogram(s), parity(s), prefix.astype(np.int64), salts if salts.max() > 1 else []))
            yield pd.DataFrame(rows, columns=["doc_id", "key", "n", "s1", "s2", "g1", "g2", "histogram", "parity", "prefix", "salts"]).astype({"doc_id": "Int64"})

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInPandas(cut, "doc_id long, key long, n long, s1 long, s2 long, g1 long, g2 long, histogram binary, parity array<long>, prefix array<long>, salts array<int>")


def fits(percent: int) -> Column:
    """Size filter and position filter of two list entries x and y: sizes, and what both still can share from here on."""
    n, m, p, q = F.col("x.n"), F.col("y.n"), F.col("x.pos"), F.col("y.pos")
    sized = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    return sized & ((100 + percent) * F.least(n - p, m - q) >= percent * (n + m))


def near(percent: int) -> Column:
    """Parity filter of two list entries x and y: sets that link differ in few shingles. Groups of several classes have no parities and pass."""
    differ = sum((F.bit_count(F.get("x.parity", F.lit(i)).bitwiseXOR(F.get("y.parity", F.lit(i)))) for i in range(1, PARITY // 64)), F.bit_count(F.get("x.parity", F.lit(0)).bitwiseXOR(F.get("y.parity", F.lit(0)))))
    return F.coalesce((100 + percent) * differ <= (100 - percent) * (F.col("x.n") + F.col("y.n")), F.lit(True))


def bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose histograms leave room for a link."""
    return _kept(pairs, classes, "histogram", percent)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link, counted on whole sets."""
    return _kept(pairs, sets, "shingles", percent)


def _kept(pairs: DataFrame, held: DataFrame, column: str, percent: int) -> DataFrame:
    def shared(x: bytes, y: bytes) -> int:
        if column == "shingles":
            return len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        h, g = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)  # cells at 255 may hold any number
        return 1 << 40 if ((h == 255) | (g == 255)).any() else int(np.minimum(h, g).sum(dtype=np.int64))

    def keep(batches):
        for batch in batches:
            found = np.array([shared(x, y) for x, y in zip(batch["a_held"], batch["b_held"], strict=True)], np.int64)
            n = batch["a_n"] + batch["b_n"]
            found = np.minimum(found, np.minimum(batch["a_n"], batch["b_n"]))
            yield batch.loc[100 * found >= percent * (n - found), ["a", "b"]]

    side = lambda s: held.select(F.col("cls").alias(s), F.col("n").alias(f"{s}_n"), F.col(column).alias(f"{s}_held"))
    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(keep, "a long, b long"), "pairs")


def ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


class Lists:
    """Posting lists of groups, and for each group of several classes a list of these.

    ``entries``: (h, unit, n, pos, inner); a unit is a group, whose id is that of its first class, or within a group (``inner``) a
    class. ``members``: (gid, cls, several, parity); ``several`` says that the group has other classes too.
    """

    def __init__(self, entries: DataFrame, members: DataFrame, percent: int) -> None:
        self.entries, self.members, self.percent = entries, members, percent

    def still_open(self, links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Entries, with the range of their components, of the lists that hold several components as ``links`` make them; and the members with their components."""
        comps = components(links).withColumnRenamed("node", "cls")
        placed = materialize(self.members.join(comps, "cls", "left").withColumn("component", F.coalesce("component", "cls")).drop("node"), "placed")
        units = placed.filter("several").groupBy(F.col("gid").alias("unit")).agg(F.min("component").alias("lo"), F.max("component").alias("hi")).withColumns({"parity": F.lit(None).cast("array<bigint>"), "inner": F.lit(False)})
        units = units.unionByName(placed.select(F.col("cls").alias("unit"), F.col("component").alias("lo"), F.col("component").alias("hi"), "parity", F.col("several").alias("inner")))
        entries = materialize(self.entries.join(units, ["unit", "inner"]), "ranges")
        lists = entries.groupBy("h").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count("*").alias("__n")).filter("least <> most").drop("least", "most")
        out = materialize(spread_join(entries, lists, "h", entries.count()), "open")
        drop_scratch(entries)
        return out, placed

    def by_pivots(self, entries: DataFrame, more: int) -> tuple[DataFrame, float]:
        """Pairs (a, b) of the open entries with PIVOTS hashed entries of their list, and an estimate of how many pairs all entries would make."""
        entry = ("unit", "n", "pos", "lo", "hi", "parity")
        pivots = F.array(*[F.min(F.struct(F.xxhash64("unit", F.lit(PIVOTS * more + i)).alias("rank"), *entry)) for i in range(PIVOTS)])
        lists = entries.groupBy("h").agg(F.array_distinct(pivots).alias("y"), F.count("*").alias("__n")).withColumn("size", F.col("__n"))
        met = spread_join(entries.select("h", F.struct(*entry).alias("x")), lists, "h", entries.count()).withColumn("made", F.col("size") / (2 * F.size("y"))).withColumn("y", F.explode("y"))
        met = met.filter((F.col("x.unit") != F.col("y.unit")) & self._apart() & fits(self.percent) & near(self.percent))
        met = materialize(met.select(*ordered("x.unit", "y.unit"), "made"), "met")
        return met.select("a", "b").distinct(), met.agg(F.sum("made")).first()[0] or 0.0

    def across(self, entries: DataFrame, placed: DataFrame) -> DataFrame:
        """All pairs (a, b) of classes of different components that meet in a list and pass the filters: groups meet, then their members."""
        side = lambda s: entries.select("h", "inner", F.struct("unit", "n", "pos", "lo", "hi", "parity").alias(s))
        met = side("x").join(side("y"), ["h", "inner"]).filter((F.col("x.unit") < F.col("y.unit")) & self._apart() & fits(self.percent) & near(self.percent))
        met = materialize(met.select("inner", F.col("x.unit").alias("x"), F.col("y.unit").alias("y")).distinct(), "met")
        of = lambda s: placed.select(F.col("gid").alias(s), F.col("cls").alias(f"{s}_cls"), F.col("component").alias(f"{s}_component"))
        members = met.filter("NOT inner").join(of("x"), "x").join(of("y"), "y").filter("x_component <> y_component").select(*ordered("x_cls", "y_cls"))
        return members.unionAll(met.filter("inner").select(*ordered("x", "y"))).distinct()

    @staticmethod
    def _apart() -> Column:
        """Not all that the two units hold is of one component."""
        return ~((F.col("x.lo") == F.col("x.hi")) & (F.col("y.lo") == F.col("y.hi")) & (F.col("x.lo") == F.col("y.lo")))

    def joined(self, links: DataFrame, check) -> tuple[DataFrame, DataFrame]:
        """``links`` with what ``check`` keeps of the pairs with pivots, in rounds until few pairs are left to meet or nothing is kept; and all of these."""
        for more in reversed(range(ROUNDS)):
            entries, placed = self.still_open(links)
            n = entries.count()
            if not n:
                return links, links.limit(0)
            pairs, left = self.by_pivots(entries, more)
            if left <= n or not more:
                return links, self.across(entries, placed)
            found = check(pairs)
            if found.isEmpty():
                return links, self.across(entries, placed)
            links = materialize(links.unionAll(found), "links")
            drop_scratch(entries, placed)


def placed_classes(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, key, n, s1, s2) and classes (s1, s2, __n, least, of, component): ``of`` is the class's first (no id, id, key), ``__n`` its documents."""
    bounded_batches(docs.sparkSession)
    full = materialize(prefixes(docs, percent).withColumn("row", F.monotonically_increasing_id()), "prefixes")
    rows = materialize(full.select("doc_id", "key", "n", "s1", "s2", "g1", "g2", "row", "histogram", "parity"), "rows")
    group = ["g1", "g2", "n"]
    classes = rows.filter("n > 0").groupBy("s1", "s2").agg(F.min("row").alias("cls"), F.count("*").alias("__n"), F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("of"), F.min(F.struct("g1", "g2")).alias("g"), F.first("n").alias("n"), F.first("histogram").alias("histogram"), F.first("parity").alias("parity"))
    classes = materialize(classes, "classes")

    # Posting lists of groups; lists of one group go, unless they are parts of a salted list. A group's id is its first row, as a
    # class's is: a group has the id of its first class.
    groups = full.filter("n > 0").groupBy(*group).agg(F.min("row").alias("gid"), F.first("prefix").alias("prefix"), F.first("salts").alias("salts"))
    listed = groups.select("gid", "n", "salts", F.posexplode("prefix").alias("pos", "h"))
    salts = F.coalesce(F.get("salts", F.col("pos")), F.lit(1))
    entry = F.struct("gid", F.shiftleft("n", 31).bitwiseOR(F.col("pos")).alias("at"))  # a size and a position in one number
    one = Window.partitionBy("h", "salt")
    listed = listed.select("h", F.when(salts > 1, F.pmod(F.hash("gid"), salts)).otherwise(-1).cast("int").alias("salt"), *[entry[c].alias(c) for c in ("gid", "at")])
    listed = listed.withColumn("many", (F.col("salt") >= 0) | (F.count("*").over(one) > 1)).withColumn("first", F.min(F.struct("gid", "at")).over(one)).filter("many")
    n, pos = (lambda c: F.shiftright(c, 31).cast("int")), (lambda c: F.col(c).bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    lists = materialize(listed.select("h", "gid", n("at").alias("n"), pos("at").alias("pos"), F.col("first.gid").alias("x"), n("first.at").alias("x_n"), pos("first.at").alias("x_pos")), "lists")
    drop_scratch(full)

    gids = rows.filter("n > 0").groupBy(*group).agg(F.min("row").alias("gid"), F.count("*").alias("__n"))
    members = spread_join(classes.select("cls", F.col("g.g1").alias("g1"), F.col("g.g2").alias("g2"), "n", "parity"), gids, group, rows.count())
    inner = members.filter("gid <> cls")
    members = members.join(inner.select("gid", F.lit(True).alias("several")).distinct(), "gid", "left")
    members = materialize(members.select("gid", "cls", F.col("n").cast("int").alias("n"), F.col("several").isNotNull().alias("several"), "parity"), "members")
    inner = members.filter("gid <> cls")

    # Stars: each group of a list with the list's first, each class of a group with the group's first.
    star = lists.filter("x <> gid").select(F.struct(F.col("x").alias("unit"), F.col("x_n").alias("n"), F.col("x_pos").alias("pos")).alias("x"), F.struct(F.col("gid").alias("unit"), "n", "pos").alias("y"))
    pairs = star.filter(fits(percent)).select(*ordered("x.unit", "y.unit")).unionAll(inner.select(*ordered("gid", "cls")))
    stars = bounded(pairs.distinct(), classes, percent)

    # Lists that still hold several components: more stars, then all pairs across components. The first time, components are taken
    # as if all bounded pairs were links: pairs within such a component are of classes whose sets are needed in any case.
    within = members.filter("several").select(F.xxhash64("gid", F.lit("group")).alias("h"), F.col("cls").alias("unit"), "n", F.lit(0).alias("pos"), F.lit(True).alias("inner"))
    entries = materialize(lists.select("h", F.col("gid").alias("unit"), "n", "pos", F.lit(False).alias("inner")).unionByName(within), "entries")
    drop_scratch(lists)
    held = Lists(entries, members.drop("n"), percent)
    found, left = held.joined(stars, lambda pairs: bounded(pairs, classes, percent))
    tried = materialize(found.unionAll(bounded(left, classes, percent)).distinct(), "tried")
    needed = tried.select(F.col("a").alias("cls")).union(tried.select(F.col("b").alias("cls"))).distinct()
    needed = needed.join(classes, "cls").select("cls", F.coalesce("of.doc_id", F.lit(-(1 << 63))).alias("doc"), F.col("of.key").alias("key"))
    sets = materialize(class_sets(docs, needed), "sets")
    # Again with verified links: what is left are pairs within bounded components that fall apart.
    known = lambda pairs: pairs.join(tried, ["a", "b"], "left_anti").join(sets.select(F.col("cls").alias("a")), "a", "left_semi").join(sets.select(F.col("cls").alias("b")), "b", "left_semi")
    check = lambda pairs: verified(bounded(known(pairs), classes, percent), sets, percent)
    links, left = held.joined(verified(tried, sets, percent), check)
    links = links.unionAll(check(left))

    placed = classes.select("s1", "s2", "__n", "cls", "least", "of").join(components(links).withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    placed = materialize(placed.drop("cls"), "placed")
    drop_scratch(entries, members, tried, sets, classes)
    return rows.select("doc_id", "key", "n", "s1", "s2"), placed


def jaccard_classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, key (hash of the text), n_shingles, component_id; one row a document."""
    rows, placed = placed_classes(docs, percent)
    n = placed.count()
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("__n"))
    placed = spread_join(placed.select("s1", "s2", F.col("__n").alias("copies"), "component"), least, "component", n)
    placed = materialize(placed.select("s1", "s2", F.col("copies").alias("__n"), "component_id"), "least")
    found = spread_join(rows.filter("n > 0"), placed, ["s1", "s2"], rows.count())
    found = found.unionByName(rows.filter("n = 0").withColumn("component_id", F.col("doc_id")))
    return found.select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")


def class_sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(cls, n, shingles) for each class of ``needed`` (cls, doc, key), read from one of its documents."""

    def build(batches):
        for batch in batches:
            sets = shingle_sets(batch["text"])
            yield pd.DataFrame({"cls": batch["cls"], "n": [len(s) for s in sets], "shingles": [s.tobytes() for s in sets]})

    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("key"), "text")
    found = keyed.join(needed, ["doc", "key"]).dropDuplicates(["doc", "key"])  # rows alike in id and text
    return found.select("cls", "text").mapInPandas(build, "cls long, n long, shingles binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest (id, text hash), null ids last. All columns stay.

    Rows without words link with nothing and all stay. Of rows alike in id and text any one stays.
    """
    rows, placed = placed_classes(docs.select("doc_id", "text"), percent)
    alike = lambda df: df["doc_id"].eqNullSafe(F.col("__doc")) & (df["key"] == F.col("__key"))
    first = placed.groupBy("component").agg(F.min("of").alias("of")).select(F.col("of.doc_id").alias("__doc"), F.col("of.key").alias("__key"))
    kept = rows.join(first, alike(rows)).groupBy("__doc", "__key").agg((F.count("*") > 1).alias("__repeated"))
    wordless = rows.filter("n = 0").select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"), F.lit(False).alias("__repeated")).distinct()
    kept = materialize(kept.unionAll(wordless), "kept")
    keyed = docs.withColumn("__text_key", F.xxhash64("text"))
    found = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["__doc"]) & (keyed["__text_key"] == kept["__key"]))
    out = found.filter(~F.col("__repeated"))
    if kept.filter("__repeated").limit(1).count():
        out = out.unionAll(found.filter("__repeated").dropDuplicates(["__doc", "__key"]))
    return out.drop("__text_key", "__doc", "__key", "__repeated")


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("key")


OP7_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS t(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
p AS (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, p.b FROM reach JOIN p ON reach.t = p.a),
c AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.t GROUP BY reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN c USING (r) LEFT JOIN n USING (r)
"""
