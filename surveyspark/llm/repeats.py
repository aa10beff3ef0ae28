"""Removal of long repeated byte strings with run-compressed Burrows-Wheeler indexes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the corpus (texts are UTF-8; strings
never cross documents). The work is cut into independent shards by anchors that depend on content alone:

1. The anchor of a window of ``length`` bytes is its first k-gram of least hash. Windows that follow each other share anchors,
   so an anchor owns a run of windows, its segment. Equal windows have equal anchors at equal offsets, and so always meet
   under one anchor hash.
2. Copies of a segment are one content with a count; a content that occurs twice is repeated as a whole. Content that occurs
   once under an anchor that has other content too may be repeated in part; these segments, and one of each content beside
   them, go on. Nothing else has a second place.
3. They are indexed in shards, into which anchors are packed by bytes: the suffixes of a shard give its Burrows-Wheeler
   transform, which is kept as runs with suffix positions and common prefixes sampled at the runs' ends. Matching statistics of
   every text against all others are streamed from these samples, for inside a run the common prefix of the next text position
   is one less. Windows with a match of ``length`` are repeated.
4. An anchor with more contents than a shard takes (at the edge of a passage that stands in many texts) is cut into ranges of at
   most 32 windows; what all windows of a range have in common is their anchor. They are counted and indexed in the same way,
   and what still does not fit is cut again, down to single windows, which need no index: equal ones are copies.

Runs of repeated windows are joined to their documents, merged and cut out.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; repeated rows count as different documents,
so that both lose all their windows; an empty table gives no rows. Exact but for collisions of 64-bit hashes of anchors and contents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, encode, materialize, prefix_hash, range_hash, spread_join

LENGTH = 400
GRAM = 64
#: Bytes hashed at once; positions in such a piece fit the low bits of a key.
PIECE_BITS = 20
#: Windows of a range of an anchor that does not fit a shard, and of ranges of such ranges. The last are single windows.
RANGES = (32, 8, 2, 1)
#: Bytes of a shard, of which no more than twice as many meet in a task, and shards of a bin.
SHARD, BIN = 1 << 20, 64
#: Byte at the end of a part, which UTF-8 does not have, and the bytes of the first ranks.
END, FIRST = 255, 6


def window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by prefix and suffix minima of blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor's place in the first window, anchor hash, content hash) of all segments in a buffer of documents that begin at ``bounds[:-1]``."""
    none = (np.zeros(0, np.int64),) * 6
    if len(raw) < length:
        return none
    prefix = prefix_hash(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = range_hash(prefix, at, at + gram)
    low = np.uint64((1 << PIECE_BITS) - 1)
    least = window_minimum((grams & ~low) | at.astype(np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    start = np.arange(len(anchor))
    doc = np.searchsorted(bounds, start, "right") - 1
    inside = start + length <= bounds[doc + 1]
    turn = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
    first = np.flatnonzero(turn & inside)
    if not len(first):
        return none
    last = np.append(np.flatnonzero(turn)[1:], len(anchor))[np.searchsorted(np.flatnonzero(turn), first)]
    last = np.minimum(last, bounds[doc[first] + 1] - length + 1)
    return doc[first], first - bounds[doc[first]], last - first, anchor[first] - first, grams[anchor[first]].astype(np.int64), range_hash(prefix, first, last - 1 + length).astype(np.int64)


def pieces(texts, length: int):
    """Buffers of about a piece's size: (bytes, bounds, number of text, offset in the text); long texts are cut with an overlap."""
    most = (1 << PIECE_BITS) - 1
    held: list[tuple[bytes, int, int]] = []
    size = 0

    def out():
        raw = np.frombuffer(b"".join(h[0] for h in held), np.uint8)
        return raw, np.cumsum([0] + [len(h[0]) for h in held]), np.array([h[1] for h in held]), np.array([h[2] for h in held])

    for i, text in enumerate(texts):
        raw = encode(text)
        for at in range(0, max(1, len(raw) - length + 1), most - length + 1):
            part = raw[at : at + most]
            if size + len(part) > most and held:
                yield out()
                held, size = [], 0
            held.append((part, i, at))
            size += len(part)
    if held:
        yield out()


ROWS = "doc long, key long, at long, n int, lead int, once boolean, up long, anchor long, content long"
PART = ("doc", "key", "at", "n", "lead", "once", "anchor", "size", "bytes")


def find_segments(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of ``n`` windows from byte ``at`` of the text with id ``doc`` and hash ``key``; the anchor stands ``lead`` bytes further."""

    def scan(batches):
        for batch in batches:
            ids, keys = batch["doc"].to_numpy(), batch["key"].to_numpy()
            for raw, bounds, which, offset in pieces(batch["text"], length):
                doc, at, n, lead, anchor, content = segments(raw, bounds, length, gram)
                at = at + offset[doc] if len(doc) else at
                yield pd.DataFrame({"doc": ids[which[doc]], "key": keys[which[doc]], "at": at, "n": n.astype(np.int32), "lead": lead.astype(np.int32), "once": True, "up": at, "anchor": anchor, "content": content})

    return docs.mapInPandas(scan, ROWS)


def ranges(parts: DataFrame, width: int, length: int) -> DataFrame:
    """Rows of at most ``width`` windows cut from ``parts``; the anchor hash is that of the bytes that all windows of a full range hold, ``up`` the part's place."""

    def cut(batches):
        for batch in batches:
            raw = np.frombuffer(b"".join(batch["bytes"]), np.uint8)
            sizes, n, lead = batch["bytes"].map(len).to_numpy(), batch["n"].to_numpy(np.int64), batch["lead"].to_numpy(np.int64)
            base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            row = np.repeat(np.arange(len(n)), n)
            j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            group = (lead[row] - j) // width
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (group[1:] != group[:-1]))))
            count = np.diff(np.append(first, len(row)))
            row, j, group = row[first], j[first], group[first]
            start, prefix = base[row] + j, prefix_hash(raw)
            inner = base[row] + lead[row] - group * width  # the same bytes whether or not the range is cut short
            core, content = range_hash(prefix, inner, inner - width + 1 + length), range_hash(prefix, start, start + count - 1 + length)
            pick = lambda c: batch[c].to_numpy()[row]
            yield pd.DataFrame({"doc": pick("doc"), "key": pick("key"), "at": pick("at") + j, "n": count.astype(np.int32), "lead": (lead[row] - j).astype(np.int32), "once": pick("once"), "up": pick("at"), "anchor": core.astype(np.int64), "content": content.astype(np.int64)})

    return parts.select("doc", "key", "at", "n", "lead", "once", "bytes").mapInPandas(cut, ROWS)


def sort_out(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """(runs repeated as a whole, rows that may be repeated in part): the second with one row of each content beside them, and the bytes of all contents of their anchor."""
    contents = rows.groupBy("anchor", "content").agg(F.count("*").alias("__n"), F.min(F.struct("doc", "key", "at", "n", "lead", "once", "up")).alias("of"))
    contents = materialize(contents, "contents")
    copies = contents.filter("__n > 1").select("anchor", "content", "__n")
    whole = spread_join(rows.filter("once"), copies, ["anchor", "content"], rows.count()).select("doc", "key", "at", "n")
    alone = (F.col("__n") == 1) & F.col("of.once")
    anchors = contents.groupBy("anchor").agg(F.count("*").alias("__n"), F.sum(F.col("of.n") + length - 1).alias("size"), F.max(alone).alias("open")).filter("__n > 1 AND open").drop("open")
    open_ = spread_join(contents.select("of.*", "anchor", alone.alias("alone")), anchors, "anchor", contents.count())
    return whole, materialize(open_.drop("once").withColumnRenamed("alone", "once"), "open")


def with_bytes(rows: DataFrame, parts: DataFrame, length: int) -> DataFrame:
    """``rows`` with their bytes, from the ``parts`` that they were cut from."""
    held = parts.select("doc", "key", F.col("at").alias("up"), F.col("bytes").alias("__held"))
    at = (F.col("at") - F.col("up") + 1).cast("int")
    return rows.join(held, ["doc", "key", "up"]).withColumn("bytes", F.substring("__held", at, F.col("n") + length - 1)).select(*PART)


def sort_suffixes(text: np.ndarray, end: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Suffix array by doubling, and for each doubled length the ranks of all suffixes by that many bytes.

    ``text`` are parts that end with END, ``end`` the place of each position's END and ``part`` the number of its part. Suffixes end
    with their part; ends of different parts differ. The first ranks are of six bytes and, if these hold an end, the part.
    """
    n = len(text)
    rest, key = end - np.arange(n), np.zeros(n, np.uint64)
    padded = np.concatenate((text, np.zeros(FIRST, np.uint8)))
    for j in range(FIRST):
        key = key << np.uint64(8) | np.where(rest < j, 0, padded[j : n + j]).astype(np.uint64)
    key = key << np.uint64(16) | np.where(rest < FIRST, part + 1, 0).astype(np.uint64)
    order = np.argsort(key)
    heads = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank = np.zeros(n + 1, np.int32)
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0)) + 1
    step, levels = FIRST, []
    loose = np.flatnonzero(np.bincount(rank[order], minlength=n + 2)[rank[order]] > 1)
    while len(loose):
        levels.append((step, rank.copy()))
        mine = order[loose]
        both = rank[mine].astype(np.int64) * (n + 2) + rank[np.minimum(mine + step, n)]
        again = np.argsort(both)
        mine, both = mine[again], both[again]
        order[loose] = mine
        new = np.concatenate(([True], both[1:] != both[:-1]))
        rank[mine] = np.maximum.accumulate(np.where(new, loose + 1, 0))
        single = new & np.concatenate((new[1:], [True]))
        loose = loose[~single]
        step *= 2
    return order, levels


def common_prefix(text: np.ndarray, levels: list, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, which differ."""
    out = np.zeros(len(a), np.int64)
    for step, rank in reversed(levels):
        out += step * (rank[np.minimum(a + out, len(text))] == rank[np.minimum(b + out, len(text))])
    going = np.ones(len(a), bool)
    for _ in range(FIRST):
        x, y = text[np.minimum(a + out, len(text) - 1)], text[np.minimum(b + out, len(text) - 1)]
        going &= (x == y) & (x != END)
        out += going
    return out


class RunLengthIndex:
    """Burrows-Wheeler transform of texts as runs, with positions and common prefixes sampled at both ends of each run."""

    def __init__(self, parts: list[bytes]) -> None:
        text = np.frombuffer(b"".join(p + bytes([END]) for p in parts), np.uint8)
        sizes = np.array([len(p) + 1 for p in parts], np.int64)
        self.starts, self.n = np.cumsum(sizes) - sizes, len(text)
        order, levels = sort_suffixes(text, np.repeat(self.starts + sizes - 1, sizes), np.repeat(np.arange(len(parts)), sizes))
        bwt = text[order - 1]
        turn = np.flatnonzero(np.concatenate(([True], (bwt[1:] != bwt[:-1]) | (bwt[1:] == END))))  # ends of parts are all different
        end = np.append(turn[1:], self.n) - 1
        self.symbols, self.sizes, self.heads, self.tails = bwt[turn], end - turn + 1, order[turn], order[end]
        self.head_match = np.append([0], common_prefix(text, levels, self.heads[1:], self.tails[:-1]))
        self.tail_match = np.append(self.head_match[1:], 0)

    def matching_statistics(self) -> np.ndarray:
        """For each text position the longest match that starts elsewhere, streamed from the samples in text order."""
        best = np.zeros(self.n, np.int64)
        for places, match in ((self.heads, self.head_match), (self.tails, self.tail_match)):
            by_place = np.argsort(places)
            places, match = places[by_place], match[by_place]
            reach = np.repeat(match + places, np.diff(np.append(places, self.n)))  # the first position is a sample: its symbol is an end
            np.maximum(best[places[0] :], reach - np.arange(places[0], self.n), out=best[places[0] :])
        return best


def repeated_parts(rows: pd.DataFrame, length: int) -> pd.DataFrame:
    """Runs of repeated windows (doc, key, at, n) in the segments of a shard that occur once."""
    index = RunLengthIndex(list(rows["bytes"]))
    matches = index.matching_statistics() >= length
    out = []
    for start, doc, key, at, n, once in zip(index.starts, rows["doc"], rows["key"], rows["at"], rows["n"], rows["once"], strict=True):
        if once:
            edge = np.diff(np.concatenate(([0], matches[start : start + n], [0])).astype(np.int8))
            out += [(doc, key, at + a, b - a) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return pd.DataFrame(out, columns=["doc", "key", "at", "n"])


def cut_out(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` rows with their bytes, from whole texts."""
    fields = ("at", "n", "lead", "once", "anchor", "size")

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, key, text, wants in zip(batch["doc"], batch["key"], batch["text"], batch["wants"], strict=True):
                raw = encode(text)
                rows += [(doc, key, *[w[f] for f in fields], raw[w["at"] : w["at"] + w["n"] + length - 1]) for w in wants]
            yield pd.DataFrame(rows, columns=["doc", "key", *fields, "bytes"])

    by_doc = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct(*fields)).alias("wants"))  # at most a text's segments
    joined = docs.join(by_doc, ["doc", "key"]).dropDuplicates(["doc", "key"])  # rows alike in id and text
    return joined.select("doc", "key", "text", "wants").mapInPandas(cut, "doc long, key long, at long, n int, lead int, once boolean, anchor long, size long, bytes binary").select(*PART)


def shards(parts: DataFrame) -> DataFrame:
    """``parts`` with the number of their ``shard`` (bin, place): anchors stay together and are packed by bytes, in bins of many shards each."""
    sizes = parts.groupBy("anchor").agg(F.first("size").alias("size"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    binned = sizes.withColumn("bin", F.pmod(F.xxhash64("anchor"), F.lit(total // (BIN * SHARD) + 1)))
    ahead = F.sum("size").over(Window.partitionBy("bin").orderBy("anchor").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = binned.select("anchor", F.struct("bin", F.floor(ahead / SHARD).alias("place")).alias("shard"))
    return parts.join(placed, "anchor")


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc, key, text) -> (doc, key, at, n): runs of windows that start at bytes at .. at + n - 1 and occur elsewhere too."""
    out, wanted = sort_out(materialize(find_segments(docs, length, gram), "segments"), length)
    parts = materialize(cut_out(docs, wanted, length), "parts")
    fit = parts.filter(F.col("size") <= SHARD)
    for width in RANGES:
        wide = parts.filter(F.col("size") > SHARD)
        if wide.isEmpty():
            break
        whole, open_ = sort_out(materialize(ranges(wide, width, length), "ranges"), length)
        out = out.unionAll(whole)
        parts = materialize(with_bytes(open_, wide, length), "parts")
        fit = fit.unionAll(parts.filter(F.col("size") <= SHARD))
    dealt = shards(fit).select("doc", "key", "at", "n", "once", "bytes", "shard")
    return out.unionAll(dealt.groupBy("shard").applyInPandas(lambda rows: repeated_parts(rows, length), "doc long, key long, at long, n int"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, kept_bytes: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) -> doc_id, n_bytes, removed (array of start, end in bytes), kept_sha256 and, unless it is not asked for, kept (bytes)."""
    bounded_batches(docs.sparkSession)
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64("text").alias("key"), "text")
    runs = repeated_windows(keyed.select("doc", "key", "text"), length)
    runs = runs.groupBy("doc", "key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))  # at most a text's windows

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(batch["doc_id"], batch["text"], batch["runs"], strict=True):
                raw = encode(text)
                cover = np.zeros(len(raw) + 1, np.int64)
                for r in found if found is not None else ():
                    cover[r["at"]] += 1
                    cover[r["at"] + r["n"] - 1 + length] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                edge = np.diff(np.concatenate(([0], gone, [0])).astype(np.int8))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if spans else raw
                rows.append((doc_id, len(raw), spans, kept if kept_bytes else None, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "removed", "kept", "kept_sha256"]).astype({"doc_id": "Int64"})

    joined = keyed.join(runs, ["doc", "key"], "left").select("doc_id", "text", "runs")
    return joined.mapInPandas(cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary, kept_sha256 string")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), kept_bytes=False)
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed")
    return found.select("doc_id", "n_bytes", removed, F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
