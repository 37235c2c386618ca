"""Near duplicates by an LSH forest.

Every distinct set of shingles has a signature of minima. Each of ORDERS sorted orders begins at another
place of the signature, and documents that stand next to each other in an order share the longest prefixes;
so a neighbourhood reaches few levels deep where documents are few, and as deep as it must where many are
alike. Neighbours whose sketches agree are candidates, and links are confirmed on full sets.

The work stays linear in groups of copies: equal sets are one document from the start; a document takes its
few best neighbours first; and documents of one region that are still in different components are then paired
by an exact prefix filter, whatever the size of the region. Orders are cut into tasks anywhere: rows at the ends of
a task and regions that reach one are compared again by keys, so results do not depend on the number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shiftgauge.llm.common import held, partitions, stored
from shiftgauge.llm.components import components

#: Percent of the union that two sets must share.
SIMILAR = 80
SIGNATURE, ORDERS, LEVELS = 96, 24, 8
#: Places of the signature between the starts of two orders.
STEP = SIGNATURE // ORDERS
#: A sketch keeps four bits of each minimum; so many minima must agree: at a similarity of 0.8 fewer do so once in about
#: two million pairs, at 0.5 so many do so once in 100.
SKETCH, AGREE = SIGNATURE // 2, 58
#: The lowest bit of every four.
LOWEST_OF_FOUR = 0x1111111111111111
#: Levels that neighbours share at least, rows that are looked back over, and neighbours that a row takes at first.
SHALLOW, LOOK_BACK, TAKEN = 2, 32, 3
#: Best neighbours of a document that are confirmed before components are formed.
BEST = 2
#: A region has REGION_LEVELS common levels, whatever its size.
REGION_LEVELS = 3
#: Rows of a region, and rows outside its largest component, that one task compares at a time.
TILE_ROWS = 4096

# Odd 64-bit multipliers that mix hashes.
MIX_A, MIX_B, MIX_C = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_draw = np.random.default_rng(20240607)
FACTORS = _draw.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32) | np.uint32(1)
OFFSETS = _draw.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it has grown large."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; with fewer words, of the whole sequence; none without words."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z alone are lowered, ASCII white space alone splits
    if not words:
        return np.zeros(0, np.uint64)
    n = min(n, len(words))
    known = held("shingles", WordHashes)
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, count=len(words))
    found = np.full(len(words) - n + 1, n, np.uint64)
    for place in range(n):
        found = (found + hashes[place : place + len(found)]) * np.uint64(MIX_A)
        found ^= found >> np.uint64(29)
    found = (found ^ (found >> np.uint64(30))) * np.uint64(MIX_B)
    found = (found ^ (found >> np.uint64(27))) * np.uint64(MIX_C)
    return np.unique(found ^ (found >> np.uint64(31)))


def signature(found: np.ndarray) -> np.ndarray:
    """Minima of the set under SIGNATURE orders, as 32-bit numbers."""
    keys = (found >> np.uint64(32)).astype(np.uint32)
    best = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(keys), 4096):
        best = np.minimum(best, (keys[at : at + 4096, None] * FACTORS + OFFSETS).min(axis=0))
    return best


def sketch_of(best: np.ndarray) -> bytes:
    """Four bits of each minimum, two minima a byte."""
    bits = (best >> np.uint32(3)).astype(np.uint8) & np.uint8(15)
    return (bits[0::2] | bits[1::2] << np.uint8(4)).tobytes()


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many minima agree, of sketches as rows of 64-bit numbers."""
    unlike = a ^ b
    unlike |= unlike >> np.uint64(1)
    unlike |= unlike >> np.uint64(2)
    return SIGNATURE - np.bitwise_count(unlike & np.uint64(LOWEST_OF_FOUR)).sum(axis=-1, dtype=np.int64)


def unlike_column(a: str, b: str) -> Column:
    """How many minima differ, of two columns of 64-bit numbers."""
    halves = F.col(a).bitwiseXOR(F.col(b))
    halves = halves.bitwiseOR(F.shiftrightunsigned(halves, 1))
    halves = halves.bitwiseOR(F.shiftrightunsigned(halves, 2))
    return F.bit_count(halves.bitwiseAND(F.lit(LOWEST_OF_FOUR)))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, set_key, levels, sketch; the last three are null for documents without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = shingle_set(text, n)
                if not len(found):
                    rows.append((0, None, None, None))
                    continue
                best = signature(found)
                levels = best.astype(np.uint16).astype(">u2")
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
                rows.append((len(found), key, np.append(levels, levels[:LEVELS]).tobytes(), sketch_of(best)))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_key", "levels", "sketch"], index=batch.index)
            yield pd.concat([batch[["doc_id"]], out], axis=1)

    schema = "doc_id long, n_shingles long, set_key binary, levels binary, sketch binary"
    return docs.mapInPandas(sign, schema)


def in_orders(sets: DataFrame, *more: str) -> DataFrame:
    """The sets once in each order, sorted; sets: id, levels, sketch and more columns."""
    rows = sets.select("id", "levels", "sketch", *more, F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("place"))
    label = F.substring("levels", 1 + 2 * STEP * F.col("place"), F.lit(2 * LEVELS))
    keys = ("place", "label", "id")
    labelled = rows.select("place", label.alias("label"), "id", "sketch", *more)
    return labelled.repartitionByRange(partitions(sets.sparkSession), *keys).sortWithinPartitions(*keys)


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place and label of rows as LEVELS + 1 numbers, sketches as 64-bit numbers, ids."""
    labels = np.frombuffer(b"".join(rows["label"]), ">u2").reshape(len(rows), LEVELS).astype(np.uint16)
    paths = np.concatenate([rows["place"].to_numpy(np.uint16)[:, None], labels], axis=1)
    return paths, _sketches(rows), rows["id"].to_numpy(np.int64)


def _sketches(rows: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(rows["sketch"]), "<u8").reshape(len(rows), SKETCH // 8)


def neighbours(ordered: DataFrame) -> DataFrame:
    """a, b, agree: the TAKEN nearest of the LOOK_BACK rows before each row that share SHALLOW levels and whose
    sketches agree.

    A task sees its own rows only, so it also hands out its first and last LOOK_BACK rows; those of one place meet in
    a second pass. They are as many as there are tasks, times 2 LOOK_BACK at most.
    """
    edge = ["place", "label", "id", "sketch"]
    schema = "a long, b long, agree int, place int, label binary, id long, sketch binary"
    pairs_or_edges = ordered.select(*edge).mapInPandas(_look, schema).filter("a is null or a <> b")
    once = stored(pairs_or_edges.groupBy("a", "b", *edge).agg(F.max("agree").alias("agree")), "neighbours")
    edges = once.filter("a is null").select(*edge)
    met = edges.repartition(partitions(ordered.sparkSession), "place").sortWithinPartitions("place", "label", "id")
    again = met.mapInPandas(_look, schema).filter("a <> b")
    return once.filter("a is not null").unionByName(again.select(*once.columns)).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs of neighbours of one task, and its first and last rows."""
    before, first = None, 0
    for batch in batches:
        if first < LOOK_BACK and len(batch):
            yield _edges(batch.iloc[: LOOK_BACK - first])
            first += min(len(batch), LOOK_BACK - first)
        rows = batch if before is None else pd.concat([before, batch], ignore_index=True)
        skip = 0 if before is None else len(before)
        paths, sketches, ids = _arrays(rows)
        taken = np.zeros(len(rows), np.int64)
        for lag in range(1, min(LOOK_BACK, len(rows) - 1) + 1):
            shared = (paths[lag:, : SHALLOW + 1] == paths[:-lag, : SHALLOW + 1]).all(axis=1)
            shared[: max(0, skip - lag)] = False
            at = np.flatnonzero(shared & (taken[lag:] < TAKEN)) + lag
            if not len(at):
                continue
            agree = agreeing(sketches[at], sketches[at - lag])
            at, agree = at[agree >= AGREE], agree[agree >= AGREE]
            taken[at] += 1
            if len(at):
                yield _pairs(ids[at], ids[at - lag], agree).assign(place=None, label=None, id=None, sketch=None)
        before = rows.iloc[-LOOK_BACK:].reset_index(drop=True)
    if before is not None and len(before):
        yield _edges(before)


def _edges(rows: pd.DataFrame) -> pd.DataFrame:
    return rows[["place", "label", "id", "sketch"]].assign(a=None, b=None, agree=None)


def _pairs(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b), "agree": agree.astype(np.int32)})


def regions(paths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of two rows or more with REGION_LEVELS common levels."""
    changed = (paths[1:, : REGION_LEVELS + 1] != paths[:-1, : REGION_LEVELS + 1]).any(axis=1)
    cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), len(paths)]
    yield from ((a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1)


def meet(sketches: np.ndarray, owners: np.ndarray, minors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows agree with one of another component, and which of them are among `minors`, whose rows meet all."""
    met, minor = np.zeros(len(owners), bool), np.zeros(len(owners), bool)
    for i in minors:
        others = np.flatnonzero(owners != owners[i])
        agree = agreeing(sketches[others], sketches[i]) >= AGREE
        if agree.any():
            met[others[agree]] = True
            met[i] = minor[i] = True
    return met, minor


def apart(paths: np.ndarray, sketches: np.ndarray, ids: np.ndarray, owners: np.ndarray) -> pd.DataFrame:
    """a, b: the TAKEN nearest of the LOOK_BACK rows before each row that are of another component, share SHALLOW levels but
    no region, and whose sketches agree. Pairs of one region are left to `across`, which sees all of them."""
    taken, found = np.zeros(len(ids), np.int64), [_pairs(ids[:0], ids[:0], ids[:0])]
    for lag in range(1, min(LOOK_BACK, len(ids) - 1) + 1):
        same = paths[lag:, : REGION_LEVELS + 1] == paths[:-lag, : REGION_LEVELS + 1]
        shared = same[:, : SHALLOW + 1].all(axis=1) & ~same.all(axis=1) & (owners[lag:] != owners[:-lag])
        at = np.flatnonzero(shared & (taken[lag:] < TAKEN)) + lag
        at = at[agreeing(sketches[at], sketches[at - lag]) >= AGREE]
        taken[at] += 1
        found.append(_pairs(ids[at], ids[at - lag], at))
    return pd.concat(found)[["a", "b"]].drop_duplicates()


def looked_across(ordered: DataFrame) -> DataFrame:
    """Rows that a pass over the orders, whose rows know their component, hands out; the columns tell their kind.

    a, b: near rows of different components and regions (see `apart`). label: the first and last rows of a task, for the same
    across tasks. id, minor without region: documents that `across` has found. region: rows of the regions that it has to put together.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch for batch in batches if len(batch)]
        if not parts:
            return
        rows = pd.concat(parts, ignore_index=True)
        paths, sketches, ids = _arrays(rows)
        owners = rows["component"].to_numpy(np.int64)
        met, minor, later = (np.zeros(len(rows), bool) for _ in range(3))
        key = paths[:, : REGION_LEVELS + 1]
        later[(key == key[0]).all(axis=1) | (key == key[-1]).all(axis=1)] = True
        for start, stop in regions(paths):
            if later[start]:
                continue
            own = owners[start:stop]
            names, counts = np.unique(own, return_counts=True)
            if len(names) < 2:
                continue
            if stop - start > TILE_ROWS:
                later[start:stop] = True
                continue
            minors = np.flatnonzero(own != names[counts.argmax()])
            met[start:stop], minor[start:stop] = meet(sketches[start:stop], own, minors)
        row = ["id", "place", "sketch", "component"]
        none = dict.fromkeys(["id", "minor", "place", "region", "sketch", "component", "label", "a", "b"])
        yield pd.DataFrame({"id": ids[met], "minor": minor[met]}).assign(**{c: None for c in none if c not in ("id", "minor")})
        left = rows[later]
        region = [label[: 2 * REGION_LEVELS] for label in left["label"]]
        yield left[row].assign(minor=None, region=region, label=None, a=None, b=None)
        ends = pd.concat([rows.iloc[:LOOK_BACK], rows.iloc[max(LOOK_BACK, len(rows) - LOOK_BACK) :]])
        yield ends[[*row, "label"]].assign(minor=None, region=None, a=None, b=None)
        yield apart(paths, sketches, ids, owners).assign(**{c: None for c in none if c not in ("a", "b")})

    schema = "id long, minor boolean, place int, region binary, sketch binary, component long, label binary, a long, b long"
    return stored(ordered.mapInPandas(look, schema), "regions")


def across(looked: DataFrame) -> DataFrame:
    """id, minor: documents of a region whose sketch agrees with one of another component.

    minor: of every pair of such documents at least one is outside the largest component of its region, and
    minor. So many rows as documents come out, not as pairs. A task compares the regions that lie within it; those
    that reach its first or last row, or have more than TILE_ROWS rows, are put together by their key.
    """
    later = looked.filter("region is not null").select("id", "place", "region", "sketch", "component")
    within = looked.filter("minor is not null").select("id", "minor")
    return within.unionByName(_across_tiles(later)).groupBy("id").agg(F.max("minor").alias("minor"))


def undecided(looked: DataFrame) -> DataFrame:
    """a, b: neighbours of different components and regions, within tasks and across their ends. At most TAKEN for each row."""

    def meet_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [batch for batch in batches if len(batch)]
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            yield apart(*_arrays(rows), rows["component"].to_numpy(np.int64))

    ends = looked.filter("label is not null").select("place", "label", "id", "sketch", "component")
    met = ends.repartition(partitions(looked.sparkSession), "place").sortWithinPartitions("place", "label", "id")
    return looked.filter("a is not null").select("a", "b").unionByName(met.mapInPandas(meet_ends, "a long, b long")).distinct()


def _across_tiles(rows: DataFrame) -> DataFrame:
    """id, minor as of across, from the rows (id, place, region, sketch, component) of whole regions.

    The rows outside the largest component, in tiles, meet all rows, in tiles: every tile of one meets every tile of
    the other in a group of its own.
    """
    key = ["place", "region"]
    counted = rows.groupBy(*key, "component").agg(F.count("*").alias("n"))
    known = counted.groupBy(*key).agg(
        F.sum("n").alias("n"), F.count("*").alias("owners"), F.max(F.struct("n", "component")).alias("top")
    )
    tiles = lambda n: F.ceil(n / F.lit(TILE_ROWS)).cast("int")
    known = known.filter("owners > 1").select(
        *key, F.col("top.component").alias("major"), tiles(F.col("n")).alias("tiles"),
        tiles(F.col("n") - F.col("top.n")).alias("minor_tiles"),
    )
    dealt = rows.join(known, key).withColumn("dealt", F.xxhash64("id", "sketch"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_row = dealt.select(
        *key, "id", "sketch", "component", F.lit(False).alias("seeks"),
        F.pmod("dealt", "tiles").cast("int").alias("tile"), F.explode(upto("minor_tiles")).alias("minor_tile"),
    )
    as_minor = dealt.filter("component <> major").select(
        *key, "id", "sketch", "component", F.lit(True).alias("seeks"),
        F.explode(upto("tiles")).alias("tile"), F.pmod("dealt", "minor_tiles").cast("int").alias("minor_tile"),
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        met, minor = meet(_sketches(group), group["component"].to_numpy(np.int64), np.flatnonzero(group["seeks"].to_numpy(bool)))
        return pd.DataFrame({"id": group["id"].to_numpy(np.int64)[met], "minor": minor[met]})

    return as_row.unionByName(as_minor).groupBy(*key, "tile", "minor_tile").applyInPandas(compare, "id long, minor boolean")


def prefix_pairs(contested: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """a, b: pairs of contested documents (id, component, minor, sketch) of different components, one of them minor,
    whose sketches agree and that may be similar.

    Sets that share enough also share one of the rarest shingles of both: of a set of k, those that are left
    when ceil(percent * k / 100) - 1 of the most frequent go. Both are in the same order, so where the first shingle that
    two similar sets share stands in them, enough others follow in either. So no similar pair is lost, and copies of one
    text that differ too much hardly meet, as their rarest shingles are their own.
    """

    words = [f"s{i}" for i in range(SKETCH // 8)]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sketches = pd.DataFrame(_sketches(batch).view(np.int64), columns=words, index=batch.index)
                yield pd.concat([batch[["id", "component", "minor"]], sketches], axis=1)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                rows = batch.iloc[start : start + 500]
                sets = [shingle_set(t, n) for t in rows["text"]]
                sizes = np.array([len(s) for s in sets])
                out = rows[["id"]].loc[rows.index.repeat(sizes)]
                yield out.assign(size=np.repeat(sizes, sizes), shingle=np.concatenate(sets).view(np.int64))

    split_words = ", ".join(f"{w} long" for w in words)
    contested = contested.select("id", "component", "minor", "sketch")
    contested = stored(contested.mapInPandas(split, f"id long, component long, minor boolean, {split_words}"), "contested")
    cut_rows = contested.select("id").join(texts, "id").mapInPandas(cut, "id long, size int, shingle long")
    cut_rows = stored(cut_rows, "shingles")
    shared = cut_rows.groupBy("shingle").agg(F.count("*").alias("documents"))
    known = cut_rows.join(shared, "shingle")
    left = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1
    rare = Window.partitionBy("id").orderBy("documents", "shingle")
    prefix = known.withColumn("place", F.row_number().over(rare)).filter(F.col("place") <= left)
    prefix = prefix.filter("documents > 1").drop("documents")
    prefix = stored(prefix.join(contested, "id"), "prefixes")  # sketches come in here: the rows before are many
    minor = prefix.filter("minor").select(
        "shingle", *[F.col(c).alias(f"m_{c}") for c in ("id", "component", "size", "place", *words)]
    )
    unlike = [unlike_column(w, f"m_{w}") for w in words]
    following = 1 + F.least(F.col("size") - F.col("place"), F.col("m_size") - F.col("m_place"))
    alike = (
        (F.col("component") != F.col("m_component"))
        & (100 * F.least("size", "m_size") >= percent * F.greatest("size", "m_size"))
        & ((100 + percent) * following >= percent * (F.col("size") + F.col("m_size")))
        & (sum(unlike[1:], unlike[0]) <= SIGNATURE - AGREE)
    )
    met = prefix.join(minor, "shingle").filter(alike)
    return met.select(F.greatest("id", "m_id").alias("a"), F.least("id", "m_id").alias("b")).distinct()


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. texts: id, text."""
    first = pairs.select("a", "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = first.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            last, found_b, keep = None, None, []
            for b, text_a, text_b in zip(batch["b"], batch["text_a"], batch["text_b"], strict=True):
                if b != last:
                    last, found_b = b, shingle_set(text_b, n)
                keep.append(similar(shingle_set(text_a, n), found_b, percent))
            yield batch.loc[keep, ["a", "b"]]

    return both.mapInPandas(confirm, "a long, b long")


def near_dedup(docs: DataFrame, n: int = 5, percent: int = SIMILAR) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs (doc_id, text).

    Documents are linked whose sets of n-word shingles share `percent` of their union or more; component_id is the
    smallest doc_id reachable, and the document with that id is kept. Documents without words are linked with
    nothing. A null doc_id takes the component of equal sets, or none, and is kept only if it has none. Rows
    with the same doc_id count as one document with all their texts. Extra columns are left out; empty tables give
    no rows.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    signed = stored(signatures(rows, n), "signatures")
    worded = signed.filter("set_key is not null and doc_id is not null")
    smallest = worded.groupBy("set_key").agg(F.min("doc_id").alias("id"))
    sets = worded.join(smallest.select("set_key", F.col("id").alias("doc_id")), ["doc_id", "set_key"], "left_semi")
    sets = sets.select(F.col("doc_id").alias("id"), "levels", "sketch").distinct()

    candidates = stored(neighbours(in_orders(sets)), "candidates")
    members = stored(candidates.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "members")
    texts = rows.join(members.withColumnRenamed("id", "doc_id"), "doc_id").select(F.col("doc_id").alias("id"), "text")
    texts = stored(texts, "texts")

    best = Window.partitionBy("a").orderBy(F.desc("agree"), "b")
    first = candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= BEST)
    owners = components(confirmed(first, texts, n, percent))

    labelled = sets.join(members, "id").join(owners.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    labelled = stored(labelled, "labelled")
    looked = looked_across(in_orders(labelled, "component"))
    known = labelled.groupBy("id").agg(F.first("component").alias("component"), F.first("sketch").alias("sketch"))
    contested = across(looked).join(known, "id")
    pairs = undecided(looked).unionByName(prefix_pairs(contested, texts, n, percent)).distinct()
    pairs = pairs.join(first.select("a", "b"), ["a", "b"], "left_anti")  # those were looked at, and are not similar
    more = confirmed(pairs, texts, n, percent)
    of = owners.select(F.col("node"), F.col("component"))
    joined = (
        more.join(of.select(F.col("node").alias("a"), F.col("component").alias("of_a")), "a", "left")
        .join(of.select(F.col("node").alias("b"), F.col("component").alias("of_b")), "b", "left")
        .select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    )
    merged = components(joined)
    nodes = owners.select("node", "component").unionByName(
        merged.select("node", F.col("node").alias("component")).join(owners.select("node"), "node", "left_anti")
    )
    final = (
        nodes.join(merged.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
        .select(F.col("node").alias("id"), F.coalesce("top", "component").alias("component_id"))
    )
    keys = smallest.join(final, "id", "left").select("set_key", F.coalesce("component_id", "id").alias("component_id"))
    grouped = signed.join(keys, "set_key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return grouped.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
