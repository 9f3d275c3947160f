"""Near-duplicates by MinHash signatures and a multi-index Hamming join.

A text is the set of its different shingles.  Equal sets are one class, and only classes are compared.  A signature has
``chunks`` x ``width`` b-bit MinHash values.  Two signatures that differ in fewer than ``chunks`` x (``errors`` + 1) values
have, by pigeonhole, a chunk with at most ``errors`` differing values.  Every chunk is therefore indexed once for each
choice of ``errors`` values to leave out, which enumerates the allowed errors on both sides, and such pairs meet in a
bucket for certain.  With 13 chunks of 6 values and one error, classes at the similarity threshold miss each other with a
probability of about one in a million.

Buckets never emit all their pairs.  First each class meets its bucket's smallest class, links are confirmed on the full
sets, and components are formed; then only classes of different components that share a bucket are compared, so a large
group of copies costs as many comparisons as it has classes.  That comparison is of signatures, in tasks of at most
two blocks of ``BLOCK`` classes; only pairs within ``max_distance`` differing values become rows, and their sets are compared.
(At the similarity threshold 15.6 of 78 values differ on average; more than 34 do with a probability below one in a million.)
Texts that share a long passage pass that test by the square of their number and are no links.  Each class therefore has a
profile too: how many of its shingles fall into each of ``profile`` groups.  Two sets have at least as many shingles
not in common as their profiles differ, so profiles that differ by more than a link allows rule it out without any error.
A pair that shares several buckets becomes a row only in that of its first common index key.

A null or empty text has no shingles and is linked with nothing.  Repeated rows and texts are copies; rows with one id
but different texts are kept apart.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from tidemill.columns import c
from tidemill.llm.common import fresh, id_type, map_columns, slices
from tidemill.session import stage

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Ids that are sent to the executors as a set (about 60 bytes each there); beyond it they are joined.
BROADCAST_IDS = 1_000_000
#: Classes of a bucket that are compared with each other or with as many others in one go.
BLOCK = 2_048


@dataclass(frozen=True)
class Similar:
    """Texts are linked if 100 * intersection >= ``percent`` * union of their sets of ``words``-word shingles."""

    words: int = 5
    percent: int = 80
    chunks: int = 13
    width: int = 6
    errors: int = 1
    max_distance: int = 34
    profile: int = 256
    seed: int = 7

    def values(self) -> int:
        return self.chunks * self.width


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of each text's different shingles; a text with fewer words is one shingle."""
    split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]
    known: dict[bytes, int] = {}
    for w in set(itertools.chain.from_iterable(split)):
        known[w] = xxhash.xxh3_64_intdigest(w)
    out = []
    for own in split:
        codes = np.fromiter(map(known.__getitem__, own), np.uint64, len(own))
        size = min(words, len(codes))
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        n = len(codes) - size + 1
        total = np.full(n, size, np.uint64)
        for k in range(size):
            total = total * _MULTIPLIER + codes[k : k + n]
        out.append(np.unique(_mixed(total)))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The 16-bit MinHash values of a set that isn't empty."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 8192):
        np.minimum(least, (shingles[i : i + 8192, None] * factors).min(axis=0), out=least)
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def profile(shingles: np.ndarray, groups: int) -> np.ndarray:
    """How many shingles fall into each group; counts above 255 are 255, which only brings profiles closer."""
    counts = np.bincount((shingles % np.uint64(groups)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8)


def _factors(rule: Similar) -> np.ndarray:
    return np.random.default_rng(rule.seed).integers(0, 2**63, rule.values(), np.uint64) * np.uint64(2) + np.uint64(1)


def _set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def chunk_keys(signatures: np.ndarray, rule: Similar) -> np.ndarray:
    """A column of index keys for each chunk and each choice of values to leave out."""
    columns = []
    for chunk in range(rule.chunks):
        own = signatures[:, chunk * rule.width : (chunk + 1) * rule.width].astype(np.uint64)
        for k, left_out in enumerate(itertools.combinations(range(rule.width), rule.errors)):
            key = np.full(len(own), chunk * 1000 + k + 1, np.uint64)
            for i in range(rule.width):
                if i not in left_out:
                    key = _mixed(key * _MULTIPLIER + own[:, i])
            columns.append(key)
    return np.stack(columns, axis=1).view(np.int64)


def signed(df: DataFrame, id_col: str, text_col: str, rule: Similar) -> DataFrame:
    """Id, set size, set key, signature and profile of each row; without shingles the last three are null."""
    factors = _factors(rule)

    def work(ids, texts):
        sets = shingle_sets(texts, rule.words)
        keys = [_set_key(s) if len(s) else None for s in sets]
        signatures = [signature(s, factors).tobytes() if len(s) else None for s in sets]
        profiles = [profile(s, rule.profile).tobytes() if len(s) else None for s in sets]
        return [ids, [len(s) for s in sets], keys, signatures, profiles]

    schema = f"id {id_type(df, id_col)}, n_shingles long, set_key binary, signature binary, profile binary"
    return map_columns(df, [id_col, text_col], schema, work)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Similar = Similar(), broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """Id, ``n_shingles``, ``set_key`` and ``component_id`` of each row: the smallest id that links can reach."""
    rows = stage(signed(df, id_col, text_col, rule), "signed")
    classes = rows.where("set_key IS NOT NULL").groupBy("set_key")
    firsts = [F.first(n).alias(k) for n, k in (("n_shingles", "size"), ("signature", "signature"), ("profile", "profile"))]
    classes = classes.agg(F.min("id").alias("low"), *firsts)
    classes = stage(classes.select(F.monotonically_increasing_id().alias("node"), "*"), "classes")
    keyed = _keyed(classes, rule)
    buckets = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = stage(keyed.join(buckets, "key"), "buckets")
    sizes = classes.select("node", "size")
    stars = shared.where("node <> least").select(c("least").alias("a"), c("node").alias("b")).distinct()
    stars = stage(_possible(stars, sizes, rule), "stars")
    nodes = stage(shared.select("node").distinct(), "candidates")
    sets = stage(_sets(df, classes.join(nodes, "node", "left_semi"), id_col, text_col, rule, broadcast_ids), "sets")
    links = stage(_confirmed(stars, sets, rule), "links")
    labels = _connected(links)
    # What stars did not join may still be linked: classes of one bucket that are in different components.
    placed = shared.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.where("x < y").select("key", "n")
    placed = stage(placed.join(mixed, "key").join(sizes, "node"), "mixed")
    pairs = _within_distance(placed.join(classes.select("node", "signature", "profile"), "node"), rule)
    more = stage(_confirmed(pairs.join(stars, ["a", "b"], "left_anti"), sets, rule), "more-links")
    if not more.isEmpty():
        labels = _connected(links.unionByName(more))
    lows = classes.join(labels, "node").groupBy("label").agg(F.min("low").alias("component"))
    found = classes.join(labels.join(lows, "label"), "node", "left").select("set_key", F.coalesce("component", "low").alias("component"))
    out = rows.select("id", "n_shingles", "set_key").join(found, "set_key", "left")
    return out.select(c("id").alias(id_col), "n_shingles", "set_key", F.coalesce("component", "id").alias("component_id"))


def mark(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Similar = Similar()) -> DataFrame:
    """The component of each row, and whether the row's id is the one that stays."""
    found = components(df, id_col, text_col, rule)
    return found.select(c(id_col), "n_shingles", "component_id", c(id_col).eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Similar = Similar()) -> DataFrame:
    """One row of each component, with all its columns; rows without shingles stay."""
    found = stage(components(df, id_col, text_col, rule), "components")
    named = found.where("set_key IS NOT NULL")
    own_key, gone_id, gone_key, place = fresh(df, "set_key", "gone_id", "gone_key", "place")
    gone = named.where(~c(id_col).eqNullSafe(F.col("component_id"))).select(c(id_col).alias(gone_id), F.hex("set_key").alias(gone_key)).distinct()
    kept = named.where(c(id_col).eqNullSafe(F.col("component_id")))
    repeated = kept.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    key = F.hex(c(own_key))
    keyed = _with_set_key(df, text_col, own_key, rule)
    rest = keyed.join(gone, c(id_col).eqNullSafe(c(gone_id)) & (key == c(gone_key)), "left_anti")
    if not repeated.isEmpty():  # repeated rows of the document that stays
        ids, same = repeated.select(F.col("component_id").alias(gone_id)), c(id_col).eqNullSafe(c(gone_id)) & key.isNotNull()
        twice, once = rest.join(ids, same, "left_semi"), rest.join(ids, same, "left_anti")
        first = F.row_number().over(Window.partitionBy(c(id_col)).orderBy(c(own_key), c(text_col)))
        rest = once.unionByName(twice.withColumn(place, first).where(c(place) == 1).drop(place))
    return rest.select(*[c(n) for n in df.columns])


def _with_set_key(df: DataFrame, text_col: str, name: str, rule: Similar) -> DataFrame:
    at, schema = df.columns.index(text_col), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            sets = shingle_sets(batch.column(at).to_pylist(), rule.words)
            keys = pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*schema.fields]).add(name, BinaryType()))


def _keyed(classes: DataFrame, rule: Similar) -> DataFrame:
    def work(nodes, signatures):
        table = np.frombuffer(b"".join(signatures), np.uint16).reshape(len(nodes), -1)
        keys = chunk_keys(table, rule)
        return [keys.ravel(), np.repeat(np.array(nodes, np.int64), keys.shape[1])]

    return map_columns(classes, ["node", "signature"], "key long, node long", work)


def _close(a, b, rule: Similar):
    """Sets whose sizes rule a link out are never fetched."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * rule.percent


def _possible(pairs: DataFrame, sizes: DataFrame, rule: Similar) -> DataFrame:
    joined = pairs.join(sizes.select(c("node").alias("a"), c("size").alias("x")), "a").join(sizes.select(c("node").alias("b"), c("size").alias("y")), "b")
    return joined.where(_close(F.col("x"), F.col("y"), rule)).select("a", "b")


def _sets(df: DataFrame, classes: DataFrame, id_col: str, text_col: str, rule: Similar, broadcast_ids: int) -> DataFrame:
    """``node`` and its shingles, read again from the texts of the classes' smallest ids."""
    wanted = stage(classes.select("node", "set_key", "low"), "wanted")
    rows = df.select(c(id_col).alias("id"), c(text_col).alias("text"))
    known = None
    if wanted.count() <= broadcast_ids:
        known = df.sparkSession.sparkContext.broadcast(frozenset(r.low for r in wanted.select("low").collect()))
    else:
        rows = rows.join(wanted.select(c("low").alias("id")).distinct(), "id", "left_semi")

    def work(ids, texts):
        chosen = [t for i, t in zip(ids, texts, strict=True) if known is None or i in known.value]
        sets = [s for s in shingle_sets(chosen, rule.words) if len(s)]
        return [[_set_key(s) for s in sets], [s.view(np.int64) for s in sets]]

    read = map_columns(rows, ["id", "text"], "set_key binary, shingles array<long>", work)
    return read.join(wanted.select("node", "set_key"), "set_key").dropDuplicates(["node"]).select("node", "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, rule: Similar) -> DataFrame:
    """The pairs that are linked, by the sizes of the intersection and the union of their full sets."""
    joined = pairs.join(sets.select(c("node").alias("b"), c("shingles").alias("y")), "b")
    joined = joined.join(sets.select(c("node").alias("a"), c("shingles").alias("x")), "a")
    common = F.size(F.array_intersect("x", "y"))
    return joined.where(common * 100 >= (F.size("x") + F.size("y") - common) * rule.percent).select("a", "b")


def _within_distance(members: DataFrame, rule: Similar) -> DataFrame:
    """Pairs of classes of one bucket, in different components, whose sizes, signatures and profiles allow a link.

    A bucket of ``n`` classes is cut into blocks; each pair of blocks is a group of its own, so none is large.
    """
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int").alias("own")
    rows = members.select("key", "node", "label", "size", "signature", "profile", own, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    rows = rows.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "label", "size", "signature", "profile")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            rest = None
            if table.num_rows:
                group = np.stack([table.column(n).to_numpy() for n in ("key", "i", "j")], axis=1)
                last = int(np.flatnonzero((group != group[-1]).any(axis=1)).max(initial=-1)) + 1
                rest = pa.Table.to_batches(table.slice(last).combine_chunks())[0]
                yield _pairs_of_groups(table.slice(0, last), rule)
        if rest is not None:
            yield _pairs_of_groups(pa.Table.from_batches([rest]), rule)

    return rows.mapInArrow(run, "a long, b long")


def _first_in(key: int, signatures: np.ndarray, left: np.ndarray, right: np.ndarray, rule: Similar) -> np.ndarray:
    """Whether ``key`` is the first index key that the two rows of a pair have in common."""
    rows, places = np.unique(np.concatenate([left, right]), return_inverse=True)
    keys, x, y = chunk_keys(signatures[rows], rule), places[: len(left)], places[len(left) :]
    first = np.zeros(len(left), bool)
    for i in range(0, len(left), BLOCK):
        own = keys[x[i : i + BLOCK]]
        column = (own == keys[y[i : i + BLOCK]]).argmax(axis=1)
        first[i : i + BLOCK] = own[np.arange(len(own)), column] == key
    return first


def _pairs_of_groups(table: pa.Table, rule: Similar) -> pa.RecordBatch:
    """The pairs of the whole groups in a table."""
    key, i, j, own, node, label, size = (table.column(n).to_numpy() for n in ("key", "i", "j", "own", "node", "label", "size"))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if len(key):
        signatures = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint16).reshape(len(key), -1)
        profiles = np.frombuffer(b"".join(table.column("profile").to_pylist()), np.uint8).reshape(len(key), -1).astype(np.int16)
        group = np.stack([key, i, j], axis=1)
        edges = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
            rows = np.arange(start, end)
            left, right = rows[own[rows] == i[start]], rows[own[rows] == j[start]]
            pairs = [(np.full(len(y), x), y) for x in left.tolist() if len(y := _partners(x, right, i[start] == j[start], label, size, signatures, profiles, rule))]
            if pairs:
                x, y = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
                first = _first_in(key[start], signatures, x, y, rule)
                found.append((node[x[first]], node[y[first]]))
    ends = [np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], names=["a", "b"])


def _partners(x: int, right: np.ndarray, same_block: bool, label, size, signatures, profiles, rule: Similar) -> np.ndarray:
    """The rows of a block that may be linked with row ``x`` and are not in its component."""
    others = right[(label[right] != label[x]) & ((right > x) | (not same_block))]
    others = others[_close_sizes(size[others], size[x], rule)]
    others = others[(signatures[others] != signatures[x]).sum(axis=1) <= rule.max_distance]
    apart = np.abs(profiles[others] - profiles[x]).sum(axis=1, dtype=np.int64)
    return others[apart * (100 + rule.percent) <= (size[others] + size[x]) * (100 - rule.percent)]


def _close_sizes(sizes: np.ndarray, size: int, rule: Similar) -> np.ndarray:
    return np.minimum(sizes, size) * 100 >= np.maximum(sizes, size) * rule.percent


def _connected(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node of its component, for all nodes with links.

    Every round passes labels along links and then replaces each label by its own label, which doubles its reach.
    """
    both = stage(links.unionByName(links.select(c("b").alias("a"), c("a").alias("b"))), "both")
    labels = stage(both.groupBy(c("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(c("node").alias("b"), "label"), "b").groupBy(c("a").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", F.least("label", "near").alias("new"), c("label").alias("old"))
        jump = new.select(c("node").alias("new"), c("new").alias("jump"))
        moved = stage(new.join(jump, "new").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") < F.col("old")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels
