"""SimHash near-deduplication with BK-trees.

near_groups links fingerprints alone; deduplicate takes them as candidates, of a wider radius, and holds the texts'
5-word shingles against each other.

A fingerprint comes from all 3-word shingles of the lower-cased text, repeats included. Two fingerprints link when
they differ in at most `radius` bits; component_id is the smallest doc_id reachable over links.

Search: of radius + 1 ranges of bits, two linked fingerprints agree in one at least. So each distinct fingerprint goes
to one shard per range, keyed by that range's bits, and a BK-tree per shard (children keyed by their Hamming distance
to the parent, only edges within the radius followed) finds every link of that shard. A shard above MAX_SHARD is split
again over its remaining bits, so that a tree has a fixed greatest size and no link is lost. Trees are built where their
shard lies rather than sent through the driver: fingerprints of all documents may not pass it.
A shard reports, for each linked fingerprint, the first one of its part: never pairs. The trees of the shards that a
batch holds are built and walked in step, as arrays.

Results: null or blank text has fingerprint zero and links like any other; texts of one or two words are one shingle;
rows sharing a doc_id share nothing else; rows with null doc_id link but lend no id (component_id is null if no
member has one); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, one_of_each, salted_join, stage

WORDS = 3
RADIUS = 2
SEED = 42
MAX_SHARD = 1024
#: Of deduplicate: bits that candidates may differ in, words of a shingle, least Jaccard similarity.
CANDIDATE_RADIUS = 8
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Nodes of a tile, about, that are held against as many.
BLOCK = 512
#: Pairs that share a copy of a text's shingles.
HUB = 512
_CHUNK = 1 << 16
#: Pairs of a query and a tree node that are looked at in one step, about.
_PAIRS = 1 << 21


def shingles(text: str | None, words: int) -> Iterator[bytes]:
    """The XXH64 of the text's shingles, big-endian, in chunks."""
    toks = (text or "").encode("utf-8", "replace").lower().split()
    if not toks:
        return
    joined = b" ".join(toks)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, len(toks)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(toks) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    h = xxhash.xxh64_digest
    for i in range(0, len(starts), _CHUNK):
        yield b"".join([h(joined[a:b], SEED) for a, b in zip(starts[i : i + _CHUNK].tolist(), ends[i : i + _CHUNK].tolist())])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned integer; shingles are hashed and counted in bounded chunks."""
    n, counts = 0, np.zeros(64, np.int64)
    for some in shingles(text, words):
        bits = np.unpackbits(np.frombuffer(some, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int32)
        n += len(bits)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def shingle_set(text: str | None, words: int = SIMILAR_WORDS) -> np.ndarray:
    """The distinct shingles' hashes in order; a text without words has one, which only such texts have."""
    found = [np.frombuffer(some, ">u8").astype(np.uint64) for some in shingles(text, words)]
    return np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(T.LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([_signed(fingerprint(t)) for t in s], dtype="int64")


class Forest:
    """A BK-tree for each shard, as arrays. Values stand shard by shard; the first of a shard is its root, and every other
    one hangs below the first value before it that has its distance to the same parent. So a child stands after its
    parent, and a tree is the same as if its values had been inserted one by one."""

    def __init__(self, values: np.ndarray, starts: np.ndarray):
        """values: shard by shard (equal ones hang below each other); starts: where each shard begins."""
        n = len(values)
        self.values = values
        self.root = np.repeat(starts, np.diff(np.append(starts, n)))
        at, todo = self.root.copy(), np.setdiff1d(np.arange(n), starts, assume_unique=True)
        keys, kids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(todo):
            key = at[todo] * 65 + self._distance(todo, at[todo])
            new, first, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(new)
            kids.append(todo[first])
            at[todo] = todo[first][group]
            todo = np.delete(todo, first)
        key, kid = np.concatenate(keys), np.concatenate(kids)
        order = np.argsort(key)
        self.key, self.kid = key[order], kid[order]  # children by parent and edge

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.values[a] ^ self.values[b]).astype(np.int64)

    def earlier(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(values, earlier values of the same shard within the radius, distances), in chunks that hold all neighbours of the
        values in them. Only edges within the radius of the distance to the parent are followed."""
        n = len(self.values)
        work = np.cumsum(np.arange(n) - self.root)
        cuts = np.unique(np.searchsorted(work, np.arange(0, work[-1] if n else 0, _PAIRS)))
        for lo, hi in zip(cuts, np.append(cuts[1:], n)):
            q = np.arange(lo, hi)
            k = self.root[q]
            q, k = q[k < q], k[k < q]
            found = []
            while len(q):
                d = self._distance(q, k)
                hit = d <= radius
                found.append((q[hit], k[hit], d[hit]))
                a = np.searchsorted(self.key, k * 65 + np.maximum(d - radius, 0), "left")
                b = np.searchsorted(self.key, k * 65 + np.minimum(d + radius, 64), "right")
                many = b - a
                q = np.repeat(q, many)
                k = self.kid[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(len(q))]
                q, k = q[k < q], k[k < q]  # below a later node all are later
            if found:
                yield tuple(map(np.concatenate, zip(*found)))


class _Parts:
    """Union-find over numbers from 0."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether i and j were apart; the smaller top stays."""
        a, b = self.top(i), self.top(j)
        self.up[max(a, b)] = min(a, b)
        return a != b


def shard_links(values: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(value, first value of its part) for the values of shards that link to another, itself excepted."""
    parts = _Parts(len(values))
    for many, earlier, _ in Forest(values, starts).earlier(radius):
        for i, j in zip(many.tolist(), earlier.tolist()):
            parts.join(i, j)
    return [(int(values[i]), int(values[t])) for i in range(len(values)) if (t := parts.top(i)) != i]


def _by_shard(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, where each shard begins) of whole shards (mask, val) with more than one row. Batches are sorted by shard; a
    shard may go on in the next batch."""
    rest = None

    def whole(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        mask, val = pdf["mask"].to_numpy(), pdf["val"].to_numpy()
        new = np.concatenate([[True], (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
        shard = np.cumsum(new) - 1
        some = np.bincount(shard)[shard] > 1
        if some.any():
            yield pdf[some].reset_index(drop=True), np.flatnonzero(new[some])

    for pdf in batches:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        last = ((pdf["mask"] == pdf["mask"].iloc[-1]) & (pdf["val"] == pdf["val"].iloc[-1])).to_numpy()
        rest = pdf[last]
        if not last.all():
            yield from whole(pdf[~last])
    if rest is not None:
        yield from whole(rest)


def _link_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches are sorted by shard (mask, val), then fp."""
    for pdf, starts in _by_shard(batches):
        got = np.array(shard_links(pdf["fp"].to_numpy().view(np.uint64), starts), np.uint64).reshape(-1, 2).view(np.int64)
        yield pd.DataFrame({"u": got[:, 0], "v": got[:, 1]})


def _ranges(mask: int, parts: int) -> list[int]:
    """The bits of mask, split into parts as equal as can be."""
    bits = [i for i in range(64) if mask >> i & 1]
    return [sum(1 << b for b in bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def shards(nodes: DataFrame, radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """Rows (fp, mask, val): in which shards each fingerprint takes part. Any two fingerprints within the radius share one;
    a shard holds max_shard fingerprints at most, or all that its few free bits allow."""
    full, done = (1 << 64) - 1, None
    level = [(0, full)]  # (bits fixed, bits free)
    pending = nodes.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        split = [(fixed, [fixed | r for r in _ranges(free, radius + 1)]) for fixed, free in level]
        to = F.create_map(*[F.lit(x) for fixed, new in split for x in (_signed(fixed), F.array(*[F.lit(_signed(m)) for m in new]))])
        pending = pending.select("fp", F.explode(to[F.col("mask")]).alias("mask"))
        pending = pending.select("fp", "mask", F.col("mask").bitwiseAND(F.col("fp")).alias("val"))
        level = [(m, full & ~m) for m in sorted({m for _, new in split for m in new})]
        if done is not None:  # different ways of splitting lead to the same shard
            pending = pending.distinct()
        small = max(f.bit_count() for _, f in level) <= max_shard.bit_length() - 1
        if small:
            return pending if done is None else done.unionByName(pending)
        heavy = stage(pending.groupBy("mask", "val").count().filter(F.col("count") > max_shard).drop("count"), "heavy")
        if heavy.isEmpty():
            return pending if done is None else done.unionByName(pending)
        light = salted_join(pending, heavy, ["mask", "val"], "left_anti", F.col("fp")).select("fp", "mask", "val")
        done = light if done is None else done.unionByName(light)
        pending = salted_join(pending, heavy, ["mask", "val"], "left_semi", F.col("fp")).select("fp", "mask")


def components(links: DataFrame) -> DataFrame:
    """Rows (u, v): v is the smallest number that u reaches, for every u but the smallest of its component. Large-star and
    small-star rounds alternate until nothing changes; each is written, and a hub's neighbours are dealt by salt."""
    mark = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    edges = stage(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct(), "links")
    seen = edges.agg(*mark).first()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = salted_join(both.filter("v > u"), least, ["u"], "inner", F.col("v")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = salted_join(large, least, ["u"], "inner", F.col("v"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").filter("u != v").distinct(), "small-star")
        now = edges.agg(*mark).first()
        if now == seen:
            return edges
        seen = now


def _linked(nodes: DataFrame, radius: int, max_shard: int) -> DataFrame:
    """Rows (fp, root) of the fingerprints that link to another: root is the smallest of the component."""
    n = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = shards(nodes, radius, max_shard).repartition(n, "mask", "val").sortWithinPartitions("mask", "val", "fp")
    star = components(dealt.mapInPandas(_link_shards, "u long, v long"))
    linked = star.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return linked.unionByName(star.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, max_shard: int = MAX_SHARD) -> DataFrame:
    """A row per row of docs: doc_id, fingerprint (16 hex digits), component_id."""
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp")), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    members = stage(_linked(nodes, radius, max_shard).join(nodes, "fp"), "members")
    roots = members.groupBy("root").agg(F.min("least").alias("component_id"))
    known = salted_join(members.select("fp", "root"), roots, ["root"], "inner", F.col("fp")).select("fp", "component_id")
    alone = nodes.filter("n > 1").join(members.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    found = salted_join(rows, known.unionByName(alone), ["fp"], "left", F.col("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def fine_shards(nodes: DataFrame, radius: int, max_shard: int = MAX_SHARD) -> DataFrame:
    """nodes: fp, and more columns. Adds mask and val: any two fingerprints within the radius share a shard.

    Of radius + depth ranges of bits, such two agree in `depth` at least. A shard of level k fixes k ranges a1 < ... < ak with
    ai <= radius + i: the pair's first k are among them. A shard above max_shard goes on to the next level, where each
    further range makes a shard; `depth` is taken from the number of nodes."""
    n = nodes.count()
    depth = next(d for d in range(1, 64 - radius) if d == 63 - radius or 64 * d / (radius + d) >= np.log2(max(n, 2)) - 8)
    bits = _ranges((1 << 64) - 1, radius + depth)
    level = [((i,), bits[i]) for i in range(radius + 1)]
    more = [c for c in nodes.columns if c != "fp"]
    out, pending = None, nodes.select("fp", *more, F.explode(F.array(*[F.lit(_signed(m)) for _, m in level])).alias("mask"))
    for k in range(1, depth + 1):
        pending = pending.withColumn("val", F.col("mask").bitwiseAND(F.col("fp")))
        if k == depth:
            break
        heavy = stage(pending.groupBy("mask", "val").count().filter(F.col("count") > max_shard).drop("count"), "heavy")
        if not (many := heavy.count()):
            break
        if many <= 500_000:  # 8 MB
            flagged = pending.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), ["mask", "val"], "left")
        else:
            flagged = salted_join(pending, heavy.withColumn("heavy", F.lit(True)), ["mask", "val"], "left", F.col("fp"))
        light = flagged.filter("heavy is null").select("fp", *more, "mask", "val")
        out = light if out is None else out.unionByName(light)
        nexts = [(mask, [((*at, i), mask | bits[i]) for i in range(at[-1] + 1, radius + k + 1)]) for at, mask in level]
        to = F.create_map(*[x for mask, new in nexts for x in (F.lit(_signed(mask)), F.array(*[F.lit(_signed(m)) for _, m in new]))])
        pending = flagged.filter("heavy").select("fp", *more, F.explode(to[F.col("mask")]).alias("mask"))
        level = [x for _, new in nexts for x in new]
    return pending if out is None else out.unionByName(pending)


def _dealt(shards: DataFrame) -> DataFrame:
    n = max(1, int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return shards.repartition(n, "mask", "val").sortWithinPartitions("mask", "val", "fp", "node")


def spanning_links(values: np.ndarray, starts: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Index pairs that connect the same values as all links do: a least spanning forest of each shard, the smallest distances
    first, so that a value's nearest neighbour is among its links."""
    found = [np.zeros((3, 0), np.int64), *[np.stack(x) for x in Forest(values, starts).earlier(radius)]]
    i, j, d = np.concatenate(found, axis=1)
    order, parts = np.lexsort((j, i, d)), _Parts(len(values))
    return [(x, y) for x, y in zip(i[order].tolist(), j[order].tolist()) if parts.join(x, y)]


def _spanning(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in _by_shard(batches):
            node = pdf["node"].to_numpy()
            got = np.array(spanning_links(pdf["fp"].to_numpy().view(np.uint64), starts, radius), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"u": node[got[:, 0]], "v": node[got[:, 1]]})

    return run


def _tile(radius: int, similarity: float):
    """Rows of a tile: queries and candidates of one wide part. Links of parts whose texts are similar, not more than there are
    parts. Pairs are looked at only while their parts are apart."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query", kind="stable")
        n = int((~pdf["query"]).sum())  # candidates, then queries
        part, names = pd.factorize(pdf["part"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf["shingles"]]
        parts, links = _Parts(len(names)), []
        for i, j, _ in Forest(pdf["fp"].to_numpy().view(np.uint64), np.zeros(1, np.int64)).earlier(radius):
            some = (i >= n) & (j < n) & (part[i] != part[j])
            for x, y in zip(i[some].tolist(), j[some].tolist()):
                if parts.top(part[x]) != parts.top(part[y]) and jaccard(sets[x], sets[y]) >= similarity:
                    parts.join(part[x], part[y])
                    links.append((names[part[x]], names[part[y]]))
        return pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    return run


@F.pandas_udf(T.BinaryType())
def _set_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([shingle_set(t).tobytes() for t in s], dtype=object)


@F.pandas_udf(T.DoubleType())
def _jaccard_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype="float64")


def _shingle_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes: node, digest. Rows (node, shingles)."""
    one = texts.join(nodes.hint("merge"), "digest").groupBy("node").agg(F.first("text").alias("text"))
    return stage(one.select("node", _set_udf("text").alias("shingles")), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (u, v) those whose sets are similar. The set of a node in many pairs is copied, a copy for HUB pairs."""
    degrees = pairs.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / HUB).cast("int").alias("copies"))
    many = stage(degrees.filter("copies > 1"), "hubs")
    copied = sets.join(many, "node", "left").select("node", "shingles", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    for end, other in (("u", "v"), ("v", "u")):
        copy = F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")
        pairs = salted_join(pairs, many.withColumnRenamed("node", end), [end], "left", F.col(other)).withColumn(f"copy_{end}", copy).drop("copies")
    for end, name in (("u", "a"), ("v", "b")):
        right = copied.select(F.col("node").alias(end), F.col("copy").alias(f"copy_{end}"), F.col("shingles").alias(name))
        pairs = pairs.join(right.hint("merge"), [end, f"copy_{end}"])
    return stage(pairs.filter(_jaccard_udf("a", "b") >= similarity).select("u", "v"), "similar")


def _members(links: DataFrame, name: str) -> DataFrame:
    """Rows (node, name) of the nodes in links: name is the smallest node of the part."""
    star = components(links)
    return star.select(F.col("u").alias("node"), F.col("v").alias(name)).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias(name)).distinct())


def similar_parts(
    texts: DataFrame, nodes: DataFrame, radius: int = CANDIDATE_RADIUS, similarity: float = SIMILARITY, max_shard: int = MAX_SHARD, block: int = BLOCK
) -> DataFrame:
    """Rows (node, part) of the nodes that are linked to another: two link if their fingerprints differ in `radius` bits at
    most and their shingle sets have the similarity. nodes: node, fp, digest; texts: digest, text.

    Fingerprints alone give wide parts, by a spanning forest of each shard. The forests' links are verified first and give
    parts. What a wide part holds beside its largest part is then held, in tiles of `block` by `block` nodes, against all
    of it, where fingerprints are near and parts still apart. So every link counts, but no group's pairs are listed, no
    task has a whole group, and a large group whose texts are linked is not gone through again."""
    # a tree holds the first of the texts of one fingerprint; the others are linked to that one
    heads = stage(nodes.groupBy("fp").agg(F.min("node").alias("node"), F.count("*").alias("n")), "heads")
    several = heads.filter("n > 1").select("fp", F.col("node").alias("v"))
    same = salted_join(nodes.select("fp", F.col("node").alias("u")), several, ["fp"], "inner", F.col("u")).filter("u != v").select("u", "v")
    found = _dealt(fine_shards(heads.select("fp", "node"), radius, max_shard)).mapInPandas(_spanning(radius), "u long, v long").unionByName(same)
    pairs = stage(found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    wide = stage(_members(pairs, "wide").join(nodes.select("node", "fp", "digest"), "node"), "wide-parts")
    sets = _shingle_sets(texts, wide.select("node", "digest"))
    links = _verified(pairs, sets, similarity)
    known = stage(wide.join(_members(links, "part"), "node", "left").select("wide", "node", "fp", F.coalesce("part", "node").alias("part")), "known")
    # of each wide part with more than one part: its size, and the largest part
    sizes = known.groupBy("wide", "part").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("wide").agg(F.count("*").alias("parts"), F.sum("n").alias("all"), F.max(F.struct("n", "part")).alias("top")).filter("parts > 1 and all > 2")
    open_ = stage(largest.select("wide", "all", (F.col("all") - F.col("top.n")).alias("rest"), F.col("top.part").alias("top")), "open")
    rows = salted_join(known, open_, ["wide"], "inner", F.col("node"))
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")
    own = lambda n: F.array(F.pmod(F.xxhash64("node"), blocks(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    asked = rows.filter("part != top").select("wide", "node", "fp", "part", F.lit(True).alias("query"), F.explode(own("rest")).alias("q"), every("all").alias("cs"))
    asked = asked.select("wide", "node", "fp", "part", "query", "q", F.explode("cs").alias("c"))
    held = rows.select("wide", "node", "fp", "part", F.lit(False).alias("query"), F.explode(every("rest")).alias("q"), own("all").alias("cs"))
    held = held.select("wide", "node", "fp", "part", "query", "q", F.explode("cs").alias("c"))
    tiles = asked.unionByName(held).join(sets.hint("merge"), "node").groupBy("wide", "q", "c")
    more = stage(tiles.applyInPandas(_tile(radius, similarity), "u long, v long"), "more-links")
    joined = known.filter("node != part").select(F.col("node").alias("u"), F.col("part").alias("v")).unionByName(more)
    return _members(joined, "part")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that stay, with their columns: of each group of similar texts (see similar_parts, which takes the
    settings) one row, that of the smallest id (null ids last), then text digest. Rows are found again by id and text
    digest; of rows equal in both, one stays."""
    rows = docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp"), _digest(F.col(text_col)).alias("digest"))
    rows = stage(rows, "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least")
    nodes = rows.groupBy("digest").agg(F.first("fp").alias("fp"), least, F.count("*").alias("n"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    parts = stage(similar_parts(docs.select(_digest(F.col(text_col)).alias("digest"), F.col(text_col).alias("text")), nodes, **settings), "parts")
    known = parts.join(nodes.select("node", "least", "digest"), "node")
    first = known.groupBy("part").agg(F.min(F.struct("least", "digest", "node")).alias("first")).select(F.col("first.node").alias("node"))
    gone = parts.join(first, "node", "left_anti").select("node", F.lit(True).alias("gone"))
    verdicts = nodes.join(gone, "node", "left").filter("gone or n > 1").select("digest", "least", F.coalesce("gone", F.lit(False)).alias("gone"))
    counts = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    keys = salted_join(counts, stage(verdicts, "verdicts"), ["digest"], "inner", F.col("doc_id"))
    goes = F.col("gone") | ~F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    gid, gdigest = free_name(docs, "_gid"), free_name(docs, "_gdigest")
    keys = stage(keys.select(F.col("doc_id").alias(gid), F.col("digest").alias(gdigest), goes.alias("goes"), "n"), "keys")
    out = stage(keys.filter("goes").select(gid, gdigest), "goes")
    digest = _digest(F.col(text_col))
    left = docs.join(out.hint("merge"), F.col(id_col).eqNullSafe(F.col(gid)) & (digest == F.col(gdigest)), "left_anti")
    return left if keys.filter("not goes and n > 1").isEmpty() else one_of_each(left, id_col, digest, text_col)
