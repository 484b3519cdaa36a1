"""Near duplicates by word n-grams: a grouped prefix join.

A text's set is its distinct word shingles, as 64-bit hashes. All sets are put in one
order: shingles that a sketch over the whole corpus finds frequent come last, the others
by hash. Two sets as similar as asked must share one of their first few members (their
prefix) and be of similar size.

1. Texts with the same size and prefix form a group; only groups are joined. Texts with
   the same set are one member.
2. A list holds the groups that have a shingle in their prefix. First each group of a
   list is compared with the list's first group, and each member of a group with the
   group's first member: a linear number of pairs. Pairs are filtered by size and by a
   parity bitmap (a proven upper bound of the overlap), and the rest verified on the whole
   sets. Verified links give components.
3. Then pairs are left out only if both sides are already in one component. Short lists
   give their pairs directly, filtered by the places of the first shingle they share; long lists are
   cut into blocks, and pairs of blocks are compared in separate tasks, which emit a forest of
   verified links. Long lists of one first group are merged where that makes fewer rows.

So no link is lost, and a group of copies of any size costs a linear number of rows.

A text of fewer words than a shingle has its whole sequence as one member; null and empty
texts, or texts without words, have none and are linked with nothing. The class of a
document is the least key in its component. Repeated rows give a row each. A null key is
never the name of a class unless all keys of the class are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import dropped, kept_in_worker, saved, slices, table
from quillgraph.llm.components import components

#: A shingle found in so many documents is put last in the order ...
FREQUENT = 48
#: ... if it is among the so many most frequent ones (the order stays valid for any choice).
FREQUENT_KEPT = 1 << 18
#: Lists of up to so many groups give their pairs directly; longer ones in blocks of this size.
SHORT_LIST = 64
BLOCK = 256
#: Columns of an incidence matrix that are multiplied at once.
COLUMNS = 4096
#: Leaves that are verified against one copy of their first member's set.
LEAVES = 256
LEAST_BITS, MOST_BITS = 256, 8192
FILTER_BITS = 23
WORDS_CACHED = 150_000
#: Groups whose prefix a task remembers; it may give a prefix again.
GROUPS_SEEN = 150_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _ODD[0]
    h = (h ^ (h >> np.uint64(29))) * _ODD[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; words are between ASCII white space, A-Z lower-cased."""
    words = text.lower().split()
    hashes = kept_in_worker("word hashes", _WordHash)
    if len(hashes) > WORDS_CACHED:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return h
    size = min(k, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        s = _mix(s + h[i : len(h) - size + 1 + i])
    return np.unique(s)


def _sets(batches: Iterator[pa.RecordBatch], text: str, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in slices(batches, text):
        yield batch, [shingle_set(x or b"", k) for x in pc.cast(batch.column(text), pa.binary()).to_pylist()]


def _set_key(s: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes())


def _signature(s: np.ndarray) -> bytes:
    """Parities of the members' places among at least twice as many bits as members, within limits.

    Folding a signature in half gives the one with half as many bits.
    """
    bits = min(max(1 << (2 * len(s) - 1).bit_length(), LEAST_BITS), MOST_BITS)
    parity = np.bincount((_mix(s ^ _ODD[2]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


class _Signatures:
    """Signatures of many sets, to be compared at the width of the narrower one."""

    def __init__(self, raw: list[bytes]) -> None:
        self.width = np.asarray([len(x) // 8 for x in raw])
        self.at = np.cumsum(self.width) - self.width
        self.words = np.frombuffer(b"".join(raw), "<u8")

    def _folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.uint64)
        for own in np.unique(self.width[rows]):
            of = np.flatnonzero(self.width[rows] == own)
            words = self.words[self.at[rows[of]][:, None] + np.arange(own)]
            out[of] = np.bitwise_xor.reduce(words.reshape(len(of), own // width, width), axis=1)
        return out

    def least_difference(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the number of members that only one of two sets has."""
        out = np.zeros(len(i), np.int64)
        width = np.minimum(self.width[i], self.width[j])
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            out[of] = np.bitwise_count(self._folded(i[of], w) ^ self._folded(j[of], w)).sum(axis=1)
        return out


def frequent_shingles(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """Hashes of frequent shingles, by lossy counting: one met once in a task's batch isn't reported."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def report() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["s", "n"])

        for _, sets in _sets(batches, text, k):
            held += sets
            size += sum(map(len, sets))
            if size > 1 << 21:
                yield report()
                held, size = [], 0
        if held:
            yield report()

    counted = docs.select(text).mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    top = counted.orderBy(F.desc("n"), "s").limit(FREQUENT_KEPT).select("s").toPandas()
    return np.sort(top["s"].to_numpy(np.int64).view(np.uint64))


def _membership(docs: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Per document: key, n, its set's key and signature, its prefix and the prefix's key, and text_hash if ``docs`` has it.

    A prefix is null if one before it in the task has the same size and key: it is the least row of a group in its task that has it.
    """
    others = [c for c in docs.columns if c == "text_hash"]
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, text, k))  # FREQUENT_KEPT at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        seen: set[tuple[int, bytes]] = set()
        for batch, sets in _sets(batches, text, k):
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            at = np.searchsorted(late, flat)
            is_late = late[np.minimum(at, len(late) - 1)] == flat if len(late) else np.zeros(len(flat), bool)
            ends = np.cumsum([len(s) for s in sets])
            prefixes = []
            for s, end in zip(sets, ends, strict=True):
                n, mark = len(s), is_late[end - len(s) : end]
                need = n - -(-percent * n // 100) + 1 if n else 0
                first = s[~mark][:need]
                prefixes.append(np.concatenate([first, s[mark][: need - len(first)]]))
            keys = [_set_key(p) if len(p) else None for p in prefixes]
            if len(seen) > GROUPS_SEEN:
                seen.clear()
            fresh = []
            for s, group in zip(sets, keys, strict=True):
                fresh.append(group is not None and (len(s), group) not in seen)
                seen.add((len(s), group))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([_signature(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array(keys, pa.binary()),
                    pa.array([p.view(np.int64) if new else None for p, new in zip(prefixes, fresh, strict=True)], pa.list_(pa.int64())),
                    *(batch.column(c) for c in others),
                ],
                [key, "n", "set", "sig", "prefix_key", "prefix", *others],
            )

    kind = docs.schema[key].dataType.simpleString()
    made = docs.mapInArrow(run, f"{key} {kind}, n int, set binary, sig binary, prefix_key binary, prefix array<long>" + ", text_hash long" * len(others))
    return made.withColumn("row", F.monotonically_increasing_id())


def _bound(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and the least possible symmetric difference leave the similarity possible."""
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return (100 * small >= percent * large) & ((100 + percent) * differ <= (100 - percent) * (na + nb))


def _filtered(pairs: DataFrame, signatures: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of sets that pass the filters on size and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if m:
                both = _Signatures(batch.column("su").to_pylist() + batch.column("sv").to_pylist())
                differ = both.least_difference(np.arange(m), np.arange(m, 2 * m))
                good = _bound(*(batch.column(c).to_numpy().astype(np.int64) for c in ("nu", "nv")), differ, percent)
                yield batch.select(["u", "v"]).filter(pa.array(good))

    joined = pairs.where("u <> v").join(signatures.toDF("u", "nu", "su"), "u")
    joined = joined.join(signatures.toDF("v", "nv", "sv"), "v").where(f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)")
    return joined.select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long")


def _whole_sets(wanted: DataFrame, docs: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(set, data): whole sets of at least the wanted rows (id, set, doc), read from the texts again."""
    bit = F.pmod(F.xxhash64("doc"), F.lit(1 << FILTER_BITS))
    # A Bloom filter of fixed size picks the texts to read; a text more does no harm.
    bitmap = wanted.groupBy(F.shiftright(bit, 15).alias("at")).agg(F.bitmap_construct_agg(F.pmod(bit, F.lit(1 << 15))).alias("bits"))
    chosen = np.zeros((1 << FILTER_BITS - 15, 1 << 12), np.uint8)
    for at, bits in bitmap.collect():
        chosen[at] = np.frombuffer(bits, np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(chosen.ravel())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value

        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.column("bit").to_numpy().astype(np.int64)
                part = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))
                if part.num_rows:
                    yield part

        for _, found in _sets(kept(), text, k):
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["set", "data"])

    return docs.select(F.pmod(F.xxhash64(key), F.lit(1 << FILTER_BITS)).alias("bit"), text).mapInArrow(read, "set binary, data binary")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, key: str, text: str, k: int, percent: int) -> DataFrame:
    """Links among ``pairs`` (u: the leaf, v: the first member), checked on whole sets.

    ``sets``: id, set, doc. The rows of a first member with many leaves are salted.
    """
    pairs = saved(pairs.distinct(), "pairs")
    wanted = saved(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct().join(sets.select("id", "set", "doc"), "id"), "wanted")
    whole = _whole_sets(wanted, docs, key, text, k)
    stars = saved(pairs.groupBy("v").agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("salts")), "hubs")
    leaves = pairs.join(stars, "v").select(F.col("u").alias("id"), "v", F.pmod(F.xxhash64("u"), "salts").cast("int").alias("salt"), F.lit(1).alias("leaf"))
    hubs = stars.select(F.col("v").alias("id"), "v", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("leaf"))
    rows = leaves.union(hubs).join(wanted.select("id", "set"), "id").join(whole, "set").drop("set")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, first = None, None
        for batch in batches:
            links = []
            for name, v, leaf, data in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "leaf", "data")), strict=True):
                if not leaf:
                    hub, first = v, np.frombuffer(data, np.uint64)
                elif v == hub:
                    other = np.frombuffer(data, np.uint64)
                    both = len(np.intersect1d(first, other, assume_unique=True))
                    if 100 * both >= percent * (len(first) + len(other) - both):
                        links.append((name, v))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["u", "v"])

    # The rows of (v, salt) lie together, the first member's set before its leaves.
    together = rows.repartition("v", "salt").sortWithinPartitions("v", "salt", "leaf")
    links = saved(together.mapInArrow(check, "u long, v long").distinct(), "verified")
    dropped(pairs, wanted, stars)
    return links


def _block_links(names: np.ndarray, part: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between rows ``left`` and ``right`` that join components: a forest of them is enough.

    Overlaps come from products of incidence matrices over the members that several sets have.
    """
    n = np.asarray([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    row = np.repeat(np.arange(len(sets)), n)
    both = np.zeros((len(left), len(right)), np.float32)
    at = column[inverse]
    for a in range(0, len(shared), COLUMNS):
        here = (at >= a) & (at < a + COLUMNS)
        part_of = np.zeros((len(sets), min(COLUMNS, len(shared) - a)), np.float32)
        part_of[row[here], at[here] - a] = 1
        both += part_of[left] @ part_of[right].T
    linked = 100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)
    label = np.unique(part, return_inverse=True)[1]
    out = []
    for i, links in zip(left, linked, strict=True):
        for j in right[links & (label[right] != label[i])]:
            if label[j] != label[i]:
                out.append((int(names[i]), int(names[j])))
                label[label == label[j]] = label[i]
    return out


def _merged(long: DataFrame) -> DataFrame:
    """Long lists (list, first, count, id, part), those with the same first group as one if that makes fewer rows for blocks.

    A family of copies has many lists with nearly the same members; merged, each pair is compared once.
    """
    cost = f"{{0}} * ceil({{0}} / {BLOCK})".format
    lists = long.select("first", "list", "count").distinct()
    union = long.select("first", "id").distinct().groupBy("first").agg(F.count("*").alias("together"))
    apart = lists.groupBy("first").agg(F.expr(f"sum({cost('count')})").alias("apart"))
    # what becomes of each list, so that members meet it by list and not by first group
    target = lists.join(apart.join(union, "first"), "first").withColumn("better", F.expr(f"{cost('together')} < apart"))
    named = F.when(F.col("better"), F.xxhash64(F.lit("merged"), "first")).otherwise(F.col("list"))
    target = target.select("list", named.alias("target"), F.when(F.col("better"), F.col("together")).otherwise(F.col("count")).alias("count"))
    rows = long.select("list", "id", "part").join(target, "list")
    return rows.select(F.col("target").alias("list"), "count", "id", "part").distinct()


def _long_list_links(members: DataFrame, percent: int) -> DataFrame:
    """Verified links within long lists, from pairs of blocks.

    ``members``: list, count, id, part (component), data (whole set).
    """
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    dealt = members.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("list", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "id", "part", "own", "data")

    def compare(block: pa.Table) -> pa.Table:
        ids, own, part = (block.column(c).to_numpy() for c in ("id", "own", "part"))
        a, b = int(block.column("a")[0].as_py()), int(block.column("b")[0].as_py())
        links: list = []
        if len(np.unique(part)) > 1:
            sets = [np.frombuffer(x, np.uint64) for x in block.column("data").to_pylist()]
            links = _block_links(ids, part, sets, np.flatnonzero(own == a), np.flatnonzero(own == b), percent)
        return pa.table({"u": pa.array([x for x, _ in links], pa.int64()), "v": pa.array([x for _, x in links], pa.int64())})

    return dealt.groupBy("list", "a", "b").applyInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, located: bool = False) -> DataFrame:
    """Per row: key, n_shingles and component_id, the least key reachable over links.

    Two documents link if 100 * intersection >= percent * union of their shingle sets. ``located`` adds
    text_hash and part, the class's number (null without words): keys may repeat or be null, parts don't.
    """
    docs = docs.select(key, text)
    member = saved(_membership(docs.withColumn("text_hash", F.xxhash64(text)) if located else docs, key, text, k, percent), "membership")
    more_columns = ["text_hash"] if located else []
    filled = member.where("n > 0")
    # The first row with a set stands for it, with the least key of all its rows; sets with the same size and prefix have a head.
    firsts = filled.groupBy("set").agg(F.min("row").alias("id"), F.min(key).alias("doc"))
    placed = saved(filled.select(key, "n", "set", "prefix_key", "row", *more_columns).join(firsts, "set"), "placed")
    sets = placed.where("id = row").select("id", "set", "doc", "n", "prefix_key")
    heads = sets.groupBy("n", "prefix_key").agg(F.min("id").alias("head"))
    sets = saved(sets.join(heads, ["n", "prefix_key"]).drop("prefix_key"), "sets")
    by_list = Window.partitionBy("list")
    # Heads, and the first row of a group in other tasks, which needs no shuffle of prefixes to tell. Such rows come after their
    # head, so the first of a list is a head; they give pairs to verify, if they are sets, and otherwise find nothing to join.
    lists = member.select(F.col("row").alias("head"), "prefix").select(F.posexplode("prefix").alias("pos", "list"), "head")
    lists = lists.select("*", F.count("*").over(by_list).alias("count"), F.min("head").over(by_list).alias("first")).where("count > 1")
    lists = saved(lists, "lists")
    bare = saved(member.where("n = 0").select(key, *more_columns), "bare")
    signatures = saved(filled.select(F.col("row").alias("id"), "n", "sig"), "signatures")
    dropped(member)

    def verify(pairs: DataFrame) -> DataFrame:
        return _verified(_filtered(pairs, signatures, percent), docs, sets, key, text, k, percent)

    # Each head with the first head it shares most lists with; each member with its head.
    shared = lists.where("head <> first").groupBy("head", "first").agg(F.count("*").alias("n"))
    stars = shared.groupBy("head").agg(F.max_by("first", F.struct("n", "first")).alias("first"))
    links = verify(stars.toDF("u", "v").union(sets.where("id <> head").select("id", "head")))
    part = components(links).toDF("id", "part")

    # What isn't settled: groups with members in several components, lists with groups in several.
    settled = saved(sets.join(part, "id", "left").select("id", "head", "n", F.coalesce("part", "id").alias("part")), "settled")
    spread = settled.groupBy("head").agg(F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    inside = spread.where("lo < hi").select(F.lit(True).alias("group"), F.col("head").alias("list"), "head", F.col("size").alias("count"), F.col("head").alias("first"), F.lit(0).alias("pos"))
    open_lists = lists.join(spread, "head").groupBy("list").agg(F.sum("size").alias("count"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    across = lists.select("list", "head", "first", "pos").join(open_lists.select("list", "count"), "list").select(F.lit(False).alias("group"), "list", "head", "count", "first", "pos")
    unsettled = inside.union(across).withColumn("list", F.xxhash64("group", "list")).join(settled, "head")
    unsettled = saved(unsettled.select("list", "count", "first", "pos", "id", "n", "part"), "unsettled")
    dropped(lists)
    short = unsettled.where(F.col("count") <= SHORT_LIST).drop("first")
    direct = short.alias("x").join(short.alias("y"), "list").where(f"x.id > y.id AND x.part <> y.part AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    # Members are in one order, so what two sets share begins at the first shingle shared, and fits in what is left of either.
    at = direct.groupBy(F.col("x.id").alias("u"), F.col("y.id").alias("v")).agg(F.min(F.struct("x.pos", F.col("y.pos").alias("other"), "x.n", F.col("y.n").alias("m"))).alias("at"))
    near = at.where(f"{100 + percent} * least(at.n - at.pos, at.m - at.other) >= {percent} * (at.n + at.m)")
    more = verify(near.select("u", "v"))
    long = _merged(unsettled.where(F.col("count") > SHORT_LIST).select("list", "first", "count", "id", "part"))
    long = saved(long.join(sets.select("id", "set", "doc"), "id"), "long-lists")
    dropped(unsettled, signatures)
    if not long.isEmpty():
        # lists go to the sets, which are shuffled by their key alone
        data = _whole_sets(long, docs, key, text, k).dropDuplicates(["set"])
        across = saved(_long_list_links(long.join(data.hint("merge"), "set").drop("set", "doc"), percent), "list-links")
        more = more.union(across)
    part = components(links.union(more)).toDF("id", "part")
    dropped(long, settled)

    named = sets.join(part, "id", "left").select("id", "doc", F.coalesce("part", "id").alias("part"))
    least = named.groupBy("part").agg(F.min("doc").alias("component"))
    named = named.join(least, "part").select("id", "component", "part")
    found = placed.join(named, "id").select(key, F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"), *more_columns, *["part"] * located)
    bare = bare.select(key, F.lit(0).cast("long").alias("n_shingles"), F.col(key).alias("component_id"), *more_columns, *[F.lit(None).cast("long").alias("part")] * located)
    return found.union(bare)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=85)


NGRAM_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), t AS MATERIALIZED (SELECT id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), s AS MATERIALIZED (
  SELECT DISTINCT id, run FROM (
    SELECT id, i, n, string_agg(word, ' ') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS run FROM t
  ) WHERE i + least(n, 4) - 1 <= n
), c AS MATERIALIZED (SELECT id, count(*) AS n FROM s GROUP BY id
), p AS MATERIALIZED (SELECT x.id AS a, y.id AS b, count(*) AS m FROM s x JOIN s y USING (run) WHERE x.id < y.id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b WHERE 100 * m >= 85 * (ca.n + cb.n - m)
), e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, other) AS (SELECT id, id FROM d UNION SELECT r.id, e.b FROM r JOIN e ON r.other = e.a
), m AS (SELECT r.id, min(d.doc_id) AS component_id FROM r JOIN d ON d.id = r.other GROUP BY r.id)
SELECT doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, component_id FROM d JOIN m USING (id) LEFT JOIN c USING (id)
"""
