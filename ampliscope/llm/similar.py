"""SimHash near-duplicates by the similarity of shingle sets: the trie self-join on the words of a wide fingerprint.

A fingerprint of 64 bits does not tell pairs at a similarity of 0.8 from others: they are some ten bits apart. Here a text has
BITS bits, the sides of as many random planes on which its set of shingles lies, in TABLES words of 32 bits. Two sets at an
angle differ in each bit with the same chance, so their distance over all bits tells the similarity, and a pair at 0.8 comes
within BUDGET bits in one word with a chance of 0.116, in one of all words with 0.993 (at 0.82: 0.998, at 0.85: 0.9999).
Each word has its trie; links found there are checked on all bits, and exactly on the sets themselves where these leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, free_name, own_columns, prepare, row_hash, saved, text_bytes
from .simhash import runs_in, shingle_hashes, stars, trie_links, whole_runs

#: A pair is a near-duplicate if its sets of WORDS-word shingles have at least OVER / UNDER of their union in common.
WORDS, OVER, UNDER = 5, 4, 5
TABLES, BUDGET = 40, 2
BITS = 32 * TABLES
#: Sets at 0.8 differ in 194 of 1,280 bits, with a deviation of 13 at most: 5 deviations more are not similar, 5 fewer are.
FAR, SURE = 259, 129
#: The bits of two words more, sent along with a word: sets at 0.8 differ in 10 of 64, with a deviation of 3.
NEAR_64 = 23
#: Each word is dealt out by one of three blocks of bits; with two bits apart at most, one block agrees. (shift, width)
BLOCKS = ((21, 11), (10, 11), (0, 10))
CHUNK = 2048  # members of a family that meet in one task
DRAWN = 256  # members of a family that tell its middle
PLANES = 2048  # dimensions that shingles are hashed to before they meet the planes


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, WORDS))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are near-duplicates."""
    if OVER * max(len(a), len(b)) > UNDER * min(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return UNDER * shared >= OVER * (len(both) - shared)


def planes() -> np.ndarray:
    return np.random.default_rng(29).standard_normal((PLANES, BITS), dtype=np.float32)


def wide_fingerprints(sets: list[np.ndarray], normals: np.ndarray) -> np.ndarray:
    """A row of TABLES words for each set."""
    x = np.zeros((len(sets), PLANES), np.float32)
    for i, s in enumerate(sets):
        sign = (s >> np.uint64(63)).astype(np.float32) * 2 - 1
        x[i] = np.bincount((s & np.uint64(PLANES - 1)).astype(np.int64), sign, PLANES)
    return np.packbits(x @ normals > 0, axis=1).view(">u4").astype(np.uint32)


def _signed(values) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _classes(batches):
    """A row's class, the hash of its set, and the set's fingerprint."""
    normals = planes()
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            own = pa.array(_signed([xxhash.xxh64_intdigest(s.tobytes(), 0) for s in sets]))
            prints = pa.array([f.tobytes() for f in wide_fingerprints(sets, normals)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), own, prints], ["doc_id", "node", "print"])


def _words(batches):
    """(table and word in one, node) of each class."""
    for batch in batches:
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TABLES)
        word = (np.arange(TABLES, dtype=np.int64) << 32) + prints
        yield pa.RecordBatch.from_arrays([pa.array(word.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), TABLES))], ["word", "node"])


def _dealt(batches):
    """(cut, rest, more, node, root): a class once for each table and block; more: the bits of the next two words."""
    for batch in batches:
        node, root = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TABLES).astype(np.int64)
        for t in range(TABLES):
            word, more = prints[:, t], prints[:, (t + 1) % TABLES] << 32 | prints[:, (t + 2) % TABLES]
            for b, (shift, width) in enumerate(BLOCKS):
                cut = ((t * 3 + b) << 11) + (word >> shift & (1 << width) - 1)
                rest = (word >> shift + width) << shift | word & (1 << shift) - 1
                arrays = [pa.array(cut.astype(np.int32)), pa.array(rest.astype(np.int32)), *map(pa.array, (more, node, root))]
                yield pa.RecordBatch.from_arrays(arrays, ["cut", "rest", "more", "node", "root"])


def _spanning(root: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the pairs i-j that join what they can join, at the least total of apart (Boruvka's rounds); root: the components before."""
    order = np.argsort(apart, kind="stable")
    root, picked = root.copy(), []
    while len(order):
        order = order[root[i[order]] != root[j[order]]]
        best = np.full(len(root), len(order))
        for end in (i, j):
            np.minimum.at(best, root[end[order]], np.arange(len(order)))
        edges = order[np.unique(best[best < len(order)])]
        picked.append(edges)
        stars(root, i[edges], j[edges])
    return np.concatenate(picked) if picked else order


def _candidates(batches):
    """Pairs of classes of other groups whose words are within the budget, and whose further words do not speak against it.

    Of each table's pairs those stay that join all that the others would, the nearest first: a row for a group at most."""
    for rows in whole_runs(batches, 5, 1):
        keys, group = rows[:, 1].astype(np.uint64), rows[:, 4]
        root = np.unique(np.stack([rows[:, 0], group]), axis=1, return_inverse=True)[1].ravel()
        root = np.unique(root, return_index=True)[1][root]
        held = [np.zeros(0, np.int64)] * 3
        for i, j in trie_links(keys, *runs_in(rows, 1), 22, BUDGET, group):
            apart = np.bitwise_count((rows[i, 2] ^ rows[j, 2]).view(np.uint64)).astype(np.int64)
            ok = apart <= NEAR_64
            held = [np.concatenate([x, y[ok]]) for x, y in zip(held, (i, j, apart))]
            if len(held[0]) > len(rows) + (1 << 18):
                held = [x[_spanning(root, *held)] for x in held]
        i, j = (x[_spanning(root, *held)] for x in held[:2])
        a, b = rows[i, 3], rows[j, 3]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _measured(batches):
    """Bits apart of pairs (a, b) with both fingerprints."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, TABLES) for c in (2, 3))
        apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], ["a", "b", "apart"])


def _sets(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "s"])


def _checked(batches):
    for batch in batches:
        x, y = ([np.frombuffer(v, np.uint64) for v in batch.column(i).to_pylist()] for i in (2, 3))
        yield batch.select([0, 1]).filter(pa.array([similar(p, q) for p, q in zip(x, y)], pa.bool_()))


def _apart(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    sides = [classes.select(F.col("node").alias(n), F.col("print").alias(f"{n}_print")) for n in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "a_print", "b_print")
    return both.mapInArrow(_measured, "a long, b long, apart int").where(F.col("apart") <= FAR)


def _exact(pairs: DataFrame, raw: DataFrame, classes: DataFrame, owner: str, name: str) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").select("node", F.col("least").alias("doc_id"))
    texts = asked.join(raw, asked["doc_id"].eqNullSafe(raw["doc_id"])).select("node", "text").dropDuplicates(["node"])
    sets = saved(texts.mapInArrow(_sets, "node long, s binary"), owner, f"sets-{name}")
    sides = sets.select(F.col("node").alias("a"), F.col("s").alias("x")), sets.select(F.col("node").alias("b"), F.col("s").alias("y"))
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "x", "y")
    found = saved(both.mapInArrow(_checked, "a long, b long"), owner, f"exact-{name}")
    discard(raw.sparkSession, owner, f"sets-{name}")
    return found


def _judged(pairs: DataFrame, raw: DataFrame, classes: DataFrame, owner: str, name: str) -> DataFrame:
    """The similar ones of pairs (a, b): by their bits where these are clear; the others, where no clear ones join their ends, by their sets."""
    near = saved(_apart(pairs, classes), owner, f"near-{name}")
    clear, open_ = near.where(F.col("apart") <= SURE).select("a", "b"), near.where(F.col("apart") > SURE).select("a", "b")
    roots = components(clear, owner)
    for n in "ab":
        open_ = open_.join(roots.select(F.col("node").alias(n), F.col("root").alias(f"{n}_root")), n, "left")
    open_ = saved(open_.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b"), owner, f"open-{name}")
    return clear.union(_exact(open_, raw, classes, owner, name))


def _middle(frame):
    """The majority of each bit over a family's drawn fingerprints."""
    import pandas as pd

    prints = np.frombuffer(b"".join(frame["print"]), np.uint8).reshape(len(frame), -1)
    most = 2 * np.unpackbits(prints, axis=1).sum(0, dtype=np.int64) > len(frame)
    return pd.DataFrame([{"family": frame["family"].iloc[0], "middle": np.packbits(most).tobytes()}])


def _from_middle(batches):
    """(family, node, apart): bits between a class and its family's middle."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, TABLES) for c in (2, 3))
        apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(apart)], ["family", "node", "apart"])


def _stars(few: DataFrame, owner: str) -> DataFrame:
    """(a, b): each class of a family with the one in its middle, a pair a class.

    A family joins classes with a word in common. Near copies of one text are less like each other than like that text, which is
    the member nearest to the majority of their bits (of DRAWN members or so, by hash)."""
    words = few.mapInArrow(_words, "word long, node long").withColumn("h", F.xxhash64("node"))
    lead = words.groupBy("word").agg(F.count("*").alias("n"), F.min(F.struct("h", F.col("node").alias("a"))).alias("l")).where("n > 1").select("word", "l")
    led = words.join(lead, "word").where("l.a <> node").groupBy("node").agg(F.min("l")["a"].alias("a"))
    families = components(led.select("a", F.col("node").alias("b")), owner)
    members = saved(few.join(families.withColumnRenamed("root", "family"), "node").select("family", "node", "print"), owner, "members")
    sizes = members.groupBy("family").agg(F.count("*").alias("n")).where("n > 2")
    drawn = members.join(sizes, "family").where(F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("n") / DRAWN))) == 0)
    middles = drawn.select("family", "print").groupBy("family").applyInPandas(_middle, "family long, middle binary")
    far = members.join(middles, "family").select("family", "node", "print", "middle").mapInArrow(_from_middle, "family long, node long, apart int")
    centre = far.groupBy("family").agg(F.min(F.struct("apart", "node"))["node"].alias("centre"))
    pairs = members.join(centre, "family").where("node <> centre")
    return pairs.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))


def _within(frame):
    """Links (a, b) that join the similar classes of a family: by their bits where these are clear, the nearest of the others first
    by their sets. Pairs that are joined by then, or share a root, need no look."""
    import pandas as pd

    prints = np.frombuffer(b"".join(frame["print"]), np.uint64).reshape(len(frame), -1)
    sets = [np.frombuffer(s, np.uint64) for s in frame["s"]]
    size = np.array([len(s) for s in sets])
    root = np.unique(frame["root"].to_numpy(), return_index=True, return_inverse=True)
    root, found = root[1][root[2]], []
    for i in range(0, len(prints), 64):
        apart = np.bitwise_count(prints[i : i + 64, None] ^ prints[None]).sum(2, dtype=np.int64)
        x, y = np.nonzero((apart <= FAR) & (root[i : i + 64, None] < root))
        x, apart = x + i, apart[x, y]
        ok = OVER * np.maximum(size[x], size[y]) <= UNDER * np.minimum(size[x], size[y])
        found.append(np.stack([apart, x, y])[:, ok])
    apart, x, y = np.concatenate(found, axis=1)
    clear = np.flatnonzero(apart <= SURE)
    clear = clear[_spanning(root, x[clear], y[clear], apart[clear])]
    links = list(zip(x[clear].tolist(), y[clear].tolist()))
    stars(root, x[clear], y[clear])
    open_ = np.flatnonzero((apart > SURE) & (root[x] != root[y]))
    open_ = open_[np.argsort(apart[open_], kind="stable")]
    over = root.tolist()
    for p, q in zip(x[open_].tolist(), y[open_].tolist()):
        while over[p] != over[over[p]]:
            over[p] = over[over[p]]
        while over[q] != over[over[q]]:
            over[q] = over[over[q]]
        if over[p] != over[q] and similar(sets[p], sets[q]):
            links.append((p, q))
            over[over[p]] = over[q]
    node = frame["node"].to_numpy()
    return pd.DataFrame({"a": [node[p] for p, _ in links], "b": [node[q] for _, q in links]}, dtype="int64")


def _links(raw: DataFrame, classes: DataFrame, owner: str) -> DataFrame:
    """(a, b): links that join all similar classes found, transitively.

    First families of near copies are joined by their middles, at a pair a class; the tries then leave out pairs that are
    joined already. What the tries join, if all of it were similar, are the families for the last step: there each class
    meets all others of its family that it is not joined to, CHUNK by CHUNK, within one task and without a row a pair."""
    few = classes.select("node", "print")
    first = _judged(_stars(few, owner), raw, classes, owner, "stars")
    roots = components(first, owner)
    rooted = saved(few.join(roots, "node", "left").select("node", "print", F.coalesce("root", "node").alias("root")), owner, "rooted")
    dealt = rooted.mapInArrow(_dealt, "cut int, rest int, more long, node long, root long")
    found = dealt.repartition("cut").sortWithinPartitions("cut", "rest").mapInArrow(_candidates, "a long, b long").distinct()
    near = saved(_apart(found, few).select("a", "b"), owner, "near-tries")
    families = components(first.union(near), owner)
    members = rooted.join(families.withColumnRenamed("root", "family"), "node")
    open_ = members.groupBy("family").agg(F.count("*").alias("n"), (F.min("root") < F.max("root")).alias("open")).where("open").select("family", "n")
    members = saved(members.join(open_, "family"), owner, "open")
    texts = members.select("node").join(classes, "node").select("node", F.col("least").alias("doc_id"))
    texts = texts.join(raw, texts["doc_id"].eqNullSafe(raw["doc_id"])).select("node", "text").dropDuplicates(["node"])
    chunks = F.ceil(F.col("n") / CHUNK)
    own = F.pmod(F.xxhash64("node"), chunks)
    units = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.struct(F.least(own, c).alias("i"), F.greatest(own, c).alias("j")))
    dealt = members.join(texts.mapInArrow(_sets, "node long, s binary"), "node").select("family", F.explode(units).alias("u"), "root", "node", "print", "s")
    joined = dealt.groupBy("family", "u").applyInPandas(_within, "a long, b long")
    return first.union(saved(joined, owner, "within"))


def near_duplicates(docs: DataFrame, owner: str = "similar", key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and component_id (least doc_id reachable over links) of each row.

    Words and shingles are those of simhash.shingle_hashes; a text of fewer than WORDS words is one shingle. Null and empty texts
    are linked to each other only. Equal sets meet in one class before any join, so a group of copies costs one row. Repeated
    rows stay. Null ids are never a component's least unless it has no other. An empty table gives an empty result."""
    prepare(docs.sparkSession)
    raw = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()
    rows = saved(raw.mapInArrow(_classes, f"doc_id {kind}, node long, print binary"), owner, "rows")
    classes = saved(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("print").alias("print")), owner, "classes")
    roots = components(_links(raw, classes, owner), owner)
    rooted = classes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "node").join(rooted.select("node", "root"), "node").join(ids, "root").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, owner: str = "similar") -> DataFrame:
    """One row of each component, with all columns of docs: that of the least doc_id (null ids first); of rows that share it, the
    first by text hash, and of those the first by the hash of all columns. An empty table gives an empty result."""
    id_, text = F.col("doc_id").alias("i"), F.col("text")
    k = free_name(docs, "k")
    both = docs.withColumn(k, F.struct(id_, F.xxhash64(text).alias("h"), F.xxhash64(F.reverse(text)).alias("g")))
    keep = near_duplicates(both, owner, key=k).select(F.col("component_id").alias(k)).distinct()
    left = both.join(keep, k, "left_semi").select(k, row_hash(docs).alias("h"), F.struct(*own_columns(docs)).alias("row"))
    return left.groupBy(k).agg(F.min_by("row", "h").alias("row")).select("row.*")
