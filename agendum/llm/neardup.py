"""Near-duplicate detection by a chosen-path set similarity join.

Every document becomes the set of its distinct five-word shingles (64-bit hashes). Documents with equal sets form a
class, and only one signature a class goes on: 256 minwise values of 16 bits. A tree starts with all classes in one
node; a node picks one of the 256 positions by a hash of its own path, sometimes two (1 / 0.85 on average), and sends
each class to the child named by its value there. Pairs at the threshold thus meet in one child on average at every
level, less alike pairs die out. Nodes of up to `leaf` classes stop; larger ones branch on, to `last_depth`. Twelve
independent trees find a pair at the threshold with a probability of over 0.999, alike pairs sooner.

Nodes are compared in rounds, so that a crowd of near copies never becomes all its pairs. First each node is cut into
parts of `part` classes, to each of which the node's leader is added; all pairs of a part are compared, and a spanning
forest of those that may be linked, most alike first, is proposed. Confirmed links give components. Then only classes
outside their node's leading component are held against the rest of the node, in blocks of bounded size, skipping pairs
that are linked or tried already: once for a spanning forest of each task's pairs, and once for all that are left. The
parities of the sets' hashes (an exact bound on what two sets don't share) rule out most unlinked pairs before they
leave their block. Signatures and parities only propose pairs; every link is confirmed on the full shingle sets.

Defined results: null or blank texts have no shingles and link with nothing; bytes that aren't UTF-8 are read as
U+FFFD; fewer than five words are one shingle; rows that repeat a doc_id are one document, linked through any of their
texts, and share its component; rows without a doc_id take the component of an equal text, if one has an id, and link
nothing themselves; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agendum.llm.common import Workspace, sieved, text_of, utf8
from agendum.llm.components import components
from agendum.llm.wordhash import mix, shingles

#: Minwise values in a signature.
T = 256
#: Residues whose parities are compared.
BITS = 2048
_RNG = np.random.default_rng(85)
_TIMES = (_RNG.integers(0, 1 << 31, T, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PLUS = _RNG.integers(0, 1 << 32, T, dtype=np.uint32)[:, None]


@dataclass(frozen=True)
class Join:
    """Parameters of the join; `percent` is the similarity from which documents are linked."""

    percent: int = 85
    words: int = 5
    trees: int = 12
    first_depth: int = 4
    last_depth: int = 8
    #: Levels that large nodes branch at a time.
    step: int = 4
    leaf: int = 64
    part: int = 256
    block: int = 2048
    #: Whether a round after the first one proposes every pair that is left, as the last one must, or a spanning forest of each task's.
    rounds: tuple[bool, ...] = (False, True)
    #: Pairs whose signatures agree less are not confirmed: 4.5 standard deviations below 0.85.
    agree: float = 0.75


def signature(hashes: np.ndarray) -> bytes:
    """The T minwise values of a set of 64-bit hashes, 16 bits each."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
    least = np.full(T, 0xFFFFFFFF, np.uint32)
    for i in range(0, low.shape[1], 1024):
        np.minimum(least, (_TIMES * low[:, i : i + 1024] + _PLUS).min(1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).tobytes()


def parities(hashes: np.ndarray) -> bytes:
    """For each of BITS residues, whether an odd number of hashes has it. Where the parities of two sets differ, the sets
    do, so the number of differing ones is never above the size of the symmetric difference."""
    return np.packbits((np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def signatures(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sig, odd) of each row; hi and lo name its set and odd has its parities, all null
    without shingles. A task gives a set's signature once, with the first row that has an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[bytes] = set()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found = shingles(text, join.words)
                name = named(found)
                if name is None:
                    out.append((0, None, None, None, None))
                    continue
                first = doc is not None and name not in given
                if first:
                    given.add(name)
                out.append((len(found), *np.frombuffer(name, np.int64).tolist(), *((signature(found), parities(found)) if first else (None, None))))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_shingles", "hi", "lo", "sig", "odd"])

    return docs.select(F.col("doc_id").cast("long"), text_of("text")).mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, sig binary, odd binary")


def named(found: np.ndarray) -> bytes | None:
    """A name of 128 bits for a set of shingles; None for the empty one."""
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None


def _branch(rows: DataFrame, percent: int) -> DataFrame:
    """One level deeper: each row (path, key, sig) goes to its children."""
    spare = F.lit(100 / percent - 1)

    def child(salt: int):
        place = F.pmod(F.xxhash64("path", F.lit(salt)), F.lit(T)).cast("int")
        return F.xxhash64("path", place, F.col("sig").substr(place * 2 + 1, F.lit(2)))

    two = F.pmod(F.xxhash64("path", F.lit(-1)), F.lit(1 << 20)) < spare * (1 << 20)
    return rows.select(F.explode(F.when(two, F.array(child(1), child(2))).otherwise(F.array(child(1)))).alias("path"), "key", "sig")


def _few(classes: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The classes whose key may be one of n `keys`, so that the others aren't shuffled for a join with them."""
    rows, may = sieved(classes, "key", keys.select("key"), n)
    return rows.where(may).select(*classes.columns)


def _nodes(classes: DataFrame, join: Join, work: Workspace) -> DataFrame:
    """(path, key, n, leader): the final nodes of all trees that hold two classes or more."""
    rows = classes.select(F.explode(F.sequence(F.lit(1).cast("long"), F.lit(join.trees).cast("long"))).alias("path"), "key", "sig")
    for _ in range(join.first_depth):
        rows = _branch(rows, join.percent)
    done, depth = None, join.first_depth
    while True:
        keys = rows.select("path", "key").distinct() if depth > join.first_depth else rows.select("path", "key")
        order = F.struct(F.xxhash64("key", "path").alias("h"), F.col("key").alias("key"))
        sizes = keys.groupBy("path").agg(F.count("*").alias("n"), F.min(order).alias("least")).where("n > 1").select("path", "n", F.col("least.key").alias("leader"))
        found, figures = work.put(f"nodes{depth}", keys.join(sizes, "path").select("path", "key", "n", "leader"), large=F.count_if(F.col("n") > join.leaf))
        last = depth >= join.last_depth
        stop = found if last else found.where(F.col("n") <= join.leaf)
        done = stop if done is None else done.unionAll(stop)
        if last or not figures["large"]:
            return done
        large = found.where(F.col("n") > join.leaf).select("path", "key")
        rows = large.join(_few(classes.select("key", "sig"), large, figures["large"]), "key").select("path", "key", "sig")
        for _ in range(join.step):
            rows = _branch(rows, join.percent)
        depth += join.step


def _forest(x: np.ndarray, y: np.ndarray, alike: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Of the pairs between components x and y, the places of those of a spanning forest, most alike first (Boruvka's rule)."""
    order = np.lexsort((tie, -alike))
    names, ends = np.unique(np.concatenate((x[order], y[order])), return_inverse=True)
    x, y = ends[: len(order)], ends[len(order) :]
    root, taken = np.arange(len(names)), []
    while len(x):
        best = np.full(len(names), len(x))
        np.minimum.at(best, x, np.arange(len(x)))
        np.minimum.at(best, y, np.arange(len(y)))
        picked = np.unique(best[best < len(x)])
        taken.append(order[picked])
        for a, b in zip(x[picked].tolist(), y[picked].tolist(), strict=True):
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            root[max(a, b)] = min(a, b)
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        order, x, y = order[x != y], x[x != y], y[x != y]
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


class _Members:
    """Rows of nodes, whose pairs are compared by signature, size and parities."""

    def __init__(self, rows: pa.Table | pa.RecordBatch, join: Join):
        at = rows.schema.get_field_index
        column = lambda name: rows.column(at(name))
        self.key, self.own, self.size = (column(x).to_numpy() for x in ("key", "own", "size"))
        self.sig = np.frombuffer(b"".join(column("sig").to_pylist()), np.uint16).reshape(-1, T)
        self.odd = np.frombuffer(b"".join(column("odd").to_pylist()), np.uint64).reshape(len(self.key), -1)
        self.join = join

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs (i, j), those of different components that may be linked, and how far their signatures agree."""
        parts = []
        for at in range(0, len(i), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            a, b = self.size[x], self.size[y]
            fits = (self.own[x] != self.own[y]) & (100 * np.minimum(a, b) >= self.join.percent * np.maximum(a, b))
            x, y = x[fits], y[fits]
            share = (self.sig[x] == self.sig[y]).mean(1)
            fits = share >= self.join.agree
            x, y, share = x[fits], y[fits], share[fits]
            unlike = np.bitwise_count(self.odd[x] ^ self.odd[y]).sum(1, dtype=np.int64)
            fits = (100 + self.join.percent) * unlike <= (100 - self.join.percent) * (self.size[x] + self.size[y])
            parts.append((x[fits], y[fits], share[fits]))
        return tuple(map(np.concatenate, zip(*parts, strict=True))) if parts else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))

    def forest(self, i: np.ndarray, j: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these pairs those of a spanning forest of their components."""
        low, high = np.minimum(self.key[i], self.key[j]), np.maximum(self.key[i], self.key[j])
        kept = _forest(self.own[i], self.own[j], share, mix(low.astype(np.uint64) + mix(high.astype(np.uint64))))
        return i[kept], j[kept], share[kept]

    def proposed(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]], every_pair: bool) -> pa.RecordBatch:
        """PAIRS: of the pairs that may be linked all, or a spanning forest."""
        held, size = [], 0
        for i, j in pairs:
            held.append(self.alike(i, j))
            size += len(held[-1][0])
            if not every_pair and size > 1 << 18:
                held = [self.forest(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
        i, j, share = map(np.concatenate, zip(*held, strict=True)) if held else (np.empty(0, np.int64),) * 3
        if len(i) and not every_pair:
            i, j, share = self.forest(i, j, share)
        turned = self.key[i] > self.key[j]
        i, j = np.where(turned, j, i), np.where(turned, i, j)
        _, first = np.unique(np.stack((self.key[i], self.key[j])), axis=1, return_index=True)
        i, j = i[first], j[first]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.key[i], self.key[j], self.own[i], self.own[j])], ["a", "b", "x", "y"])


#: Pairs of classes, and the components that they are in.
PAIRS = "a long, b long, x long, y long"
_MEMBERS = ("key", "own", "size", "sig", "odd")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows in order of their first `keys` columns, with the places where groups begin and the end; none is cut."""
    held: pa.Table | None = None

    def starts(rows: pa.Table) -> np.ndarray:
        key = np.stack([rows.column(i).to_numpy() for i in range(keys)], 1)
        return np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]))

    for batch in batches:
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if held.num_rows and len(cuts := starts(held)) > 2:  # the last group may go on in the next batch
            yield held.slice(0, int(cuts[-2])), cuts[:-1]
            held = held.slice(int(cuts[-2]))
    if held is not None and held.num_rows:
        yield held, starts(held)


def _inside(cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs within the groups that begin at these places, many at a time."""
    sizes = np.diff(cuts)
    for size in np.unique(sizes[sizes > 1]):
        i, j = np.triu_indices(size, 1)
        begins = cuts[:-1][sizes == size]
        step = max(1, (1 << 16) // len(i))
        for at in range(0, len(begins), step):
            base = begins[at : at + step, None]
            yield (base + i).ravel(), (base + j).ravel()


def _parts(nodes: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """PAIRS that a spanning forest of each task's parts of nodes proposes; own is a class's id."""
    parts = F.ceil(F.col("n") / join.part).cast("int")
    mine = F.array(F.pmod(F.xxhash64("key"), parts).cast("int"))
    part = F.explode(F.when(F.col("key") == F.col("leader"), F.sequence(F.lit(0), parts - 1)).otherwise(mine))
    rows = nodes.select("path", part.alias("part"), "key").join(classes.withColumn("own", F.col("id")), "key").select("path", "part", *_MEMBERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, cuts in _groups(batches, 2):
            yield _Members(held, join).proposed(_inside(cuts), False)

    return rows.repartition("path", "part").sortWithinPartitions("path", "part").mapInArrow(run, PAIRS)


def _mixed(rows: DataFrame) -> DataFrame:
    """Of the nodes' rows (path, key, n, leader, own) those of nodes with several components, with `away`: whether a row
    is outside the leader's."""
    ends = rows.groupBy("path").agg(F.min("own").alias("least"), F.max("own").alias("most"), F.max(F.when(F.col("key") == F.col("leader"), F.col("own"))).alias("home"))
    return rows.join(ends.where("least <> most").select("path", "home"), "path").select("path", "key", "n", "leader", "own", (F.col("own") != F.col("home")).alias("away"))


def _rest(mixed: DataFrame, classes: DataFrame, join: Join, every_pair: bool) -> DataFrame:
    """PAIRS of different components that share a node, one end outside the node's leading component, that may be
    linked: all of them, or a spanning forest of each task's."""
    rows = mixed.join(classes.select("key", "size", "sig", "odd"), "key")
    blocks = F.ceil(F.col("n") / join.block).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    mine = F.pmod(F.xxhash64("key"), blocks).cast("int")
    inner = rows.select("path", F.explode(every).alias("u"), mine.alias("v"), F.lit(False).alias("asks"), *_MEMBERS)
    asks = rows.where("away").select("path", mine.alias("u"), F.explode(every).alias("v"), F.lit(True).alias("asks"), *_MEMBERS)

    def across(cuts: np.ndarray, asking: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at, end in zip(cuts[:-1], cuts[1:], strict=True):
            a, b = (at + np.flatnonzero(asking[at:end] == x) for x in (True, False))
            step = max(1, (1 << 16) // max(1, len(b)))
            for k in range(0, len(a) if len(b) else 0, step):
                part = a[k : k + step]
                yield np.repeat(part, len(b)), np.tile(b, len(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, cuts in _groups(batches, 3):
            yield _Members(held, join).proposed(across(cuts, held.column(3).to_numpy()), every_pair)

    return inner.unionAll(asks).repartition("path", "u", "v").sortWithinPartitions("path", "u", "v").mapInArrow(run, PAIRS)


def _sets(docs: DataFrame, needed: DataFrame, n: int, join: Join) -> DataFrame:
    """(key, words): the full shingle sets of the n classes (key, id, hi, lo). A document is read if its id may be that
    of a class, and its set is kept if it has the class's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x, join.words) for x in utf8(batch.column(0))]
            names = np.frombuffer(b"".join(named(x) or bytes(16) for x in found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([x.tobytes() for x in found], pa.binary())], ["hi", "lo", "words"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    rows, may = sieved(texts, "doc_id", needed.select(F.col("id").alias("doc_id")), n)
    words = rows.where(may).select("text").mapInArrow(run, "hi long, lo long, words binary")
    return words.join(needed.select("key", "hi", "lo"), ["hi", "lo"]).dropDuplicates(["hi", "lo"]).select("key", "words")


def _confirmed(pairs: DataFrame, sets: DataFrame, join: Join) -> DataFrame:
    """(a, b): the components that the PAIRS link whose full sets are alike enough."""
    own = {x: sets.select(F.col("key").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= join.percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(own["a"], "a").join(own["b"], "b").select("x", "y", "words_a", "words_b").mapInArrow(run, "a long, b long")


def _same_document(members: DataFrame) -> DataFrame:
    """(a, b): the classes, by id, of rows that repeat a doc_id with other texts."""
    own = members.where("doc_id is not null and id is not null").select("doc_id", "id")
    several = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("most")).where("a <> most").select("doc_id", "a")
    return own.join(several, "doc_id").where("id <> a").select("a", F.col("id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row a document, linked as the module says."""
    work = Workspace(docs.sparkSession)
    known, _ = work.put("known", signatures(docs, join))
    grouped = known.where("n_shingles > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("size"), F.first("sig", ignorenulls=True).alias("sig"), F.first("odd", ignorenulls=True).alias("odd"))
    classes, _ = work.put("classes", grouped.withColumn("key", F.monotonically_increasing_id()))
    members, _ = work.put("members", known.select("doc_id", "n_shingles", "hi", "lo").join(classes.select("hi", "lo", "id"), ["hi", "lo"], "left").select("doc_id", "n_shingles", "id"))
    work.drop("known")
    nodes = _nodes(classes, join, work)
    keys, figures = work.put("keys", nodes.select("key").distinct())
    classes, _ = work.put("needed", _few(classes, keys, figures["n"]).join(keys, "key"))  # only these share a node
    work.drop("classes", "keys")
    pairs, _ = work.put("pairs", _parts(nodes, classes, join).dropDuplicates(["a", "b"]))
    sets, _ = work.put("sets", _sets(docs, classes, figures["n"], join))
    links, _ = work.put("links", _confirmed(pairs, sets, join).unionAll(_same_document(members)))
    owners, _ = work.put("owners", components(links, work))
    tried = pairs.select("a", "b")
    labels = classes.select("key", "id").join(owners, "id", "left").select("key", F.coalesce("component", "id").alias("own"))
    mixed, figures = work.put("mixed", _mixed(nodes.join(labels, "key")))
    work.drop("links", "edges")
    for every_pair in join.rounds:
        if not figures["n"]:
            break
        rest, found = work.put(f"rest{every_pair}", _rest(mixed, classes, join, every_pair).dropDuplicates(["a", "b"]).join(tried, ["a", "b"], "left_anti").select("a", "b", "x", "y"))
        if not found["n"]:
            continue
        tried = tried.unionAll(rest.select("a", "b"))
        links, found = work.put("links", _confirmed(rest, sets, join))
        if not found["n"]:
            continue
        merged = components(links, work)
        further = owners.join(merged.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
        owners, _ = work.put("owners", further.unionAll(merged))
        moved = mixed.join(merged.select(F.col("id").alias("own"), F.col("component").alias("root")), "own", "left").withColumn("own", F.coalesce("root", "own"))
        mixed, figures = work.put("mixed", _mixed(moved.select("path", "key", "n", "leader", "own")))
        work.drop("links", "edges")
    component = F.coalesce("component", "id", "doc_id")
    result, _ = work.put("result", members.join(owners, "id", "left").select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")))
    work.drop(*(x for x in work.paths if x != "result"))
    return result


def deduplicated(docs: DataFrame, join: Join = Join()) -> DataFrame:
    """The documents that are kept: of each component the one with the smallest id. Rows without an id stay.

    Only documents whose id may be one of those that go are shuffled.
    """
    gone, figures = Workspace(docs.sparkSession).put("gone", near_duplicates(docs, join).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct())
    rows, may = sieved(docs.withColumn("__gone", F.col("doc_id").cast("long")), "__gone", gone, figures["n"])
    return rows.where(~may).select(*docs.columns).unionAll(rows.where(may).join(gone, "__gone", "left_anti").select(*docs.columns))
