"""N-gram Jaccard join with a token-group matrix.

Documents are sets of distinct word shingles, as 64-bit hashes; documents with equal sets form one
class. Components of the links between classes (similarity at or above the threshold) are exact:

1. Token order. Shingles whose hash is in the lowest COUNTED_SHARE of all hashes are counted over the
   corpus. Those in one document only come first, then by hash the others that are counted, then the
   most frequent ones by their count, and last, by hash, all that aren't counted. Any fixed order keeps
   the next step exact; this one keeps common passages out of it.
2. Prefixes. Of two linked sets each has one of its first n - ceil(t n) + 1 shingles among those of the
   other, and that one is in two documents. Classes whose prefix is made of shingles of their own, or
   that share none with another class, are done: they have no link.
3. Groups. The remaining classes are partitioned into groups of similar ones, by the least shingle under
   a seeded hash, split at random into groups of about GROUP shingles, which also share the LEADERS most
   central classes of the key. Links within a group are found in its task and joined to components. This is done ROUNDS times with other seeds, each time only for
   classes that share a prefix shingle with a class of another component: each round moves every set at
   most once, however large a group of near copies is.
4. Matrix. What is left are mostly unlike texts that share a passage. Rows of the matrix are (shingle,
   group), for the prefix shingles that classes of two or more components share; the overlap of a class
   with a group is summed over them. A class opens a group only if it overlaps a member of another
   component, of a size that allows a link; only then sets move. In the task, the union of the group's
   members must hold at least ceil(t n) of the class's n shingles before it is compared by member.
5. Components over all links found.

Texts are cut into shingles once; the counted part of each set is staged until step 2 is over. Only
documents of classes that go on are read again. The broadcast data have fixed bounds: 2**20 frequent
shingles with counts and 16 MB filters of repeated shingles and of document ids. Where these fill up,
more shingles count as repeated and more texts meet the join behind the filter: at most
n - ceil(t n) + 1 shingles a class and one shuffle of the texts, with the same results. Tables are
deleted as soon as nothing reads them.

Defined cases: null or empty text, or text without a word, has an empty set, links with nothing and is
its own component; fewer words than a shingle make one shingle; repeated rows fall into one class and
link; rows that share an id are one document for the component; a null id stands last among ids and
gets the least id of its component; an empty table gives an empty result; other columns are not read.
Sets are told apart by size and a 64-bit digest.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_marked, filter_room, id_filter, join_groups, passes, passing, small, staged, tidy, unstage
from .components import components
from .wordtable import CHUNK_BYTES, words_of_texts

#: Words per shingle and similarity in percent, unless the caller says otherwise.
WORDS, PERCENT = 5, 80
COUNTED_SHARE = 0.4
MAX_FREQUENT = 1 << 20
MIN_FREQUENT = 12
GROUP = 1 << 18
ROUNDS = 2
LEADERS = 8


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: a bijection whose bits all depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], k: int):
    """Sorted arrays of the texts' distinct shingle hashes."""
    words, at, ends = words_of_texts([t.lower() for t in texts])
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[at]
    total = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):  # the hash of the window that starts at each word
        total[: len(h) - j] = _mix(total[: len(h) - j] + h[j:])
    a = 0
    for z in ends.tolist():
        if z - a >= k:
            yield np.unique(total[a : z - k + 1])
        elif z > a:  # the whole sequence is one shingle
            one = np.zeros(1, np.uint64)
            for w in h[a:z]:
                one = _mix(one + w)
            yield one
        else:
            yield total[:0]
        a = z


def _rows(batches, k: int, text_column: int):
    """(batch, first row, sets) of bounded chunks of rows."""
    for b in batches:
        first, texts, size = 0, [], 0
        for t in b.column(text_column):
            texts.append(t.as_py() or b"")
            size += len(texts[-1]) + 1
            if size > CHUNK_BYTES:
                yield b, first, list(shingle_sets(texts, k))
                first, texts, size = first + len(texts), [], 0
        if texts:
            yield b, first, list(shingle_sets(texts, k))


def digest(s: np.ndarray) -> int:
    """64-bit digest of a set, mixed with its size."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([_mix(s).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def keys_of(s: np.ndarray) -> list[int]:
    """For each round the least shingle of a set under its seeded hash."""
    return [int(np.min(_mix(s ^ np.uint64(r))).view(np.int64)) if len(s) else 0 for r in range(1, ROUNDS + 1)]


def needed(n, percent: int):
    """Least overlap with any set that a set of size n can be linked to: ceil(t n)."""
    return -(-n * percent // 100)


def counted_limit() -> np.uint64:
    return np.uint64(int(COUNTED_SHARE * 2**64))


def nodes_of(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(rid, doc_id, text_hash, n, cls, keys, low) of (rid, doc_id, text_hash, binary text).

    low: the counted shingles, by hash, and no fewer than a prefix may need; null for a class that the
    task has met before.
    """
    limit = counted_limit()

    def run(batches):
        met: set[int] = set()  # bounded; copies in other tasks cost time only
        for b, first, sets in _rows(batches, words, 3):
            part = b.slice(first, len(sets))
            names, low, keys = [], [], []
            for s in sets:
                names.append(digest(s))
                new = names[-1] not in met
                if new and len(met) < 1_000_000:
                    met.add(names[-1])
                size = max(int(np.searchsorted(s, limit)), len(s) - needed(len(s), percent) + 1)
                low.append(s[:size].tobytes() if new else None)
                keys.append(keys_of(s))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                names=["rid", "doc_id", "text_hash", "n", "cls", "keys", "low"],
            )
        tidy()

    return docs.mapInArrow(run, "rid long, doc_id long, text_hash long, n long, cls long, keys array<long>, low binary")


def most_frequent(counts: DataFrame, room: int = MAX_FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, their counts) of the shingles that occur most, at most `room` and MIN_FREQUENT times
    at least. The cut is a power of two: a level that doesn't fit is left out whole."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["m"] for r in counts.filter(F.col("n") >= MIN_FREQUENT).groupBy(level.alias("level")).agg(F.count("*").alias("m")).collect()}
    cut = None
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            break
        cut = at
    if cut is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = counts.filter((F.col("n") >= MIN_FREQUENT) & (level >= cut)).select("h", "n").toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def repeated_shingles(nodes: DataFrame):
    """(hashes and counts of the most frequent counted shingles; filter of all repeated ones)."""
    limit = counted_limit()

    def run(batches):
        held, size = [], 0

        def flush():
            u, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

        for b in batches:
            for raw in b.column(0):
                s = np.frombuffer(raw.as_py(), np.uint64)
                held.append(s[: np.searchsorted(s, limit)])
                size += len(held[-1])
            if size > 1_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        held.clear()
        tidy()

    counts = nodes.filter("low IS NOT NULL").select("low").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > 1)
    counts = staged(counts, "repeated")
    frequent = most_frequent(counts)
    bits = id_filter(counts.select("h"), counts.count())
    unstage(counts)
    return frequent, bits


def shared_prefix(low: np.ndarray, n: int, percent: int, limit: np.uint64, frequent: tuple[np.ndarray, np.ndarray], bits: np.ndarray) -> np.ndarray:
    """The prefix without the shingles that no other document has."""
    k = int(np.searchsorted(low, limit))
    counted, rest = low[:k], low[k:]
    again = passes(bits, counted)
    size = n - needed(n, percent) + 1 - int((~again).sum())
    if size <= 0:
        return low[:0]
    counted = counted[again]
    hashes, times = frequent
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, counted), len(hashes) - 1)
        counted = counted[np.argsort(np.where(hashes[at] == counted, times[at], 0), kind="stable")]
    return np.concatenate([counted, rest])[:size]


def postings(nodes: DataFrame, percent: int, frequent: tuple[np.ndarray, np.ndarray], repeated) -> DataFrame:
    """(h, cls): the prefix shingles of the classes that may be in another class's prefix too."""
    limit = counted_limit()
    shared = nodes.sparkSession.sparkContext.broadcast(frequent)

    def emit(batches):
        for b in batches:
            hs, cs = [], []
            for n, c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                p = shared_prefix(np.frombuffer(raw.as_py(), np.uint64), n, percent, limit, shared.value, repeated.value)
                if len(p):
                    hs.append(p)
                    cs.append(np.full(len(p), c))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.concatenate(cs))], names=["h", "cls"])

    return nodes.filter("n > 0 AND low IS NOT NULL").select("n", "cls", "low").mapInArrow(emit, "h long, cls long")


def in_several(lists: DataFrame, label: str) -> DataFrame:
    """The rows of lists whose shingle has rows with different values of `label`. Sums come before the shuffle."""
    several = lists.groupBy("h").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).filter("lo < hi").select("h")
    return lists.join(several, "h", "left_semi")


def _pairs(ids: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return _mix(ids.view(np.uint64) ^ _mix(cls.view(np.uint64))).view(np.int64)


def sets_of(docs: DataFrame, nodes: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """(cls, keys, shingles) of the classes in `names` (cls), from the document with the least id of each.

    A fixed-size filter of ids decides which texts are cut, and one of ids and classes which of their sets
    are kept, so that no set moves. What both let through by chance are true sets: of a class that links with
    nothing, or once more of one that is there, once for a task at most. A join drops unwanted classes where
    there are more than the filters hold.
    """
    first = staged(nodes.groupBy("cls").agg(F.min("doc_id").alias("first_id")).join(names, "cls"), "first")
    rows = first.count()
    wanted = id_filter(first.select(F.xxhash64("first_id")), rows)

    def pairs(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_pairs(b.column(0).to_numpy(), b.column(1).to_numpy()))], names=["h"])

    right = id_filter(first.select(F.coalesce("first_id", F.lit(0)).alias("id"), "cls").mapInArrow(pairs, "h long"), rows)

    def run(batches):
        met: set[int] = set()  # bounded; repeated sets cost time only
        read = (b.filter(pa.array(passes(wanted.value, b.column(2).to_numpy()))) for b in batches)
        for b, start, sets in _rows(read, words, 1):
            cls = np.array([digest(s) for s in sets], np.int64)
            kept = []
            for k in np.flatnonzero(passes(right.value, _pairs(b.column(0).slice(start, len(sets)).to_numpy(), cls))).tolist():
                if int(cls[k]) not in met:
                    kept.append(k)
                    if len(met) < 1_000_000:
                        met.add(int(cls[k]))
            yield pa.RecordBatch.from_arrays([pa.array(cls[kept]), pa.array([keys_of(sets[k]) for k in kept], pa.list_(pa.int64())), pa.array([sets[k].tobytes() for k in kept], pa.binary())], names=["cls", "keys", "shingles"])
        tidy()

    found = docs.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text", F.xxhash64("doc_id")).mapInArrow(run, "cls long, keys array<long>, shingles binary")
    if rows > filter_room():
        found = found.join(first, "cls", "left_semi")
    out = staged(found, "sets")
    unstage(first)
    return out


class Group:
    """Members of a group: their union (the group's matrix row) and an index from shingle to members."""

    def __init__(self, members: list[tuple[int, np.ndarray]]):
        self.cls = np.array([c for c, _ in members], np.int64)
        self.n = np.array([len(s) for _, s in members], np.int64)
        every = np.concatenate([s for _, s in members])
        owner = np.repeat(np.arange(len(members)), self.n)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        self.union, self.first = np.unique(every, return_index=True)
        self.first = np.append(self.first, len(every))

    def links(self, s: np.ndarray, percent: int) -> np.ndarray:
        """Members linked to a set; none unless the union holds enough of it."""
        at = np.searchsorted(self.union, s)
        at = at[(at < len(self.union)) & (self.union[np.minimum(at, len(self.union) - 1)] == s)]
        if len(at) < needed(len(s), percent):
            return at[:0]
        a, m = self.first[at], self.first[at + 1] - self.first[at]
        upto = np.cumsum(m)
        both = np.bincount(self.owner[np.repeat(a - (upto - m), m) + np.arange(int(upto[-1]))], minlength=len(self.n))
        return np.flatnonzero(100 * both >= percent * (self.n + len(s) - both))


def cluster_group(part: pd.DataFrame, percent: int) -> pd.DataFrame:
    """(a, b): each class of a group and the least class of its cluster, where these differ."""
    part = part.drop_duplicates("cls").sort_values("cls")
    sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
    group = Group(list(zip(part["cls"], sets, strict=True)))
    label = np.arange(len(sets))
    for i, s in enumerate(sets):
        if not label.any():  # one cluster already
            break
        roots = np.unique(label[group.links(s, percent)])
        label[np.isin(label, roots)] = roots[0]
    moved = label != np.arange(len(sets))
    return pd.DataFrame({"a": group.cls[moved], "b": group.cls[label[moved]]})


def group_links(sets: DataFrame, names: DataFrame, large: DataFrame, lead: DataFrame, turn: int, percent: int) -> DataFrame:
    """Links (a, b) that make the clusters within each group of a turn, from what `groups_of` gave.

    Sets move once, to their groups. A filter of classes and groups tells those that are in a group with
    others; what it lets through by chance adds true links or none.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        return cluster_group(part, percent)

    several = names.groupBy("grp").agg(F.count("*").alias("size")).filter("size > 1").select("grp")
    wanted = staged(names.join(several, "grp", "left_semi").select(F.xxhash64("cls", "grp").alias("h")), "wanted")
    member = passing(id_filter(wanted, wanted.count()))
    unstage(wanted)
    keyed = sets.select("cls", "shingles", F.col("keys")[turn].alias("key")).join(small(large, large.count()), "key", "left")
    own = keyed.select("cls", _grp(F.col("key"), _part(turn, F.coalesce("parts", F.lit(1).cast("long")))).alias("grp"), "shingles")
    more = sets.join(small(lead, lead.count()), "cls").select("cls", "grp", "shingles")
    return own.unionByName(more).filter(member(F.xxhash64("cls", "grp"))).groupBy("grp").applyInPandas(run, "a long, b long")


def open_groups(pairs: DataFrame, grouped: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between query classes and members of groups, from pairs (cls, grp) and members (cls, grp).

    A group's sets are sent once for each 4,096 of its queries, so that a group with many queries is dealt
    over many tasks; a task holds one group at a time. Where sets go is settled before they move.
    """
    slices = F.pmod(F.xxhash64("cls"), F.greatest(F.lit(1), F.ceil(F.col("queries") / 4096)))
    counts = staged(pairs.groupBy("grp").agg(F.count("*").alias("queries")), "queries")
    asked = pairs.join(counts, "grp").select("cls", "grp", slices.alias("slice"), F.lit(1).alias("kind"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), F.ceil(F.col("queries") / 4096)).cast("long") - 1))
    members = grouped.join(counts.select("grp", each.alias("slice")), "grp").select("cls", "grp", "slice", F.lit(0).alias("kind"))
    ways = staged(members.unionByName(asked), "ways")
    goes = staged(ways.select("cls").distinct(), "goes")
    wanted = passing(id_filter(goes, goes.count()))
    unstage(goes, counts)
    both = sets.filter(wanted("cls")).join(ways, "cls").select("grp", "slice", "kind", "cls", "shingles")
    both = both.repartition("grp", "slice").sortWithinPartitions("grp", "slice", "kind", "cls")

    def run(batches):
        at, members, group = None, [], None
        for b in batches:
            a, q = [], []
            for grp, part, kind, cls, raw in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if at != (grp, part):
                    at, members, group = (grp, part), [], None
                s = np.frombuffer(raw, np.uint64)
                if kind == 0:
                    if all(c != cls for c, _ in members[-1:]):
                        members.append((cls, s))
                elif members:
                    group = group or Group(members)
                    for i in group.links(s, percent):
                        if group.cls[i] != cls:
                            a.append(cls)
                            q.append(int(group.cls[i]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(q, pa.int64())], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def scored(lists: DataFrame) -> DataFrame:
    """(cls, score, top) of the classes in lists (h, cls): the number of rows that their shingles have, and
    the shingle that has most."""
    sizes = lists.groupBy("h").agg(F.count("*").alias("rows"))
    return lists.join(sizes, "h").groupBy("cls").agg(F.sum("rows").alias("score"), F.max(F.struct("rows", "h"))["h"].alias("top"))


def _part(turn: int, parts: Column) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(turn)), parts)


def _grp(key: Column, part: Column) -> Column:
    return F.xxhash64(key, part)


def groups_of(active: DataFrame, lists: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members (cls, grp), large (key, parts), lead (cls, grp)): classes with equal keys of a turn, with about
    GROUP shingles to a group; the keys with several groups, and the leaders that are in each of them.

    The LEADERS classes with the greatest scores of a large key are members of all its groups: near copies of
    one text are often linked to that text only, and it scores highest among them. Large keys number no more
    than the corpus has times GROUP shingles.
    """
    keyed = active.select("cls", "n", F.col("keys")[turn].alias("key"))
    sizes = staged(keyed.groupBy("key").agg(F.ceil(F.sum("n") / GROUP).alias("parts")), "parts")
    members = keyed.join(sizes, "key").select("cls", _grp(F.col("key"), _part(turn, F.col("parts"))).alias("grp"))
    large = staged(sizes.filter("parts > 1"), "large")
    if large.isEmpty():
        return members, large, members.limit(0)
    wide = staged(keyed.join(large, "key").select("cls", "key", "parts"), "wide")
    scores = scored(lists.join(wide.select("cls"), "cls", "left_semi")).drop("top")
    lead = wide.join(scores, "cls").groupBy("key", "parts", F.pmod(F.xxhash64("cls", F.lit(-1)), F.lit(LEADERS)).alias("nth"))
    lead = lead.agg(F.max(F.struct("score", "cls")).alias("best")).select("key", "parts", F.col("best.cls").alias("cls"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # a leader is in one of the groups as a member
    lead = staged(lead.filter(F.col("part") != _part(turn, F.col("parts"))).select("cls", _grp(F.col("key"), F.col("part")).alias("grp")), "lead")
    return members.unionByName(lead), large, lead


def joined_by(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cls, component) after joining components by links (a, b) between classes."""
    ends = links.join(labels.select(F.col("cls").alias("a"), F.col("component").alias("la")), "a").join(labels.select(F.col("cls").alias("b"), F.col("component").alias("lb")), "b")
    found = components(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    return labels.join(found.withColumnRenamed("component", "now"), labels["component"] == found["node"], "left").select("cls", F.coalesce("now", "component").alias("component"))


def class_components(docs: DataFrame, nodes: DataFrame, words: int, percent: int) -> DataFrame:
    """(cls, component) of the classes that may have links, from the documents and their nodes."""
    frequent, repeated = repeated_shingles(nodes)
    posts = staged(postings(nodes, percent, frequent, repeated), "postings")
    lists = staged(in_several(posts, "cls"), "lists")
    unstage(posts)
    per_class = nodes.groupBy("cls").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = staged(per_class.join(lists.select("cls").distinct(), "cls"), "classes")
    sets = sets_of(docs, nodes.select("cls", "doc_id"), classes.select("cls"), words)
    labels = staged(classes.select("cls", F.col("cls").alias("component")), "labels")
    old, active = [lists, sets, classes], classes
    for turn in range(ROUNDS):
        links = staged(group_links(sets, *groups_of(active, lists, turn), turn, percent), "links")
        labels = staged(joined_by(labels, links), "labels")
        apart = staged(in_several(lists.join(labels, "cls"), "component"), "apart")
        unstage(links, lists)
        lists = apart.select("h", "cls")
        active = staged(classes.join(apart.select("cls").distinct(), "cls"), "active")
        old += [apart, active]
        if active.isEmpty():
            break
    else:
        links = staged(matrix_links(apart, active, sets, percent), "links")
        if not links.isEmpty():
            labels = staged(joined_by(labels, links), "labels")
        unstage(links)
    unstage(*old)
    return labels


def matrix_links(apart: DataFrame, active: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of different components that share a prefix shingle (h, cls, component).

    Groups are parts of a component, or for classes that are alone parts of those whose most frequent
    shingle is the same, so that many near copies that just miss the threshold make few groups.
    """
    of = active.select("cls", "n").join(apart.select("cls", "component").distinct(), "cls").join(scored(apart.select("h", "cls")).select("cls", "top"), "cls")
    alone = of.groupBy("component").agg(F.count("*").alias("peers"))
    named = of.join(alone, "component").withColumn("name", F.when(F.col("peers") > 1, F.xxhash64("component", F.lit(1))).otherwise(F.xxhash64("top", F.lit(0))))
    parts = named.groupBy("name").agg(F.ceil(F.sum("n") / GROUP).alias("parts"))
    grouped = staged(named.join(parts, "name").select("cls", "n", F.xxhash64("name", F.pmod(F.xxhash64("cls"), F.col("parts"))).alias("grp")), "grouped")
    rows = staged(apart.join(grouped, "cls"), "rows")
    matrix = rows.groupBy("h", "grp").agg(F.min("component").alias("lo"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    asks = rows.select("h", "cls", "n", "component")
    # of two components the greater asks; a member's size must lie within what a link allows
    fits = (F.col("n_lo") * percent <= F.col("n") * 100) & (F.col("n_hi") * 100 >= F.col("n") * percent)
    pairs = asks.join(matrix, "h").filter((F.col("lo") < F.col("component")) & fits).select("cls", "grp").distinct()
    return open_groups(staged(pairs, "asked"), grouped.select("cls", "grp"), sets, percent)


def _numbered(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).cast("binary").alias("text"))


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(rid, doc_id, text_hash, n_shingles, class_id, component_id), one row per document."""
    rows = _numbered(docs, doc_id, text)
    whole = staged(nodes_of(rows, words, percent), "nodes")
    links = class_components(rows, whole, words, percent)
    nodes = staged(whole.drop("low", "keys"), "nodes")
    unstage(whole)
    # without a shingle a row is its own component
    full = nodes.filter("n > 0")
    per_class = full.groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows"))
    named = per_class.join(links, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = staged(named, "named")
    ids = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = staged(named.join(ids, "component").select("cls", "component", "component_id", F.col("rows").alias("copies")), "ids")
    out = join_groups(full, named, "cls", "copies", nodes.count())
    out = out.select("rid", "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("cls").alias("class_id"), "component", "component_id")
    none = F.lit(None).cast("long")
    empty = nodes.filter("n = 0").select("rid", "doc_id", "text_hash", F.lit(0).cast("long").alias("n_shingles"), none.alias("class_id"), none.alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component stays, the one with the least id (null last), then text hash; all columns.

    Rows with equal id and text can't be told apart, so any one of them is that row. Decisions are made by
    id and text hash, not by id alone: a row that only shares its id with a copy stays. Only decisions to
    drop are joined, with the rows that a filter of them doesn't clear; documents without a word stay.
    """
    found = staged(link_documents(docs, doc_id, text, words, percent).select("class_id", "component", F.col("doc_id").alias("id"), F.col("text_hash").alias("key")), "found")
    linked = found.filter("class_id IS NOT NULL")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    first = linked.groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    marked = linked.groupBy("component", "id", "key").agg(F.count("*").alias("times")).join(first, "component")
    stays = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.key") == F.col("key"))
    marked = marked.withColumn("stays", stays).filter("NOT stays OR times > 1").select("id", "key", "stays")
    return drop_marked(docs, F.col(doc_id).cast("long"), F.xxhash64(text), found, marked)
