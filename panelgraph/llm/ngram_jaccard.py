"""Set-similarity join on word shingles by token-combination prefixes, and its components.

Documents link when the Jaccard similarity of their sets of five-word shingles is 0.75 or more.
Equal sets are one class, named by a digest of the set; everything up to the last step is about
classes. |A & B| must reach ceil(3 (|A| + |B|) / 7).

1. Tokens are split by hash. Those of the lower half are counted over all documents; a lower token
   below an adaptive count (the smallest power of two that leaves `CAPACITY` tokens at most, 16 in the
   least) is rare. All others are the frequent class, parted by bitmaps of rising counts.
2. Tokens are ordered rare ones first, then by class, and by hash. With s tokens of which a
   partner may miss s - ceil(0.75 s), a prefix of s - ceil(0.75 s) + 1 rare tokens shares a token
   with every partner. Where rare tokens run out the prefix is extended by frequent ones, dealt
   by hash into parts: each part costs one token more, and then either a rare token or two tokens
   of one part are shared. So rare tokens are indexed singly and frequent ones as 2-combinations
   inside a part. The number of parts follows the size class of the sets, and a document emits
   the combinations of every class a partner can have.
3. Lists of at most `SMALL` members are paired (that is a bound per row, not a cut: longer ones follow). A pair that shares c rare tokens in such lists and no
   longer list has at most c tokens in common plus those behind one of the prefixes; pairs for which
   that is too few are dropped unseen. A longer list is verified against one well connected document
   only (a star, so m members make m candidates).
4. Verified links are joined to components. A longer list whose members lie in several is indexed
   again, by how its members differ from a set C, their centre with the tokens that most of them have
   and without those that most of them lack. Linked A and B that share no token outside C have
   |A & B & C| >= ceil(3 (|A| + |B|) / 7) and so miss ceil(3 (|A| + |B|) / 7) + |C| - |A & C| - |B & C| tokens of C in
   common; if that is not above 0, both are linked to the member nearest to C. So members emit a
   prefix of their tokens outside C and, only where those bounds allow a partner, a prefix of the tokens
   of C that they miss. In the new lists members that may link with others of their size or more are
   open, and open ones are paired with all that fit (up to `OPEN` ones a list) or else starred as
   before, until no such list holds several components. The bound on open ones grows fourfold from the
   third round on, so the rounds end.

No link between different texts is lost: linked documents share a list, and only pairs that are
already connected or provably below the threshold are left out.

Hot keys: copies met again in a task emit nothing; combinations are salted before they are counted;
where a list, a centre or a class holds over a thousandth of the rows its (at most 1000) rows
are broadcast, and the sets of a centre go to salted copies of it.

Defined cases: a null or empty text has no shingle and links with nothing; a text of fewer than
five words is one shingle; rows that repeat an id are one document with several texts; a null id
links with nothing and has a null component; an empty table gives an empty result. Very long texts are hashed whole, one at a
time. Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelgraph.llm.bitmap import bitmap, in_bitmap
from panelgraph.llm.common import discard, join_skewed, materialize, tidy
from panelgraph.llm.components import components
from panelgraph.llm.shingles import digest, mix, parts, shingle_sets

#: The similarity, as a fraction.
NUM, DEN = 3, 4
#: Linked sets of sizes a and b share ceil(NUM * (a + b) / WHOLE) tokens at least.
WHOLE = NUM + DEN
CAPACITY = 1 << 22
#: Members of a list that is paired; tokens of fewer documents may be rare.
SMALL = 16
#: Classes beyond the first frequent one start at its least count times these powers of two.
LEVELS = (2, 4, 6, 8, 10)
#: Open members of a list that are paired with all that fit.
OPEN = 256
#: Bits of the sketch of a difference: the parity of its tokens with each hash. Two sketches differ in no more bits than the sets in tokens.
SKETCH = 512
#: Bits of the bitmaps of frequent tokens, of tokens of several documents and of documents to verify.
TOKEN_BITS, SHARED_BITS, ID_BITS = 24, 25, 22
#: Tokens of a size class go to 2**class / PART parts.
PART = 8
#: Parts of a hot combination before it is counted.
SALTS = 64
#: Nodes of a centre that one task compares.
SALTED = 256
#: Tokens that a task counts together.
CHUNK = 1 << 20
HALF = np.uint64(1 << 63)
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def needed(s: int) -> int:
    """Tokens of s that a prefix must hold so that no partner can miss them all."""
    return s - -(-NUM * s // DEN) + 1


class _Seen(set):
    """Digests of the sets a task has met; forgets all when it has grown large."""

    def new(self, mark: int) -> bool:
        if mark in self:
            return False
        if len(self) > 500_000:
            self.clear()
        self.add(mark)
        return True


def _named(seed: int):
    """(id, text) to (id, size of the set, two halves of its digest)."""
    schema = pa.schema([(c, pa.int64()) for c in ("id", "n", "d1", "d2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            rows = [(len(s), *digest(s, seed)) for s in shingle_sets(part.column(1))]
            cols = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(list(c), pa.int64()) for c in cols)], schema=schema)

    return run


def _lower(seed: int):
    """Texts to the lower tokens of their sets with counts, summed over CHUNK tokens at a time."""
    schema = pa.schema([("sig", pa.int64()), ("n", pa.int64())])

    def folded(waiting: list[np.ndarray]) -> pa.RecordBatch:
        token, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, held = _Seen(), [], 0
        for part in parts(batches):
            for s in shingle_sets(part.column(1)):
                if len(s) > 2 and seen.new(digest(s, seed)[0]):
                    waiting.append(s[: np.searchsorted(s, HALF)])
                    held += len(waiting[-1])
                    if held >= CHUNK:
                        yield folded(waiting)
                        waiting, held = [], 0
        if waiting:
            yield folded(waiting)

    return run


def token_classes(texts: DataFrame, seed: int) -> list[np.ndarray]:
    """Bitmaps of lower tokens: those of several documents, then frequent ones from an adaptive count on and from higher ones."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Repartitioned first: summing unique tokens before the shuffle is in vain, and hot ones are summed by their tasks.
    counts = texts.mapInArrow(tidy(_lower(seed)), "sig long, n long").repartition(n, "sig").groupBy("sig").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialize(counts, "token-counts")
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()  # a row a power of two
    k, total = 64, 0
    for row in sorted(sizes, key=lambda r: -r["k"]):
        total += row["n"]
        if total > CAPACITY or 1 << row["k"] < SMALL:
            break
        k = row["k"]
    least = [(2.0, SHARED_BITS), (2.0**k, TOKEN_BITS), *((2.0 ** (k + step), TOKEN_BITS - 2) for step in LEVELS)]
    out = [bitmap(counts.where(F.col("n") >= c).select(F.col("sig").alias("h")), bits) for c, bits in least]
    discard(counts)
    return out


def classes_of_partners(s: int) -> range:
    """The size classes (log2) of all sets that a set of size s can link with."""
    return range((-(-NUM * s // DEN)).bit_length() - 1, (DEN * s // NUM).bit_length())


def signatures(s: np.ndarray, frequent: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rare tokens and the combinations by which a sorted token set is indexed; frequent is the bitmaps of the classes."""
    size = len(s)
    none = np.empty(0, np.uint64)
    if size < 3:  # such a set links with equal ones only, and those are one class
        return none, none
    need = needed(size)
    half = int(np.searchsorted(s, HALF))
    known = in_bitmap(frequent[0], s[:half])
    rare = s[:half][~known]
    if len(rare) >= need:
        return rare[:need], none
    level = 1 + sum(in_bitmap(f, s).astype(np.int8) for f in frequent)
    level[:half][~known] = 0
    often = np.argsort(level, kind="stable")[len(rare) :]
    out, often, need = [none], s[often], need - len(rare)
    for c in classes_of_partners(size):
        parts = max(1, (1 << c) // PART)
        part = (often >> np.uint64(20)) % np.uint64(parts)
        first = np.zeros(len(often), bool)
        first[np.unique(part, return_index=True)[1]] = True
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        order = np.argsort(part[:end], kind="stable")
        for run in np.split(often[:end][order], np.flatnonzero(np.diff(part[:end][order])) + 1):
            if len(run) > 1:
                pairs = np.array(list(itertools.combinations(run, 2)), np.uint64)
                out.append(mix(pairs[:, 0] * _P1 + pairs[:, 1] * _P2 + np.uint64(c) * _P3))
    return rare, np.concatenate(out)


#: sig: a list, odd for combinations; np: the size of the set and the number of its rare tokens that are indexed.
ENTRY = "sig long, node long, np long"


def _emit(shared, seed: int):
    """shared: a broadcast of the bitmaps of token_classes."""
    schema = pa.schema([(c, pa.int64()) for c in ("sig", "node", "np")])
    one = np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, *frequent = shared.value
        seen = _Seen()
        for part in parts(batches):
            sigs, heads, counts = [np.empty(0, np.uint64)], [], []
            for s in shingle_sets(part.column(1)):
                if len(s) < 3 or not seen.new(node := digest(s, seed)[0]):
                    continue
                rare, pairs = signatures(s, frequent)
                lone = rare[in_bitmap(several, rare)]  # tokens of one document only meet nobody
                sigs += [lone & ~one, pairs | one]
                heads.append((node, len(s) << 32 | len(rare)))
                counts.append(len(lone) + len(pairs))
            head = np.repeat(np.array(heads, np.int64).reshape(-1, 2), counts, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(head[:, 0]), pa.array(head[:, 1])], schema=schema)

    return run


def _sets(wanted, seed: int):
    """(id, text) to (node, tokens) of the ids in a broadcast bitmap."""
    schema = pa.schema([("node", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Seen()
        inside = (b.filter(pa.array(in_bitmap(wanted.value, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)))) for b in batches)
        for part in parts(inside, rows=200):
            found = [(d, s) for d, s in ((digest(s, seed)[0], s) for s in shingle_sets(part.column(1))) if seen.new(d)]
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int64()), pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], schema=schema)

    return run


#: Of a node under its centre; see Corpus.compared.
COMPARED = "node long, centre long, same long, na long, nb long, outside array<long>, missing array<long>, sketch array<long>"


class _Votes:
    """Tokens that most of a stream of sets hold; rarer ones are forgotten when there are many."""

    def __init__(self) -> None:
        self.members, self.held = 0, 0
        self.waiting: list[np.ndarray] = []
        self.token, self.count = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.members += 1
        self.waiting.append(tokens)
        self.held += len(tokens)
        if self.held > CHUNK:
            self.most(4)

    def most(self, part: int = 2) -> np.ndarray:
        """The tokens of more than 1 / part of the sets, all others forgotten."""
        new, n = np.unique(np.concatenate([self.token[:0], *self.waiting]), return_counts=True)
        token, at = np.unique(np.concatenate([self.token, new]), return_inverse=True)
        count = np.bincount(at, np.concatenate([self.count, n]), len(token)).astype(np.int64)
        many = count * part > self.members
        self.token, self.count, self.waiting, self.held = token[many], count[many], [], 0
        return self.token


def _compare(changed: bool):
    """(centre, salt, role, node, tokens, more, less), a centre (role 0) before its nodes, to COMPARED; see Corpus.compared."""
    longs, lists = pa.int64(), pa.list_(pa.int64())
    schema = pa.schema([(c, longs) for c in ("node", "centre", "same", "na", "nb")] + [("outside", lists), ("missing", lists), ("sketch", lists)])

    def sketch(*sets: np.ndarray) -> np.ndarray:
        odd = np.bincount(np.concatenate(sets).astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1
        return np.packbits(odd.astype(bool)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub, none = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        out: list[tuple] = []
        votes = _Votes(), _Votes()

        def flush() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [[]] * 8
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
            out.clear()
            return batch

        def voted() -> None:
            if not changed and votes[0].members >= SMALL // 2:
                out.append((None, now[0], votes[0].members, 0, 0, *(v.most().view(np.int64) for v in votes), none))

        for part in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            sets = [part.column(k) for k in (4, 5, 6)]
            of = lambda col, i: col[i].values.to_numpy(zero_copy_only=False).view(np.uint64)
            for i, (centre, salt, role, node) in enumerate(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True)):
                own = of(sets[0], i)
                if role == 0:
                    voted()
                    now, hub, votes = (centre, salt), own.copy(), (_Votes(), _Votes())
                    if sets[1][i].is_valid:
                        hub = np.setdiff1d(np.union1d(hub, of(sets[1], i)), of(sets[2], i))
                elif now == (centre, salt):
                    outside, missing = np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)
                    if not changed:
                        votes[0].add(outside)
                        votes[1].add(missing)
                    more = (outside.view(np.int64), missing.view(np.int64), sketch(outside, missing)) if changed else (none, none, none)
                    out.append((node, centre, len(own) - len(outside), len(own), len(hub), *more))
            yield flush()
        voted()
        yield flush()

    return run


class Corpus:
    """The classes of a table: which document stands for which, and their sets on demand."""

    def __init__(self, rows: DataFrame) -> None:
        named, seed = rows.mapInArrow(tidy(_named(0)), "id long, n long, d1 long, d2 long"), 0
        while True:
            self.members = materialize(named, "shingle-sets")
            group = self.members.where("id is not null and n > 0").groupBy(F.col("d1").alias("node"))
            self.classes = materialize(group.agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.min("d2").alias("lo"), F.max("d2").alias("hi")), "classes")
            if self.classes.where("lo <> hi").isEmpty():
                break
            seed += 1  # two sets share half a digest: take other digests
            named = rows.mapInArrow(tidy(_named(seed)), "id long, n long, d1 long, d2 long")
        self.texts, self.seed = rows.where("id is not null and text is not null"), seed

    def compared(self, pairs: DataFrame, changes: DataFrame | None = None) -> DataFrame:
        """pairs (node, centre) with same, na and nb: the sizes of the intersection and of both sets.

        Centres of many nodes also give rows with a null node: outside holds the tokens that most of
        `same` nodes have and it has not, missing those that it has and they lack. With changes
        (centre, more, less) the tokens `more` count as a centre's and `less` do not, and outside and missing are,
        for each node, its tokens that are not the centre's and the centre's that it lacks, and sketch is one of both.

        The sets of about the documents in pairs are hashed anew (a bitmap of fixed size says which)
        and travel to their pairs; a centre goes to a salted copy for each SALTED nodes and meets
        them one at a time.
        """
        both = pairs.select("node").unionByName(pairs.select(F.col("centre").alias("node"))).distinct()
        ids = both.join(self.classes, "node").select(F.col("rep").alias("h"))
        wanted = pairs.sparkSession.sparkContext.broadcast(bitmap(ids, ID_BITS))
        sets = self.texts.mapInArrow(tidy(_sets(wanted, self.seed)), "node long, tokens array<long>")
        counts = materialize(pairs.groupBy("centre").agg(F.count("*").alias("size")), "centre-sizes")
        salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / SALTED)).cast("int")
        pairs = join_skewed(pairs, counts, "centre", "size").select("centre", salt.alias("salt"), F.lit(1).alias("role"), "node")
        salts = F.explode(F.sequence(F.lit(0), F.ceil(F.col("size") / SALTED).cast("int") - 1))
        hubs = counts.select("centre", salts.alias("salt"), F.lit(0).alias("role"), F.col("centre").alias("node"))
        names = ["centre", "salt", "role", "node", "tokens", "more", "less"]
        if changes is None:
            lists = [F.lit(None).cast("array<long>").alias(c) for c in ("more", "less")]
            pairs, hubs = pairs.select("*", *lists), hubs.select("*", *lists)
        else:
            hubs = hubs.join(changes, "centre", "left").select(*[c for c in names if c != "tokens"])
            pairs = pairs.select("*", *[F.lit(None).cast("array<long>").alias(c) for c in ("more", "less")])
        width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sent = sets.join(pairs.unionByName(hubs), "node").select(*names)
        sent = sent.repartition(width, "centre", "salt").sortWithinPartitions("centre", "salt", "role")
        return sent.mapInArrow(tidy(_compare(changes is not None)), COMPARED)

    def label(self, links: DataFrame, more: DataFrame | None = None) -> DataFrame:
        """(node, component) of documents: the smallest that each reaches by links (a, b) of classes and more ones (x, y) of documents."""
        rep = self.classes.select("node", "rep")
        ends = links.join(rep.select(F.col("node").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("node").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
        return components((ends if more is None else ends.unionByName(more)).select(F.col("x").alias("a"), F.col("y").alias("b")))


def sized(entries: DataFrame) -> DataFrame:
    """entries with the size of their list, of lists of two or more."""
    counts = materialize(entries.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"), "list-sizes")
    return join_skewed(entries, counts, "sig", "size")


def first_lists(corpus: Corpus) -> DataFrame:
    """(sig, node, np, size): the lists of step 2 with two members or more."""
    shared = corpus.texts.sparkSession.sparkContext.broadcast(token_classes(corpus.texts, corpus.seed))
    entries = corpus.texts.mapInArrow(tidy(_emit(shared, corpus.seed)), ENTRY)
    hot = F.col("sig").bitwiseAND(1) == 1
    entries = entries.withColumn("salt", F.when(hot, F.pmod(F.xxhash64("node"), F.lit(SALTS))).otherwise(0))
    part = Window.partitionBy("sig", "salt")
    entries = entries.withColumn("before", F.lag("node").over(part.orderBy("node"))).where("before is null or before <> node")
    entries = materialize(entries.withColumn("size", F.count("*").over(part)).where(hot | (F.col("size") > 1)).drop("before", "salt"), "entries")
    return materialize(entries.where(~hot).unionByName(sized(entries.where(hot).drop("size"))), "lists")


def _size(np_: Column) -> Column:
    return F.shiftright(np_, 32)


def paired(lists: DataFrame) -> DataFrame:
    """(node, centre): of members of one list of at most SMALL the pairs that may link.

    A pair's rare tokens in such lists are counted against what it needs.
    """
    got = lists.where(F.col("size") <= SMALL).groupBy("sig").agg(F.sort_array(F.collect_list(F.struct("node", "np"))).alias("g"))

    def mates(x: Column, i: Column) -> Column:
        fits = lambda y: DEN * F.least(_size(x["np"]), _size(y["np"])) >= NUM * F.greatest(_size(x["np"]), _size(y["np"]))
        others = F.filter(F.slice("g", i + 2, F.lit(SMALL)), fits)
        return F.transform(others, lambda y: F.struct(x["node"].alias("node"), x["np"].alias("np"), y["node"].alias("centre"), y["np"].alias("np2")))

    pairs = got.select((F.col("sig").bitwiseAND(1) == 0).cast("long").alias("rare"), F.explode(F.flatten(F.transform("g", mates))).alias("p")).select("rare", "p.*")
    pairs = pairs.groupBy("node", "np", "centre", "np2").agg(F.sum("rare").alias("c"))
    rest = lambda c: _size(F.col(c)) - F.col(c).bitwiseAND((1 << 32) - 1)
    both = _size(F.col("np")) + _size(F.col("np2"))
    return pairs.where(WHOLE * (F.col("c") + F.greatest(rest("np"), rest("np2"))) >= NUM * both).select("node", "centre")


def paired_with_open(lists: DataFrame, small: int) -> DataFrame:
    """(node, centre): in lists with at most `small` open members each of those with all members that it may link with.

    Of two members the smaller one is open (see next_lists), components differ, neither is larger
    than the other's cap, and their sketches differ in no more bits than linked sets in tokens. So a
    member is held against `small` others at most, however long its list is, and few pairs come out.
    """
    few = lists.where(F.col("open") <= small)
    about = F.struct("node", _size(F.col("np")).alias("n"), "comp", "cap", "sketch")
    opened = few.where("cap >= shiftright(np, 32)").groupBy("sig").agg(F.collect_list(about).alias("g"), F.first("size").alias("size"))
    n = _size(F.col("np"))
    apart = lambda y: sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(y["sketch"][k])) for k in range(1, SKETCH // 64)), F.bit_count(F.col("sketch")[0].bitwiseXOR(y["sketch"][0])))
    fits = lambda y: (y["comp"] != F.col("comp")) & (y["n"] <= F.col("cap")) & (n <= y["cap"]) & (WHOLE * apart(y) <= n + y["n"])
    pairs = join_skewed(few.drop("size"), materialize(opened, "open"), "sig", "size").select("node", F.explode(F.filter("g", fits)).alias("y"))
    return pairs.select(F.greatest("node", "y.node").alias("node"), F.least("node", "y.node").alias("centre")).distinct()


def starred(lists: DataFrame) -> DataFrame:
    """The members (sig, node, np) of the lists with a centre, by which few centres serve many lists.

    A member's favourite is, of the best connected members (whose lists hold most members) of its
    lists, the best. Most members' favourite is a list's centre, though it need not be in the list.
    """
    large = materialize(lists, "long-lists")
    score = large.groupBy("node").agg(F.sum("size").alias("score"))
    best = large.join(score, "node").groupBy("sig").agg(F.max(F.struct("score", "node")).alias("best"), F.count("*").alias("size"))
    large = large.select("sig", "node", "np")
    favourite = join_skewed(large, materialize(best, "best"), "sig", "size").groupBy("node").agg(F.max("best")["node"].alias("centre"))
    votes = large.join(favourite, "node").groupBy("sig", "centre").agg(F.count("*").alias("n"))
    centres = materialize(votes.groupBy("sig").agg(F.max(F.struct("n", "centre"))["centre"].alias("centre"), F.sum("n").alias("size")), "centres")
    return materialize(join_skewed(large, centres, "sig", "size").where("node <> centre").drop("size"), "stars")


def unsettled(stars: DataFrame, named: DataFrame) -> DataFrame:
    """(node, np, comp, centre) of the lists whose members, the centre aside, lie in several components; named is (node, comp)."""
    at = materialize(stars.join(named, "node"), "labelled")
    mixed = at.groupBy("sig").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig", "size")
    members = join_skewed(at, materialize(mixed, "mixed"), "sig", "size")
    return materialize(members.select("node", "np", "comp", "centre").distinct(), "members")


def majorities(votes: DataFrame) -> DataFrame:
    """(centre, more, less): the tokens that most nodes of a centre have and it has not, and the other way round."""
    total = votes.groupBy("centre").agg(F.sum("same").alias("all"))
    each = [votes.select("centre", F.lit(k).alias("kind"), "same", F.explode(c).alias("token")) for k, c in enumerate(("outside", "missing"))]
    most = each[0].unionByName(each[1]).groupBy("centre", "kind", "token").agg(F.sum("same").alias("n")).join(total, "centre").where("2 * n > all")
    of = lambda k: F.coalesce(F.sort_array(F.collect_list(F.when(F.col("kind") == k, F.col("token")))), F.array().cast("array<long>"))
    return most.groupBy("centre").agg(of(0).alias("more"), of(1).alias("less"))


def prefixes(na: Column, nb: Column, same: Column, low: Column, top: Column) -> tuple[Column, Column]:
    """How many of the tokens outside and missing list a set of size na that shares `same` with a set C of size nb.

    low is the least size of the sets under C, top the largest 7 |X & C| - 3 |X| of them. See step 4 of the module.
    """
    ceiling = lambda x, d: (x + d - 1 - F.pmod(x + d - 1, F.lit(d))) / d
    least = F.greatest(ceiling(NUM * na, DEN), low)
    owed = ceiling(NUM * (na + least), WHOLE) - same
    outside = F.greatest(F.lit(0), na - same - F.greatest(owed, F.lit(1)) + 1)
    near = WHOLE * same - NUM * na
    common = F.greatest(F.lit(1), F.when(near + top >= WHOLE * nb, ceiling(top + 1 - near, WHOLE)).otherwise(ceiling(WHOLE * nb - near - top, WHOLE)))
    missing = F.when(owed > 0, 0).otherwise(F.greatest(F.lit(0), nb - same - common + 1))
    return outside.cast("int"), missing.cast("int")


def next_lists(corpus: Corpus, members: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, node, np, comp, cap, size, open): the members' lists by their differences from their centres; and certain links.

    A centre is changed by the tokens that most of its members have or lack; call it C. Members A and B with
    7 (|A & C| + |B & C|) >= 3 (|A| + |B|) + 7 |C| share enough of C to be linked; so is each of them
    to the member nearest to C, the one with the largest 7 |X & C| - 3 |X|. Those links are returned.
    Two members of a list of missing tokens that share no token outside C link only if
    3 (|A| + |B|) <= 7 |A & C|, and the same with |B & C|; cap is the size of |B| up to which that
    holds for A. Then the smaller one's cap is its own size at least: such members are open. Lists without
    an open member or with one component are dropped, and so are members whose cap is below all open members.
    """
    found = materialize(corpus.compared(members.select("node", "centre"), changes), "differences")
    near = WHOLE * F.col("same") - NUM * F.col("na")
    facts = found.groupBy("centre").agg(F.min("na").alias("low"), F.max(near).alias("top"), F.max_by("node", F.struct(near, "node")).alias("nearest"), F.count("*").alias("size"))
    found = join_skewed(found, materialize(facts, "centre-facts"), "centre", "size")
    links = found.where((near + F.col("top") >= WHOLE * F.col("nb")) & (F.col("node") != F.col("nearest"))).select(F.col("node").alias("a"), F.col("nearest").alias("b"))
    caps = F.lit(1 << 40), F.floor(WHOLE * F.col("same") / NUM) - F.col("na")
    upto = prefixes(*(F.col(c) for c in ("na", "nb", "same", "low", "top")))
    kinds = [found.select("node", "centre", F.lit(k).alias("kind"), cap.alias("cap"), "sketch", F.explode(F.slice(c, F.lit(1), n)).alias("token")) for k, (c, cap, n) in enumerate(zip(("outside", "missing"), caps, upto, strict=True))]
    entries = kinds[0].unionByName(kinds[1]).select(F.xxhash64("centre", "kind", "token").alias("sig"), "node", "cap", "sketch")
    entries = materialize(entries.join(members.select("node", "np", "comp").distinct(), "node").distinct(), "entries")
    links = materialize(links.distinct(), "certain-links")
    n = _size(F.col("np"))
    facts = [F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count_if(F.col("cap") >= n).alias("open"), F.min(F.when(F.col("cap") >= n, n)).alias("least")]
    facts = materialize(entries.groupBy("sig").agg(*facts).where("lo <> hi and open > 0").select("sig", "size", "open", "least"), "list-sizes")
    return materialize(join_skewed(entries, facts, "sig", "size").where("cap >= least").drop("least"), "lists"), links


def links_between(corpus: Corpus) -> DataFrame:
    """Links (a, b) of classes that have the same components as all links.

    Components are found after the first round; the few links of later ones only leave work undone that they would save.
    """
    lists, small, links, named, round_ = first_lists(corpus), SMALL, None, None, 0
    while True:
        stars = starred(lists.where(F.col("open" if round_ else "size") > small))
        pairs = paired_with_open(lists, small) if round_ else paired(lists)
        pairs = pairs.unionByName(stars.select("node", "centre")).distinct()
        checked = materialize(corpus.compared(pairs), "checked")
        new = checked.where(DEN * F.col("same") >= NUM * (F.col("na") + F.col("nb") - F.col("same")))
        new = new.where("node is not null").select(F.col("node").alias("a"), F.col("centre").alias("b"))
        links = new if links is None else links.unionByName(new)
        discard(lists)
        if stars.isEmpty():
            return links
        if named is None:
            rep = corpus.classes.select("node", "rep")
            found = corpus.label(links).withColumnRenamed("node", "rep")
            named = materialize(rep.join(found, "rep", "left").select("node", F.coalesce("component", "rep").alias("comp")), "components")
        members = unsettled(stars, named)
        discard(stars)
        if members.isEmpty():
            return links
        lists, certain = next_lists(corpus, members, majorities(checked.where("node is null")))
        links = links.unionByName(certain)
        discard(members)
        round_ += 1
        small = OPEN * 4 ** max(0, round_ - 2)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id_col, n_shingles, component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    corpus = Corpus(rows)
    links = links_between(corpus)
    # A document with several texts is in several classes; it joins them, as a copy joins its class.
    rep = corpus.classes.select(F.col("node").alias("d1"), "rep", "copies")
    own = corpus.members.where("id is not null and n > 0")
    of = join_skewed(own, materialize(rep, "class-of"), "d1", "copies").where("id <> rep")
    ends = corpus.label(links, of.select(F.col("id").alias("x"), F.col("rep").alias("y")))
    return corpus.members.join(ends, corpus.members["id"] == ends["node"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
