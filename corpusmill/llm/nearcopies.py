"""Near copies for the SimHash stage: texts whose five-word shingles have a Jaccard similarity of 4/5 or more, and their components.

SimHash over vantage-point trees links the nearest of them, as in op1. A radius wide enough for all (about 10 bits are expected
to differ, up to 24) leaves a tree nothing to prune. So shingles bring the rest of the candidates together, fingerprints and
counts of shingles by bucket thin them, and the shingles themselves decide on the trees' links as on all others.

With the shingles of all texts in one total order, two texts of similarity 4/5 or more share a shingle among the first
n - ceil(4n/5) + 1 of each (n: its distinct shingles). So texts that share such a shingle are the only candidates, and none is
lost. Any order is right; shingles that are frequent in a bounded sample come last, which keeps the lists of texts short.
A list of more than LIST texts is dealt to lists of pairs of its blocks. The trees' links and a random chain through each list
are checked first; pairs inside a component that they make change nothing and are left out. Of the other pairs that may hold a
list gives a spanning forest, never the pairs themselves; the texts that such forests chain meet once, with their shingles,
and give a spanning forest of the pairs that do hold. So pairs never make rows by the square of a group's size; only a text of
a group of many blocks is repeated for each of them.

Buckets grow with the text, as counts in a fixed number of them tell nothing of long texts: from some 6,600 shingles in 256
buckets on, unlike texts have the shared counts of near copies, and candidates by chance chain all long texts into one group.
Shingles travel only to pairs that the counts allow, and counts only to texts that a list's numbers and fingerprints allow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, bit_table, bounded_batches, discard, materialize, passes, release
from .components import components
from .simhash import SEED, _forest, linked, shingles, vote

WORDS = 5
#: Rows in the sample, its frequent shingles (in so many sampled rows or more), and how many of those are told apart.
SAMPLE, FREQUENT, MOST = 5_000, 10, 65_536
#: Buckets at least of a text's shingle counts, from which an upper bound of two texts' shared shingles is read, and shingles to a bucket at most.
BUCKETS, LOAD = 256, 4
#: A count that stands for more, and bucket counts that are compared at once.
FULL_COUNT, AT_ONCE = 255, 1 << 22
#: Bits that may differ: of texts of similarity 4/5 about 10 in 64 do, more than 24 in one pair of tens of thousands.
BITS = 24
#: Texts of a block. Two blocks meet in one list, so a list has twice as many at most.
LIST = 4096
#: Bits that may differ in a link of the vantage-point trees: op1's.
RADIUS = 3
#: Shingles of a block of candidates that meet with their shingles; two blocks meet in one group.
GROUP = 1 << 18


def _tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _key(tokens: list[bytes]) -> int:
    """Names a text: copies but for case and white space share it."""
    return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)


def grams(tokens: list[bytes]) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingles(tokens, WORDS)).view(np.int64) if tokens else np.empty(0, np.int64)


def prefix(own: np.ndarray, heavy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The shingles of which a text of similarity 4/5 or more has one in its own prefix."""
    if not len(own):
        return own
    rank = np.zeros(len(own), dtype=np.int64)
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, own), len(heavy) - 1)
        rank = np.where(heavy[at] == own, weight[at], 0)
    return own[np.lexsort((own, rank))][: len(own) - (4 * len(own) + 4) // 5 + 1]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    share = F.lit(min(1.0, SAMPLE / max(rows.count(), 1)) * (1 << 30)).cast("long")
    out = pa.schema([("g", pa.int64())])

    def each(batches):
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield arrow_rows(out, [grams(_tokens(text))])

    drawn = rows.where(F.pmod("text_hash", F.lit(1 << 30)) < share).select("text").mapInArrow(each, "g long")
    top = drawn.groupBy("g").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "g").limit(MOST).collect()
    top = np.array(sorted((r[0], r[1]) for r in top), dtype=np.int64).reshape(-1, 2)
    return top[:, 0].copy(), top[:, 1].copy()


def _sketch(own: np.ndarray) -> bytes:
    """Counts of shingles by bucket; texts whose numbers of shingles allow the similarity have as many buckets, or twice as many."""
    buckets = BUCKETS << (max(len(own) - 1, 0) // (LOAD * BUCKETS)).bit_length()
    return np.minimum(np.bincount(own & (buckets - 1), minlength=buckets), FULL_COUNT).astype(np.uint8).tobytes()


def _counts(sketches: list[bytes]) -> np.ndarray:
    """A row for each of some sketches of one width."""
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), -1)


def _may_hold(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """A flag for each row of counts a and b (b: one row, or as many): false only where the texts have a similarity below 4/5.

    Two texts share no more shingles than the sum of the lesser counts of each bucket.
    """
    full = (a.max(axis=1) == FULL_COUNT) | (b.max(axis=1) == FULL_COUNT)
    a, b = a.astype(np.uint16), b.astype(np.uint16)
    while a.shape[1] != b.shape[1]:
        half = max(a.shape[1], b.shape[1]) // 2
        a, b = (x[:, :half] + x[:, half:] if x.shape[1] > half else x for x in (a, b))
    return full | (9 * np.minimum(a, b).sum(axis=1, dtype=np.int64) >= 4 * (na + nb))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts have a similarity of 4/5 or more."""
    side = lambda c, to: sets.select(F.col("key").alias(c), F.col("grams").alias(to))
    both = pairs.join(side("a", "ga"), "a").join(side("b", "gb"), "b")
    return both.where("9 * size(array_intersect(ga, gb)) >= 4 * (size(ga) + size(gb))").select("a", "b")


def _likely(pairs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs (a, b) whose numbers of shingles, fingerprints and bucket counts allow the similarity."""
    side = lambda c: wanted.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("fp").alias(f"f{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    met = met.where(f"5 * least(na, nb) >= 4 * greatest(na, nb) and bit_count(fa ^ fb) <= {BITS}").select("a", "b", "na", "nb")
    counts = lambda c: wanted.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}"))
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def each(batches):
        for batch in batches:
            a, b, na, nb = (np.asarray(batch.column(c)) for c in ("a", "b", "na", "nb"))
            sa, sb = (batch.column(c).to_pylist() for c in ("sa", "sb"))
            widths = np.array([(len(x), len(y)) for x, y in zip(sa, sb, strict=True)]).reshape(-1, 2)
            for wide in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == wide).all(axis=1))
                step = max(1, AT_ONCE // int(wide.max()))
                for own in (at[k : k + step] for k in range(0, len(at), step)):
                    own = own[_may_hold(_counts([sa[i] for i in own]), _counts([sb[i] for i in own]), na[own], nb[own])]
                    yield arrow_rows(out, [a[own], b[own]])

    return met.join(counts("a"), "a").join(counts("b"), "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(each, "a long, b long")


def _tree_links(indexed: DataFrame) -> DataFrame:
    """indexed(key, fp) -> (a, b): texts joined as their fingerprints are by the vantage-point trees; equal fingerprints meet at one text."""
    texts = indexed.select("key", "fp").distinct()
    lead = materialize(texts.groupBy("fp").agg(F.min("key").alias("key"), F.max("key").alias("last")), "nearleads")
    side = lambda c: lead.select(F.col("fp").alias(c), F.col("key").alias(f"k{c}"))
    met = linked(lead.select("fp"), RADIUS).join(side("a"), "a").join(side("b"), "b").selectExpr("ka as a", "kb as b")
    same = texts.join(lead.where("key < last").selectExpr("fp", "key as lead"), "fp").where("key <> lead").selectExpr("lead as a", "key as b")
    links = materialize(met.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "neartrees")
    discard(lead)
    return links


def _partners(root: np.ndarray, n: np.ndarray, fp: np.ndarray):
    """(k, partners of k) so that each pair of a list in two components, whose sizes and fingerprints allow the similarity, is given once at least."""
    _, place, size = np.unique(root, return_inverse=True, return_counts=True)
    largest = int(size.argmax())
    for k in np.nonzero(place != largest)[0].tolist():
        other = (place == largest) | (place > place[k])
        other &= (place != place[k]) & (5 * np.minimum(n, n[k]) >= 4 * np.maximum(n, n[k]))
        at = np.nonzero(other)[0]
        at = at[np.bitwise_count(fp[at] ^ fp[k]) <= BITS]
        if len(at):
            yield k, at


def _apart(lists: DataFrame) -> DataFrame:
    """lists(h, members: key, root, n, fp) -> (h, key, root, n, fp) of the texts that have a partner in their list."""
    out = pa.schema([(c, pa.int64()) for c in ("h", "key", "root", "n", "fp")])

    def each(batches):
        for batch in batches:
            for h, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                key, root, n, fp = (np.asarray(members.values.field(c)) for c in range(4))
                met = np.zeros(len(key), dtype=bool)
                for k, at in _partners(root, n, fp.view(np.uint64)):
                    met[k] = met[at] = True
                if met.any():
                    yield arrow_rows(out, [np.full(int(met.sum()), h), key[met], root[met], n[met], fp[met]])

    return lists.select("h", "members").mapInArrow(each, "h long, key long, root long, n long, fp long")


def _across(lists: DataFrame) -> DataFrame:
    """lists(members: key, root, n, fp, sketch) -> (a, b): a spanning forest, as stars, of a list's pairs in two components whose sizes, fingerprints and bucket counts allow the similarity.

    a and b need not be such a pair themselves.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def each(batches):
        for batch in batches:
            for members in batch.column(0):
                own = members.values
                key, root, n, fp = (np.asarray(own.field(c)) for c in range(4))
                order = np.argsort(key)  # stars of lists with the same least text are the same rows
                key, root, n, fp = key[order], root[order], n[order], fp[order].view(np.uint64)
                sketches = own.field(4).take(pa.array(order)).to_pylist()
                width, row, counts = np.array([len(x) for x in sketches]), np.zeros(len(key), dtype=np.int64), {}
                for wide in np.unique(width).tolist():
                    at = np.flatnonzero(width == wide)
                    row[at], counts[wide] = np.arange(len(at)), _counts([sketches[i] for i in at])
                label, held, pairs = np.arange(len(key)), [], 0
                for k, near in _partners(root, n, fp):
                    mine, at = counts[int(width[k])][row[k]][None], []
                    for wide in np.unique(width[near]).tolist():
                        same, step = near[width[near] == wide], max(1, AT_ONCE // wide)
                        at += [part[_may_hold(counts[wide][row[part]], mine, n[part], n[k])] for part in (same[i : i + step] for i in range(0, len(same), step))]
                    at = np.concatenate([np.empty(0, np.int64), *at])
                    held.append((np.full(len(at), k), at))
                    pairs += len(at)
                    if pairs > len(key):  # joining costs as much as the texts: never for fewer pairs
                        label, held, pairs = _forest(*map(np.concatenate, zip(*held, strict=True)), label), [], 0
                if pairs:
                    label = _forest(*map(np.concatenate, zip(*held, strict=True)), label)
                at = np.nonzero(label != np.arange(len(key)))[0]
                if len(at):
                    yield arrow_rows(out, [key[label[at]], key[at]])

    return lists.mapInArrow(each, "a long, b long").distinct()


def _joined(groups: DataFrame) -> DataFrame:
    """groups(members: key, root, n, fp, grams) -> (a, b): a spanning forest of a group's pairs in two components that have a similarity of 4/5 or more.

    Texts near the middle of the group come first, so that what they join is not compared any more.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def each(batches):
        for batch in batches:
            for members in batch.column(0):
                own = members.values
                key, root, n, fp = (np.asarray(own.field(c)) for c in range(4))
                fp, ends = fp.view(np.uint64), np.cumsum(n)
                name = np.unique(np.asarray(own.field(4).flatten()), return_inverse=True)[1]
                label = np.unique(root, return_inverse=True)[1]
                left, mine, a, b = np.ones(len(key), dtype=bool), np.zeros(len(name), dtype=bool), [], []
                for k in np.argsort(np.bitwise_count(fp ^ np.uint64(vote(fp))), kind="stable").tolist():
                    left[k] = False
                    at = np.flatnonzero(left & (label != label[k]) & (5 * np.minimum(n, n[k]) >= 4 * np.maximum(n, n[k])))
                    at = at[np.bitwise_count(fp[at] ^ fp[k]) <= BITS]
                    if not len(at):
                        continue
                    grams_of = lambda i: name[ends[i] - n[i] : ends[i]]  # noqa: B023, E731
                    mine[grams_of(k)] = True
                    hits = mine[np.concatenate([grams_of(i) for i in at])]
                    mine[grams_of(k)] = False
                    shared = np.add.reduceat(hits, np.cumsum(n[at]) - n[at], dtype=np.int64)
                    at = at[9 * shared >= 4 * (n[at] + n[k])]
                    met, first = np.unique(label[at], return_index=True)
                    a += [key[k]] * len(first)
                    b += key[at[first]].tolist()
                    label[np.isin(label, met)] = label[k]
                if a:
                    yield arrow_rows(out, [np.minimum(a, b), np.maximum(a, b)])

    return groups.mapInArrow(each, "a long, b long").distinct()


def _met(forest: DataFrame, known: DataFrame, rows: DataFrame) -> DataFrame:
    """forest(a, b) of candidates, known(key, root, n, fp) -> (a, b), written: the edges that join roots.

    Candidates of one component of the forest meet with their shingles, in groups of pairs of blocks where they are many.
    """
    chained = materialize(components(forest).toDF("key", "c"), "nearchained")
    sets = _sets(rows, chained.select("key"))
    met = materialize(chained.join(known, "key"), "nearmet")
    blocks = met.groupBy("c").agg(F.expr(f"cast(ceil(sum(n) / {GROUP}) as int)").alias("blocks"))
    dealt = _dealt(met.join(blocks, "c"), "c", "key", "root", "n", "fp")
    groups = dealt.join(sets, "key").groupBy("c", "i", "j").agg(F.collect_list(F.struct("key", "root", "n", "fp", "grams")).alias("members"))
    edges = materialize(_joined(groups.select("members")), "nearedges")
    discard(chained, sets, met)
    release(rows.sparkSession)
    return edges


def _dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """rows(key, blocks, ...) -> the columns, i, j: each row in every pair of blocks that its own is in."""
    own = rows.withColumn("i", F.expr("cast(pmod(xxhash64(key), blocks) as int)"))
    own = own.select(*columns, "i", F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"))
    return own.select(*columns, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))


def _sets(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, grams) of the texts whose keys are wanted, and of a few others that the bit table lets through."""
    wanted = bit_table(keys.select(F.col("key").alias("h")))
    out = pa.schema([("key", pa.int64()), ("grams", pa.list_(pa.int64()))])

    def each(batches):
        for batch in batches:
            split = [_tokens(t) for t in batch.column(0).to_pylist()]
            named = np.array([_key(t) for t in split], dtype=np.uint64)
            at = np.flatnonzero(passes(wanted.value, named))
            if len(at):
                yield arrow_rows(out, [named[at].view(np.int64), _lists([grams(split[i]) for i in at])])

    return materialize(rows.select("text").mapInArrow(each, "key long, grams array<long>").dropDuplicates(["key"]), "nearsets")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, root) per row of docs; rows of one root are chained by five-word similarity 4/5 or more.

    Texts are compared lower-cased (A-Z), white space collapsed; a text of five words or fewer is one shingle. Null and
    blank texts are equal. A null id keeps its place; repeated rows stay; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_hash"))
    heavy, weight = _frequent(rows)
    fields = {"doc_id": pa.int64(), "text_hash": pa.int64(), "key": pa.int64(), "n": pa.int64(), "fp": pa.int64(), "sketch": pa.binary(), "prefix": pa.list_(pa.int64())}
    out = pa.schema(list(fields.items()))

    def index(batches):
        for batch in batches:
            split = [_tokens(t) for t in batch.column(1).to_pylist()]
            own = [grams(t) for t in split]
            unsigned = lambda x: np.array(x, dtype=np.uint64).view(np.int64)
            yield arrow_rows(out, [batch.column(0), batch.column(2), unsigned([_key(t) for t in split]), [len(g) for g in own], unsigned([vote(g.view(np.uint64)) for g in own]), [_sketch(g) for g in own], _lists([prefix(g, heavy, weight) for g in own])])

    indexed = materialize(rows.mapInArrow(index, "doc_id long, text_hash long, key long, n long, fp long, sketch binary, prefix array<long>"), "nearindex")
    # a shingle of one text only brings nothing together; copies of a text count as one, and meet within their tasks first
    shared = indexed.select("key", F.explode("prefix").alias("g")).groupBy("g").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("g")
    shared = materialize(shared, "nearshared")
    release(spark)
    some = bit_table(shared.select(F.col("g").alias("h")))
    pairs = pa.schema([("key", pa.int64()), ("g", pa.int64())])

    def post(batches):
        for batch in batches:
            g = batch.column(1).values
            key = np.repeat(np.asarray(batch.column(0)), np.diff(np.asarray(batch.column(1).offsets)))
            at = np.flatnonzero(passes(some.value, np.asarray(g).view(np.uint64)))
            yield arrow_rows(pairs, [key[at], np.asarray(g)[at]])

    posted = indexed.select("key", "prefix").mapInArrow(post, "key long, g long").distinct()
    posted = materialize(posted.join(shared.hint("shuffle_hash"), "g", "left_semi"), "nearposted")
    blocks = posted.groupBy("g").agg(F.expr(f"cast(ceil(count(1) / {LIST}) as int)").alias("blocks"))
    dealt = _dealt(posted.join(blocks, "g"), "g", "key")
    lists = dealt.groupBy("g", "i", "j").agg(F.sort_array(F.collect_list("key")).alias("members")).where("size(members) > 1")
    lists = materialize(lists.select(F.xxhash64("members").alias("h"), "members").dropDuplicates(["h"]), "nearlists")
    discard(shared, posted)
    release(spark)
    keys = lists.select(F.explode("members").alias("key")).distinct()
    wanted = materialize(indexed.join(keys, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "fp", "sketch")]), "nearwanted")
    whole, indexed = indexed, materialize(indexed.select("doc_id", "text_hash", "key", "fp"), "nearrows")
    discard(whole)
    release(spark)
    order = lists.selectExpr("transform(array_sort(transform(members, k -> struct(xxhash64(k, h) as o, k as k))), x -> x.k) as m")
    chain = order.select(F.explode(F.expr("transform(sequence(0, size(m) - 2), i -> struct(least(m[i], m[i + 1]) as a, greatest(m[i], m[i + 1]) as b))")).alias("p")).select("p.*").distinct()
    trees = _tree_links(indexed)
    edges = _edges(_likely(chain.unionByName(trees).distinct(), wanted), rows)
    roots = materialize(components(edges).toDF("key", "root"), "nearroots")
    known = wanted.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "n", "fp")
    labelled = lists.select("h", F.explode("members").alias("key")).join(known, "key")
    apart = materialize(_apart(labelled.groupBy("h").agg(F.collect_list(F.struct("key", "root", "n", "fp")).alias("members"))), "nearapart")
    discard(lists, trees)
    release(spark)
    sketches = wanted.select("key", "sketch")
    members = apart.join(sketches, "key").groupBy("h").agg(F.collect_list(F.struct("key", "root", "n", "fp", "sketch")).alias("members"))
    forest = materialize(_across(members.select("members")), "nearforest")
    more = _met(forest, known, rows)
    if not more.isEmpty():
        roots = materialize(components(edges.unionByName(more)).toDF("key", "root"), "nearroots")
    discard(apart, edges, forest, more, wanted)
    release(spark)
    return indexed.join(roots, "key", "left").select("doc_id", "text_hash", F.coalesce("root", "key").alias("root"))


def _edges(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) that hold, written."""
    pairs = materialize(pairs, "nearpairs")
    sets = _sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("key")))
    edges = materialize(_checked(pairs, sets), "nearedges")
    discard(pairs, sets)
    release(rows.sparkSession)
    return edges
