"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two sets that are alike enough share at least l tokens of their prefixes of length
n - need(n) + l in any common order of tokens, for every l. Each document takes the l for which
the estimated cost is least: a longer prefix means more rows, but a candidate must then share l
of them. Tokens are ordered from rare to frequent by a sketch of all documents' frequencies.

Documents with equal sets are one vertex from the start. Before all candidates are verified,
each vertex is compared with the set that leads most of its tokens' lists, in a group of near
copies the original; what that connects needs no further comparison, so such a group isn't
expanded into all its pairs. All other candidates are then verified, so no link between
components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, mixed, saved, shuffle_width, table
from .components import connected_components
from .shingles import Key, new_key, shingle_sets

#: Buckets of the frequency sketch, as bits.
SKETCH_BITS = 18
#: Shared prefix tokens that a document may ask for at most.
MOST_MATCHES = 8
#: Documents that share a rare token by chance, which the sketch can't see.
BY_CHANCE = 0.5
#: 64-bit words of the bitmap that each set has.
BITMAP_WORDS = 4
#: Bits of the filter of ids whose sets are wanted, for each of them; a join behind it decides.
FILTER_BITS_EACH = 12
#: Bits of the largest filter, as a power of two (8 MB). Where even that would let most ids
#: through, there is none, and all sets go to the join.
FILTER_MOST = 26
#: Pairs of one document from which on its set is sent to several tasks, so many for each.
SET_PAIRS = 4096
#: Documents of a list from which on its comparisons are dealt out among tasks, so many for each.
LIST_ROWS = 1024


def reduced(parts: DataFrame, dtype: str, op: Callable) -> np.ndarray | None:
    """Arrays of one fixed length, a row each, reduced to one in two levels of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                part = np.frombuffer(x.as_buffer(), dtype)
                total = part.copy() if total is None else op(total, part, out=total)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"a": [total.tobytes()]})

    for n in (max(1, math.isqrt(shuffle_width(parts.sparkSession))), 1):
        parts = parts.repartition(n).mapInArrow(run, "a binary")
    got = parts.first()
    return np.frombuffer(got[0], dtype) if got else None


def token_frequencies(docs: DataFrame, words: int, key: Key) -> np.ndarray:
    """In how many documents the shingles of each bucket occur; docs is (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for s in shingle_sets(batch.column(1), words, key):
                total += np.bincount(s >> np.uint64(64 - SKETCH_BITS), minlength=len(total)).astype(np.uint32) if len(s) > 4096 else 0
                if len(s) <= 4096:
                    np.add.at(total, s >> np.uint64(64 - SKETCH_BITS), np.uint32(1))
        yield pa.RecordBatch.from_pydict({"a": [total.astype("<u8").tobytes()]})

    got = reduced(docs.mapInArrow(run, "a binary"), "<u8", np.add)
    return got if got is not None else np.zeros(1 << SKETCH_BITS, np.uint64)


def need(n: int, percent: int) -> int:
    """Tokens that a set of n must share with any set it links with."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, frequency: np.ndarray, percent: int) -> tuple[int, np.ndarray]:
    """(l, prefix): the tokens that a set of sorted distinct tokens sends, and how many must match."""
    n = len(tokens)
    if not n:
        return 1, tokens
    often = frequency[tokens >> np.uint64(64 - SKETCH_BITS)]
    order = np.argsort(often, kind="stable")  # ties by the token itself
    t = need(n, percent)
    most = min(MOST_MATCHES, t)
    lists = np.cumsum(often[order[: n - t + most]])
    matches = np.arange(1, most + 1)
    length = n - t + matches
    # a candidate takes l entries of the lists at least, and few share that many by chance; its set has n tokens to send
    cost = length + n * (lists[length - 1] + BY_CHANCE * length) / matches**2
    k = int(np.argmin(cost))
    return int(matches[k]), tokens[order[: length[k]]]


def signatures(tokens: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, equal for equal sets."""
    with np.errstate(over="ignore"):
        a = int(mixed(tokens).sum(dtype=np.uint64))
        b = int(mixed(tokens * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)).sum(dtype=np.uint64))
    return a - (a >> 63 << 64), b - (b >> 63 << 64)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Parities of a set's tokens by their low bits: two sets differ in as many tokens as bits, or more."""
    count = np.bincount((tokens & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS)
    return np.packbits((count & 1).astype(np.uint8)).view("<i8")


def _sets(docs: DataFrame, frequency: np.ndarray, percent: int, words: int, key: Key) -> DataFrame:
    """(id, n, sig1, sig2, matches, prefix, bits) of every document (id, text, and what else is carried along)."""
    carried = docs.columns[2:]
    excess = np.maximum(0.0, frequency.astype(float) - np.median(frequency))  # the rest of a bucket is other tokens
    sent = docs.sparkSession.sparkContext.broadcast(excess)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, matches, kept, bits = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), words, key):
                m, p = prefix(s, sent.value, percent)
                a, b = signatures(s)
                n.append(len(s))
                one.append(a)
                two.append(b)
                matches.append(m)
                kept.append(p.view(np.int64))
                bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(matches, pa.int32()), pa.array(kept, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), *batch.columns[2:]],
                ["id", "n", "sig1", "sig2", "matches", "prefix", "bits", *carried],
            )

    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.schema[2:])
    return docs.mapInArrow(run, f"id bigint, n bigint, sig1 bigint, sig2 bigint, matches int, prefix array<bigint>, bits array<bigint>{more}")


def _filter_places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two places in a filter of 2 ** bits for each id."""
    h = mixed(ids.view(np.uint64) + np.uint64(7))
    return np.stack([h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)]).astype(np.int64)


def _id_filter(ids: DataFrame, most: int) -> tuple[int, np.ndarray] | None:
    """The size, as a power of two, and the bits of a Bloom filter over a column of at most so many ids (null counts as 0)."""
    if most > 1 << FILTER_MOST - 1:
        return None
    size = min(FILTER_MOST, max(16, (FILTER_BITS_EACH * most).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << size, bool)
        for batch in batches:
            bits[_filter_places(batch.column(0).fill_null(0).to_numpy(), size).ravel()] = True
        yield pa.RecordBatch.from_pydict({"a": [np.packbits(bits).tobytes()]})

    got = reduced(ids.mapInArrow(run, "a binary"), "u1", np.bitwise_or)
    return size, got if got is not None else np.zeros((1 << size) // 8, np.uint8)


def _with_set(rows: DataFrame, pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """rows, one for each of pairs, with the tokens t_<side> of one side; a document in very many pairs is dealt out among tasks."""
    many = pairs.groupBy(side).agg((F.count(other) / SET_PAIRS).cast("int").alias("parts")).filter("parts > 0")
    parts = F.coalesce("parts", F.lit(0))
    dealt = rows.join(many, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), parts + 1).cast("int")).drop("parts")
    own = sets.select(F.col("v").alias(side), F.col("tokens").alias(f"t_{side}")).join(many, side, "left")
    return dealt.join(own.withColumn("salt", F.explode(F.sequence(F.lit(0), parts))).drop("parts").hint("merge"), [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, vertices: DataFrame, docs: DataFrame, percent: int, words: int, key: Key) -> DataFrame:
    """Those of pairs (a, b) whose whole sets are alike; their documents' sets are made anew.

    pairs and vertices are to be written tables. Sets travel for the pairs' own documents only.
    """
    about = vertices.select("v", "id", "n", "sig1", "sig2")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(about, "v")
    found = _id_filter(wanted.select("id"), 2 * pairs.count())
    sent_filter = docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple] = set()
        for batch in batches:
            part = batch
            if sent_filter.value is not None:
                size, bits = sent_filter.value
                at = _filter_places(batch.column(0).fill_null(0).to_numpy(), size)
                part = batch.filter(pa.array((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(0)))
            made = []
            for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), words, key), strict=True):
                one, two = signatures(s)
                if (i, one, two) not in sent:  # rows alike in id and text give one set in a task
                    sent.add((i, one, two))
                    made.append((i, one, two, len(s), s.view(np.int64)))
            ids, one, two, n, sets = zip(*made, strict=True) if made else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(list(sets), pa.list_(pa.int64()))], ["id", "n", "sig1", "sig2", "tokens"]
            )

    made = docs.mapInArrow(run, "id bigint, n bigint, sig1 bigint, sig2 bigint, tokens array<bigint>")
    names = [F.coalesce("id", F.lit(0)).alias("k"), "n", "sig1", "sig2"]
    # sets and pairs grow with the documents, so no estimate shall make one side of their joins a broadcast
    sets = made.select(*names, "tokens").join(wanted.select(*names, "v").hint("merge"), ["k", "n", "sig1", "sig2"]).select("v", "tokens")
    both = _with_set(_with_set(pairs.select("a", "b"), pairs, sets, "a", "b"), pairs, sets, "b", "a")
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return both.filter(100 * shared >= percent * (F.size("t_a") + F.size("t_b") - shared)).select("a", "b")


def _may_link(percent: int) -> F.Column:
    """Of two sets that meet in a token, can they still be alike, and this be one of the first matches?

    They must share alpha tokens. The first l shared ones lie in the first n - alpha + l of each,
    each has room there for the others, and the tokens before a match, as far as any other set
    has them, with those from it on must come to alpha. Their bitmaps differ in no more bits than
    the sets in tokens.
    """
    alpha = F.ceil(percent * (F.col("n") + F.col("n2")) / (100 + percent))
    l = F.least("matches", "matches2")  # noqa: E741
    room, room2 = F.col("n") - alpha + l - F.col("pos"), F.col("n2") - alpha + l - F.col("pos2")
    ahead = F.least("q", "q2")
    alike = 100 * F.least("n", "n2") >= percent * F.greatest("n", "n2")
    unlike = reduce(add, [F.bit_count(F.col(f"b{i}").bitwiseXOR(F.col(f"b{i}2"))) for i in range(BITMAP_WORDS)])
    return alike & (unlike <= F.col("n") + F.col("n2") - 2 * alpha) & (room > 0) & (room2 > 0) & (ahead + F.least(room, room2) >= l) & (ahead + F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2")) >= alpha)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90, words: int = 3, key_col: str | None = None) -> DataFrame:
    """(id, n_shingles, component_id) of every document, for links of Jaccard similarity of percent or more.

    Sets are the distinct shingles of so many words, A-Z lower-cased; a text of fewer words is
    one shingle, and one without words, or null, has none and links with nothing. component_id
    is the smallest id that links reach; null ids take part but never name a component unless
    there is no other. Repeated rows stay. An empty df gives no rows. With key_col there are two
    more columns: key, that column of df, and component, a number that tells components apart
    whatever ids they share (null without words). Other columns of df are left out.
    """
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *([F.col(f"`{key_col}`").alias("key")] if key_col else []))
    plain = docs.select("id", "text")
    key = new_key()  # the answer doesn't depend on it
    rows = saved(_sets(docs, token_frequencies(plain, words, key), percent, words, key))
    docs = plain
    sets = ["n", "sig1", "sig2"]
    # equal sets are one vertex; its prefix is the same in each document
    first = rows.filter("n > 0").groupBy(*sets).agg(F.min(F.struct("id", "matches", "prefix", "bits")).alias("x"))
    vertices = saved(first.select(F.monotonically_increasing_id().alias("v"), "x.id", *sets, "x.matches", "x.prefix", "x.bits"))

    # prefixes are in vertices from here on
    used, rows = rows, saved(rows.drop("matches", "prefix", "bits"))
    discard(used)
    posts = vertices.select(F.posexplode("prefix").alias("pos", "token"), "v", "n", "matches")
    # of a list, the set in which the token comes earliest has the fewest tokens of its own: the likeliest original
    of_token = Window.partitionBy("token")
    listed = posts.withColumns({"size": F.count("v").over(of_token), "center": F.min_by("v", "pos").over(of_token)}).filter("size > 1").drop("size")
    before = F.row_number().over(Window.partitionBy("v").orderBy("pos")) - 1
    # q: how many tokens before this one another set may have at all
    posts = saved(listed.withColumn("q", before))

    hits = posts.filter("v <> center").groupBy("v", "matches", "center").count().filter("count >= matches")
    best = hits.groupBy("v").agg(F.max_by("center", "count").alias("c"))
    pairs = saved(best.select(F.greatest("v", "c").alias("a"), F.least("v", "c").alias("b")).distinct())
    links = saved(verified(pairs, vertices, docs, percent, words, key))

    found = connected_components(links).select("v", F.col("root").alias("c"))
    placed = posts.drop("center").join(found, "v", "left").withColumn("c", F.coalesce("c", "v"))
    # tokens that occur in the same vertices, as copies' do, are one list of that many tokens
    same = [F.bit_xor(F.xxhash64("v")).alias("list1"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("list2")]
    mixed_lists = placed.groupBy("token").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), *same).filter("c0 < c1").select("token", "list1", "list2")
    # whatever any token of the list allows, the least pos and the largest q do
    loosest = [F.min("pos").alias("pos"), F.max("q").alias("q"), F.count("token").alias("tokens")]
    left = placed.join(mixed_lists, "token").groupBy("list1", "list2", "v", "c", "n", "matches").agg(*loosest)
    bits = vertices.select("v", *(F.col("bits")[i].alias(f"b{i}") for i in range(BITMAP_WORDS)))
    lists = ["list1", "list2"]
    parts = (F.count("v").over(Window.partitionBy(*lists)) / LIST_ROWS).cast("int")
    left = saved(left.join(bits.hint("merge"), "v").withColumn("parts", parts))
    # nothing below needs prefixes or their lists any more
    discard(posts)
    used, vertices = vertices, saved(vertices.select("v", "id", *sets))
    discard(used)
    other = left.select(*lists, F.explode(F.sequence(F.lit(0), "parts")).alias("salt"), *(F.col(x).alias(f"{x}2") for x in left.columns if x not in (*lists, "parts")))
    own = left.withColumn("salt", F.pmod(F.xxhash64("v"), F.col("parts") + 1).cast("int")).drop("parts")
    met = own.join(other.hint("merge"), [*lists, "salt"]).filter("v > v2 and c <> c2").filter(_may_link(percent))
    more = met.groupBy(F.col("v").alias("a"), F.col("v2").alias("b")).agg(F.sum(F.least("tokens", "tokens2")).alias("k"), F.min(F.least("matches", "matches2")).alias("m")).filter("k >= m").select("a", "b")
    rest = saved(more)
    discard(left)
    if not rest.isEmpty():
        links = saved(links.union(verified(rest, vertices, docs, percent, words, key)))
        found = connected_components(links).select("v", F.col("root").alias("c"))

    known = vertices.select("v", "id", *sets).join(found, "v", "left").withColumn("c", F.coalesce("c", "v"))
    named = known.groupBy("c").agg(F.min("id").alias("component_id"))
    of_set = known.join(named, "c").select(*sets, "component_id", F.col("c").alias("component"))
    more = ["key", "component"] if key_col else []
    return rows.join(of_set, sets, "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), *more)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 90 % of three-word shingles."""
    return jaccard_components(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
