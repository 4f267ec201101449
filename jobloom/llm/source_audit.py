"""How sources of a language diverge: which sources differ most, and by which terms.

Terms are counted within tasks first, so a hot source or a frequent term sends one row a task.
The divergence of two sources is the sum over all kept terms, most of which neither has: the sum
starts from what a term without occurrences adds, and is corrected for the terms that one of
them has, by their distinct counts, and for those that both have, by the terms themselves. All
arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, table
from .radix_select import top_k

#: Documents of a language that a kept term has to be in, and terms that are reported for a source.
LEAST_DOCUMENTS, TOP_TERMS = 3, 200
#: A share of 1 as an integer.
WHOLE = 1_000_000_000
#: Distinct terms that a task holds before it passes them on, bytes of text at a time, and pairs of sources before they are passed on.
HELD_TERMS, SLICE_BYTES, HELD_PAIRS = 600_000, 1 << 20, 1 << 20
#: Bits of a number that count documents; the rest count occurrences. No task comes near either bound.
DOC_BITS = 30
#: A-Z become a-z; bytes that are no part of a term become spaces.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

GROUP = ["lang", "source"]


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    data = text.encode().translate(TERM_BYTES)
    lo = 0
    while lo < len(data):
        hi = data.find(b" ", lo + SLICE_BYTES)
        hi = len(data) if hi < 0 else hi
        yield data[lo:hi].split()
        lo = hi


def count_terms(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that have it.

    Null texts, langs and sources are ''. Each group has a row with a null term besides, so
    groups without terms are there too. Repeated rows count as documents of their own, other
    columns are left out, and an empty df gives no rows. Rows of a language and a term lie together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}  # occurrences and documents in one number
        size = 0

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in held.items():
                packed = np.fromiter(found.values(), np.int64, len(found))
                names = [None, *found]
                found.clear()
                n, docs = (np.concatenate([[0], x]) for x in (packed >> DOC_BITS, packed & ((1 << DOC_BITS) - 1)))
                for i in range(0, len(names), 20_000):
                    part = slice(i, i + 20_000)
                    term = pa.array(names[part], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang), len(term)), pa.repeat(pa.scalar(source), len(term)), term, pa.array(n[part]), pa.array(docs[part])], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*batch.columns, strict=True):
                found = held.setdefault((lang.as_py(), source.as_py()), {})
                size -= len(found)
                own: Counter = Counter()
                for words in terms_of(text.as_py()):
                    own.update(words)
                for term, n in own.items():
                    found[term] = found.get(term, 0) + (n << DOC_BITS | 1)
                size += len(found)
                if size > HELD_TERMS:
                    yield from passed_on()
                    size = 0
        yield from passed_on()

    rows = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = rows.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    # tasks have added up what they can: the rows are dealt out as they are, by what the next steps need together
    return counted.repartition("lang", "term").groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


#: Counts below this can be multiplied by WHOLE.
SMALL = 9_000_000_000


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + terms)); for large counts by long division in steps of 1000, so nothing overflows."""
    div = lambda x, y: F.call_function("div", x, y)
    by = F.greatest(F.lit(1), total + terms)
    whole = F.when(n + 1 >= by, 1).otherwise(0).cast("bigint")  # 1 where the only kept term is all there is
    rest = n + 1 - whole * by
    for _ in range(3):
        step = rest * 1000
        digit = div(step, by)
        whole, rest = whole * 1000 + digit, step - digit * by
    return F.when(n < SMALL, div((n + 1) * WHOLE, by)).otherwise(whole) + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def both_have(rated: DataFrame) -> DataFrame:
    """rated (lang, source, term, p, p0) -> (lang, source, item, value): what terms that two sources both have add to their sum, beyond what is counted for either.

    Terms lie together; a task compares the sources of each, and adds up for each pair of sources before anything is passed on.
    """

    def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        names: list[tuple[str, str]] = []
        keys, sums = np.empty(0, np.int64), np.empty(0, np.int64)
        square = np.zeros((0, 0), np.int64)  # the sums of all pairs, while they are few enough to be held

        def added(keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, where = np.unique(keys, return_inverse=True)
            total = np.zeros(len(found), np.int64)
            np.add.at(total, where, sums)
            return found, total

        def passed_on(a: np.ndarray, b: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            cols = [[names[i][0] for i in a], [names[i][1] for i in a], [names[i][1] for i in b]]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array(sums)], ["lang", "source", "item", "value"])

        kept = None
        for batch in _with_end(batches):
            rows = kept if batch is None else pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            if rows is None or not len(rows):
                continue
            rows = rows.combine_chunks()
            lang, source = (rows[c].combine_chunks().dictionary_encode() for c in GROUP)
            term = rows["term"].combine_chunks()
            at = lang.indices.to_numpy().astype(np.int64)
            n = len(rows)
            new = np.ones(n, bool)
            if n > 1:
                new[1:] = (at[1:] != at[:-1]) | ~pc.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)
            if batch is None:
                kept = None
            else:  # the last term's rows may go on in the next batch
                n = int(np.flatnonzero(new)[-1])
                kept = rows.slice(n)
            if not n:
                continue
            of = np.cumsum(new[:n])
            width = len(source.dictionary)
            code = at[:n] * width + source.indices.to_numpy()[:n]
            known = np.zeros(len(lang.dictionary) * width, np.int64)
            for c in np.flatnonzero(np.bincount(code, minlength=len(known))).tolist():
                x = lang.dictionary[c // width].as_py(), source.dictionary[c % width].as_py()
                if x not in number:
                    number[x] = len(names)
                    names.append(x)
                known[c] = number[x]
            who = known[code]
            if len(square) < len(names) and len(names) ** 2 <= HELD_PAIRS:
                square = np.pad(square, (0, min(2 * len(names), int(HELD_PAIRS**0.5)) - len(square)))
            held = len(names) <= len(square)
            p, p0 = (rows[c][:n].to_numpy() for c in ("p", "p0"))
            for d in range(1, int(np.bincount(of).max())):
                i = np.flatnonzero(of[d:] == of[:-d])
                for x, y in ((i, i + d), (i + d, i)):
                    value = gaps(p[x], p[y]) - gaps(p[x], p0[y]) - gaps(p0[x], p[y]) + gaps(p0[x], p0[y])
                    if held:
                        np.add.at(square.reshape(-1), who[x] * len(square) + who[y], value)
                        continue
                    k, s = added(who[x] << 32 | who[y], value)
                    keys, sums = np.concatenate([keys, k]), np.concatenate([sums, s])
                if len(keys) > HELD_PAIRS:
                    keys, sums = added(keys, sums)
                    if len(keys) > HELD_PAIRS // 2:
                        yield passed_on(keys >> 32, keys & 0xFFFFFFFF, sums)
                        keys, sums = keys[:0], sums[:0]
        keys, sums = added(keys, sums)
        if len(keys):
            yield passed_on(keys >> 32, keys & 0xFFFFFFFF, sums)
        a, b = np.nonzero(square)
        if len(a):
            yield passed_on(a, b, square[a, b])

    dealt = rated.select("lang", "source", "term", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return dealt.mapInArrow(run, "lang string, source string, item string, value bigint")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def divergence(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for each group of a language and a source.

    Part 'pair' ranks the language's other sources by the divergence from them, all of them; part
    'term' ranks the terms that the source has more often than its language has, the top first.
    Terms in fewer than least documents of the language don't count; a language without others
    has divergences of 0. Nulls are ''; repeated rows are documents of their own; a df without rows gives none.
    """
    alike = Window.partitionBy("lang", "term")
    counts = count_terms(df, text_col, lang_col, source_col).withColumns({
        "n_lang": F.sum("n").over(alike), "docs": F.sum("docs").over(alike), "sources": F.count("source").over(alike), "leads": (F.col("source") == F.min("source").over(alike)).cast("int"),
    })
    counts = saved(counts.filter(F.col("term").isNull() | (F.col("docs") >= least)).drop("docs"), "counts")
    kept = counts.filter("term is not null")
    # a term is counted for the language with one of its sources; rows without a term have an n of 0
    groups = saved(counts.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.sum(F.when(F.col("term").isNull(), 0).otherwise(F.col("leads"))).alias("leads")), "groups")
    langs = groups.groupBy("lang").agg(F.sum("leads").alias("terms"), F.sum("total").alias("total_lang"))
    groups = saved(groups.drop("leads").join(langs, "lang").withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")

    rated = kept.join(groups, GROUP).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    q = share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    over = rated.withColumn("q", q).filter("p > q").select(*GROUP, F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    term = top_k(over, GROUP, top).select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")

    own, other = groups.alias("a"), groups.alias("b")
    pairs = own.join(other, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    base = pairs.select("a.lang", "a.source", F.col("b.source").alias("item"), (F.col("a.terms") * gap(F.col("a.p0"), F.col("b.p0"))).cast("decimal(38,0)").alias("value"))
    levels = rated.groupBy(*GROUP, "p", "p0").agg(F.count("term").alias("m")).alias("a")
    met = levels.join(other, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source")))
    p, p0, o = F.col("a.p"), F.col("a.p0"), F.col("b.p0")
    ways = F.array(
        F.struct(F.col("a.source").alias("source"), F.col("b.source").alias("item"), (F.col("m") * (gap(p, o) - gap(p0, o))).alias("value")),
        F.struct(F.col("b.source").alias("source"), F.col("a.source").alias("item"), (F.col("m") * (gap(o, p) - gap(o, p0))).alias("value")),
    )
    one = met.select("a.lang", F.explode(ways).alias("w")).select("lang", "w.source", "w.item", F.col("w.value").cast("decimal(38,0)").alias("value"))
    two = both_have(rated.filter("sources > 1")).withColumn("value", F.col("value").cast("decimal(38,0)"))
    summed = base.union(one).union(two).groupBy(*GROUP, "item").agg(F.sum("value").cast("bigint").alias("value"))
    # all sources of a language are ranked against each: as many rows as the answer has
    pair = summed.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item"))).select(*GROUP, F.lit("pair").alias("part"), "item", "value", "rank")
    return pair.union(term)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sources, audited language by language."""
    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 3
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counted GROUP BY lang, source
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), ranked AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM cells WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM ranked) WHERE part = 'pair' OR rank <= 200
"""
