"""How far the sources of a language are apart, by the words they use.

Documents are cut into terms where they lie, and terms are counted per document and summed over each
task, so that one shuffle of these sums by term gives what is kept. What follows works on terms per
language and source, all in whole numbers.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, small_batches

DOCUMENTS = 3  # of a language that must hold a term for it to be kept
TERMS = 200  # terms of a group in the report
UNIT = 1_000_000_000  # shares are in billionths
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
WIDE = "decimal(38,0)"
MARKS = bytes(c for c in range(128) if not chr(c).isalpha())  # ASCII that is in no term
#: what is in no term becomes a space and A-Z its lower case; bytes of other letters, from 128 on, stay
CUT = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))
HELD = 1_000_000  # terms or chunks whose counts a task holds
HELD_BYTES = 64_000_000
COUNTS = "lang string, source string, chunk binary, n bigint, docs bigint, first bigint, last bigint"
# the same as it is shuffled, and compressed: what is alike in most rows lies side by side, and span is last - first
PACKED = "lang string, source string, n bigint, docs bigint, span bigint, chunk binary, first bigint"
SUMS = "lang string, source string, n bigint, docs bigint, term binary"


class _Held:
    """Sums per (lang, source, chunk) of the documents that a task has counted since they were last given out."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[int, dict[bytes, int]]] = {}
        self.chunks: list[bytes] = []
        self.size = 0
        self.group, self.n, self.docs, self.first, self.span = (array("q") for _ in range(5))

    def add(self, lang: str, source: str, row: int, text: bytes) -> None:
        """Count the chunks of a document, without the marks around them, which are in no term.

        For bytes, white space and letters with a lower case are those of ASCII.
        """
        if (lang, source) not in self.groups:
            self.groups[lang, source] = (len(self.groups), {})
        group, places = self.groups[lang, source]
        n, docs, first, span = self.n, self.docs, self.first, self.span
        counted: dict[bytes, int] = {}
        so_far, marks = counted.get, MARKS
        for chunk, times in Counter(text.lower().split()).items():
            chunk = chunk.strip(marks)
            counted[chunk] = so_far(chunk, 0) + times
        counted.pop(b"", None)
        for chunk, times in counted.items():
            if (at := places.get(chunk)) is not None:
                n[at] += times
                docs[at] += 1
                span[at] = row - first[at]
            else:
                places[chunk] = len(n)
                self.chunks.append(chunk)
                self.size += len(chunk)
                self.group.append(group)
                n.append(times)
                docs.append(1)
                first.append(row)
                span.append(0)

    def batch(self) -> pa.RecordBatch:
        names = [pa.array(part, pa.string()) for part in zip(*self.groups)] or [pa.array([], pa.string())] * 2
        group = pa.array(self.group, pa.int64())
        n, docs, span, first = (pa.array(x, pa.int64()) for x in (self.n, self.docs, self.span, self.first))
        columns = [*(x.take(group) for x in names), n, docs, span, pa.array(self.chunks, pa.binary()), first]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "n", "docs", "span", "chunk", "first"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each document counted, then summed per (lang, source, chunk) until too many are held."""
    held = _Held()
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("lang", "source", "row", "text"))):
            held.add(*row)
            if len(held.chunks) >= HELD or held.size >= HELD_BYTES:
                yield held.batch()
                held = _Held()
    yield held.batch()


class _Terms:
    """Sums per (lang, source, term) of the documents that a task has counted since they were last given out."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[int, dict[bytes, int]]] = {}
        self.terms: list[bytes] = []
        self.size = 0
        self.group, self.n, self.docs = (array("q") for _ in range(3))

    def add(self, lang: str, source: str, text: bytes) -> None:
        if (lang, source) not in self.groups:
            self.groups[lang, source] = (len(self.groups), {})
        group, places = self.groups[lang, source]
        n, docs, place = self.n, self.docs, places.get
        for term, times in Counter(text.translate(CUT).split()).items():
            if (at := place(term)) is not None:
                n[at] += times
                docs[at] += 1
            else:
                places[term] = len(n)
                self.terms.append(term)
                self.size += len(term)
                self.group.append(group)
                n.append(times)
                docs.append(1)

    def batch(self) -> pa.RecordBatch:
        names = [pa.array(part, pa.string()) for part in zip(*self.groups)] or [pa.array([], pa.string())] * 2
        group = pa.array(self.group, pa.int64())
        columns = [*(x.take(group) for x in names), *(pa.array(x, pa.int64()) for x in (self.n, self.docs)), pa.array(self.terms, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "n", "docs", "term"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each document counted, then summed per (lang, source, term) until too many are held."""
    held = _Terms()
    for batch in batches:
        for row in zip(*(batch[c].to_pylist() for c in ("lang", "source", "text"))):
            held.add(*row)
            if len(held.terms) >= HELD or held.size >= HELD_BYTES:
                yield held.batch()
                held = _Terms()
    yield held.batch()


def _group() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a number for each, ``row``, rising within a task.

    Numbers are as small as the rows are few, as their squares are summed and many are shuffled: the place within
    the task times the number of tasks, plus the task.
    """
    tasks = rows.rdd.getNumPartitions()  # of the plan: nothing runs for it
    number = F.monotonically_increasing_id()
    place = number.bitwiseAND(F.lit((1 << 33) - 1))  # fixed by Spark: the task is above the low 33 bits
    task = F.shiftright(number, 33)
    known = F.when(task < tasks, place * tasks + task).otherwise(F.raise_error(F.lit("more tasks than planned")))
    return rows.withColumn("row", known.cast("bigint"))


def term_sums(docs: DataFrame) -> DataFrame:
    """Sums (lang, source, term, n, docs), one row for each term of a group, all rows of a term in a
    language in one partition: n occurrences in docs documents; term in UTF-8.

    A document is counted in one task and as a whole, so documents add up without being told apart.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = small_batches(docs).select(*_group(), text.alias("text"))
    dealt = rows.mapInArrow(_sum, SUMS).repartition("lang", "term")
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def chunk_counts(docs: DataFrame) -> DataFrame:
    """Sums (lang, source, chunk, n, docs, first, last), one row or more for each chunk of a group, all
    rows of a chunk in one partition: n occurrences in docs documents, from row first to row last."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = small_batches(docs).select(*_group(), text.alias("text"))
    dealt = _numbered(rows).mapInArrow(_count, PACKED).repartition("chunk")
    return dealt.withColumn("last", F.col("first") + F.col("span")).select("lang", "source", "chunk", "n", "docs", "first", "last")


def term_counts(sums: DataFrame) -> DataFrame:
    """Per (lang, source, term): n occurrences, and docs, the number of documents with it, 3 for 3 or more.

    All sums of a chunk are in one partition. They become one row per distinct chunk, which holds at most one
    entry for each group and is cut into terms once; its terms then go with each of its entries.

    Documents of a chunk with 3 or more settle the number for its terms. Else first and last name all
    of them, and over the chunks of a term it takes the smallest and the largest that are named to know if there
    is one between: the sum of (x - smallest) (largest - x) is 0 only if there is none, and it
    follows from the sums of x and its square. So documents are counted without being listed.
    """
    chunks = sums.groupBy("lang", "source", "chunk").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.min("first").alias("first"), F.max("last").alias("last")
    )
    entry = F.struct("lang", "source", "n", "docs", "first", "last")
    distinct = chunks.groupBy("chunk").agg(F.collect_list(entry).alias("entries"))
    terms = F.regexp_extract_all(F.col("chunk").cast("string"), F.lit(TERM), F.lit(0))
    each = distinct.select(F.explode(terms).alias("term"), "entries").select("term", F.inline("entries"))
    few = F.col("docs") < 3
    ends = [F.col(c).cast(WIDE) for c in ("first", "last")]
    found = each.groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"),
        F.min("first").cast(WIDE).alias("low"),
        F.max("last").cast(WIDE).alias("high"),
        F.max("docs").alias("most"),
        F.sum(F.when(few, 2)).alias("named"),
        F.sum(F.when(few, ends[0] + ends[1])).alias("one"),
        F.sum(F.when(few, ends[0] * ends[0] + ends[1] * ends[1])).alias("two"),
    )
    low, high, named = F.col("low"), F.col("high"), F.col("named").cast(WIDE)
    between = F.col("one") * (low + high) - F.col("two") - named * low * high
    docs = F.when(F.col("most") > 2, 3).when(low == high, 1).when(between > 0, 3).otherwise(2)
    return found.select("lang", "source", "term", "n", docs.alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)), in decimals as the product can pass 64 bits."""
    share = F.lit(UNIT).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", share, (total + terms).cast("decimal(20,0)")) + 1


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); shares are at most UNIT + 1, so it fits into 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _groups(docs: DataFrame, kept: DataFrame, uses: DataFrame) -> DataFrame:
    """Per occurring (lang, source): its kept terms in use and their occurrences, those of the language, and
    ``zero``, the share of a term that it does not have; null where the language keeps none."""
    used = uses.groupBy("lang", "source").agg(F.count("*").alias("used"), F.sum("n").alias("sum"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_sum"))
    both = docs.select(*_group()).distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    zero = _share(F.lit(0).cast("bigint"), F.col("sum"), F.col("terms"))
    return both.fillna(0, ["used", "sum"]).withColumn("zero", zero)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each ordered pair of sources of a language.

    A term in neither source, or in one of them, has the share of a count of 0 there, which is one
    number per source. So the sum over all terms is a sum over terms in both, corrected
    for what sums over the terms of each source, by the number of occurrences, have said of them. A term
    holds as many entries as it has sources, and their pairs are summed where they are made.
    """
    a, b = F.col("a"), F.col("b")
    groups = groups.select("lang", F.struct("source", "terms", "used", "zero").alias("group"))
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    alike = alike.select("lang", F.struct("source", "p", "n").alias("group"))
    held = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("held"))
    met = held.select("lang", F.explode("held").alias("a"), "held").select("lang", "a", F.explode("held").alias("b"))

    def sides(left: DataFrame, right: DataFrame) -> DataFrame:
        return left.withColumnRenamed("group", "a").join(right.withColumnRenamed("group", "b"), "lang")

    both = _gap(a.p, b.p) - _gap(a.p, b.zero) - _gap(a.zero, b.p) + _gap(a.zero, b.zero)
    parts = [
        (met, both),
        (sides(alike, groups), a.n * _gap(a.p, b.zero)),
        (sides(groups, alike), b.n * _gap(a.zero, b.p)),
        (sides(groups, groups), F.coalesce((a.terms - a.used - b.used) * _gap(a.zero, b.zero), F.lit(0))),
    ]
    sums = [
        part.filter(a.source != b.source)
        .groupBy("lang", a.source.alias("source"), b.source.alias("item"))
        .agg(F.sum(value).alias("value"))
        for part, value in parts
    ]
    together = sums[0].unionByName(sums[1]).unionByName(sums[2]).unionByName(sums[3])
    return together.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, documents: int = DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    Part ``pair``: ``item`` is each other source of the language, ``value`` how far the group's shares of
    all kept terms are from those of that source. Part ``term``: the ``terms`` kept terms whose share in
    the group exceeds that in the language most. Ranks go by value, then by item in UTF-8.

    Null text, lang and source count as empty. Each row is a document of its own, also when it
    repeats an id or has none; ids are not read. A group without terms still has its pairs; a
    language without kept terms has pairs of value 0 and no terms; a group alone in its language has no
    pairs. An empty table gives no rows. Other columns are ignored.

    Tables of terms and of shares are written to the shared folder, each far smaller than the texts and
    read more than once. The pairs are as many as the result has; no task holds the terms of a group, as
    the best are chosen before they are shuffled.
    """
    if not 1 <= documents <= 3:
        raise ValueError("documents of a term are told apart up to three")
    # a document has one source, so those of a language add up
    kept = term_sums(docs).groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("uses")
    )
    kept = kept.filter(F.col("docs") >= documents).select("lang", F.col("term").cast("string").alias("term"), "total", "uses")
    kept = materialize(kept, "kept-terms")
    uses = kept.select("lang", "term", "total", F.inline("uses"))
    groups = materialize(_groups(docs, kept, uses), "groups")
    n, total = F.col("n"), F.col("total")
    shares = uses.join(groups, ["lang", "source"]).select(
        "lang",
        "term",
        "source",
        _share(n, F.col("sum"), F.col("terms")).alias("p"),
        "zero",
        _share(total, F.col("lang_sum"), F.col("terms")).alias("q"),
    )
    shares = materialize(shares, "shares")
    pairs = _pairs(groups, shares.drop("q"))
    apart = shares.filter(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), _gap(F.col("p"), F.col("q")).alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(part: str, found: DataFrame) -> DataFrame:
        numbered = found.withColumn("rank", F.row_number().over(order))
        return numbered.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")

    return ranked("pair", pairs).unionByName(ranked("term", apart).filter(F.col("rank") <= terms))
