"""What each filter removes, in every order in which filters can be applied.

Orders form a trie: a path from its root applies filters one after the other,
an edge is one filter applied to the survivors of those before it. Which rows
survive doesn't depend on the order of the filters before, so the nodes of one
unordered set of filters share one state: with k filters there are 2^k states
for k! orders. States are visited depth first. A state is a persisted table of
survivors, cut from its parent's; it is dropped once everything below it is
counted, so at most k of them are held at once. One aggregation of a state
counts, for all edges out of it, what the filter really removes from these
survivors. Orders, redundancy and Shapley sums are read from the edges.

Survivors carry no text: measures are taken in one scan, and what fails is a
bit each. That table is written to the shared folder, so the survivors of a
lost executor are cut from it again.

Copies are found by 128 bits of hash and the length of the text. Rows of one
text are dealt out over cells, counted per cell and then per text, so a text
that a third of all rows share is spread over at least :data:`CELLS` groups.

Defined results: a null text is an empty one, and so the copy of any other; a
null doc_id is less than all others, and rows of one doc_id aren't copies of
each other; a null lang is the empty string, as is an empty one; documents
without a label are neither good nor toxic, and a label that occurs several
times counts if any of its rows has a 1; labels of null ids belong to nothing;
a text of any length is measured as a whole; empty tables have no parts; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial
from string import ascii_uppercase

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fundflow.llm.common import SPACE_CLASS, discard, only, stored

#: What a filter rejects, by letter, in terms of :data:`MEASURES`.
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_capitals > 3 * n_chars",
    "D": "has_symbol",
    "E": "is_copy",
}
MEASURES = ("n_words", "n_distinct", "n_chars", "n_capitals", "has_symbol", "is_copy")
SYMBOLS = "[#$%&*|]"
#: Rows of one text that share a group, and the least number of groups.
CELL_ROWS, CELLS = 50_000, 64
COUNTS = ("n", "removed", "good_lost", "toxic_lost")


def _long(c: Column) -> Column:
    return c.cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, part, the measures of the text alone, its hashes."""
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), "")
    sizes = F.transform(F.array(words), lambda w: F.struct(_long(F.size(w)).alias("n_words"), _long(F.size(F.array_distinct(w))).alias("n_distinct")))[0]
    rows = only(docs, "doc_id", "text", "lang").select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), sizes.alias("s"), _long(F.length(text)).alias("n_chars"),
        _long(F.octet_length(text) - F.octet_length(F.translate(text, ascii_uppercase, ""))).alias("n_capitals"), text.rlike(SYMBOLS).alias("has_symbol"),
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"),
    )
    return rows.select("doc_id", "part", "s.*", *[c for c in rows.columns if c not in ("doc_id", "part", "s")])


def with_copies(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`measured`, with is_copy: some row of a lesser doc_id
    has the same text."""
    cells = max(CELLS, rows.count() // CELL_ROWS)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "place"), F.lit(cells))).withColumn("id", F.struct(F.col("doc_id").isNotNull(), "doc_id"))
    text = ["a", "b", "n_chars"]
    per_cell = rows.groupBy(*text, "cell").agg(F.count("*").alias("k"), F.min("id").alias("first"))
    several = per_cell.groupBy(*text).agg(F.sum("k").alias("k"), F.min("first").alias("first"), F.collect_list("cell").alias("cells")).where("k > 1")
    firsts = several.select(*text, "first", F.explode("cells").alias("cell"))
    return rows.join(firsts, [*text, "cell"], "left").withColumn("is_copy", F.coalesce(F.col("first") < F.col("id"), F.lit(False)))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with ``good`` and ``toxic``, each 0 or 1."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    known = only(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    keyed = known.withColumnRenamed("doc_id", "_id").withColumn("_none", F.lit(False))
    # rows without an id match nothing and are dealt by their text
    both = rows.join(keyed, (F.coalesce("doc_id", "a") == F.col("_id")) & (F.col("doc_id").isNull() == F.col("_none")), "left")
    return both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")}).drop("_id", "_none")


def failures(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, part, good, toxic and ``bits`` (bit i: the i-th filter
    rejects the row), as a table in the shared folder."""
    filters = filters or FILTERS
    rows = stored(measured(docs).withColumn("place", F.monotonically_increasing_id()), "audit-measures")
    bits = sum((F.when(F.expr(rule), 1 << i).otherwise(0) for i, rule in enumerate(filters.values())), F.lit(0))
    out = stored(with_labels(with_copies(rows), labels).select("doc_id", "part", "good", "toxic", bits.alias("bits")), "audit-failures")
    discard(rows)
    return out


def _out_of(survivors: DataFrame, state: int, left: list[int]) -> DataFrame:
    """The edges out of a state: part, state, filter and :data:`COUNTS`."""
    gone = {i: F.col("bits").bitwiseAND(1 << i) != 0 for i in left}
    how_many = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    counted = survivors.groupBy("part").agg(
        F.count("*").alias("n"), *[how_many(c & more).alias(f"{name}{i}") for i, c in gone.items() for name, more in (("removed", F.lit(True)), ("good_lost", F.col("good") == 1), ("toxic_lost", F.col("toxic") == 1))]
    )
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("filter"), *[F.col(f"{c}{i}").alias(c) for c in COUNTS[1:]]) for i in left])).alias("e")
    return counted.select("part", F.lit(state).alias("state"), "n", each).select("part", "state", "e.filter", "n", *[f"e.{c}" for c in COUNTS[1:]])


def edges(failed: DataFrame, k: int) -> DataFrame:
    """Every edge of the trie, once per unordered state, in the shared folder;
    parts without survivors have no rows."""
    seen: set[int] = set()
    counted: list[DataFrame] = []

    def visit(rows: DataFrame, state: int) -> None:
        seen.add(state)
        if not (left := [i for i in range(k) if not state >> i & 1]):
            return
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        counted.append(stored(_out_of(rows, state, left), "audit-edges"))
        for i in left:
            if (below := state | 1 << i) not in seen:
                visit(rows.where(F.col("bits").bitwiseAND(1 << i) == 0), below)
        rows.unpersist()

    visit(failed.select("part", "good", "toxic", "bits"), 0)
    out = stored(reduce(DataFrame.unionByName, counted), "audit-edges")
    discard(*counted)
    return out


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order,
    step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    filters = filters or FILTERS
    k, names = len(filters), list(filters)
    failed = failures(docs, labels, filters)
    found = edges(failed, k)
    discard(failed)
    # every part has every edge, with zeros where nothing is left to remove
    whole = found.where("state = 0").select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit((1 << k) - 1))).alias("state"))
    whole = whole.select("part", "state", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("filter")).where(F.getbit("state", "filter") == 0)
    counts = whole.join(found, ["part", "state", "filter"], "left").fillna(0, COUNTS)
    of = Window.partitionBy("part", "filter")
    where_state = lambda s: F.max(F.when(F.col("state") == s, F.col("removed"))).over(of)
    alone = F.lit((1 << k) - 1).bitwiseXOR(F.call_function("shiftleft", F.lit(1), F.col("filter")))
    before = F.bit_count("state")
    orders = F.element_at(F.array(*[F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)]), (before + 1).cast("int"))  # that pass this edge
    edge = counts.select(
        "part", "state", "filter", (F.col("n") - F.col("removed")).alias("kept"), "removed", (where_state(F.lit(0)) - F.col("removed")).alias("redundant"),
        where_state(alone).alias("unique_fails"), "good_lost", "toxic_lost", F.sum(F.col("removed") * orders).over(of).alias("shapley"),
    )
    steps = [("".join(names[i] for i in order), step + 1, sum(1 << i for i in order[:step]), order[step]) for order in permutations(range(k)) for step in range(k)]
    trie = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return edge.join(F.broadcast(trie), ["state", "filter"]).select("part", "filter_order", "step", *edge.columns[3:])
