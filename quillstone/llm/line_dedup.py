"""Line dedup by winnowing over line hashes.

A text is the sequence of its lines that hold a word. From each line a seed
window runs over as many lines as hold ``SEED`` words; among the seeds that start
within ``SPAN`` words of a line the one of least hash is selected, so that any
two equal runs of ``SEED + SPAN - 1`` words or more select equal fingerprints at
equal places. Only positions whose fingerprint is met at another one go on: they
are extended both ways, to ``RUN`` words from the line on that selected them and
up to the line at which these end, and positions with equal extensions are joined
to the first of them. Such matches of one document with another at one distance
are run together to maximal matches. What a match covers is deleted; the first
occurrence, by id and position, stays. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import WORD, materialise, release

#: Words of a seed window, words within which one seed is selected, and words from which on a run counts.
SEED, SPAN, RUN = 25, 26, 50
DOC = ["id", "text_key"]


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def _window(kind: str, words: int) -> Window:
    """Lines from this one on, or up to this one, as far as it takes for so many words."""
    whole = Window.partitionBy(*DOC)
    return whole.orderBy("start").rangeBetween(0, words - 1) if kind == "on" else whole.orderBy("end").rangeBetween(1 - words, 0)


def _content(frame: Window, words: int) -> Column:
    """Hash of the lines in the frame, null if they hold fewer words."""
    return F.when(F.sum("words").over(frame) >= words, F.xxhash64(F.collect_list("hash").over(frame)))


def fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Lines with a word: id, text_key, at (line number), hash, words, start and end (words before and up to the line's end), and the seed that each selects with its place, ties going to the last."""
    numbered = F.transform(F.split(text_column, "\n"), lambda line, i: F.struct(i.alias("at"), F.xxhash64(_trimmed(line)).alias("hash"), F.regexp_count(line, F.lit(WORD)).alias("words")))
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"), F.filter(numbered, lambda x: x["words"] > 0).alias("lines"))
    # rows with equal id and text are one document
    once = texts.dropDuplicates(DOC).select(*DOC, F.explode("lines").alias("x")).select(*DOC, "x.at", "x.hash", "x.words")
    end = F.sum("words").over(Window.partitionBy(*DOC).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    lines = once.withColumn("end", end).withColumn("start", F.col("end") - F.col("words"))
    seeds = lines.withColumn("own", _content(_window("on", SEED), SEED))
    least = F.min(F.when(F.col("own").isNotNull(), F.struct("own", (-F.col("start")).alias("back")))).over(_window("on", SPAN))
    return seeds.withColumn("least", least).select(*DOC, "at", "hash", "words", "start", "end", F.col("least.own").alias("seed"), (-F.col("least.back")).alias("seed_at"))


def met(lines: DataFrame) -> DataFrame:
    """id, text_key and seed of the fingerprints that are selected at two positions or more."""
    positions = lines.filter(F.col("seed").isNotNull()).select("seed", *DOC, "seed_at").distinct()
    often = positions.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("seed")
    return positions.join(often, "seed").select(*DOC, "seed").distinct()


def extensions(lines: DataFrame, seeds: DataFrame) -> DataFrame:
    """id, text_key, start and end (words), first and last (line numbers), and content of each met fingerprint extended both ways.

    From the line on that selected it, and up to each line that, of lines that
    selected a met one, is the end of so many words.
    """
    found = seeds.withColumnsRenamed({"id": "id_", "text_key": "text_key_", "seed": "seed_"}).withColumn("hit", F.lit(True))
    on = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("text_key_")) & (F.col("seed") == F.col("seed_"))
    near = lines.join(found, on, "left").select(*lines.columns, "hit")
    near = near.withColumn("any", F.max("hit").over(Window.partitionBy(*DOC))).filter("any").drop("any", "seed", "seed_at")
    ahead, back = _window("on", RUN), _window("back", RUN)
    # the line that a window up to this one begins with has selected the seed that lies in it
    both = near.withColumns(
        {
            "on": F.when(F.col("hit"), F.struct("start", F.max("end").over(ahead).alias("end"), F.col("at").alias("first"), F.max("at").over(ahead).alias("last"), _content(ahead, RUN).alias("content"))),
            "back": F.when(F.first("hit").over(back), F.struct(F.min("start").over(back).alias("start"), "end", F.min("at").over(back).alias("first"), F.col("at").alias("last"), _content(back, RUN).alias("content"))),
        }
    )
    each = both.select(*DOC, F.explode(F.array_distinct(F.array("on", "back"))).alias("x")).filter("x.content IS NOT NULL")
    return each.select(*DOC, "x.start", "x.end", "x.first", "x.last", "x.content").distinct()


def matches(windows: DataFrame) -> DataFrame:
    """id, text_key, first, last, from_id, from_text_key and shift: maximal matches with what the first of equal extensions begins, ``shift`` words before."""
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key", "start")
    first = windows.groupBy("content").agg(F.min(place).alias("origin"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("content", "origin")
    # a table, so that a content that very many positions share is split between tasks when it is joined
    first = materialise(first, "dedup-origins")
    joined = windows.join(first.hint("merge"), "content").filter(place != F.col("origin"))
    pairs = joined.select(*DOC, "start", "end", "first", "last", F.col("origin.id").alias("from_id"), F.col("origin.text_key").alias("from_text_key"), (F.col("start") - F.col("origin.start")).alias("shift"))
    together = ["from_id", "from_text_key", "shift"]
    order = Window.partitionBy(*DOC, *together).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = pairs.repartition(*DOC).withColumn("opens", F.when(F.col("start") <= before, 0).otherwise(1)).withColumn("island", F.sum("opens").over(order))
    return islands.groupBy(*DOC, *together, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def repeated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, text_key, and ``spans``: the spans of line numbers that matches cover, sorted and apart, of documents that have any."""
    lines = materialise(fingerprints(docs, id_column, text_column), "dedup-lines")
    windows = materialise(extensions(lines, met(lines)), "dedup-windows")
    found = matches(windows).groupBy(*DOC).agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans"))
    nothing = F.slice(F.col("spans"), 1, 0)

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (span["first"] <= F.get(done, F.size(done) - 1)["last"] + 1)
        longer = F.array(F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last")))
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.concat(done, F.array(span)))

    spans = materialise(found.withColumn("spans", F.aggregate("spans", nothing, add)), "dedup-spans")
    release(lines, windows)
    return spans


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lines_column: str = "n_lines_", removed_column: str = "n_removed_") -> DataFrame:
    """``docs`` with the text less its repeated runs, and two columns more: the lines of the text and the lines deleted.

    Lines compare without white space at their ends; lines without a word are
    passed over and stay. A null text stays null and an empty one empty. Rows with
    equal id and text are one document and lose the same lines; a null id comes
    after all others; texts with equal ids follow in the order of their hashes.
    Runs repeated within a text go too. An empty table gives no rows. Further
    columns stay as they are, whatever their names; one named like the columns
    added is an error, so name these apart.
    """
    for name in (lines_column, removed_column):
        if name.lower() in {c.lower() for c in docs.columns}:
            raise ValueError(f"the documents have a column {name}")
    spans = repeated(docs, id_column, text_column).withColumnsRenamed({"id": "id_", "text_key": "text_key_"})
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_key"))
    on = F.col("id").eqNullSafe(F.col("id_")) & (F.col("text_key") == F.col("text_key_"))
    text = F.col("doc").getField(text_column)
    lines = F.split(text, "\n")
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["last"] + 1))
    ends = F.concat(F.transform("spans", lambda s: s["first"]), F.array(F.size(lines)))
    pieces = F.arrays_zip(starts.alias("a"), ends.alias("b"))
    between = F.transform("spans", lambda s: F.filter(F.slice(lines, s["first"] + 1, s["last"] - s["first"] + 1), lambda x: ~x.rlike(WORD)))
    # what lies between the spans, each followed by the lines without a word within the next one
    outside = F.transform(pieces, lambda k, i: F.concat(F.slice(lines, k["a"] + 1, k["b"] - k["a"]), F.coalesce(F.get(between, i), F.array().cast("array<string>"))))
    kept = F.flatten(outside)
    changed = F.col("spans").isNotNull()
    named = [F.when(changed, F.array_join("kept", "\n")).otherwise(text).alias(c) if c == text_column else F.col("doc").getField(c).alias(c) for c in docs.columns]
    joined = keyed.join(spans.hint("merge"), on, "left").select("doc", "spans", F.when(changed, kept).alias("kept"))
    count = F.coalesce(F.size(lines), F.lit(0))
    return joined.select(*named, count.alias(lines_column), F.when(changed, count - F.size("kept")).otherwise(0).alias(removed_column))
