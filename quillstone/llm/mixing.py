"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source is to be taken ``target / source size`` times. The
whole part is taken by all; the fractional parts are rounded in pairs: words of
one of a pair are moved to the other, up or down at random with the chances that
leave both expectations as they are, until one of the two is integral; the other
goes on. A pair's expected words never change, so a source ends off its target by
the last open document alone.

Documents that are large in their source are rounded first, the largest before
others, so that what the last of them leaves over is spread over all smaller ones,
whose chances it shifts evenly. The small ones are rounded in blocks, and what
each block has left over goes up a tree of blocks, a few levels for any input. All
of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.llm.common import WORD, materialise

#: Documents of a block, about; also how many blocks share one of the next level.
FAN = 64
#: Large documents have more than one in so many of their source's words, by falling size; a source has fewer than that of each kind.
LARGE = (8, 64, 256)


def words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """source, source_size, weight, target: by weight, at most ``most`` times the size, the excess reshared.

    Sources in code-point order, null last, take the weights in turn. With caps
    in rising order of cap per weight, a source is capped just if the share that
    is left for it and those after it exceeds its cap. The table has one row per
    source.
    """
    stats = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    stats = stats.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumns({"size_all": F.sum("source_size").over(everything).cast("double"), "weight_all": F.sum("weight").over(everything)})
    stats = stats.withColumns({"size_left": F.col("size_all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weight_left": F.col("weight_all") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    stats = stats.withColumn("capped", F.col("size_left") * F.col("weight") > F.col("cap") * F.col("weight_left"))
    stats = stats.withColumn("share", F.min(F.when(~F.col("capped"), F.struct(-F.col("weight_left"), F.col("size_left") / F.col("weight_left")))).over(everything)["col2"])
    return stats.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.coalesce(F.col("share") * F.col("weight"), F.col("cap"))).alias("target"))


def _chance(seed: int, *columns: str) -> Column:
    """A number in [0, 1) that depends on the values and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11).cast("double") * F.lit(2.0**-53)


def _round(items: Column, id_type: str) -> Column:
    """Pivotal rounding along an array of items with chance ``p``: those decided, and the one held at the end."""
    state = f"struct<held:struct<nsize:bigint,id:{id_type},copy:bigint,p:double,u:double>,done:array<struct<id:{id_type},copy:bigint,size:bigint,take:int>>>"

    def step(a: Column, x: Column) -> Column:
        held = a["held"]
        own, other = -held["nsize"], -x["nsize"]
        # words that either can gain or lose
        room, has, room_x, has_x = own * (1 - held["p"]), own * held["p"], other * (1 - x["p"]), other * x["p"]
        up, down = F.least(room, has_x), F.least(has, room_x)
        rises = x["u"] * (up + down) < down
        held_ends = F.when(rises, room <= has_x).otherwise(has <= room_x)
        moved = F.when(rises, up).otherwise(-down)
        open_x = x.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), x["p"] - moved / other)))
        open_held = held.withField("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), held["p"] + moved / own)))
        ended = F.when(held_ends, held).otherwise(x)
        # what ends by a rise of the one held is that one, full, or the other, empty
        out = F.struct(ended["id"].alias("id"), ended["copy"].alias("copy"), (-ended["nsize"]).alias("size"), (rises == held_ends).cast("int").alias("take"))
        on = F.struct(F.when(held_ends, open_x).otherwise(open_held).alias("held"), F.concat(a["done"], F.array(out)).alias("done"))
        return F.when(held.isNull(), F.struct(x.alias("held"), a["done"].alias("done"))).otherwise(on)

    return F.aggregate(items, F.from_json(F.lit('{"done":[]}'), state), step)


def _last(folded: DataFrame, seed: int) -> Column:
    """Whether the item held at the end is taken, by its own chance."""
    return (_chance(seed, "x.held.id", "x.held.copy", "x.held.nsize") < F.col("x.held.p")).cast("int")


def _decided(folded: DataFrame) -> DataFrame:
    """Items of ``done`` and the last one, of rows with source, whole, x and last, as id, source, size, copy, copies."""
    end = F.struct(F.col("x.held.id").alias("id"), F.col("x.held.copy").alias("copy"), (-F.col("x.held.nsize")).alias("size"), F.col("last").alias("take"))
    every = F.when(F.col("last").isNull(), F.col("x.done")).otherwise(F.concat("x.done", F.array(end)))
    return folded.select("source", "whole", F.explode(every).alias("d")).select("d.id", "source", "d.size", "d.copy", (F.col("whole") + F.col("d.take")).alias("copies"))


def copies(docs: DataFrame, target: DataFrame, seed: int = 11) -> DataFrame:
    """id, source, size, copy, copies for every row of ``docs`` (id, source, size); repeated rows differ in ``copy``.

    ``target`` comes from ``targets``. Every row is taken ``target / source_size``
    times in expectation. The result depends on the rows and the seed alone, not
    on their order or partitions.
    """
    id_type = docs.schema["id"].dataType.simpleString()
    numbered = docs.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("n")).select("id", "source", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("copy"))
    target = target.withColumn("source_", F.col("source")).drop("source", "weight")
    rows = numbered.join(target, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("whole", F.floor(times).cast("int")).withColumn("p", times - F.floor(times))
    kind = F.when((F.col("size") == 0) | (F.col("p") == 0), 0)
    for tier, part in enumerate(LARGE, 1):
        kind = kind.when(F.col("size") * part > F.col("source_size"), tier)
    small_kind = len(LARGE) + 1
    rows = materialise(rows.withColumn("kind", kind.otherwise(small_kind)).drop("source_size", "target"), "mix-rows")
    settled = rows.filter("kind = 0").select("id", "source", "size", "copy", F.col("whole").alias("copies"))

    item = F.struct((-F.col("size")).alias("nsize"), "id", "copy", "p", "u")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.col("shift")))

    def rounded(items: DataFrame, key: list[str], level: int) -> DataFrame:
        """One row of each group, with x: its items from the largest on, rounded."""
        grouped = items.withColumn("u", _chance(seed + level, "id", "copy", "size")).groupBy(*key).agg(F.sort_array(F.collect_list(item)).alias("items"))
        return grouped.select(*key, _round(F.col("items"), id_type).alias("x"))

    # one row a source: the chance of its open documents, the words of those of each kind and smaller, the blocks of the small ones, and by how much larger ones have shifted the chance
    below = [F.coalesce(F.sum(F.when(F.col("kind") > tier, F.col("size"))), F.lit(0)).alias(f"below_{tier}") for tier in range(1, small_kind)]
    blocks = F.ceil(F.count(F.when(F.col("kind") == small_kind, 1)) / FAN).alias("blocks")
    stats = rows.filter("kind > 0").groupBy("source").agg(F.first("p").alias("chance"), blocks, *below).withColumnRenamed("source", "source_").withColumn("shift", F.lit(0.0))
    stats = materialise(stats, "mix-sources")
    own = F.col("source").eqNullSafe(F.col("source_"))
    results = [settled]
    for tier in range(1, small_kind):
        items = rows.filter(F.col("kind") == tier).join(stats.select("source_", "shift"), own).withColumn("p", clipped)
        large = rounded(items, ["source", "whole"], -tier)
        large = materialise(large.withColumn("last", _last(large, seed + 1000 + tier)), f"mix-large{tier}")
        results.append(_decided(large))
        held = F.col("x.held")
        left_over = large.select("source", ((held["p"] - F.col("last")) * -held["nsize"]).alias("off"), (-held["nsize"] * F.greatest(held["p"], 1 - held["p"])).alias("most_off"))
        now, words_below = F.col("chance") + F.col("shift"), F.col(f"below_{tier}")
        room = words_below * F.greatest(F.lit(0.0), F.least(now, 1 - now))
        share = F.when(F.col("most_off") > room, room / F.col("most_off")).otherwise(1.0)
        more = F.when((words_below > 0) & F.col("off").isNotNull() & (F.col("most_off") > 0), share * F.col("off") / words_below).otherwise(0.0)
        stats = stats.join(left_over, own, "left").withColumn("shift", F.col("shift") + more).drop("source", "off", "most_off")
        stats = materialise(stats, f"mix-shift{tier}")
    small = rows.filter(F.col("kind") == small_kind)
    most = stats.agg(F.max("blocks")).first()[0]
    if most:
        placed = small.join(stats.select("source_", "shift", "blocks"), own).withColumn("p", clipped).withColumn("block", F.pmod(F.xxhash64("id", "copy", F.lit(seed)), F.col("blocks")))
        current, width, level = placed, most, 1
        key = ["source", "whole", "blocks", "block"]
        while True:
            folded = rounded(current, key, level)
            folded = materialise(folded.withColumn("last", _last(folded, seed + 2000) if width == 1 else F.lit(None).cast("int")), f"mix-level{level}")
            results.append(_decided(folded))
            if width == 1:
                break
            width, level = -(-width // FAN), level + 1
            fewer = F.ceil(F.col("blocks") / FAN)
            current = folded.filter("x.held IS NOT NULL").select("source", "whole", F.col("x.held.id").alias("id"), F.col("x.held.copy").alias("copy"), (-F.col("x.held.nsize")).alias("size"), F.col("x.held.p").alias("p"), fewer.alias("blocks"), F.pmod(F.xxhash64("block", F.lit(seed)), fewer).alias("block"))
    union = results[0]
    for more in results[1:]:
        union = union.unionByName(more)
    return union


def mix(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", weights: tuple[int, ...] = (5, 2, 1), most: float = 3.0, seed: int = 11) -> DataFrame:
    """Per row: id, source, size, copy, copies, source_size, target.

    A null or empty text has size 0 and costs nothing; null sources are one
    source, the last; repeated rows are rounded each; documents of equal size go
    by id; texts of any length are counted whole; further columns are ignored; an
    empty table gives no rows. At most ``ceil(most)`` copies are taken. The words
    taken of a source differ from its target by less than one of its documents,
    and by less than the last of ``LARGE`` says of its words where smaller ones
    can always take up what larger ones leave.
    """
    sizes = materialise(docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), words(text_column).alias("size")), "mix-sizes")
    target = materialise(targets(sizes, weights, most), "mix-targets")
    taken = copies(sizes, target, seed)
    named = target.select(F.col("source").alias("source_"), "source_size", "target")
    return taken.join(named, F.col("source").eqNullSafe(F.col("source_"))).drop("source_").withColumnsRenamed({"id": id_column, "source": source_column})


def apply(docs: DataFrame, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Rows move once, by a hash of id, source and size; of rows with one hash the
    n-th in the order of their texts is taken as the n-th copy was decided.
    """
    taken = mix(docs, id_column, source_column, text_column, **options)
    key = F.xxhash64(F.col(id_column), F.col(source_column), F.col("size"))
    lists = taken.groupBy(key.alias("key_")).agg(F.sort_array(F.collect_list(F.struct("copy", "copies"))).alias("taken_")).filter(F.exists("taken_", lambda x: x["copies"] > 0))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(F.col(id_column), F.col(source_column), words(text_column)).alias("key"), F.xxhash64(text_column).alias("text_key"))
    numbered = keyed.withColumn("turn", F.row_number().over(Window.partitionBy("key").orderBy("text_key")))
    joined = numbered.join(lists.hint("merge"), F.col("key") == F.col("key_"))
    times = F.get(F.col("taken_"), F.col("turn") - 1)["copies"]
    return joined.filter(times > 0).select("doc", F.explode(F.sequence(F.lit(1), times))).select("doc.*")
