"""Extraction batches: pages cut and packed in order under a size, and failing batches halved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, stored

c = F.col
#: What stands between the units of a batch, and its most characters.
BETWEEN = "\n\n---\n\n"
MOST = 9_000_000


def rendered(text: Column, chunk: Column, chunks: Column) -> Column:
    """A unit as the text that is sent; lines without content are left out."""
    line = lambda name, x: F.concat(F.lit(name), x.cast("string"))
    some = lambda x: F.when(x != "", x)
    return F.concat_ws(
        "\n", line("PAGE ", c("page")), line("SOURCE ID: ", c("source")), line("URL: ", c("url")), line("TYPE: ", c("type")), F.when(F.coalesce(c("title"), F.lit("")) != "", line("TITLE: ", c("title"))),
        F.concat(line("CHUNK: ", chunk), line(" OF ", chunks)), F.lit("CONTENT:"), some(text),
    )


def units(pages: DataFrame, most: int = MOST) -> DataFrame:
    """Pages (project, page, source, url, type, title, text), those whose text doesn't fit cut into chunks.

    Chunks are as long as they can be while their number is not known, so a chunk number of d digits leaves ``room - d``
    characters: where a chunk starts follows from its number. Columns page to text, chunk, chunks, size (characters as
    rendered) and ``fits``, which is false for a page whose other lines alone are too long: it has one unit without text.
    """
    text = F.coalesce(c("text"), F.lit(""))
    own = pages.withColumns({"text": text, **{k: F.coalesce(c(k), F.lit("")) for k in ("source", "url", "type", "title")}}).withColumn("n", F.length("text").cast("long"))
    whole = F.length(rendered(c("text"), F.lit(1), F.lit(1))) <= most
    room = F.lit(most) - (F.length(rendered(F.lit("."), F.lit(""), c("n"))) - 1)  # without the digits of the number, and the text
    own = own.withColumns({"whole": whole, "room": room.cast("long")})
    # Chunks of numbers of d digits, one digit more after the other.
    count, start = F.lit(0).cast("long"), F.lit(0).cast("long")
    at, taken, number = F.lit(None).cast("long"), F.lit(0).cast("long"), c("chunk")
    for d in range(1, 10):
        many, each = 9 * 10 ** (d - 1), c("room") - d
        count = count + F.when(each > 0, F.least(F.lit(many), F.ceil(F.greatest(c("n") - start, F.lit(0)) / each))).otherwise(0)
        at = F.when((number >= 10 ** (d - 1)) & (number < 10**d), taken + (number - 10 ** (d - 1)) * each).otherwise(at)
        start, taken = start + F.greatest(each, F.lit(0)) * many, taken + each * many
    own = own.withColumn("fits", c("whole") | (c("room") > 9)).withColumn("chunks", F.when(c("whole") | ~c("fits"), 1).otherwise(F.greatest(F.lit(1), count)).cast("long"))
    own = own.withColumn("chunk", F.explode(F.sequence(F.lit(1).cast("long"), c("chunks"))))
    length = c("room") - F.length(c("chunk").cast("string"))
    piece = F.when(c("whole"), c("text")).when(~c("fits"), "").otherwise(F.substring(c("text"), (at + 1).cast("int"), length.cast("int")))
    own = own.withColumn("piece", piece).drop("text").withColumnRenamed("piece", "text")
    return own.withColumn("size", F.length(rendered(c("text"), c("chunk"), c("chunks"))).cast("long")).drop("n", "whole", "room")


def numbered(rows: DataFrame, key: str, order: list[str], size: str, gap: int) -> DataFrame:
    """``rows`` with ``place`` and ``starts``, the number of rows and the sum of ``size + gap`` before them in their key's order.

    Rows are range-partitioned over keys and order, so a key of any size is spread; ranges add what comes before them.
    """
    spread = rows.repartitionByRange(c(key), *map(c, order)).withColumn("range", F.spark_partition_id())
    spread = stored(spread, "ranges")
    inside = W.partitionBy("range", key).orderBy(*order)
    total = F.sum(c(size) + gap)
    parts = spread.groupBy(key, "range").agg(F.count("*").alias("n"), total.alias("s"))
    before = W.partitionBy(key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(key, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0"))
    own = spread.withColumns({"n1": F.row_number().over(inside) - 1, "s1": total.over(inside.rowsBetween(W.unboundedPreceding, 0)) - c(size) - gap})
    return own.join(parts, [key, "range"]).withColumns({"place": (c("n0") + c("n1")).cast("long"), "starts": (c("s0") + c("s1")).cast("long")}).drop("range", "n0", "n1", "s0", "s1")


def packed(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """Project, place and batch (from 1) of units (project, place, starts, size) packed greedily in order.

    A unit's next batch starts at the first unit that would not fit beside it any more. All these steps are found by one
    sort of ends and bounds in buckets of ``most`` characters; the steps that are taken from the first unit on are found
    by doubling their length, so n batches take log2(n) rounds of joins, and no task sees a whole project.
    """
    gap, span = len(BETWEEN), most + len(BETWEEN)
    end = c("starts") + c("size")
    # The bound of a unit is in the bucket of the first end beyond it, or in the one before: ends stand in both.
    ends = sizes.select("project", end.alias("at"), F.lit(1).alias("kind"), "place", F.explode(F.array(F.floor(end / span), F.floor(end / span) - 1)).alias("bucket"))
    bounds = sizes.select("project", (c("starts") + most).alias("at"), F.lit(0).alias("kind"), "place", F.floor((c("starts") + most) / span).alias("bucket"))
    beyond = W.partitionBy("project", "bucket").orderBy(c("at").desc(), "kind").rowsBetween(W.unboundedPreceding, 0)
    step = ends.union(bounds).withColumn("next", F.min(F.when(c("kind") == 1, c("place"))).over(beyond)).where("kind = 0 and next is not null").select("project", "place", "next")
    step = stored(step, "steps")  # of the units that another batch follows
    taken = cut(sizes.where("place = 0").select("project", "place"))
    while True:
        more = taken.join(step, ["project", "place"]).select("project", c("next").alias("place"))
        if more.isEmpty():
            break
        taken = cut(taken.union(more).distinct())
        far = step.select("project", c("place").alias("next"), c("next").alias("then"))
        step = cut(step.join(far, ["project", "next"]).select("project", "place", c("then").alias("next")))
    first = taken.join(sizes, ["project", "place"]).select("project", c("place").alias("first"), "starts")
    first = first.withColumn("batch", F.row_number().over(W.partitionBy("project").orderBy("first")).cast("long"))
    # A batch reaches into two buckets at most, and three start in one at most.
    first = first.withColumn("bucket", F.explode(F.array(F.floor(c("starts") / span), F.floor(c("starts") / span) + 1))).withColumnRenamed("starts", "from")
    own = sizes.withColumn("bucket", F.floor(c("starts") / span)).join(first, ["project", "bucket"]).where("starts >= from")
    return own.groupBy("project", "place").agg(F.max("batch").alias("batch"))


def batches(pages: DataFrame, most: int = MOST) -> DataFrame:
    """The units of pages with their batch; units that can't fit have none."""
    own = units(pages, most)
    good = stored(numbered(own.where("fits"), "project", ["page", "chunk"], "size", len(BETWEEN)), "units")
    where = packed(good.select("project", "place", "starts", "size"), most)
    return good.join(where, ["project", "place"]).drop("starts").unionByName(own.where("not fits").withColumns({"place": F.lit(None).cast("long"), "batch": F.lit(None).cast("long")}))


def halved(sent: DataFrame, fails, rounds: int = 40) -> DataFrame:
    """Batches halved until none fails, or what fails is a single character or less (``refused``).

    ``sent``: project, batch, place, chunk, chunks, text, size. ``fails`` maps a table of batches (project, batch, units, size)
    to those that fail (project, batch). A failing batch of several units becomes two of half the units; one unit becomes two of half its
    text, never within a character. Each round only meets what still fails; parts of a batch are numbered by a path of 1 and 2.
    """
    open_, done = cut(sent.withColumn("batch", c("batch").cast("string"))), None
    for k in range(rounds):
        total = open_.groupBy("project", "batch").agg(F.count("*").alias("units"), F.sum(c("size") + len(BETWEEN)).alias("size")).withColumn("size", c("size") - len(BETWEEN))
        bad = fails(total).select("project", "batch").join(total.select("project", "batch", "units"), ["project", "batch"])
        marked = cut(open_.join(bad, ["project", "batch"], "left"))
        stuck = c("units").isNotNull() & ((c("units") == 1) & (F.length("text") < 2) | F.lit(k == rounds - 1))
        ok = marked.where(c("units").isNull() | stuck).withColumn("refused", c("units").isNotNull()).drop("units")
        done = ok if done is None else done.unionByName(ok)
        again = marked.where(c("units").isNotNull() & ~stuck)
        if again.isEmpty():
            return done
        nth = F.row_number().over(W.partitionBy("project", "batch").orderBy("place", "chunk"))
        many = again.where("units > 1").withColumn("half", F.when(nth <= F.ceil(c("units") / 2), "1").otherwise("2"))
        many = many.withColumn("batch", F.concat_ws(".", "batch", "half")).drop("units", "half")
        middle = F.floor(F.length("text") / 2).cast("int")
        one = again.where("units = 1").withColumn("side", F.explode(F.array(F.lit(1), F.lit(2))))
        text = F.when(c("side") == 1, F.substring("text", 1, middle)).otherwise(F.substring(c("text"), middle + 1, F.length("text")))
        one = one.withColumns({"text": text, "size": c("size") - F.length("text") + F.length(text), "chunk": c("chunk") * 2 - 2 + c("side"), "chunks": c("chunks") * 2, "batch": F.concat_ws(".", "batch", c("side").cast("string"))}).drop("units", "side")
        open_ = cut(many.unionByName(one))
    return done
