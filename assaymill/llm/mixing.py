"""Mixing of sources to target weights over output shards.

The documents of a source fall into blocks by a hash of their identifier and text, which permutes them. Each
source has an exact quota of blocks; a splitting tree parts the quotas among the shards, at every
node by one multivariate hypergeometric draw, so each shard gets a random but exact number of blocks
of each source. Shards take disjoint runs of a source's blocks and shuffle what they got.
DataFrame functions only: nothing here runs Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assaymill.llm.common import WORD, cut, pick, table, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1_000_000
LEAST_BLOCKS = 1024
SHARD_WORDS = 16_000_000
#: Shards at least, however few the words.
LEAST_SHARDS = 16
#: Levels of the splitting tree between two that are dealt anew and written: its nodes spread over tasks as
#: they grow in number, and the plan stays short.
LEVELS_DEALT = 6
MOST_PARTS = 2000
SEED = "mix-1"
#: Rows up to which the tables of sources and of blocks are broadcast; beyond it Spark shuffles them.
BROADCAST_ROWS = 200_000


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast, if the rows are few. df: a table that is cheap to count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def text_mark(text: Column) -> Column:
    """A digest that parts the texts of one identifier; null: empty."""
    return F.coalesce(F.md5(text), F.lit(""))


def document_hash(doc_id: Column, mark: Column, seed: str = SEED) -> Column:
    """60 bits of md5, the same in any SQL engine. mark: of the text, so that many texts of one identifier fall into
    many blocks."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), mark)
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A source's name, never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """sizes: source, words. One row a source: skey, rank, source_size, target.

    Sources are ranked by code point, null last; weights repeat along the ranks. The targets share
    ``share`` of all words by weight; one that comes above ``most`` times its source's size stays
    there, and what it leaves is shared by the others in the same way.
    """
    by_rank = W.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    ranked = ranked.withColumn("rank", F.row_number().over(by_rank) - 1)
    ranked = ranked.withColumn(
        "weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank"), F.lit(len(weights))))
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filling = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    so_far = filling.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = ranked.withColumns(
        {
            "place": F.row_number().over(filling),
            # Words for each unit of weight, if those before this one stand at their caps.
            "level": (
                F.sum("source_size").over(everything) * F.lit(float(share))
                - (F.sum("cap").over(so_far) - F.col("cap"))
            )
            / (F.sum("weight").over(everything) - (F.sum("weight").over(so_far) - F.col("weight"))),
        }
    )
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    ranked = ranked.withColumn("first", F.min(F.when(fits, F.col("place"))).over(everything))
    ranked = ranked.withColumn(
        "common", F.max(F.when(F.col("place") == F.col("first"), F.col("level"))).over(everything)
    )
    target = F.when(F.col("place") < F.col("first"), F.col("cap")).otherwise(F.col("weight") * F.col("common"))
    return ranked.select(
        source_key(F.col("source")).alias("skey"), "rank", "source_size", F.coalesce(target, F.lit(0.0)).alias("target")
    )


def hypergeometric(good: Column, bad: Column, draw: Column, u: Column) -> Column:
    """How many of ``draw`` things, drawn from ``good`` and ``bad`` ones, are good; u: uniform in [0, 1).

    Inverts the distribution outwards from its mode, upwards and then downwards, as far as eight
    standard deviations and eight more.
    """
    d = lambda c: c.cast("double")

    def at_mode(p: Column) -> Column:
        g, b, n, m = p["g"], p["b"], p["n"], p["m"]
        total = g + b
        variance = n * (g / total) * (b / total) * ((total - n) / F.greatest(total - 1, F.lit(1.0)))
        reach = F.ceil(8 * F.sqrt(variance)) + 8
        up = F.sequence(F.lit(0).cast("long"), (F.least(n, g, m + reach) - m).cast("long"))
        down = F.sequence(F.lit(0).cast("long"), (m - F.greatest(F.lit(0.0), n - b, m - reach)).cast("long"))

        def higher(w: Column, j: Column) -> Column:
            k = m + j - 1
            return F.when(j == 0, w).otherwise(w * ((g - k) * (n - k)) / ((k + 1) * (b - n + k + 1)))

        def lower(w: Column, j: Column) -> Column:
            k = m - j + 1
            return F.when(j == 0, w).otherwise(w * (k * (b - n + k)) / ((g - k + 1) * (n - k + 1)))

        def mass(steps: Column, ratio) -> Column:
            """Of all values beyond the mode, the mode's own as 1."""
            start = F.struct(F.lit(1.0).alias("w"), F.lit(-1.0).alias("s"))
            add = lambda a, j: _let(ratio(a["w"], d(j)), lambda w: F.struct(w.alias("w"), (a["s"] + w).alias("s")))
            return F.aggregate(steps, start, add, lambda a: F.greatest(a["s"], F.lit(0.0)))

        def find(steps: Column, ratio, before: Column, x: Column) -> Column:
            """The step at which the sum from ``before`` on exceeds x, else -1; step 0 adds nothing."""
            start = F.struct(F.lit(1.0).alias("w"), before.alias("s"), F.lit(-1).cast("long").alias("at"))

            def add(a: Column, j: Column) -> Column:
                def with_(w: Column) -> Column:
                    s = a["s"] + F.when(j == 0, F.lit(0.0)).otherwise(w)
                    found = F.when((a["at"] < 0) & (j > 0) & (s > x), j).otherwise(a["at"])
                    return F.struct(w.alias("w"), s.alias("s"), found.alias("at"))

                return _let(ratio(a["w"], d(j)), with_)

            return F.aggregate(steps, start, add, lambda a: a["at"])

        def pick_(q: Column) -> Column:
            x = p["u"] * (1 + q["up"] + q["down"])
            above = find(up, higher, F.lit(1.0), x)
            below = find(down, lower, 1 + q["up"], x)
            return F.when(x < 1, m).when(x < 1 + q["up"], m + F.greatest(above, F.lit(0))).otherwise(
                m - F.greatest(below, F.lit(0))
            )

        return _let(F.struct(mass(up, higher).alias("up"), mass(down, lower).alias("down")), pick_)

    mode = F.floor((d(draw) + 1) * ((d(good) + 1) / (d(good) + d(bad) + 2)))
    given = F.struct(
        d(good).alias("g"),
        d(bad).alias("b"),
        d(draw).alias("n"),
        # Within what is possible, whatever the division rounds to.
        F.least(F.greatest(d(mode), d(draw) - d(bad), F.lit(0.0)), d(good), d(draw)).alias("m"),
        u.alias("u"),
    )
    return F.when((good == 0) | (draw == 0), F.lit(0)).when(bad == 0, draw).when(draw == good + bad, good).otherwise(
        _let(given, at_mode)
    ).cast("long")


def split_quota(quota: Column, draw: Column, *key: Column) -> Column:
    """A multivariate hypergeometric draw of ``draw`` blocks out of those of each source in ``quota``."""
    total = F.aggregate(quota, F.lit(0).cast("long"), lambda a, b: a + b)
    start = F.struct(
        total.alias("left"),
        draw.cast("long").alias("draw"),
        F.lit(0).alias("i"),
        F.array().cast("array<long>").alias("out"),
    )

    def step(a: Column, good: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(*key, a["i"]), 11) / F.lit(float(1 << 53))
        taken = hypergeometric(good, a["left"] - good, a["draw"], u)
        return _let(
            taken,
            lambda t: F.struct(
                (a["left"] - good).alias("left"),
                (a["draw"] - t).alias("draw"),
                (a["i"] + 1).alias("i"),
                F.concat(a["out"], F.array(t)).alias("out"),
            ),
        )

    return F.aggregate(quota, start, step, lambda a: a["out"])


def shard_quotas(quotas: DataFrame, shards: int, seed: str = SEED) -> DataFrame:
    """quotas: rank, quota (blocks). Returns shard, rank, blocks: every shard's blocks of every source.

    The tree halves a range of shards until each stands alone; a half's blocks are in proportion to
    its shards, which sources they come from is drawn. A node holds a number for each source, so a task holds
    a few rows of that size; draws hang on a node's range alone, wherever it is computed.
    """
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("rank", "quota"))).alias("q")).select(
        F.lit(0).cast("long").alias("low"),
        F.lit(shards).cast("long").alias("high"),
        F.transform("q", lambda x: x["quota"]).alias("quota"),
    )
    for level in range(max(0, math.ceil(math.log2(shards)))):
        if level and level % LEVELS_DEALT == 0:
            nodes = cut(nodes.repartition(min(MOST_PARTS, 1 << level), "low"))
        middle = F.expr("(low + high) div 2")
        nodes = nodes.withColumns(
            {"mid": middle, "blocks": F.aggregate("quota", F.lit(0).cast("long"), lambda a, b: a + b)}
        )
        left = F.floor(F.col("blocks") * ((F.col("mid") - F.col("low")) / (F.col("high") - F.col("low"))))
        nodes = nodes.withColumn(
            "left", split_quota(F.col("quota"), left.cast("long"), F.lit(seed), F.col("low"), F.col("high"))
        )
        halves = F.array(
            F.struct(F.col("low"), F.col("mid").alias("high"), F.col("left").alias("quota")),
            F.struct(
                F.col("mid").alias("low"),
                F.col("high"),
                F.zip_with("quota", "left", lambda a, b: a - b).alias("quota"),
            ),
        )
        nodes = nodes.select(F.explode(halves).alias("n")).select("n.*").where("high > low")
    return nodes.select(F.col("low").alias("shard"), F.posexplode("quota").alias("rank", "blocks"))


class Mix:
    """What to draw, from narrow rows of all documents. sized: doc_id, source, mark, size (cheap to read)."""

    def __init__(
        self,
        sized: DataFrame,
        weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE,
        most: float = MOST,
        block_words: int = BLOCK_WORDS,
        least_blocks: int = LEAST_BLOCKS,
        shard_words: int = SHARD_WORDS,
        least_shards: int = LEAST_SHARDS,
        seed: str = SEED,
    ):
        self.seed = seed
        sizes = sized.groupBy("source").agg(F.sum("size").alias("words"))
        blocks = F.greatest(F.lit(least_blocks), F.ceil(F.col("source_size") / block_words)).cast("long")
        self.sources = cut(source_targets(sizes, weights, share, most).withColumn("blocks", blocks))

        # Blocks that hold documents, in the order of their hash; words before each in its source.
        held = self.place(sized.select("doc_id", "source", "mark", "size")).groupBy("skey", "block").agg(F.sum("size").alias("words"))
        order = W.partitionBy("skey").orderBy("block")
        # Blocks without words come last: a round that stops early takes the first ones with words.
        wordless_last = W.partitionBy("skey").orderBy(F.col("words") == 0, "block")
        held = held.withColumns(
            {
                "at": F.row_number().over(wordless_last) - 1,
                "before": F.sum("words").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("words"),
                "n": F.count("*").over(W.partitionBy("skey")),
            }
        ).join(_small(self.sources.select("skey", "rank", "source_size", "target")), "skey")
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        held = held.withColumn("whole", whole.cast("long"))
        rest = F.col("target") - F.col("whole") * F.col("source_size")
        self.held = cut(
            held.withColumn("more", (F.col("before") + F.col("words") / 2 <= rest) & (F.col("words") > 0))
        )
        quotas = self.held.groupBy("skey", "rank", "n", "whole").agg(F.count_if("more").alias("more"))
        quotas = quotas.withColumn("quota", F.col("n") * F.col("whole") + F.col("more"))
        words = self.sources.agg(F.sum("target")).head()[0] or 0
        self.shards = max(1, least_shards, math.ceil(words / shard_words))
        dealt = shard_quotas(quotas, self.shards, seed)
        # Shards take runs of a source's blocks: first once through all of them, then again.
        runs = W.partitionBy("rank").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
        dealt = dealt.withColumn("end", F.sum("blocks").over(runs)).where("blocks > 0")
        # posexplode numbers sources by their order in the array, which leaves out those without a block.
        numbered = quotas.withColumn("number", F.row_number().over(W.orderBy("rank")) - 1)
        dealt = dealt.withColumnRenamed("rank", "number").join(_small(cut(numbered.select("skey", "number", "n"))), "number")
        drawn = dealt.select(
            "skey", "n", "shard", F.explode(F.sequence(F.col("end") - F.col("blocks"), F.col("end") - 1)).alias("draw")
        ).select(
            "skey",
            F.pmod("draw", "n").alias("at"),
            F.struct(F.expr("draw div n").alias("round"), F.col("shard")).alias("draw"),
        )
        # A block is drawn once a round, so a list has at most ``most`` + 1 entries.
        drawn = drawn.groupBy("skey", "at").agg(F.sort_array(F.collect_list("draw")).alias("draws"))
        self.draws = cut(self.held.select("skey", "at", "block").join(drawn, ["skey", "at"]).drop("at"))

    def place(self, docs: DataFrame) -> DataFrame:
        """docs: doc_id, source, mark and more, none of them called skey, block, blocks, rank, source_size or target."""
        keyed = docs.withColumn("skey", source_key(F.col("source")))
        placed = keyed.join(_small(self.sources), "skey")
        return placed.withColumn("block", F.pmod(document_hash(F.col("doc_id"), F.col("mark"), self.seed), F.col("blocks"))).drop(
            "blocks", "rank", "mark"
        )

    def draw(self, docs: DataFrame) -> DataFrame:
        """``docs`` with source_size, target and draws: an array of (round, shard), empty if not drawn."""
        found = self.place(docs).join(_small(self.draws), ["skey", "block"], "left")
        empty = F.array().cast("array<struct<round:bigint,shard:bigint>>")
        return found.withColumn("draws", F.coalesce("draws", empty)).drop("skey", "block")


def sized_documents(docs: DataFrame) -> DataFrame:
    """doc_id, source, mark of the text and size (words of the whole text; null: 0)."""
    rows = pick(docs, doc_id="long", source="string", text="string")
    return rows.select(
        "doc_id", "source", text_mark(F.col("text")).alias("mark"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """doc_id, source, size, source_size (long), target (double), draws and taken of every row of ``docs``.

    draws has a (round, shard) for each time the mix takes the row, at most twice where targets stop at
    twice a source's size; taken is the words of all of them. A null or empty text has size 0. A null
    source is a source of its own, a null doc_id hashes like any other value. Rows that are equal in doc_id and
    text are drawn alike, since blocks go by these; different texts of one doc_id are not. Where all texts are empty every target is 0. An empty
    table gives no rows. Other columns are ignored. The same rows always give the same mix.
    settings: those of :class:`Mix`.
    """
    sized = cut(sized_documents(docs))
    mixed = Mix(sized, **settings).draw(sized)
    return mixed.withColumn("taken", (F.col("size") * F.size("draws")).cast("long"))


def deal_documents(docs: DataFrame, columns: list[str], **settings) -> DataFrame:
    """``columns`` of the mixed rows themselves: each as often as it is drawn, dealt to 16 slices of its
    shard, each of which stands together in an order of its own.

    A null or empty text has size 0, and its row is drawn as its block is; null sources and identifiers,
    repeated rows and empty tables are as in :func:`mix_sources`. Columns of ``docs`` that aren't named, or
    whose names clash with a named one, are left out.
    """
    mix = Mix(cut(sized_documents(docs)), **settings)
    types = dict(docs.dtypes)
    rows = pick(docs, **{c: types.get(c, "string") for c in dict.fromkeys([*columns, "doc_id", "source", "text"])})
    whole = rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        text_mark(F.col("text").cast("string")).alias("mark"),
        *[F.col(c).alias(f"carried_{c}") for c in columns],
    )
    drawn = mix.draw(whole).select(
        F.explode("draws").alias("draw"), "doc_id", *[f"carried_{c}" for c in columns]
    )
    order = F.xxhash64(F.lit(mix.seed), "doc_id", "draw.round")
    shuffled = drawn.withColumns({"shard": F.col("draw.shard"), "order": order}).repartition("shard", F.pmod("order", F.lit(16)))
    shuffled = shuffled.sortWithinPartitions("shard", "order")
    return shuffled.select(*[F.col(f"carried_{c}").alias(c) for c in columns])


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``, and n_draws: how often the mix takes a row, by the
    draws that the tree dealt to shards."""
    found = mix_sources(table(spark, sf_dir, "documents")).withColumn("n_draws", F.size("draws").cast("long"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "n_draws")


OP7_SQL = f"""
with sized as (
  select cast(doc_id as bigint) as doc_id, source, coalesce(md5(text), '') as mark,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size
  from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size,
         row_number() over (order by source nulls last) - 1 as rank
  from sized group by source
), weighed as (
  select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
         source_size * 2.0::double as cap from sources
), filled as (
  select *, row_number() over (order by cap / weight, rank) as place,
         (sum(source_size) over () * 1.5::double
           - (sum(cap) over (order by cap / weight, rank rows unbounded preceding) - cap))
         / (sum(weight) over () - (sum(weight) over (order by cap / weight, rank rows unbounded preceding) - weight))
         as level
  from weighed
), stopped as (
  select *, min(case when level <= cap / weight then place end) over () as first from filled
), targets as (
  select source, source_size, rank,
         case when place < first then cap
              else weight * max(case when place = first then level end) over () end as target,
         greatest({LEAST_BLOCKS}, cast(ceil(source_size / {BLOCK_WORDS}.0) as bigint)) as blocks
  from stopped
), placed as (
  select s.doc_id, s.size, t.*,
         cast('0x' || substr(md5('{SEED}:' || coalesce(cast(s.doc_id as varchar), 'null') || ':' || s.mark), 1, 15) as bigint)
           % t.blocks as block
  from sized s join targets t on s.source is not distinct from t.source
), held as (
  select rank, block, source_size, target, sum(size) as words from placed group by all
), cumulated as (
  select *, sum(words) over (partition by rank order by block rows unbounded preceding) - words as before,
         case when source_size > 0 then floor(target / source_size) else 0 end as whole
  from held
), drawn as (
  select rank, block,
         whole + (case when before + words / 2.0 <= target - whole * source_size and words > 0 then 1 else 0 end) as times
  from cumulated
)
select p.doc_id, p.size, p.source_size, p.target, cast(p.size * d.times as bigint) as taken,
       cast(d.times as bigint) as n_draws
from placed p join drawn d on p.rank = d.rank and p.block = d.block
"""
