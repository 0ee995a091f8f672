"""Items that appear together: an incremental pair table.

State, in a folder all executors share: the baskets (one row a basket with its sorted distinct
items), the marginals of single items, and the pairs with their counts and association scores,
each in hash buckets. A change compares the changed baskets with their stored form and emits
signed deltas of marginals and pairs. Only buckets that hold something affected are read, merged
with their deltas and written anew; the next version is a list of the buckets' folders, old and
new. A run that dies before that list is written leaves the old version whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fernmill.session import delete_path, materialise, path_exists, small, state_dir, table
from fernmill.sources.store import Conflict, Pointer, folders

#: Rows a bucket is meant to hold; with more on average the number of buckets doubles.
BUCKET_ROWS = 250_000
#: Items of a basket that are paired at once; the pairs of a longer one are spread over blocks of so many.
BLOCK = 256
#: Layout of the state; another one begins anew.
FORMAT = 2


def baskets(df: DataFrame, basket: str, item: str) -> DataFrame:
    """(basket, items): each item once a basket, sorted; null baskets and items are left out.

    The maps combine first: a basket repeated without end costs its distinct items.
    """
    return df.where(F.col(basket).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(basket).alias("basket")).agg(F.sort_array(F.collect_set(item)).alias("items"))


def weigh(sets: DataFrame) -> DataFrame:
    """Equal item sets as one row with their signed number: copies never expand to pairs twice."""
    return sets.groupBy("items").agg(F.sum("sign").alias("weight")).where("weight != 0")


def marginal_deltas(weighed: DataFrame) -> DataFrame:
    return weighed.select(F.explode("items").alias("item"), "weight").groupBy("item").agg(F.sum("weight").alias("n")).where("n != 0")


def pair_deltas(weighed: DataFrame) -> DataFrame:
    """Signed counts of item pairs, the smaller item first.

    The items of a set are cut into blocks; each two blocks make a row of their own, so that a
    very long set is spread over tasks.
    """
    blocks = F.ceil(F.size("items") / F.lit(BLOCK)).cast("int")
    part = lambda i: F.slice("items", i * BLOCK + 1, F.lit(BLOCK))
    short = weighed.where((F.size("items") > 1) & (F.size("items") <= BLOCK)).select("weight", F.col("items").alias("left"), F.col("items").alias("right"))
    long = weighed.where(F.size("items") > BLOCK).select("items", "weight", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))
    cut = long.select("weight", part(F.col("i")).alias("left"), F.explode(F.transform(F.sequence(F.col("i"), blocks - 1), part)).alias("right"))
    spread = cut.repartition(F.xxhash64("left"), F.xxhash64("right"))
    return (
        short.unionByName(spread)
        .select("weight", "right", F.explode("left").alias("item_a"))
        .select("weight", "item_a", F.explode("right").alias("item_b"))
        .where("item_a < item_b")
        .groupBy("item_a", "item_b")
        .agg(F.sum("weight").alias("k"))
        .where("k != 0")
    )


def _folders(of: dict) -> set[str]:
    return {p.split("/")[0] for at in of["at"].values() for p in at.values()}


class PairTable:
    """Persistent counts of baskets, items and pairs of items; see the module's text."""

    KEYS = {"baskets": ["basket"], "items": ["item"], "pairs": ["item_a", "item_b"]}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = Pointer(spark, self.path)

    # -- state ---------------------------------------------------------------------------
    def version(self) -> int:
        return self.pointer.read()[0]

    def _read(self, of: dict, what: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a table's buckets (all, or those named); None if they hold nothing."""
        at = of["at"][what]
        paths = [f"{self.path}/{at[str(b)]}" for b in (sorted(map(int, at)) if buckets is None else buckets) if str(b) in at]
        return self.spark.read.schema(of["schema"][what]).parquet(*paths) if paths else None

    def _all(self, what: str) -> DataFrame:
        of = self.pointer.read()[1]
        df = self._read(of, what)
        return df if df is not None else self.spark.createDataFrame([], of["schema"][what])

    def basket_state(self) -> DataFrame:
        return self._all("baskets")

    def items(self) -> DataFrame:
        return self._all("items")

    def pairs(self) -> DataFrame:
        return self._all("pairs")

    def total(self) -> int:
        """The number of baskets with an item."""
        return self.pointer.read()[1].get("total", 0)

    def _bucket(self, what: str, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.KEYS[what]), F.lit(n)).cast("int")

    def _touched(self, rows: DataFrame, what: str, n: int) -> list[int]:
        """The buckets in which rows lie: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self._bucket(what, n).alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, what: str, n: int, of: dict, touched: list[int] | None) -> dict:
        """Write the touched buckets anew (all for None); returns the table's new list of folders."""
        folder = f"{what}-{uuid.uuid4().hex[:12]}"
        # a bucket is one file of bounded size
        placed = rows.withColumn("bucket", self._bucket(what, n)).repartition(max(1, n if touched is None else len(touched)), "bucket").sortWithinPartitions("bucket", *self.KEYS[what])
        placed.write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        new = {f.split("=")[1]: f"{folder}/{f}" for f in folders(self.spark, f"{self.path}/{folder}") if f.startswith("bucket=")}
        old = {} if touched is None else {b: p for b, p in of["at"][what].items() if int(b) not in touched}
        return old | new

    # -- change --------------------------------------------------------------------------
    def apply(self, changed: DataFrame, basket: str, item: str, removed: DataFrame | None = None, amend: bool = False) -> None:
        """Take over new or changed baskets.

        ``changed`` holds all rows of each changed basket, or with ``amend`` rows to be
        added to it. ``removed`` has baskets that are gone. A change that changes nothing
        makes no version; another writer's version in between is a ``Conflict``.
        """
        v, of = self.pointer.read()
        new = baskets(changed, basket, item)
        if v:
            new = materialise(new, "pair-changes")
            gone = None if removed is None else removed.select(F.col(basket).alias("basket")).where("basket is not null").distinct()
            keys = new.select("basket") if gone is None else new.select("basket").unionByName(gone)
            old = self._read(of, "baskets", self._touched(keys, "baskets", of["buckets"]["baskets"]))
            if old is not None:
                prior = old.select("basket", F.col("items").alias("was"))
                both = new.join(prior, "basket", "left")
                if amend:
                    both = both.withColumn("items", F.when(F.col("was").isNotNull(), F.sort_array(F.array_union("items", "was"))).otherwise(F.col("items")))
                if gone is not None:
                    absent = prior.join(gone, "basket", "left_semi").join(new, "basket", "left_anti")
                    both = both.join(gone.withColumn("gone", F.lit(True)), "basket", "left").withColumn("items", F.when(F.col("gone").isNull(), F.col("items"))).drop("gone")
                    both = both.unionByName(absent.select("basket", F.lit(None).cast(new.schema["items"].dataType).alias("items"), "was"))
                new = both
        self._take(v, of, new)

    def sync(self, rows: DataFrame, basket: str, item: str) -> None:
        """Make the state that of ``rows``: baskets that differ from their stored form are changed, others untouched."""
        v, of = self.pointer.read()
        if not all(path_exists(self.spark, f"{self.path}/{f}") for f in (_folders(of) if v else ())):
            delete_path(self.spark, self.path)  # someone cleaned the folder in part: the rows have all that is needed
            v, of = 0, {}
        new = baskets(rows, basket, item)
        if v and (old := self._read(of, "baskets")) is not None:
            new = new.join(old.select("basket", F.col("items").alias("was")), "basket", "full")
        self._take(v, of, new)

    def _take(self, v: int, of: dict, new: DataFrame) -> None:
        """Commit the changes (basket, items, was): null items are a basket that is gone, null ``was`` a new one."""
        if "was" not in new.columns:
            new = new.withColumn("was", F.lit(None).cast(new.schema["items"].dataType))
        delta = materialise(new.where(~F.col("items").eqNullSafe(F.col("was"))), "pair-delta")
        count = delta.agg(F.count("*").alias("rows"), F.count("items").alias("now"), F.count("was").alias("was")).first()
        if v and not count["rows"]:
            return
        of = of or {"at": {w: {} for w in self.KEYS}, "buckets": {}, "rows": dict.fromkeys(self.KEYS, 0), "total": 0, "schema": {}}
        to: dict = {"at": {}, "buckets": {}, "rows": {}, "schema": {}, "total": of["total"] + count["now"] - count["was"]}
        sides = [F.struct(F.col(c).alias("items"), F.lit(s).cast("bigint").alias("sign")) for c, s in (("items", 1), ("was", -1))]
        signed = delta.select(F.explode(F.array(*sides)).alias("s")).select("s.items", "s.sign").where("items is not null")
        weighed = materialise(weigh(signed), "pair-weights")

        # the changed baskets take the place of their stored form
        gone = delta.select("basket")
        now = delta.where("items is not null").select("basket", "items")
        self._merge("baskets", of, to, gone, now, to["total"], lambda old: old.join(gone, "basket", "left_anti").unionByName(now))

        # marginals: stored counts and signed deltas are added up
        ones = materialise(marginal_deltas(weighed), "pair-items")
        n_ones = ones.count()
        add = lambda old: old.unionByName(ones).groupBy("item").agg(F.sum("n").alias("n")).where("n != 0")
        self._merge("items", of, to, ones, ones, of["rows"]["items"] + n_ones, add)
        items = self._read(to, "items")
        if items is None:
            items = self.spark.createDataFrame([], to["schema"]["items"])
        named = lambda df, c, n: df.select(F.col("item").alias(c), F.col("n").alias(n))

        # pairs: deltas come with their items' new counts; stored pairs of a changed item get its new count
        n_items = to["rows"]["items"]
        pairs = pair_deltas(weighed)
        for c in "ab":
            pairs = pairs.join(small(named(items, f"item_{c}", f"n_{c}"), n_items), f"item_{c}", "left")
        twos = materialise(pairs.select("item_a", "item_b", "k", *[F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("n_a", "n_b")]), "pair-counts")
        scored = lambda df: df.select("item_a", "item_b", "k", "n_a", "n_b", (F.col("k") / (F.col("n_a").cast("double") * F.col("n_b"))).alias("score"))
        old_pairs = self._read(of, "pairs") if v else None
        changed = twos.select("item_a", "item_b")
        recount = lambda df: df
        if old_pairs is not None:
            moved = ones.select("item").join(items, "item")
            for c in "ab":
                hit = old_pairs.join(small(moved.select(F.col("item").alias(f"item_{c}")), n_ones), f"item_{c}", "left_semi")
                changed = changed.unionByName(hit.select("item_a", "item_b"))

            def recount(df: DataFrame) -> DataFrame:
                for c in "ab":
                    df = df.join(small(named(moved, f"item_{c}", "_n"), n_ones), f"item_{c}", "left").withColumn(f"n_{c}", F.coalesce("_n", f"n_{c}")).drop("_n")
                return df.select(twos.columns)

        def join(old: DataFrame) -> DataFrame:
            both = recount(old.drop("score")).unionByName(twos)
            return scored(both.groupBy("item_a", "item_b").agg(F.sum("k").alias("k"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b")).where("k != 0"))

        self._merge("pairs", of, to, changed, scored(twos), of["rows"]["pairs"] + twos.count(), join)
        to["before"] = sorted(_folders(of))
        self.pointer.move(v + 1, to)
        self._sweep(to, of)

    def _merge(self, what: str, of: dict, to: dict, affected: DataFrame, fresh: DataFrame, rows: int, merge) -> None:  # type: ignore[no-untyped-def]
        """Bring a table to its next version: the buckets of ``affected`` rows through ``merge``, or ``fresh`` rows alone at first."""
        n = before = of["buckets"].get(what, 1)
        while rows > n * BUCKET_ROWS:
            n *= 2
        to["buckets"][what], to["rows"][what] = n, rows
        to["schema"][what] = of["schema"].get(what) or ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fresh.schema)
        touched = None if n != before or not of["at"][what] else self._touched(affected, what, n)
        old = self._read(of, what, touched)
        to["at"][what] = self._write(fresh if old is None else merge(old), what, n, of, touched)

    def _sweep(self, to: dict, of: dict) -> None:
        """Remove folders that only the version before the last has; readers of the last keep theirs."""
        self.pointer.forget(2)
        for folder in set(of.get("before", ())) - _folders(to) - _folders(of):
            delete_path(self.spark, f"{self.path}/{folder}")

    # -- scores --------------------------------------------------------------------------
    def scores(self) -> DataFrame:
        """(item_a, item_b, k, n_a, n_b, n, lift): how much more often than by chance; the stored scores, times all baskets."""
        n = F.lit(self.total()).cast("bigint")
        return self.pairs().select("item_a", "item_b", "k", "n_a", "n_b", n.alias("n"), (F.col("score") * n).alias("lift"))


def stands_out(k: Column, n: Column, n_a: Column, n_b: Column) -> Column:
    """At least 6 records, at least one in a thousand, at least 4 times as many as by chance."""
    wide = lambda c: c.cast("decimal(38,0)")
    return (k >= 6) & (k * 1000 >= n) & (wide(k) * wide(n) >= 4 * wide(n_a) * wide(n_b))


def skill_pairs(links: DataFrame, *, path: str) -> DataFrame:
    """Pairs of skills that share postings clearly more often than chance would give.

    The state under ``path`` is brought to the links as they are now: at first all postings
    are changes, later those whose skills differ. An empty table has no pairs.
    """
    held = PairTable(links.sparkSession, path)
    try:
        held.sync(links, "posting_id", "skill_id")
    except Conflict:  # another run brought it on; what differs still is taken over
        held.sync(links, "posting_id", "skill_id")
    s = held.scores()
    return s.where(stands_out(F.col("k"), F.col("n"), F.col("n_a"), F.col("n_b"))).select(
        F.col("item_a").alias("skill_id_a"), F.col("item_b").alias("skill_id_b"), "k", "n_a", "n_b", "n", "lift"
    )


def of_directory(spark: SparkSession, d: str) -> DataFrame:
    """``skill_pairs`` of a data directory, with the state kept for it."""
    return skill_pairs(table(spark, d, "posting_skill"), path=state_dir(spark, f"skill-pairs{FORMAT}", d))
