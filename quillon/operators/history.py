"""Commit graphs and trees: what is reachable, what lies between, where branches left each other, what two revisions differ in.

A history is cut into runs: chains in which each commit has one parent and that parent one child.
Runs are found by pointer doubling, in as many rounds as the logarithm of the longest; only the
oldest commit of a run has parents in other runs, and these are the newest there. So the ancestors
of a commit are a part of its own run and other runs whole, and walks go from run to run. A run's
generation is one more than the largest of its parents' runs: no walk goes below what it looks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.tables import BROADCAST_ROWS, dropped, written


@dataclass
class History:
    """nodes (sha, run, place from the run's oldest) and runs (run, generation, parents, newest); runs are numbers."""

    nodes: DataFrame
    runs: DataFrame

    @staticmethod
    def of(commits: DataFrame) -> History:
        """The graph of commits (sha, parents); parents that are no commits here count as none, as behind a shallow end."""
        known = commits.select("sha", F.array_distinct(F.coalesce("parents", F.array().cast("array<string>"))).alias("parents")).dropDuplicates(["sha"])
        # From here on commits and runs are numbers, which are written once.
        known = written(known.withColumn("id", F.monotonically_increasing_id()))
        links = known.select("id", F.explode("parents").alias("sha")).join(known.select("sha", F.col("id").alias("parent")), "sha").select("id", "parent")
        links = written(links)
        single = links.groupBy("id").agg(F.count("*").alias("n"), F.first("parent").alias("to")).filter("n = 1").select("id", "to")
        only = links.groupBy(F.col("parent").alias("to")).agg(F.count("*").alias("n")).filter("n = 1").select("to")
        at = written(known.select("id", "sha").join(single.join(only, "to", "left_semi"), "id", "left").select("id", "sha", F.coalesce("to", "id").alias("run"), F.col("to").isNotNull().cast("long").alias("place")))
        while True:
            # Everyone's pointer jumps to where its target points; a run's oldest commit points to itself.
            far = at.select(F.col("id").alias("run"), F.col("run").alias("further"), F.col("place").alias("more")).filter("more > 0")
            if at.filter("place > 0").join(far, "run", "left_semi").isEmpty():
                break
            after = written(at.join(far, "run", "left").select("id", "sha", F.coalesce("further", "run").alias("run"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place")))
            dropped(at)
            at = after
        above = links.join(at.filter("place > 0").select("id"), "id", "left_anti").join(at.select(F.col("id").alias("parent"), F.col("run").alias("above")), "parent")
        above = above.groupBy(F.col("id").alias("run")).agg(F.collect_set("above").alias("parents"))
        newest = at.groupBy("run").agg(F.max("place").alias("newest"))
        runs = written(newest.join(above, "run", "left").select("run", F.coalesce("parents", F.array().cast("array<bigint>")).alias("parents"), "newest"))
        return History(at.select("sha", "run", "place"), _generations(runs))

    def write(self, path: str) -> None:
        self.nodes.write.parquet(f"{path}/nodes")
        self.runs.write.parquet(f"{path}/runs")

    @staticmethod
    def read(spark: SparkSession, path: str) -> History:
        return History(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/runs"))

    def reached(self, starts: DataFrame) -> DataFrame:
        """(name, run, upto): what is reachable from each name's commits (name, sha), as places of runs; any number of names at once."""
        found = frontier = self._entered(starts)
        while not frontier.isEmpty():
            known, found, frontier = self._step(found, frontier)
            dropped(known)
        return found

    def _entered(self, starts: DataFrame) -> DataFrame:
        return written(starts.join(self.nodes, "sha").groupBy("name", "run").agg(F.max("place").alias("upto")))

    def _step(self, found: DataFrame, frontier: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        up = frontier.select("name", "run").join(self.runs.select("run", F.explode("parents").alias("above")), "run").select("name", F.col("above").alias("run")).distinct()
        fresh = up.join(self.runs.select("run", F.col("newest").alias("upto")), "run").select("name", "run", "upto")
        # A run that was entered in its middle may be reached whole later on.
        new = written(fresh.join(found, ["name", "run", "upto"], "left_anti"), compact=True)
        both = written(found.unionByName(new).groupBy("name", "run").agg(F.max("upto").alias("upto")))
        return found, both, new

    def ancestors(self, starts: DataFrame) -> DataFrame:
        """(name, sha): each name's commits and all that is reachable from them."""
        return self.nodes.join(self.reached(starts), "run").filter("place <= upto").select("name", "sha")

    def between(self, since: DataFrame, until: DataFrame) -> DataFrame:
        """(sha): what is reachable from a commit of ``until`` (sha) and from none of ``since``.

        Both sides walk at once. The later side stops where the earlier has been, and the earlier
        goes no further back than the oldest generation that the later has reached, so the work
        grows with the range and not with the history behind it.
        """
        starts = since.select(F.lit("since").alias("name"), "sha").unionByName(until.select(F.lit("until").alias("name"), "sha")).distinct()
        generation = self.runs.select("run", "generation", "newest")
        found = self._entered(starts)
        waiting = found
        while True:
            covered = found.filter("name = 'since'").select("run", F.col("upto").alias("not_below"))
            wanted = found.filter("name = 'until'").join(covered, "run", "left").filter("not_below is null or upto > not_below").select("run", "upto", "not_below").join(generation, "run")
            least = wanted.agg(F.min("generation")).first()[0]
            if least is None:
                return self.nodes.limit(0).select("sha")
            # What is above a run that the earlier side is in, the earlier side reaches as well.
            ahead = waiting.filter("name = 'until'").join(wanted.filter("not_below is null").select("run"), "run", "left_semi")
            behind = waiting.filter("name = 'since'").join(generation.filter(F.col("generation") > least).select("run"), "run", "left_semi")
            now = written(ahead.unionByName(behind), compact=True)
            if now.isEmpty():
                break
            left = waiting.join(now.select("name", "run"), ["name", "run"], "left_anti")
            known, found, new = self._step(found, now)
            waiting = written(left.unionByName(new), compact=True)
        covered = found.filter("name = 'since'").select("run", F.col("upto").alias("not_below"))
        parts = found.filter("name = 'until'").join(covered, "run", "left").filter("not_below is null or upto > not_below")
        return self.nodes.join(parts, "run").filter((F.col("place") <= F.col("upto")) & (F.col("place") > F.coalesce("not_below", F.lit(-1)))).select("sha")

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """(pair, sha): the best common ancestors of the two sides of each pair (pair, side 0 or 1, sha); a side may have several commits.

        A common ancestor is a best one if no other common one has it as an ancestor. All pairs walk
        from the largest generation down, so a run is met once, after all that lead to it, and no
        pair's past is kept: a run that both sides lead to is a best one unless a common one led to
        it as well (``stale``). A pair whose runs are all stale has met all of its bases.
        """
        part = lambda n: F.max(F.when(F.col("side") == n, F.col("place")))
        rows = written(pairs.select("pair", "side", "sha").join(self.nodes, "sha").groupBy("pair", "run").agg(part(0).alias("left"), part(1).alias("right")))
        rows = rows.select(*rows.columns, F.lit(False).alias("stale"), F.lit(False).alias("best"))
        last = rows.select("run").distinct().join(self.runs, "run").agg(F.max("generation")).first()[0] or 0
        # The numbers of runs tell how many generations one job can walk.
        sizes = {r[0]: r[1] for r in self.runs.filter(F.col("generation") <= last).groupBy("generation").count().collect()}
        out, before = None, None
        while last > 0:
            room, steps = BROADCAST_ROWS, 0
            while steps < WALKED and last > 0 and (not steps or sizes.get(last, 0) <= room):
                runs = self.runs.filter(F.col("generation") == last).select("run", "parents", "newest")
                rows = _walked(rows, F.broadcast(runs) if sizes.get(last, 0) <= BROADCAST_ROWS else runs)
                room, steps, last = room - sizes.get(last, 0), steps + 1, last - 1
            done = written(rows)
            found = done.filter("best").select("pair", "run", F.col("left").alias("place"))
            out = found if out is None else out.unionByName(found)
            rows = done.filter("not best").withColumn("open", F.max(~F.col("stale")).over(Window.partitionBy("pair"))).filter("open").drop("open")
            if rows.isEmpty():
                break
        out = pairs.select("pair", F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("place")).limit(0) if out is None else out
        return self.nodes.join(out, ["run", "place"]).select("pair", "sha")


#: Generations that one job walks at most.
WALKED = 8
#: A place that stands for a run's newest.
WHOLE = 1 << 62


def _walked(rows: DataFrame, level: DataFrame) -> DataFrame:
    """``rows`` (pair, run, left, right, stale, best) a generation further: those in a run of ``level`` go to its parents.

    left and right are the newest places that the sides lead to. A common run that is not stale
    stays, as a best one. Partitions by pair stay, so steps that broadcast their level shuffle once.
    """
    both = F.col("left").isNotNull() & F.col("right").isNotNull()
    own = ["run", "left", "right", "stale", "best"]
    whole = lambda side: F.when(F.col(side).isNotNull(), F.lit(WHOLE))
    up = F.transform("parents", lambda p: F.struct(p.alias("run"), whole("left").alias("left"), whole("right").alias("right"), both.alias("stale"), F.lit(False).alias("best")))
    base = F.least("left", "right", "newest")
    base = F.struct("run", base.alias("left"), base.alias("right"), F.lit(False).alias("stale"), F.lit(True).alias("best"))
    after = F.when(F.col("parents").isNull() | F.col("best"), F.array(F.struct(*own))).when(both & ~F.col("stale"), F.concat(F.array(base), up)).otherwise(up)
    each = rows.repartition("pair").join(level, "run", "left").select("pair", F.explode(after).alias("x")).select("pair", "x.*")
    return each.groupBy("pair", "run", "best").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("stale").alias("stale")).select("pair", *own)


def _generations(runs: DataFrame) -> DataFrame:
    """(run, generation, parents, newest) of ``runs`` without generation: a round for each generation.

    A round takes the links to what the last one has found. Runs that wait for more parents are
    kept with how many they have met; all others are not touched.
    """
    links = written(runs.filter(F.size("parents") > 0).select("run", "parents", "newest", F.explode("parents").alias("above")))
    own, n = ["run", "parents", "newest"], 1
    last, waiting = runs.filter(F.size("parents") == 0), None
    every = last.select(*own, F.lit(n).alias("generation"))
    while True:
        met = links.join(last.select(F.col("run").alias("above")), "above", "left_semi").select(*own, F.lit(1).cast("long").alias("met"))
        met = met if waiting is None else met.unionByName(waiting)
        now = written(met.groupBy("run").agg(F.first("parents").alias("parents"), F.first("newest").alias("newest"), F.sum("met").alias("met")), compact=True)
        last, waiting, n = now.filter(F.col("met") == F.size("parents")).drop("met"), now.filter(F.col("met") < F.size("parents")), n + 1
        if last.isEmpty():
            break
        every = every.unionByName(last.select(*own, F.lit(n).alias("generation")))
    return written(every.select("run", "generation", "parents", "newest"))


def newest_first(history: History, shas: DataFrame) -> DataFrame:
    """``shas`` with generation and place of each, which order a history: a parent is of a smaller generation, or place of the same run."""
    return shas.join(history.nodes, "sha").join(history.runs.select("run", "generation"), "run").select("sha", "generation", "place")


def listed(trees: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, path, hash): the files of the trees ``roots`` (root), expanded a level a round.

    ``trees`` has a row for each entry of each tree: tree, name, kind (tree or blob), hash.
    """
    level, out = roots.select("root", F.lit("").alias("path"), F.col("root").alias("tree")).distinct(), None
    while True:
        entries = written(level.join(trees, "tree").select("root", F.concat("path", "name").alias("path"), "kind", "hash"))
        files = entries.filter("kind = 'blob'").select("root", "path", "hash")
        out = files if out is None else out.unionByName(files)
        level = entries.filter("kind = 'tree'").select("root", F.concat("path", F.lit("/")).alias("path"), F.col("hash").alias("tree"))
        if level.isEmpty():
            return out


def tree_changes(trees: DataFrame, before: str | None, after: str | None) -> DataFrame:
    """(path, change, level): added, deleted and modified files between two root trees; None is an empty tree.

    Only pairs of subtrees whose hashes differ are opened: a level of folders a round, and work by
    what changed. A name that is a folder on one side and a file on the other is both deleted and
    added.
    """
    spark = trees.sparkSession
    level, out, depth = spark.createDataFrame([("", before, after)], "path string, before string, after string").filter("not before <=> after"), None, 0
    while True:
        def side(name: str) -> DataFrame:
            of = level.filter(F.col(name).isNotNull()).select("path", F.col(name).alias("tree")).join(trees, "tree")  # noqa: B023
            return of.select(F.concat("path", "name").alias("path"), "kind", F.col("hash").alias(name))

        both = written(side("before").join(side("after"), ["path", "kind"], "full").filter("not before <=> after"), compact=True)
        change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "deleted").otherwise("modified")
        files = both.filter("kind = 'blob'").select("path", change.alias("change"), F.lit(depth).alias("level"))
        out = files if out is None else out.unionByName(files)
        level, depth = both.filter("kind = 'tree'").select(F.concat("path", F.lit("/")).alias("path"), "before", "after"), depth + 1
        if level.isEmpty():
            return out


def best_base(history: History, bases: DataFrame) -> DataFrame:
    """(pair, sha): one base a pair; of several the one of the largest generation, then the smallest sha."""
    ranked = bases.join(newest_first(history, bases.select("sha").distinct()), "sha")
    order = Window.partitionBy("pair").orderBy(F.desc("generation"), "sha")
    return ranked.withColumn("n", F.row_number().over(order)).filter("n = 1").select("pair", "sha")
