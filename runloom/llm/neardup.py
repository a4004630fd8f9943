"""Operator 6. MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.base import WordHashes, broadcast_if_small, held, small_batches, table, text_runs, written, written_small
from runloom.llm.shingles import BANDS, shingle_sets, signatures

#: Links need 100 * |A and B| >= percent * |A or B|; op6_minhash_near_dedup has a percentage of its own.
PERCENT, OP6_PERCENT = 80, 85
#: A group's open pairs are confirmed one by one if there are at most so many for each member.
FEW = 8
#: A template is copied so many times, so a large group meets it in as many tasks.
SALTS = 16


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = held(("words",), WordHashes)
    for rows, texts in text_runs(batches, 1):
        flat, ends = shingle_sets(words, texts)
        fp, bands = signatures(flat, ends)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * BANDS), pa.array(bands.reshape(-1).view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(ends).astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists], names=["id", "n", "f1", "f2", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = held(("words",), WordHashes)
    for rows, texts in text_runs(batches, 1):
        flat, ends = shingle_sets(words, texts)
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["id", "set"])


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, least): each node of the edges (a, b) with the smallest node that it is connected to.

    Alternating large and small stars: every step keeps the components and shortens paths,
    until each node hangs on its component's least. Each step is a minimum by node, made
    before the shuffle where it can be, written, and joined: broadcast while it is small,
    else by a shuffle whose large keys can be split.
    """
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    n, before = e.count(), None
    small = lambda df, k: written_small(df, k * n, name)  # noqa: E731 (no step makes more than twice as many rows)
    while True:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        least = broadcast_if_small(small(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), 2))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = small(large, 1)
        least = broadcast_if_small(small(large.groupBy("u").agg(F.min("v").alias("m")), 1))
        stars = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        e = small(stars.where("u != v").distinct(), 2)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("least"))


def merged(least: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, least) after more edges (a, b): these connect components, which are few nodes, and no link is looked at again."""
    n = least.count()
    small = broadcast_if_small(least)
    at = lambda c: small.select(F.col("node").alias(c), F.col("least").alias(f"c{c}"))
    between = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    between = written_small(between.distinct(), n, "between")
    if between.isEmpty():
        return least
    top = broadcast_if_small(written_small(components(between).select(F.col("node").alias("top"), F.col("least").alias("new")), n, "least"))
    out = least.join(top, F.col("least") == F.col("top"), "left").select("node", F.coalesce("new", "least").alias("least"))
    lone = top.join(least, F.col("top") == F.col("node"), "left_anti").select(F.col("top").alias("node"), F.col("new").alias("least"))
    return out.unionByName(lone)


def candidates(reps: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of the ids of reps (id, n, bands) that share a bucket with a hub of it; and the buckets (bucket, id, n, c) of more than one member, c of them.

    A bucket links its members to two of them only: the most central, that is the one with
    the most company in all its buckets (in a group of copies with edits this is the text
    they were made from), and one picked by a hash of its own, another in each bucket. So a
    bucket of k members gives less than 2 k pairs. Pairs whose sizes rule out a link go.
    What these pairs leave open is for rest_of_buckets.
    """
    rows = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = written_small(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), 8 * reps.count(), "shared")
    buckets = rows = written_small(rows.join(broadcast_if_small(shared), "bucket"), 8 * reps.count(), "buckets")
    central = rows.groupBy("id").agg(F.sum("c").alias("company"))
    rows = rows.join(central, "id")
    hub = lambda order: F.max(F.struct(order.alias("o"), (-F.col("id")).alias("i"), "n"))
    hubs = rows.groupBy("bucket").agg(hub(F.col("company")).alias("x"), hub(F.xxhash64("id", "bucket")).alias("y"))
    hubs = written_small(hubs, shared.count(), "hubs")  # so the join below can split a large bucket
    hubs = hubs.select("bucket", F.explode(F.array_distinct(F.array(F.struct((-F.col("x.i")).alias("hub"), F.col("x.n").alias("m")), F.struct((-F.col("y.i")).alias("hub"), F.col("y.n").alias("m"))))).alias("h")).select("bucket", "h.*")
    pairs = rows.join(hubs, "bucket").where((F.col("id") != F.col("hub")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    return pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), buckets


def side(t: DataFrame, i: int, on: list[str]) -> DataFrame:
    """t with a number behind the names of all columns but `on`."""
    return t.select(*on, *[F.col(c).alias(f"{c}{i}") for c in t.columns if c not in on])


def across(members: DataFrame, on: list[str], rows: int, bounds: dict[str, Column] | None = None, may: Column | None = None) -> DataFrame:
    """All pairs of members (columns on, comp and others) that agree in `on` and differ in comp, each once, from 0 and 1 of its columns.

    Pairs of components are made first, and members put to them, so no pair within a
    component is ever made: a settled group of any size beside a few others costs what its
    pairs with these do. bounds are aggregates of a component's members; may says from those
    of two components, numbered 0 and 1, whether a pair of theirs can count at all.
    """
    comps = members.groupBy(*on, "comp").agg(*[c.alias(n) for n, c in (bounds or {"k": F.count(F.lit(1))}).items()])
    comps = written_small(comps, rows, "components")
    two = side(comps, 0, on).join(side(comps, 1, on), on).where(F.expr("comp0 < comp1") & (F.lit(True) if may is None else may)).select(*on, "comp0", "comp1")
    return two.join(side(members, 0, on), [*on, "comp0"]).join(side(members, 1, on), [*on, "comp1"])


def rest_of_buckets(buckets: DataFrame, least: DataFrame, sets_of, confirmed, percent: int = PERCENT) -> DataFrame | None:
    """The links (a, b) that the hubs' links leave out within the buckets, given the components of those; None if no bucket is open.

    A bucket whose members are in one component is settled. The members of all other buckets
    that have the same most central member H form one group, so a group of near copies is
    looked at once and not in each of its buckets. Where a group's open pairs, that is those
    of different components, are few for each member, they are confirmed one by one.

    Else H serves as a template. With D(A) = what A lacks of H and what it has besides, and
    W(A) = 100 * |H - A| + percent * |A - H|, two members are linked exactly if
    (100 + percent) * |D(A) and D(B)| >= W(A) + W(B) - (100 - percent) * |H|. A is linked with
    H itself if W(A) is at most the last term; such members are in one component, so a pair
    that is still open has one that isn't, and needs a common element of the D's. By how many
    it needs at least, over all partners that the group offers, only the rarest elements of a
    D can be the first common ones (prefix filter; rarity is counted in the group), and what
    the D's hold after it bounds the overlap (positional filter). Only members that share
    such an element are compared, once, by their D's. So no link is left out, and pairs
    without a rare difference in common are never made.

    buckets has the columns bucket, id, n and c, of candidates(). sets_of gives (id, set) for
    a table of ids; confirmed the links among pairs (a, b).
    """
    comp = broadcast_if_small(written_small(least.select(F.col("node").alias("id"), "least"), buckets.count(), "least"))
    rows = buckets.where("c > 2").join(comp, "id", "left").withColumn("comp", F.coalesce("least", "id")).drop("least")
    sums = [F.sum("k").alias("all"), ((F.sum("k") * F.sum("k") - F.sum(F.col("k") * F.col("k"))) / 2).alias("cross")]
    by = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(*sums).where("cross > 0")
    by = written_small(by.select("bucket"), buckets.count(), "unsettled")  # tables of their own, so the joins with them can split a large bucket
    rows = written(rows.join(broadcast_if_small(by), "bucket", "left_semi"), "open")
    n = rows.count()
    if not n:
        return None
    company = rows.groupBy("id").agg(F.sum("c").alias("company"))
    hubs = rows.join(company, "id").groupBy("bucket").agg((-F.max(F.struct("company", (-F.col("id")).alias("i")))["i"]).alias("hub"))
    hubs = broadcast_if_small(written_small(hubs, by.count(), "hubs"))
    members = written_small(rows.join(hubs, "bucket").select("hub", "id", "n", "comp").distinct(), n, "groups")
    size = members.groupBy("hub", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("hub").agg(*sums)
    size = broadcast_if_small(written_small(size, n, "sizes"))
    close = lambda: 100 * F.least("n0", "n1") >= percent * F.greatest("n0", "n1")
    few = members.join(size.where(F.col("cross") <= FEW * F.col("all")), "hub").select("hub", "id", "n", "comp")
    pairs = across(few, ["hub"], n).where(close())
    links = confirmed(written_small(pairs.select(F.least("id0", "id1").alias("a"), F.greatest("id0", "id1").alias("b")).distinct(), FEW * n, "few"))
    many = members.join(size.where(F.col("cross") > FEW * F.col("all")), "hub").select("hub", "id", "n", "comp")
    many = written_small(many, n, "many")
    if many.isEmpty():
        return links
    sets = written(sets_of(many.select("id").distinct()), "open-sets")
    salt = F.array([F.lit(i) for i in range(SALTS)])
    template = sets.join(many.select(F.col("hub").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.max("set").alias("t")).select(F.col("id").alias("hub"), "t", F.explode(salt).alias("salt"))
    d = many.where("id != hub").join(sets, "id").withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(template, ["hub", "salt"])
    d = d.select("hub", "id", "n", "comp", F.array_except("set", "t").alias("own"), F.array_except("t", "set").alias("lacks"), F.size("t").alias("h"))
    d = d.select("hub", F.struct("id", F.monotonically_increasing_id().alias("text")).alias("node"), "id", "n", "comp", F.concat("own", "lacks").alias("d"), (100 * F.size("lacks") + percent * F.size("own") - (100 - percent) * F.col("h")).alias("w"), ((100 - percent) * F.col("h")).alias("g"))
    d = written(d, "differences")  # w is W less the last term: above 0 for those that H isn't linked with
    least_w = broadcast_if_small(written_small(d.groupBy("hub").agg(F.min("w").alias("low"), F.min(F.when(F.col("w") > 0, F.col("w"))).alias("far"), F.max("g").alias("g")), n, "weights"))
    need = F.ceil((F.col("w") + F.when(F.col("w") > 0, F.col("low")).otherwise(F.col("far")) + F.col("g")) / (100 + percent))
    d2 = d.join(least_w.drop("g"), "hub").where("far IS NOT NULL").withColumn("take", F.size("d") - F.greatest(need, F.lit(1)) + 1)
    words = d2.where("take > 0").select("hub", "node", "comp", "n", "w", "take", F.size("d").alias("k"), F.explode("d").alias("s"))
    often = words.groupBy("hub", "s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    first = words.join(often, ["hub", "s"]).groupBy("hub", "node", "comp", "n", "w", "take", "k").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("x"))
    alone = F.col("k") - F.size("x")
    first = first.select("hub", "node", "comp", "n", "w", F.size("x").alias("k"), F.slice("x", 1, F.greatest(F.lit(0), F.col("take") - alone).cast("int"))["s"].alias("all"))
    first = first.select("hub", "node", "comp", "n", "w", "k", "all", F.posexplode("all").alias("at", "s"))
    first = first.select("hub", "node", "comp", "n", "w", "all", "s", (F.col("k") - F.col("at")).alias("left")).join(least_w.select("hub", "g"), "hub")
    first = written(first, "prefixes")
    on = ["hub", "s"]
    shares = lambda a, b: F.element_at(F.array_intersect(a, b), 1) == F.col("s")
    bounds = {"w": F.min("w"), "most": F.max("w"), "left": F.max("left"), "g": F.max("g"), "low": F.min("n"), "high": F.max("n"), "own": F.when(F.count(F.lit(1)) == 1, F.first("all"))}
    may = (F.greatest("most0", "most1") > 0) & ((100 + percent) * F.least("left0", "left1") >= F.col("w0") + F.col("w1") + F.col("g0"))
    may = may & (100 * F.col("high0") >= percent * F.col("low1")) & (100 * F.col("high1") >= percent * F.col("low0")) & F.coalesce(shares("own0", "own1"), F.lit(True))
    met = across(first, on, first.count(), bounds, may).where((F.greatest("w0", "w1") > 0) & close())
    # of several shared elements the first makes the pair; what is left from there on must be enough
    met = met.where(shares("all0", "all1") & ((100 + percent) * F.least("left0", "left1") >= F.col("w0") + F.col("w1") + F.col("g0")))
    met = written(met.select("hub", "node0", "node1"), "met")
    own = d.select("hub", "node", "d", "w", "g")
    j = met.join(side(own, 0, ["hub"]), ["hub", "node0"]).join(side(own, 1, ["hub"]), ["hub", "node1"])
    j = j.where((100 + percent) * F.size(F.array_intersect("d0", "d1")) >= F.col("w0") + F.col("w1") + F.col("g0"))
    found = j.select(F.least("node0.id", "node1.id").alias("a"), F.greatest("node0.id", "node1.id").alias("b")).where("a != b")
    found = found.union(d.where("w <= 0").select(F.least("id", "hub"), F.greatest("id", "hub"))).distinct()
    return links.union(written_small(found, met.count() + n, "rest"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row for each document: key, n_shingles, component_id, kept.

    Documents are linked if their sets of five-word shingles have a similarity of percent / 100
    or more; component_id is the least key of what a document is linked with over any path.
    Texts with equal sets form a class first and go on as one representative, so copies cost
    one row each and no pair. Candidates are confirmed on the full sets. All linked documents
    that share one of the 32 buckets get one component; hubs are tried first, then what they
    leave open.

    A null or empty text has no shingles and is its own component. A null key takes no part:
    its component_id is null and it is kept. Rows that repeat a key count as one document,
    linked with all that any of its texts is linked with; n_shingles is each row's own. An
    empty table gives no rows. Other columns of docs are not looked at.
    """
    ids = small_batches(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = written(ids.mapInArrow(_sketch, "id long, n long, f1 long, f2 long, bands array<long>"), "sketch")
    n = sketch.count()
    classes = sketch.where("n > 0 AND id IS NOT NULL").groupBy("f1", "f2").agg(F.min("id").alias("rep"), F.max("n").alias("rep_n"))
    classes = written_small(classes, n, "classes")
    reps = sketch.join(classes.select(F.col("rep").alias("id"), "f1", "f2"), ["id", "f1", "f2"], "left_semi").dropDuplicates(["id", "f1", "f2"])
    reps = written_small(reps, n, "reps")

    def sets_of(need: DataFrame) -> DataFrame:
        need = written_small(need, n, "ids")
        return ids.join(broadcast_if_small(need), "id", "left_semi").mapInArrow(_sets, "id long, set array<long>").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = written(sets_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()), "sets")
        j = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
        both = F.size(F.array_intersect("x", "y"))
        return written_small(j.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b").distinct(), pairs.count(), "confirmed", 1 << 12)

    pairs, buckets = candidates(reps, percent)
    pairs = written_small(pairs, 8 * n, "pairs")
    links = confirmed(pairs)
    # a key with several texts is one document: its texts' classes are linked
    text_of = F.struct("f1", "f2")
    several = sketch.where("n > 0 AND id IS NOT NULL").groupBy("id").agg(F.min(text_of).alias("a"), F.max(text_of).alias("b")).where("a != b").select("id")
    several = written_small(several, n, "several")
    if not several.isEmpty():
        own = sketch.where("n > 0").join(several, "id", "left_semi").join(classes, ["f1", "f2"]).select("id", "rep")
        own = own.join(own.groupBy("id").agg(F.min("rep").alias("a")), "id").where("a != rep").select("a", F.col("rep").alias("b")).distinct()
        links = links.union(written_small(own, n, "same-key"))
    least = components(links)
    rest = rest_of_buckets(buckets, least, sets_of, confirmed, percent)
    if rest is not None:
        least = merged(least, rest)
    some = F.col("n") > 0
    out = sketch.where(some & F.col("id").isNotNull()).select("id", "n", "f1", "f2").join(classes.select("f1", "f2", "rep"), ["f1", "f2"]).select("id", "n", "rep")
    out = out.join(broadcast_if_small(written_small(least, n, "least")), F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("least", "rep").alias("component_id"))
    out = out.unionByName(sketch.where(~some | F.col("id").isNull()).select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=OP6_PERCENT)
