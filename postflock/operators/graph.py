"""Mention and retweet graphs: adjacency, links, neighbours, ego networks.

Edges (src, dst) are a multiset. A row is made for each user of the dictionary
that takes part in any link at all, also if none of its links leads to another
user of the dictionary.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mentioned_users, retweeted_user
from ..sources.staging import settled, stage
from .features import variance


def edges(posts: DataFrame, kind: str) -> DataFrame:
    """``kind`` is mention (to each user mentioned before a retweet marker) or
    retweet (to the user retweeted)."""
    if kind == "mention":
        return posts.select(F.col("user_name").alias("src"), F.explode(mentioned_users(F.col("text"))).alias("dst"))
    if kind == "retweet":
        return posts.select(F.col("user_name").alias("src"), retweeted_user(F.col("text")).alias("dst")).where("dst <> ''")
    raise ValueError(f"no graph of {kind!r}")


def reverse(links: DataFrame) -> DataFrame:
    return links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _users(users: DataFrame, name: str) -> DataFrame:
    return users.select(F.col("user_name").alias(name)).distinct()


def count_links(links: DataFrame) -> DataFrame:
    """Distinct (src, dst, times): what all functions below may be given as links, so
    that texts are read once for several of them."""
    return links.groupBy("src", "dst").agg((F.sum("times") if "times" in links.columns else F.count(F.lit(1))).alias("times"))


def counted_links(links: DataFrame, users: DataFrame) -> DataFrame:
    """Distinct (src, dst, times) between different users of the dictionary. Links
    are counted first, so that a much repeated one is a single row in the joins."""
    each = count_links(links.where("src <> dst"))
    return each.join(_users(users, "src"), "src", "left_semi").join(_users(users, "dst"), "dst", "left_semi")


def candidates(links: DataFrame, users: DataFrame, both: bool = False) -> DataFrame:
    """(user_name) of the dictionary's users with an outgoing link, or any."""
    ends = links.select(F.col("src").alias("user_name"))
    if both:
        ends = ends.unionByName(links.select(F.col("dst").alias("user_name")))
    return ends.distinct().join(_users(users, "user_name"), "user_name", "left_semi")


def out_neighbours(links: DataFrame, users: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(user_name, n, nbrs): sorted distinct neighbours of each user. ``known``, here
    and below, is the result of ``counted_links`` if it is there already."""
    known = counted_links(links, users) if known is None else known
    lists = known.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))
    rows = candidates(links, users).join(lists, F.col("user_name") == F.col("src"), "left")
    nbrs = F.coalesce("nbrs", F.array().cast("array<string>"))
    return rows.select("user_name", F.size(nbrs).cast("bigint").alias("n"), nbrs.alias("nbrs"))


def in_neighbours(links: DataFrame, users: DataFrame) -> DataFrame:
    return out_neighbours(reverse(links), users)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def link_stats(links: DataFrame, users: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """user_name, uniq_double (neighbours linked both ways), uniq_out, double_out
    (their share), uniq_in, double_in, total_out, total_in."""
    known = counted_links(links, users) if known is None else known
    ways = known.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("times").alias("outs"), F.lit(0).cast("bigint").alias("ins"))
    ways = ways.unionByName(known.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.lit(0).cast("bigint").alias("outs"), F.col("times").alias("ins")))
    pairs = ways.groupBy("a", "b").agg(F.sum("outs").alias("outs"), F.sum("ins").alias("ins"))
    stats = pairs.groupBy("a").agg(
        F.count_if((F.col("outs") > 0) & (F.col("ins") > 0)).alias("uniq_double"),
        F.count_if(F.col("outs") > 0).alias("uniq_out"),
        F.count_if(F.col("ins") > 0).alias("uniq_in"),
        F.sum("outs").alias("total_out"),
        F.sum("ins").alias("total_in"),
    )
    rows = candidates(links, users, both=True).join(stats, F.col("user_name") == F.col("a"), "left").na.fill(0)
    return rows.select("user_name", "uniq_double", "uniq_out", _ratio("uniq_double", "uniq_out").alias("double_out"), "uniq_in", _ratio("uniq_double", "uniq_in").alias("double_in"), "total_out", "total_in")


def _mean_and_variance(n: str, total: str, squares: str) -> tuple[Column, Column]:
    c, s, q = F.col(n), F.col(total), F.col(squares)
    some = c > 0
    return F.when(some, s / c).otherwise(float("nan")), F.when(some, variance(c, s, q)).otherwise(float("nan"))


def neighbour_stats(links: DataFrame, users: DataFrame, degrees: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Mean and variance of the out- and in-degrees (``degrees`` is the result of
    ``link_stats``) of each user's out- and in-neighbours; NaN for no neighbours."""
    known = counted_links(links, users) if known is None else known
    of = degrees.select(F.col("user_name").alias("dst"), F.col("uniq_out").alias("o"), F.col("uniq_in").alias("i"))

    def side(way: DataFrame, name: str) -> DataFrame:
        sums = [f for d in ("o", "i") for f in (F.sum(d).alias(f"{d}_sum"), F.sum(F.col(d) * F.col(d)).alias(f"{d}_squares"))]
        rows = way.join(of, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("c"), *sums)
        out = []
        for d, degree in (("o", "out"), ("i", "in")):
            mean, var = _mean_and_variance("c", f"{d}_sum", f"{d}_squares")
            out += [mean.alias(f"{name}_{degree}_mean"), var.alias(f"{name}_{degree}_var")]
        return rows.select(F.col("src").alias(f"{name}_of"), *out)

    rows = candidates(links, users, both=True)
    for way, name in ((known, "out"), (reverse(known), "in")):
        rows = rows.join(side(way, name), F.col("user_name") == F.col(f"{name}_of"), "left").drop(f"{name}_of")
    return rows.select("user_name", *[F.coalesce(c, F.lit(float("nan"))).alias(c) for c in rows.columns if c != "user_name"])


def links_of(adjacency: DataFrame) -> DataFrame:
    """Distinct links (src, dst) of an adjacency table, without self-links."""
    return adjacency.select(F.col("user_name").alias("src"), F.explode("nbrs").alias("dst")).where("src <> dst AND dst <> ''").distinct()


def directed(out: DataFrame) -> DataFrame:
    """(l, h, lh, hl) for each pair of linked users, from distinct links (src, dst):
    l = (edges, user) is the end with fewer edges, lh and hl tell which links there
    are. No user has more than about sqrt(2 E) edges that lead away from it."""
    both = out.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    edges = both.groupBy("a", "b").agg(F.bool_or("up").alias("ab"), F.bool_or(~F.col("up")).alias("ba"))
    ends = edges.select(F.col("a").alias("u")).unionByName(edges.select(F.col("b").alias("u")))
    degree = ends.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    known = edges.join(degree.select(F.col("u").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("u").alias("b"), F.col("d").alias("db")), "b")
    rank = lambda d, u: F.struct(F.col(d).alias("d"), F.col(u).alias("u"))
    first = rank("da", "a") < rank("db", "b")
    low, high = F.when(first, rank("da", "a")).otherwise(rank("db", "b")), F.when(first, rank("db", "b")).otherwise(rank("da", "a"))
    return known.select(low.alias("l"), high.alias("h"), F.when(first, F.col("ab")).otherwise(F.col("ba")).alias("lh"), F.when(first, F.col("ba")).otherwise(F.col("ab")).alias("hl"))


def triangles(out: DataFrame) -> DataFrame:
    """(center, x, z) for links center -> x, x -> z and center -> z, from distinct
    links (src, dst). A triangle is found once, from its user with the fewest edges,
    so that a hub makes no list of all pairs of its neighbours."""
    led = stage(directed(out), "led")
    one = led.select(F.col("l.u").alias("p"), F.col("h").alias("q"), F.col("lh").alias("pq"), F.col("hl").alias("qp"))
    two = led.select(F.col("l.u").alias("p"), F.col("h").alias("r"), F.col("lh").alias("pr"), F.col("hl").alias("rp"))
    wedge = one.join(two, "p").where("q < r").select("p", F.col("q.u").alias("q"), F.col("r.u").alias("r"), "pq", "qp", "pr", "rp")
    closing = led.select(F.col("l.u").alias("q"), F.col("h.u").alias("r"), F.col("lh").alias("qr"), F.col("hl").alias("rq"))
    closed = wedge.join(closing, ["q", "r"])
    ways = [F.when(F.col(c + x) & F.col(x + z) & F.col(c + z), F.struct(F.col(c).alias("center"), F.col(x).alias("x"), F.col(z).alias("z"))) for c, x, z in permutations("pqr")]
    return closed.select(F.explode(F.filter(F.array(*ways), lambda t: t.isNotNull())).alias("t")).select("t.*")


def ego_links(adjacency: DataFrame) -> DataFrame:
    """(center, src, dst) of each user's ego network, from out-adjacency: links to
    neighbours that have a row of their own, their links back, and their links to
    other neighbours of the center."""
    own = adjacency.select(F.col("user_name").alias("x")).distinct()
    out = stage(links_of(adjacency), "out")
    star = out.select(F.col("src").alias("center"), F.col("dst").alias("x")).join(own, "x", "left_semi")
    back = out.select(F.col("src").alias("center"), F.col("dst").alias("x")).join(out.select(F.col("dst").alias("center"), F.col("src").alias("x")), ["center", "x"], "left_semi")
    parts = [star.select("center", F.col("center").alias("src"), F.col("x").alias("dst"))]
    parts.append(back.select("center", F.col("x").alias("src"), F.col("center").alias("dst")))
    parts.append(triangles(out).select("center", F.col("x").alias("src"), F.col("z").alias("dst")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@settled("egos")
def ego_stats(adjacency: DataFrame, direction: str = "out") -> DataFrame:
    """Of each ego network with a link: the number of sources and the mean and
    variance of links of each, and the same of destinations. ``adjacency`` holds
    neighbours of that direction; with "in" the network is the mirror image."""
    if direction not in ("out", "in"):
        raise ValueError(f"direction is {direction!r}")
    links = stage(ego_links(adjacency), "ego")
    if direction == "in":
        links = links.select("center", F.col("dst").alias("src"), F.col("src").alias("dst"))

    def side(end: str) -> DataFrame:
        each = links.groupBy("center", end).agg(F.count(F.lit(1)).alias("k"))
        sums = each.groupBy("center").agg(F.count(F.lit(1)).alias("c"), F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
        mean, var = _mean_and_variance("c", "s", "q")
        return sums.select("center", F.col("c").alias(f"n_{end}"), mean.alias(f"{end}_mean"), var.alias(f"{end}_var"))

    return side("src").join(side("dst"), "center").withColumnRenamed("center", "user_name")


def ego_dump(adjacency: DataFrame) -> DataFrame:
    """(node, tag, place, line): the rows that meet at each node, its own (tag 0)
    before those of which it is a neighbour (tag 1)."""
    line = F.concat_ws("\t", "user_name", F.col("n").cast("string"), F.array_join("nbrs", "\t"))
    line = F.when(F.col("n") == 0, F.concat_ws("\t", "user_name", F.lit("0"))).otherwise(line)
    rows = adjacency.select("user_name", "nbrs", line.alias("line"))
    own = rows.select(F.col("user_name").alias("node"), F.lit(0).alias("tag"), "line")
    other = rows.select(F.explode("nbrs").alias("node"), F.lit(1).alias("tag"), "line").where("node <> ''")
    both = own.unionByName(other)
    return both.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("tag", "line")).cast("bigint")).select("node", F.col("tag").cast("bigint").alias("tag"), "place", F.concat_ws(" ", F.col("tag").cast("string"), "line").alias("line"))
